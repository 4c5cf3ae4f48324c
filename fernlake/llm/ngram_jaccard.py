"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles (64-bit hashes of whole lower-cased texts).
Two documents link when ``den * |A and B| >= num * |A or B|``; documents are then grouped into
the connected components of these links.

Candidates.  Let ``o = ceil(num * n / den)`` for a set of n tokens.  All sets are put in one
global order: tokens outside the frequent class by hash, then frequent tokens by hash.  A linked
pair shares a token among the first ``n - o + 1`` of each (prefix filter).  Rare tokens of that
prefix are indexed alone.  A document whose prefix reaches the frequent class extends its prefix
by m tokens; a pair that shares no rare prefix token then shares m + 1 frequent ones, so of m
token classes at least one holds two shared tokens, and all 2-token combinations within each
class are indexed.  m follows the power-of-two level of n; a document just above a level's bound
is indexed on the level below as well.  The frequent class only orders tokens, so its contents
(the most common prefix tokens, at most ``max_frequent``) never change the result.

Verification.  Equal sets are collapsed first.  In each index bucket the most central document
is compared with the others (a star, linear in the bucket); after the components of these links
are known, only pairs of different components that pass the size bound and an exact bound from a
parity sketch (set bits of the xor never exceed the symmetric difference) are compared.  All
links are decided on the whole shingle sets.  Buckets over ``cell`` rows are split into cells.

Skew.  A large group of copies fills one index key, one leader or one class with its rows.  What
a key needs (its count, leader, span of components) is aggregated map-side and then joined back
as a table of one row per key; both sides of such a join are shuffled for it alone, so adaptive
execution splits a hot key's rows.  No window runs over a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.llm import textkernel as tk
from fernlake.operators.components import components
from fernlake.plans.scratch import Scratch
from fernlake.plans.skew import dealt_anew

SKETCH = [f"s{i}" for i in range(8)]
_A, _B, _C = tk.U(0x9E3779B185EBCA87), tk.U(0xC2B2AE3D27D4EB4F), tk.U(0x165667B19E3779F9)


def _sets(batch: pa.RecordBatch, size: int):
    """(row, sorted distinct shingle hashes) of each text of a batch with columns id, text."""
    row = 0
    for part in tk.slices(batch, "text"):
        sh, at = tk.shingle_hashes(tk.words(part.column(1)), size)
        for i in range(part.num_rows):
            yield row, np.unique(sh[at[i] : at[i + 1]])
            row += 1


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _meta(size: int, num: int, den: int):
    """Size, 128-bit class, parity sketches and prefix tokens of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            prefix = [np.zeros(0, tk.U)] * batch.num_rows
            hi, lo = np.zeros(batch.num_rows, tk.U), np.zeros(batch.num_rows, tk.U)
            sketch = np.zeros((batch.num_rows, 8), tk.U)
            wide: list[bytes | None] = [None] * batch.num_rows
            for i, s in _sets(batch, size):
                n[i] = len(s)
                hi[i], lo[i] = (s * _A).sum(), tk.mix(s ^ _B).sum()
                if len(s):
                    prefix[i] = s[: _prefix(len(s), num, den)]
                size_2 = max(512, 1 << (len(s) - 1).bit_length()) if len(s) else 512
                bits = (np.bincount((s & tk.U(size_2 - 1)).astype(np.int64), minlength=size_2) & 1).astype(np.uint8)
                if size_2 > 512:
                    wide[i] = np.packbits(bits).tobytes()
                    bits = np.bitwise_xor.reduce(bits.reshape(-1, 512), axis=0)
                sketch[i] = np.packbits(bits).view(tk.U)
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(at), tk.signed(np.concatenate(prefix) if prefix else np.zeros(0, tk.U)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), tk.signed(hi), tk.signed(lo), *(tk.signed(sketch[:, k]) for k in range(8)), pa.array(wide, pa.binary()), tokens],
                names=["id", "n", "hi", "lo", *SKETCH, "wide", "prefix"],
            )

    return run


def index_keys(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of one sorted token set: rare prefix tokens, and combinations of frequent ones."""
    n = len(s)
    p = _prefix(n, num, den)
    if not len(frequent):
        return s[:p]

    def common(x: np.ndarray) -> np.ndarray:
        return frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x

    if not common(s[:p]).any():
        return s[:p]
    hot = common(s)
    rare, freq = s[~hot], s[hot]
    if len(rare) >= p:
        return rare[:p]
    keys = [rare]
    top = n.bit_length() - 1
    levels = [top] + ([top - 1] if top and num * n <= den << top else [])
    for level in levels:
        m = max(1, (1 << level) // 8) if level else 0
        part = freq[: max(0, p + m - len(rare))]
        salt = tk.U((level + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        if not m:
            keys.append(tk.mix(part * _A + salt))
            continue
        cls = ((tk.mix(part ^ _C) >> tk.U(20)) % tk.U(m)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        part, cls = part[order], cls[order]
        d = 1
        at = np.flatnonzero(cls[:-1] == cls[1:])
        while len(at):
            keys.append(tk.mix(part[at] * _A + part[at + d] * _B + salt))
            d += 1
            at = at[at + d < len(cls)]
            at = at[cls[at] == cls[at + d]]
    return np.unique(np.concatenate(keys))


def _entries(size: int, num: int, den: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]):
        hot = frequent.value
        for batch in batches:
            ids = batch.column(0)
            keys, rows = [], []
            for i, s in _sets(batch, size):
                if len(s) and ids[i].is_valid:
                    keys.append(index_keys(s, hot, num, den))
                    rows.append(np.full(len(keys[-1]), i))
            if keys:
                yield pa.RecordBatch.from_arrays([tk.signed(np.concatenate(keys)), ids.take(pa.array(np.concatenate(rows)))], names=["key", "id"])

    return run


def _verify(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]):
        kept: tuple = (None, None)
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ok = np.zeros(batch.num_rows, bool)
            right = dict(_sets(pa.RecordBatch.from_arrays([b, batch.column(3)], names=["id", "text"]), size))
            for i in range(batch.num_rows):
                if kept[0] != a[i] or i == 0:
                    one = pa.RecordBatch.from_arrays([a.slice(i, 1), batch.column(2).slice(i, 1)], names=["id", "text"])
                    kept = (a[i], next(_sets(one, size))[1])
                x, y = kept[1], right[i]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _narrow(num: int, den: int):
    """Drop pairs by the parity bound on their wide sketches; a sketch folds to half its bits by xor."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = np.ones(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                if x.is_valid and y.is_valid:
                    p, q = np.frombuffer(x.as_py(), tk.U), np.frombuffer(y.as_py(), tk.U)
                    least = min(len(p), len(q))
                    p, q = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (p, q))
                    ok[i] = int(np.bitwise_count(p ^ q).sum()) * (den + num) <= (den - num) * int(na[i] + nb[i])
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _cross(num: int, den: int):
    """Pairs of a bucket that lie in different components and may link; rows are sorted by key."""

    def pairs(t: dict) -> Iterator[pa.RecordBatch]:
        key, n, sk = t["key"], t["n"], t["sketch"]
        d = 1
        at = np.flatnonzero(key[:-1] == key[1:])
        while len(at):
            i, j = at, at + d
            ok = (t["comp"][i] != t["comp"][j]) & ((t["block"][i] != t["block"][j]) | t["diagonal"][i])
            i, j = i[ok], j[ok]
            ok = num * np.maximum(n[i], n[j]) <= den * np.minimum(n[i], n[j])
            i, j = i[ok], j[ok]
            if len(i):
                diff = np.bitwise_count(sk[i] ^ sk[j]).sum(axis=1).astype(np.int64)
                ok = diff * (den + num) <= (den - num) * (n[i] + n[j])
                i, j = i[ok], j[ok]
            if len(i):
                x, y = t["rep"][i], t["rep"][j]
                found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
            d += 1
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]

    def run(batches: Iterator[pa.RecordBatch]):
        names = ["key", "rep", "n", "comp", "block", "diagonal"]
        carry: dict = {}
        for batch in batches:
            t = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
            t["sketch"] = np.stack([batch.column(len(names) + k).to_numpy() for k in range(8)], axis=1).view(tk.U)
            if carry:
                t = {c: np.concatenate([carry[c], t[c]]) for c in t}
            if not len(t["key"]):
                continue
            cut = int(np.argmax(t["key"] == t["key"][-1]))
            yield from pairs({c: v[:cut] for c, v in t.items()})
            carry = {c: v[cut:] for c, v in t.items()}
        if carry:
            yield from pairs(carry)

    return run


def _may_link(num: int, den: int, x: str, y: str):
    """Size bound and parity bound as a column."""
    diff = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))).cast("long") for s in SKETCH), F.lit(0))
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (num * F.greatest(nx, ny) <= den * F.least(nx, ny)) & (diff * (den + num) <= (den - num) * (nx + ny))


def jaccard_components(
    docs: DataFrame,
    size: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent_over: int = 64,
    max_frequent: int = 1 << 20,
    broadcast_ids: int = 1 << 20,
    cell: int = 1024,
) -> DataFrame:
    """(id, n_shingles, component_id) per input row; component_id is the smallest id reachable.

    Null and wordless texts have no shingles and link with nothing.  A row with a null id keeps
    its n_shingles and has a null component_id.  Rows that share an id are one node.  Other
    columns are ignored.  An empty table gives an empty result.  ``num / den`` is above 1/2.
    Ids are long integers.
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold must be over 0.5 and at most 1")
    spark = docs.sparkSession
    tk.bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(spark)

    longs = ", ".join(f"{s} long" for s in SKETCH)
    schema = f"id long, n long, hi long, lo long, {longs}, wide binary, prefix array<long>"
    meta = scratch.keep(rows.mapInArrow(_meta(size, num, den), schema), "meta")
    known = meta.where("id is not null and n > 0")
    cls = ["n", "hi", "lo"]
    # joined by id as well, so that the copies of one text do not meet
    least = known.groupBy(*cls).agg(F.min("id").alias("id"))
    reps = known.join(least, ["id", *cls]).select(F.col("id").alias("rep"), *cls, *SKETCH, "wide").dropDuplicates(["rep", *cls])
    reps = scratch.keep(reps, "reps")

    # the frequent class: the most common prefix tokens, at most max_frequent of them (8 bytes each)
    counted = meta.select(F.explode("prefix").alias("token")).groupBy("token").count().where(F.col("count") > frequent_over)
    top = counted.orderBy(F.desc("count"), "token").limit(max_frequent).select("token").toPandas()["token"]
    frequent = spark.sparkContext.broadcast(np.sort(top.to_numpy(np.int64).view(tk.U)))

    entries = scratch.keep(rows.mapInArrow(_entries(size, num, den, frequent), "key long, id long"), "entries")
    frequent.destroy()
    shared = dealt_anew(entries.groupBy("key").count().where("count > 1").select("key"), "key")
    named = entries.join(shared, "key").select("key", F.col("id").alias("rep")).join(reps.select("rep", "n"), "rep")
    share = F.count(F.lit(1)).over(Window.partitionBy("rep")) / F.col("n")
    index = scratch.keep(named.select("key", "rep", share.alias("share")), "index")
    scratch.drop(entries)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        # long sets need a sketch of about a bit for each token; it decides before any text moves
        side = lambda c: reps.select(F.col("rep").alias(c), F.struct("n", *SKETCH).alias(f"{c}_"), F.col("wide").alias(f"w{c}"))
        pairs = pairs.join(side("b"), "b").join(side("a"), "a").where(_may_link(num, den, "a_", "b_"))
        pairs = pairs.select("a", "b", F.col("a_.n").alias("na"), F.col("b_.n").alias("nb"), "wa", "wb")
        pairs = scratch.keep(pairs.mapInArrow(_narrow(num, den), "a long, b long"), f"{name}-pairs")
        ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
        few = ids.count() <= broadcast_ids
        texts = scratch.keep(rows.join(F.broadcast(ids) if few else ids, "id", "left_semi"), f"{name}-texts")
        left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        found = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
        out = scratch.keep(found.mapInArrow(_verify(size, num, den), "a long, b long"), f"{name}-links")
        for t in (pairs, ids, texts):
            scratch.drop(t)
        return out

    # each bucket's most central document against the others
    lead = index.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("share", (-F.col("rep")).alias("r"))).alias("best")).where("c > 1")
    lead = dealt_anew(lead.select("key", (-F.col("best.r")).alias("lead")), "key")
    star = index.join(lead, "key").where("lead != rep").select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()
    first = links(star, "star")
    comp = components(first).withColumnsRenamed({"node": "rep", "component": "comp"})

    # what is left: pairs of one bucket in different components
    placed = scratch.keep(index.select("key", "rep").join(comp, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp")), "placed")
    scratch.drop(index)
    spans = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).where("low != high")
    spans = dealt_anew(spans.select("key", F.ceil(F.col("c") / cell).cast("int").alias("blocks")), "key")
    rest = placed.join(spans, "key").join(reps.select("rep", "n", *SKETCH), "rep")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rest = rest.withColumn("key", F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)))
    rest = rest.select("key", "rep", "n", "comp", "block", (F.col("block") == F.col("other")).alias("diagonal"), *SKETCH)
    # a split bucket's rows of one cell: (i, i) compares within block i, (i, j) across both
    cells = rest.repartition("key").sortWithinPartitions("key", "block")
    second = links(cells.mapInArrow(_cross(num, den), "a long, b long").distinct(), "rest")

    # ids that name several texts join their classes
    several = known.groupBy("id").agg(F.min(F.struct(*cls)).alias("a"), F.max(F.struct(*cls)).alias("z")).where("a != z").select("id")
    class_of = reps.select("rep", *cls)
    same = known.select("id", *cls).join(several, "id").join(class_of, cls).select("id", "rep")
    same = same.join(same.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b"))

    # the later links join components of the first ones
    extra = scratch.keep(second.union(same).where("a != b"), "extra")
    final = class_of.join(comp, "rep", "left").withColumn("least", F.coalesce("comp", "rep"))
    if not extra.isEmpty():
        for end in ("a", "b"):
            of = comp.withColumnRenamed("rep", end)
            extra = extra.join(of, end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
        joined = components(extra).withColumnsRenamed({"node": "least", "component": "lower"})
        final = final.join(joined, "least", "left").withColumn("least", F.coalesce("lower", "least"))
    final = dealt_anew(final.select(*cls, "least"), *cls)
    out = meta.select("id", *cls).join(final, cls, "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
    out = scratch.keep(out, "result", last=True)
    scratch.close()
    return out


def keep_one(docs: DataFrame, broadcast_ids: int = 1 << 20, **options) -> DataFrame:
    """The documents with one of each component kept: the one with the smallest id.

    Rows with a null id, which link with nothing, all stay; of rows that repeat a kept id, all stay.
    """
    key = options.get("id_col", "doc_id")
    found = jaccard_components(docs, broadcast_ids=broadcast_ids, **options).where(f"{key} is not null and {key} != component_id").select(key).distinct()
    few = found.count() <= broadcast_ids
    return docs.join(F.broadcast(found) if few else found, key, "left_anti")
