"""Packing documents into token sequences by cutting-stock column generation.

Each document's ids, with an end id, are cut into pieces of `size` and a rest.  The histogram of
rest lengths is all that planning sees, `size` numbers at most whatever the corpus.  A linear
program over patterns, multisets of lengths that fill a sequence exactly, covers as many
tokens as possible: it starts from patterns built greedily, and a knapsack over the dual prices of
the lengths finds the next pattern to enter.  Patterns are rounded down, what that leaves is
patterned once more in whole numbers, and pieces that no pattern takes are laid end to end and
cut where a sequence is full.  So no token is padding; the last sequences have powers of two as lengths.

Pieces of one length are ranked by counts per written part and handed to the patterns by
arithmetic: after encoding no ids are shuffled while the parts' counts can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.llm import encoding
from fernlake.llm import textkernel as tk
from fernlake.plans.scratch import Scratch

SIZE = 1024


@dataclass
class Pattern:
    """`count` sequences with pieces[k] pieces of length lengths[k] each."""

    lengths: list[int]
    pieces: list[int]
    count: int


@dataclass
class Plan:
    size: int
    patterns: list[Pattern] = field(default_factory=list)
    rest: dict[int, int] = field(default_factory=dict)

    def covered(self) -> int:
        return self.size * sum(p.count for p in self.patterns)


def cheapest_fill(price: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the least price of pieces that sum to each total, and a piece of such a filling; price[0] is unused."""
    best = np.full(total + 1, np.inf)
    best[0] = 0.0
    pick = np.zeros(total + 1, np.int64)
    for c in range(1, total + 1):
        cost = price[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(cost.argmin())
        best[c], pick[c] = cost[k], k + 1
    return best, pick


def _unwind(pick: np.ndarray, total: int) -> list[int]:
    out = []
    while total:
        out.append(int(pick[total]))
        total -= out[-1]
    return out


def _companions(there: np.ndarray, first: int, size: int) -> list[int] | None:
    """Lengths that fill a sequence with one of `first`, few and long ones before others; None if there are none."""
    gap = size - first
    if not gap or there[gap]:
        return [first, gap] if gap else [first]
    some = np.flatnonzero(there[: gap + 1])
    pair = some[there[gap - some]]
    if len(pair):
        return [first, int(pair[-1]), gap - int(pair[-1])]
    best, pick = cheapest_fill(np.where(there[: gap + 1], 1.0, np.inf), gap)
    return [first, *_unwind(pick, gap)] if np.isfinite(best[gap]) else None


def _greedy(left: np.ndarray, size: int, whole: bool):
    """Patterns from the longest length down, each until one of its lengths runs out: (that length, lengths, pieces, count)."""
    left, out = left.astype(float), []
    low = 1.0 if whole else 1e-9
    stuck = np.zeros(size + 1, bool)
    while len(live := np.flatnonzero((left[:size] >= low) & ~stuck[:size])):
        first = int(live[-1])
        got = _companions(left >= low, first, size)
        if got is not None:
            lengths, pieces = np.unique(got, return_counts=True)
            ratio = left[lengths] / pieces
            count = np.floor(ratio.min()) if whole else ratio.min()
        if got is None or count <= 0:
            stuck[first] = True
            continue
        end = int(lengths[ratio.argmin()])
        left[lengths] -= count * pieces
        if not whole:
            left[end] = 0.0
        out.append((end, lengths, pieces, count))
    return out, left


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Product with a vector of few entries; without BLAS, whose threads may hang in a driver that forks."""
    some = np.flatnonzero(vector)
    return np.einsum("ij,j->i", matrix[:, some], vector[some])


def plan(histogram: dict[int, int], size: int = SIZE, max_pivots: int = 400, gap: float = 0.002) -> Plan:
    """Patterns and the pieces left over, for numbers of pieces by length 1..size.

    The program is max sum of size * x over patterns, with no length used beyond its number.  It
    stops when all but `gap` of the tokens are covered, when the knapsack finds no pattern worth
    more than its prices, or after `max_pivots` steps; any step's solution is a valid packing.
    """
    have = np.zeros(size + 1)
    for length, n in histogram.items():
        have[length] = n
    out = Plan(size)
    if have[size]:
        out.patterns.append(Pattern([size], [1], int(have[size])))
    have[size] = 0
    lengths = np.flatnonzero(have)
    if not len(lengths):
        return out
    m, total = len(lengths), float((lengths * have[lengths]).sum())
    at = np.zeros(size + 1, np.int64)
    at[lengths] = np.arange(m)
    inverse, value, column = np.eye(m), np.zeros(m), [None] * m

    def enter(i: int, new: np.ndarray, step: np.ndarray, worth: float) -> None:
        """The pattern `new` takes the place of the i-th of the basis."""
        row = inverse[i] / step[i]
        rows, cols = np.flatnonzero(step), np.flatnonzero(row)
        inverse[np.ix_(rows, cols)] -= np.multiply.outer(step[rows], row[cols])
        inverse[i] = row
        value[i], column[i] = worth, new if worth else None

    # each greedy pattern uses up one length and none used up before it, so they can enter one by one
    for end, used, pieces, _ in _greedy(have, size, False)[0]:
        new = np.zeros(m)
        new[at[used]] = pieces
        enter(at[end], new, _times(inverse, new), size)
    x = np.maximum(_times(inverse, have[lengths]), 0.0)
    for _ in range(max_pivots):
        if (value * x).sum() > (1 - gap) * total:
            break
        dual = np.einsum("i,ij->j", value, inverse)
        k = int(dual.argmin())
        price = np.full(size + 1, np.inf)
        price[lengths] = np.maximum(dual, 0.0)
        best, pick = cheapest_fill(price, size)
        gain = size - best[size]
        if max(gain, -dual[k]) < 1e-6 * size:
            break
        new, worth = np.zeros(m), 0.0
        if -dual[k] > gain:
            new[k] = 1.0  # some of a length goes unused
        else:
            np.add.at(new, at[_unwind(pick, size)], 1.0)
            worth = float(size)
        step = _times(inverse, new)
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        if not up.any():
            break
        ratio[up] = x[up] / step[up]
        i = int(ratio.argmin())
        x = np.maximum(x - ratio[i] * step, 0.0)
        x[i] = ratio[i]
        enter(i, new, step, worth)
    left = have.copy()
    for k in range(m):
        if column[k] is None:
            continue
        used = np.flatnonzero(column[k])
        n = int(min(np.floor(x[k] + 1e-6), (left[lengths[used]] // column[k][used]).min()))
        if n > 0:
            left[lengths[used]] -= n * column[k][used]
            out.patterns.append(Pattern(lengths[used].tolist(), column[k][used].astype(int).tolist(), n))
    more, left = _greedy(left, size, True)
    out.patterns += [Pattern(used.tolist(), pieces.tolist(), int(n)) for _, used, pieces, n in more]
    out.rest = {int(n): int(left[n]) for n in np.flatnonzero(left)[::-1]}
    return out


def _powers(n: int) -> list[int]:
    """n as a sum of distinct powers of two, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def encoded_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, nth, start, length, doc_tokens, ids) of each piece; ids are little-endian 32-bit numbers.

    `nth` counts the pieces of this length before it in the same part, which is one task's output.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        own = encoding.encoder(vocabulary)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        names = ["id", "part", "nth", "start", "length", "doc_tokens", "ids"]
        for batch in batches:
            for rows in tk.slices(batch, "text"):
                who, start, length, nth, doc_tokens, ids = [], [], [], [], [], []
                for k, text in enumerate(rows.column(1)):
                    got = np.append(own.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(got), size):
                        one = got[s : s + size]
                        who.append(k)
                        start.append(s)
                        length.append(len(one))
                        nth.append(seen[len(one)])
                        doc_tokens.append(len(got))
                        ids.append(one.tobytes())
                        seen[len(one)] += 1
                columns = [rows.column(0).take(pa.array(who, pa.int64())), pa.array([part] * len(who), pa.int64())]
                columns += [pa.array(v, pa.int64()) for v in (nth, start, length, doc_tokens)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=names)

    tk.bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part long, nth long, start long, length long, doc_tokens long, ids binary")


def _allocation(made: Plan) -> tuple[list[tuple], int]:
    """(length, low, high, per, first, base) per length and pattern, and the number of patterned sequences.

    Pieces of the length with ranks low..high-1 go there: `per` to each sequence from `first` on,
    at `base` and behind.  What is left of a length has per 0, and `base` is its place among all that is left.
    """
    rows, taken, first = [], {}, 0
    for p in made.patterns:
        base = 0
        for length, per in sorted(zip(p.lengths, p.pieces, strict=True), reverse=True):
            low = taken.get(length, 0)
            taken[length] = low + per * p.count
            rows.append((length, low, taken[length], per, first, base))
            base += length * per
        first += p.count
    base = 0
    for length, n in made.rest.items():
        low = taken.get(length, 0)
        rows.append((length, low, low + n, 0, 0, base))
        base += length * n
    return rows, first


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_pivots: int = 400, broadcast_rows: int = 500_000) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of each piece of each document.

    `start` counts the document's ids before the piece, `offset` those of the sequence.  Null and
    empty texts have the end id alone; rows that repeat an id, or have none, are packed one by one.  Other
    columns are not carried.  An empty table gives an empty result.  `vocabulary` is the path of a
    tokenizer file that executors can read (default: the supplied one).
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size is a power of two")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    path = scratch.path("pieces")
    made = encoded_pieces(docs, vocabulary or encoding.vocabulary_path(), size, end_id, id_col, text_col)
    made.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(made.schema).parquet(path)
    counts = scratch.keep(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts", last=True)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    done = plan(histogram, size, max_pivots)
    rows, n_patterned = _allocation(done)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    key = F.col("part") * (size + 1) + F.col("length")
    earlier = counts.select(key.alias("key"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    if counts.count() <= broadcast_rows:
        earlier = F.broadcast(earlier)
    ranked = pieces.withColumn("key", key).join(earlier, "key").withColumn("rank", F.col("earlier") + F.col("nth"))
    places = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("at_length", "low", "high", "per", "first", "base"))}))
    here = (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(places), here)  # patterns are `size` twice at most, of few lengths each

    nth = F.col("rank") - F.col("low")
    segment = lambda a, n, s, o: F.struct(a.cast("long").alias("from"), n.cast("long").alias("n"), s.cast("long").alias("sequence_id"), o.cast("long").alias("offset"))
    whole = F.array(segment(F.lit(0), F.col("length"), F.expr("first + (rank - low) div greatest(per, 1)"), F.expr("base + (rank - low) % greatest(per, 1) * length")))
    # what is left lies on one line; full sequences are cut from it, then powers of two
    line = sum(n * c for n, c in done.rest.items())
    full = line // size
    ends, stop = [], full * size
    for k, p in enumerate(_powers(line - stop)):
        ends.append((stop, stop + p, n_patterned + full + k))
        stop += p
    low, high = F.col("base") + nth * F.col("length"), F.col("base") + (nth + 1) * F.col("length")

    def cut(start, end, sequence):
        a, b = F.greatest(low, start), F.least(high, end)
        return segment(a - low, b - a, sequence, a - start)

    blocks = F.sequence(F.floor(low / size).cast("long"), F.floor((high - 1) / size).cast("long"))
    cuts = F.transform(F.filter(blocks, lambda b: b < full), lambda b: cut(b * size, (b + 1) * size, b + n_patterned))
    if ends:
        tails = F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(e, ("start", "end", "sequence"), strict=True))) for e in ends))
        tails = F.filter(tails, lambda e: (e["start"] < high) & (e["end"] > low))
        cuts = F.concat(cuts, F.transform(tails, lambda e: cut(e["start"], e["end"], e["sequence"])))
    out = placed.select("id", "start", "ids", "doc_tokens", F.inline(F.when(F.col("per") > 0, whole).otherwise(cuts)))
    ids = F.when(F.col("n") * 4 == F.length("ids"), F.col("ids")).otherwise(F.substring(F.col("ids"), (F.col("from") * 4 + 1).cast("int"), (F.col("n") * 4).cast("int")))
    return out.select(F.col("id").alias(id_col), (F.col("start") + F.col("from")).alias("start"), F.col("n").alias("length"), ids.alias("ids"), "doc_tokens", "sequence_id", "offset")


def sequences(packed: DataFrame, id_col: str = "doc_id", size: int = SIZE) -> DataFrame:
    """(sequence_id, ids, length, spans) of each sequence, its ids padded with 0 to `size` unless their number is a power of two.

    `spans` lists (offset, length, id, start) of its pieces, from which attention and position ids are made.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(id_col).alias("id"), "start", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.expr("cast('' as binary)"), lambda a, x: F.concat(a, x["ids"]))
    pad = F.when(F.bit_count("length") == 1, F.lit(0)).otherwise(size - F.col("length"))
    zero = F.unhex(F.repeat(F.lit("00000000"), pad.cast("int")))
    spans = F.transform("parts", lambda x: F.struct(x["offset"], x["length"], x["id"], x["start"]))
    return rows.select("sequence_id", F.concat(joined, zero).alias("ids"), "length", spans.alias("spans"))
