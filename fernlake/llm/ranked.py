"""Ranked lexical search by the best position algorithm over impact lists.

One pass counts, in each text, all its terms and those that the queries hold; sums over documents
give the weights.  The postings then lie in partitions as they were written.  Each task cuts its own into shards of
a bounded number of postings, sorts a shard's lists by impact, and answers every query on it: lists are read in
rounds, each new document is looked up in all lists at once (direct access), and each list
keeps its best position, up to which all places were seen, whether by reading or by access.
Impacts at the best positions sum to a bound on every document unseen; a query stops when its k-th
score is strictly above it.  Scores of earlier shards count for the k-th score.  A task gives out k rows
a query, so that only these are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.llm import textkernel as tk
from fernlake.plans.scratch import Scratch

#: Bytes that separate terms: ASCII but digits and letters.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Queries:
    """Terms of a block of queries: distinct term hashes, ascending, and each query's slots among them with their repeats."""

    items: list
    terms: np.ndarray
    slots: list[np.ndarray]
    repeats: list[np.ndarray]


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in tk.slices(batch, "text"):
            w = tk.words(one.column(1), SEPARATORS)
            got = [np.unique(w.hash[w.at[k] : w.at[k + 1]], return_counts=True) for k in range(one.num_rows)]
            terms = pa.array([t.view(np.int64) for t, _ in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([one.column(0), terms, pa.array([c for _, c in got], pa.list_(pa.int64()))], names=["item", "terms", "repeats"])


def query_blocks(queries: DataFrame, scratch: Scratch, id_col: str, text_col: str, max_terms: int) -> Iterator[tuple[Queries, pa.DataType]]:
    """The queries in blocks of at most `max_terms` terms together; a query with more is a block by itself."""
    kind = queries.schema[id_col].dataType.simpleString()
    rows = queries.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.keep(rows.mapInArrow(_query_terms, f"item {kind}, terms array<long>, repeats array<long>").where(F.size("terms") > 0), "queries")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-total // max_terms)
    while parts > 1:
        block = F.pmod(F.xxhash64("item", "terms"), F.lit(parts))
        worst = rows.groupBy(block.alias("b")).agg(F.sum(F.size("terms")).alias("t"), F.count_distinct("item", "terms").alias("n")).where(f"t > {max_terms} and n > 1")
        if worst.limit(1).isEmpty():
            break
        parts *= 2
    for b in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "terms"), F.lit(parts)) == b)
        got = mine.toArrow()
        if not got.num_rows:
            continue
        terms = np.unique(np.array(got.column("terms").combine_chunks().flatten(), np.int64).view(np.uint64))
        each = [np.array(t.as_py(), np.int64).view(np.uint64) for t in got.column("terms")]
        repeats = [np.array(c.as_py(), np.int64) for c in got.column("repeats")]
        yield Queries(got.column("item").to_pylist(), terms, [np.searchsorted(terms, t) for t in each], repeats), got.schema.field("item").type


def _postings(terms):
    def run(batches: Iterator[pa.RecordBatch]):
        known = terms.value
        for batch in batches:
            for one in tk.slices(batch, "text"):
                w = tk.words(one.column(1), SEPARATORS)
                owner = np.repeat(np.arange(one.num_rows), np.diff(w.at))
                slot = np.searchsorted(known, w.hash)
                hit = known[np.minimum(slot, len(known) - 1)] == w.hash
                pair, tf = np.unique(owner[hit] * len(known) + slot[hit], return_counts=True)
                doc, slot = pair // len(known), (pair % len(known)).astype(np.int32)
                at = np.searchsorted(doc, np.arange(one.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (slot, tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array(np.diff(w.at).astype(np.int64)), *lists], names=["doc", "n", "slots", "tfs"])

    return run


class Shard:
    """Impact lists of some documents, sorted within each term, with direct access by document."""

    def __init__(self, weights: np.ndarray, m: np.ndarray, doc: np.ndarray, slot: np.ndarray, tf: np.ndarray):
        self.slot = slot
        self.impact = weights[slot] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        self.row = np.searchsorted(doc, np.arange(len(m) + 1))
        order = np.lexsort((-self.impact, slot))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_at = np.searchsorted(slot[order], np.arange(len(weights) + 1))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - self.list_at[slot[order]]

    def top(self, slots: np.ndarray, repeats: np.ndarray, k: int, floor: int, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold all documents of this shard whose scores are `floor` or more and among the k best.

        Rounds read `first` places of each list, then twice as many.
        """
        size = self.list_at[slots + 1] - self.list_at[slots]
        used = size > 0
        slots, repeats, size = slots[used], repeats[used], size[used]
        begin = self.list_at[slots]
        local = np.full(len(self.list_at), -1, np.int64)
        local[slots] = np.arange(len(slots))
        off = np.append(0, np.cumsum(size))
        seen = np.zeros(off[-1], bool)
        best = np.zeros(len(slots), np.int64)
        known = np.zeros(len(self.row) - 1, bool)
        docs, scores = [], []
        kth, found, depth, step = floor, 0, 0, first
        while len(slots) and depth < size.max():
            reads = [self.list_doc[b + depth : b + min(depth + step, n)] for b, n in zip(begin, size, strict=True) if depth < n]
            depth, step = depth + step, 2 * step
            new = np.unique(np.concatenate(reads))
            new = new[~known[new]]
            if len(new):
                known[new] = True
                n = self.row[new + 1] - self.row[new]
                at = np.repeat(self.row[new] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
                who, where = np.repeat(np.arange(len(new)), n), local[self.slot[at]]
                mine = where >= 0
                at, who, where = at[mine], who[mine], where[mine]
                score = np.zeros(len(new), np.int64)
                np.add.at(score, who, repeats[where] * self.impact[at])
                seen[off[where] + self.place[at]] = True
                docs.append(new)
                scores.append(score)
                found += len(new)
                if found >= k:
                    every = np.concatenate(scores)
                    kth = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]))
            bound = 0
            for i in range(len(slots)):
                if best[i] < size[i]:
                    rest = seen[off[i] + best[i] : off[i + 1]]
                    gap = int(rest.argmin())
                    best[i] += len(rest) if rest[gap] else gap
                if best[i] < size[i]:
                    bound += int(repeats[i]) * int(self.list_impact[begin[i] + max(best[i] - 1, 0)])
            if kth > bound:
                break
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = scores >= max(kth, 1)
        return docs[good], scores[good]


def _search(shared, n_docs: int, n_terms: int, k: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]):
        queries, weights, kind = shared.value
        top: list[list[tuple]] = [[] for _ in queries.items]
        held, count, doc_kind = [], 0, None

        def answer() -> None:
            ids = [x for b in held for x in b.column(0).to_pylist()]
            n, sizes, slot, tf = (
                np.concatenate([np.asarray(get(b)) for b in held])
                for get in (lambda b: b.column(1), lambda b: np.diff(b.column(2).offsets), lambda b: b.column(2).flatten(), lambda b: b.column(3).flatten())
            )
            m = 75 + (25 * n * n_docs) // n_terms
            shard = Shard(weights, m, np.repeat(np.arange(len(n)), sizes), slot, tf)
            for q, (slots, repeats) in enumerate(zip(queries.slots, queries.repeats, strict=True)):
                docs, scores = shard.top(slots, repeats, k, -top[q][-1][0] if len(top[q]) == k else 1)
                more = [(-s, ids[d] is None, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                top[q] = sorted(top[q] + more, key=lambda x: (x[0], True, 0) if x[1] else x)[:k]

        for batch in batches:
            doc_kind = batch.schema.field(0).type
            held.append(batch)
            count += len(batch.column(2).flatten())
            if count >= shard_postings:
                answer()
                held, count = [], 0
        if count:
            answer()
        if doc_kind is not None:
            rows = [(q, queries.items[q], x[2], -x[0]) for q, best in enumerate(top) for x in best]
            kinds = (pa.int64(), kind, doc_kind, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["query", "item", "doc", "score"])

    return run


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    max_terms: int = 1_000_000,
    shard_postings: int = 2_000_000,
    spread: int = 64,
) -> DataFrame:
    """(item, rank, doc, score): the k best documents of each query with scores above 0.

    Equal scores go by ascending document id, null ids last.  Each row of `queries` is a query, so
    ids that repeat are answered each; rows of `docs` that repeat are ranked each.  Null and empty texts have
    no terms.  Queries are taken in blocks of `max_terms` terms, with a pass over the documents each; a
    block's terms and weights are what is broadcast.  Terms are told apart by a 64-bit hash.  Columns beside id
    and text are not read.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    tk.bound_batches(spark)
    scratch = Scratch(spark)
    kinds = docs.schema[doc_col].dataType.simpleString(), queries.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block, item_kind in query_blocks(queries, scratch, item_col, text_col, max_terms):
        terms = spark.sparkContext.broadcast(block.terms)
        postings = scratch.keep(texts.mapInArrow(_postings(terms), f"doc {kinds[0]}, n long, slots array<int>, tfs array<long>"), "postings")
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.terms), np.int64)
        counts = postings.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row per term of the block
        df[np.asarray(counts.column("slot").combine_chunks())] = np.asarray(counts.column("df").combine_chunks())
        shared = spark.sparkContext.broadcast((block, weights_of(df, n_docs), item_kind))
        best = postings.select("doc", "n", "slots", "tfs").mapInArrow(_search(shared, n_docs, max(1, n_terms), k, shard_postings), f"query long, item {kinds[1]}, doc {kinds[0]}, score long")
        order = (F.desc("score"), F.asc_nulls_last("doc"))
        for keys in (["query", "part"], ["query"]):
            best = best.withColumn("part", F.pmod(F.xxhash64("doc", "score"), F.lit(spread))).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        best = scratch.keep(best.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_col), "score"), "best", last=True)
        found = best if found is None else found.union(best)
        scratch.drop(postings)
        terms.unpersist()
        shared.unpersist()
    scratch.close()
    if found is None:
        found = spark.range(0).select(F.lit(None).cast(kinds[1]).alias(item_col), F.lit(0).alias("rank"), F.lit(None).cast(kinds[0]).alias(doc_col), F.lit(0).cast("long").alias("score"))
    return found
