"""Inverted-file search beside the exact one: vectors in lists by their nearest of some learned centroids.

A query reads the lists whose centroids are nearest.  A list's members lie within an angle of its
centroid, which bounds their cosine with any query; the exact mode then reads every list whose
bound reaches the query's k-th score, so that nothing is lost and lists beyond reach stay unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.operators.retrieval import _first, _units
from fernlake.plans.scratch import Scratch

#: The list of vectors whose length is not that of the centroids.
OTHERS = -1


@dataclass
class VectorIndex:
    """`rows` has list, item_id, v; reach[list] is the greatest angle between a member and its centroid."""

    centroids: np.ndarray
    reach: dict[int, float]
    rows: DataFrame


def _fit(lists: int, rounds: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["v"].map(len)
        v = np.stack(pdf["v"][size == size.mode()[0]].to_numpy()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rng = np.random.default_rng(seed)
        c = v[rng.choice(len(v), min(lists, len(v)), replace=False)]
        for _ in range(rounds):
            near = np.concatenate([(v[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(v), 4096)])
            total = np.zeros_like(c)
            np.add.at(total, near, v)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            # a centroid without members starts anew
            c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), v[rng.integers(0, len(v), len(c))])
        return pd.DataFrame({"c": list(c)})

    return run


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            place, angle = np.full(batch.num_rows, OTHERS), np.zeros(batch.num_rows)
            good = np.zeros(batch.num_rows, bool)
            for rows, v in _units(batch.column(1), batch.num_rows):
                good[rows] = True
                if len(c) and v.shape[1] == c.shape[1]:
                    score = v @ c.T
                    place[rows] = score.argmax(1)
                    angle[rows] = np.arccos(np.clip(score.max(1), -1, 1))
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([pa.array(place[good], pa.int32()), pa.array(angle[good]), *kept.columns], names=["list", "angle", "item_id", "v"])

    return run


def build_index(vectors: DataFrame, lists: int = 256, sample: int = 20_000, rounds: int = 10, seed: int = 5) -> VectorIndex:
    """An index of all vectors (item_id, embedding); null, zero and non-finite ones are in no list.

    Centroids are learned on about `sample` vectors, drawn by a hash of the id and of the
    commonest length; every vector is indexed.  The index is written by list below the shared folder.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select("item_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = rows.where(F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    n = max(1, fine.count())
    draw = F.shiftrightunsigned(F.xxhash64("item_id", F.lit(seed)), 1) / float(1 << 63)
    got = fine.where(draw < sample / n).withColumn("one", F.lit("sample")).groupBy("one").applyInPandas(_fit(lists, rounds, seed), "c array<double>").toPandas()  # `lists` rows
    centroids = np.stack(got["c"].to_numpy()) if len(got) else np.zeros((0, 0))
    kind = rows.schema["item_id"].dataType.simpleString()
    placed = rows.mapInArrow(_assign(spark.sparkContext.broadcast(centroids)), f"list int, angle double, item_id {kind}, v array<double>")
    path = scratch.path("lists")
    placed.repartition(F.col("list"), F.pmod(F.xxhash64("item_id"), F.lit(16))).write.partitionBy("list").parquet(path)
    table = spark.read.schema(placed.schema).parquet(path)
    reach = {r["list"]: r["a"] for r in table.groupBy("list").agg(F.max("angle").alias("a")).collect()}  # one row per list
    return VectorIndex(centroids, reach, table.select("list", "item_id", "v"))


def _probe(shared, k: int, least: float | None, digits: int, cells: int = 1 << 22):
    """A task's k best items of each query, over the lists that the query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units, wants = shared.value
        best: pa.Table | None = None
        for batch in batches:
            kind = batch.schema.field(1).type
            lists = np.asarray(batch.column(0))
            for rows, v in _units(batch.column(2), batch.num_rows):
                for at, q in units:
                    if q.shape[1] != v.shape[1]:
                        continue
                    for one in np.unique(lists[rows]):
                        mine = np.flatnonzero(np.isin(at, wants.get(int(one), ())))
                        here = np.flatnonzero(lists[rows] == one)
                        for i in range(0, len(here) if len(mine) else 0, max(1, cells // max(1, len(mine)))):
                            part = here[i : i + max(1, cells // len(mine))]
                            score = np.round(q[mine] @ v[part].T, digits)
                            floor = np.partition(score, -k - 1, axis=1)[:, -k - 1][:, None] if len(part) > k else -2.0
                            x, y = np.nonzero((score >= floor) & (score >= (-2.0 if least is None else least)))
                            new = pa.table({"q": pa.array(at[mine[x]]), "item": batch.column(1).take(pa.array(rows[part[y]])), "score": pa.array(score[x, y])})
                            new = new.filter(pc.invert(pc.fill_null(pc.equal(new["item"], names.take(new["q"]).cast(kind)), False)))
                            best = _first(pa.concat_tables([best, new]) if best is not None else new, k)
        for b in best.combine_chunks().to_batches() if best is not None else ():
            yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(1), b.column(2)], names=["query_id", "item_id", "score"])

    return run


def search(index: VectorIndex, queries: DataFrame, k: int = 5, probe: int = 8, exact: bool = False, least: float | None = None, digits: int = 6, max_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, item_id, score, rank) as `vector_topk` gives it, from the `probe` nearest lists of each query.

    With `exact`, all further lists whose bound reaches the k-th score found are read as well, and the
    result is that of the exact search.  Query ids are distinct; queries are broadcast in blocks of about `max_bytes`.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark)
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q is not null")
    ids = [f.dataType.simpleString() for f in (q.schema["query_id"], index.rows.schema["item_id"])]
    blocks = max(1, -(-(q.agg(F.sum(F.size("q") * 8 + 16)).first()[0] or 0) // max_bytes))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    out = None

    def read(names, units, wants, name):
        lists = [x for x, at in wants.items() if len(at)]
        shared = spark.sparkContext.broadcast((names, units, wants))
        rows = index.rows.where(F.col("list").isin(lists)).mapInArrow(_probe(shared, k, least, digits), f"query_id {ids[0]}, item_id {ids[1]}, score double")
        return scratch.keep(rows, name)

    for b in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        names = rows["query_id"].combine_chunks()
        units = _units(rows["q"].combine_chunks(), rows.num_rows)
        angle = np.full((rows.num_rows, len(index.centroids)), np.pi)
        known = np.zeros(rows.num_rows, bool)
        for at, v in units:
            if len(index.centroids) and v.shape[1] == index.centroids.shape[1]:
                # einsum calls no BLAS, whose threads may hang in a driver that forks
                angle[at] = np.arccos(np.clip(np.einsum("ij,kj->ik", v, index.centroids), -1, 1))
                known[at] = True
        nearest = np.argsort(angle, axis=1, kind="stable")[:, :probe]
        wants = {j: np.flatnonzero(known & (nearest == j).any(1)) for j in index.reach if j >= 0}
        wants[OTHERS] = np.flatnonzero(~known)
        found = read(names, units, wants, "near")
        if exact:
            best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", "score").toArrow()  # a row per query of the block
            kth = dict(zip(best["query_id"].to_pylist(), best["score"].to_pylist(), strict=True))
            floor = np.array([kth.get(x, -2.0) for x in names.to_pylist()])
            if least is not None:
                floor = np.maximum(floor, least)
            # scores are rounded, so a list within half a unit of the last digit counts
            more = {j: np.flatnonzero(known & (np.cos(np.maximum(0.0, angle[:, j] - r)) + 10.0**-digits >= floor)) for j, r in index.reach.items() if j >= 0}
            more = {j: np.setdiff1d(at, wants[j]) for j, at in more.items()}
            found = found.union(read(names, units, more, "further"))
        out = found if out is None else out.union(found)
    if out is None:
        out = index.rows.limit(0).select(F.lit(None).cast(ids[0]).alias("query_id"), "item_id", F.lit(0.0).alias("score"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
