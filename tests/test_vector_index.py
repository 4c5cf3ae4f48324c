"""The inverted file against exact search: equal in the exact mode, recall by probing alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 24))
    v = [(k, (centers[k % 40] + 0.4 * rng.normal(size=24)).tolist()) for k in range(4000)]
    v += [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [1.0, 2.0]), (9004, [2.0, 1.0]), (9005, [2.0, 4.0]), (9006, v[3][1])]
    return spark.createDataFrame(v, "item_id long, embedding array<double>").repartition(4)


def test_exact_mode_and_recall(spark, vectors):
    index = vector_index.build_index(vectors, lists=40, sample=2000)
    assert index.rows.count() == vectors.count() - 3
    queries = vectors.where("item_id % 20 = 0 or item_id >= 9000").withColumnRenamed("item_id", "query_id")
    key = lambda df: {(r.query_id, r.item_id, r.score, r["rank"]) for r in df.collect()}
    want = key(retrieval.vector_topk(queries, vectors))
    assert key(vector_index.search(index, queries, probe=1, exact=True)) == want
    assert key(vector_index.search(index, queries, probe=2, exact=True, max_bytes=20_000)) == want
    got = key(vector_index.search(index, queries, probe=4))
    assert len({x[:2] for x in got} & {x[:2] for x in want}) >= 0.95 * len(want)


def test_empty_tables(spark, vectors):
    none = vectors.limit(0)
    index = vector_index.build_index(none)
    assert vector_index.search(index, vectors.withColumnRenamed("item_id", "query_id"), exact=True).count() == 0
    full = vector_index.build_index(vectors.where(F.col("item_id") < 50), lists=4)
    assert vector_index.search(full, none.withColumnRenamed("item_id", "query_id")).count() == 0
