"""Latency statistics of windows of many runs equal their SQL, medians of counted values theirs."""

import random
import statistics

import oracle
import pytest
from pyspark.sql import functions as F

from fernlake import catalog
from fernlake.plans.selection import with_median


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events whose 12,000 tool runs of a day and tool have 12,000 latencies."""
    path = tmp_path_factory.mktemp("many")
    value = ((F.col("event_id") * 7919) % 48_017) / 1000
    rows = spark.range(48_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"))
    rows.withColumn("value", value).withColumn("props", F.lit('{"k": 1}')).coalesce(1).toPandas().to_parquet(path / "events.parquet", coerce_timestamps="us")
    return str(path)


@pytest.mark.parametrize("name", ["run_latency_batch", "run_latency_stream"])
def test_windows_of_many_runs(spark, folder, name):
    con = oracle.connect(folder)
    assert oracle.compare(con, catalog.queries()[name](spark, folder), catalog.oracle_sql()[name]) == ""
    assert min(r[0] for r in con.sql(f"select n from ({catalog.oracle_sql()[name]})").fetchall()) == 12_000


@pytest.mark.parametrize(("ranges", "direct"), [(4096, 100_000), (4, 3), (7, 0)])
def test_lower_medians_of_counted_values(spark, ranges, direct):
    rng, nan, inf = random.Random(direct), float("nan"), float("inf")
    rows = [("many", rng.gauss(0, 100), rng.randint(1, 9)) for _ in range(200)] + [(None, float(k), 2) for k in range(10)] + [("one", 4.0, 6), ("two", 1.0, 3), ("two", 2.0, 3), ("odd", nan, 2), ("odd", 1.0, 1), ("odd", inf, 3), ("none", None, 5)]
    got = {r.k: (r.n, r.median) for r in with_median(spark.createDataFrame(rows, "k string, x double, n long"), ["k"], "x", [F.sum("n").alias("n")], ranges=ranges, direct=direct, weight="n", lower=True).collect()}
    for k in {k for k, _, _ in rows}:
        mine = [x for g, x, n in rows if g == k and x is not None for _ in range(n)]
        assert got[k][1] == (statistics.median_low(sorted(mine, key=lambda x: (x != x, x))) if mine and k != "odd" else None if not mine else inf)
