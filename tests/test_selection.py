"""Exact medians: ties, gaps, odd values, and a hot key that no task holds."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.plans.selection import with_median


@pytest.mark.parametrize(("ranges", "direct"), [(4096, 100_000), (4, 3), (2, 1), (7, 0)])
def test_medians(spark, ranges, direct):
    rng = random.Random(ranges)
    rows = [("ties", x) for x in [5.0] * 50 + [1.0, 9.0, 5.5]] + [("even", float(k)) for k in range(40)] + [(None, rng.gauss(0, 1e6)) for _ in range(101)]
    rows += [("tail", x) for x in [1e300, -1e300, 1e-300, 0.0, -0.0, 2.0, 3.0]] + [("one", 4.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    rows += [("step", 10.0 ** rng.randint(-9, 9)) for _ in range(200)]
    got = {r.k: (r.n, r.median) for r in with_median(spark.createDataFrame(rows, "k string, x double").repartition(3), ["k"], "x", [F.count("x").alias("n")], ranges=ranges, direct=direct).collect()}
    for k in {k for k, _ in rows}:
        mine = [x for g, x in rows if g == k and x is not None]
        assert got[k] == (len(mine), pytest.approx(statistics.median(mine), rel=1e-12) if mine else None)
    assert with_median(spark.createDataFrame([], "k string, x double"), ["k"], "x", [F.count("x").alias("n")]).count() == 0


@pytest.mark.parametrize("direct", [0, 1000])
def test_odd_values(spark, direct):
    nan, inf = float("nan"), float("inf")
    groups = {"a": [nan, 1.0, inf], "b": [nan, nan, 1.0], "c": [-inf, -inf, 2.0], "d": [-inf, 1.0, 2.0, 3.0, inf], "e": [1.0, inf], "f": [-inf, inf], "g": [inf] * 2 + [3.0, 4.0, 5.0, 6.0]}
    rows = [(k, x) for k, v in groups.items() for x in v]
    got = {r.k: r.median for r in with_median(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", [F.count("x").alias("n")], direct=direct).collect()}
    assert str(got.pop("b")) == "nan" and str(got.pop("f")) == "nan"
    assert got == {"a": inf, "c": -inf, "d": 2.0, "e": inf, "g": 5.5}


def test_hot_key_of_ten_million(spark):
    """One key: the largest number of values that a task collects is that of one range."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("k").alias("k"), F.pow(F.lit(1.000003), F.pmod(F.col("id") * 7919, F.lit(n))).alias("x"))
    want = float(np.median(np.float64(1.000003) ** np.arange(n)))
    got = with_median(rows, ["k"], "x", [F.count("x").alias("n")], direct=20_000).first()
    assert got.n == n and got.median == pytest.approx(want, rel=1e-9)
