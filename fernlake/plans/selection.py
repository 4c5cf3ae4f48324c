"""Exact medians of groups of any size.

A group's values are counted by ranges between its least and greatest; the range that holds the
middle ranks is kept, with the least and greatest value in it, and counted by ranges again, until
it holds few values or one value alone.  Counts are combined before they are shuffled, and no task
holds more of a group than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake.plans.scratch import Scratch


def _same(keys: list[str], suffix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(k + suffix)) for k in keys]


def _range(x: Column, low: Column, high: Column, ranges: int, spread: bool) -> Column:
    """Number of x's range, from 0; ascends with x.  `spread` makes ranges near zero the narrower ones."""
    f = F.asinh if spread else (lambda c: c / 2)
    return F.least(F.floor((f(x) - f(low)) / (f(high) - f(low)) * ranges).cast("int"), F.lit(ranges - 1))


def with_median(
    rows: DataFrame, keys: list[str], value: str, aggregates: list[Column], name: str = "median", ranges: int = 4096, direct: int = 100_000, weight: str | None = None, lower: bool = False
) -> DataFrame:
    """One row per distinct `keys` (null is a key like others): `aggregates`, and the exact median of `value` as `name`.

    Nulls are left out, NaN counts as greatest; a group of nulls alone has a null median.  Groups of more than `direct` values are narrowed down range by range.
    A row stands for as many equal values as its column `weight` says, for one without it.  With `lower` the median of an even number is the lower middle value.
    """
    spark = rows.sparkSession
    x, inf = F.col(value).cast("double"), F.lit(float("inf"))
    times = F.lit(1) if weight is None else F.col(weight)
    number = lambda test: F.coalesce(F.sum(F.when(test, times)), F.lit(0))
    is_finite = ~F.isnan(x) & (F.abs(x) < inf)
    finite = F.when(is_finite, x)
    with Scratch(spark) as scratch:
        extra = [number(x.isNotNull()).alias("__n"), number(is_finite).alias("__finite"), number(x == -inf).alias("__under"), number(x == inf).alias("__over"), F.min(finite).alias("__low"), F.max(finite).alias("__high")]
        first = scratch.keep(rows.groupBy(*keys).agg(*aggregates, *extra), "groups")
        below = F.col("__under")

        def odd(rank: Column) -> Column:
            """The value at a rank outside the finite ones."""
            return F.when(rank < below, -inf).when(rank >= below + F.col("__finite") + F.col("__over"), F.lit(float("nan"))).when(rank >= below + F.col("__finite"), inf)

        rank_a = ((F.col("__n") - 1) / 2).cast("long")
        rank_b = rank_a if lower else (F.col("__n") / 2).cast("long")
        first = first.withColumn("__odd_a", F.when(F.col("__n") > 0, odd(rank_a))).withColumn("__odd_b", F.when(F.col("__n") > 0, odd(rank_b)))
        # ranks are counted from 0 among the values of low..high; where one is outside them, the other stands for both
        a = F.when(F.col("__odd_a").isNull(), rank_a).otherwise(rank_b) - below
        b = F.when(F.col("__odd_b").isNull(), rank_b).otherwise(rank_a) - below
        open_ = first.where("__finite > 0 and (__odd_a is null or __odd_b is null)")
        state = open_.select(*(F.col(k).alias(f"{k}__of") for k in keys), F.col("__low").alias("low"), F.col("__high").alias("high"), F.col("__finite").alias("left"), a.alias("a"), b.alias("b"))
        state = state.withColumn("at_a", F.when(F.col("low") == F.col("high"), F.col("low"))).withColumn("at_b", F.col("at_a"))
        values = rows.where(x.isNotNull()).select(*keys, x.alias("__x"), times.alias("__times"))
        wide, spread = f"at_a is null and left > {direct}", True
        of = [f"{k}__of" for k in keys]
        while not state.where(wide).limit(1).isEmpty():
            inside = values.join(state.where(wide), [*_same(keys, "__of"), F.col("__x").between(F.col("low"), F.col("high"))])
            part = _range(F.col("__x"), F.col("low"), F.col("high"), ranges, spread).alias("part")
            hist = inside.groupBy(*of, "a", "b", part).agg(F.sum("__times").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
            w = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            hist = hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
            holds = lambda r: (F.col("before") <= F.col(r)) & (F.col(r) < F.col("before") + F.col("n"))
            pick = lambda c, r: F.max(F.when(holds(r), F.col(c)))
            got = hist.groupBy(*of, "a", "b").agg(
                pick("low", "a").alias("low"), pick("high", "a").alias("high"), pick("n", "a").alias("left"), pick("before", "a").alias("before"),
                pick("part", "a").alias("part_a"), pick("part", "b").alias("part_b"), pick("low", "b").alias("low_b"),
            )
            # ranks in two ranges are the last of one and the first of the other
            split, one = F.col("part_a") != F.col("part_b"), F.col("low") == F.col("high")
            got = got.select(
                *of, "low", "high", "left", (F.col("a") - F.col("before")).alias("a"), (F.col("b") - F.col("before")).alias("b"),
                F.when(split, F.col("high")).when(one, F.col("low")).alias("at_a"), F.when(split, F.col("low_b")).when(one, F.col("low")).alias("at_b"),
            )
            state, spread = scratch.keep(state.where(f"not ({wide})").unionByName(got), "ranges"), False
        few = values.join(state.where("at_a is null"), [*_same(keys, "__of"), F.col("__x").between(F.col("low"), F.col("high"))])
        listed = F.collect_list("__x") if weight is None else F.flatten(F.collect_list(F.array_repeat("__x", F.col("__times").cast("int"))))
        sorted_ = F.array_sort(listed)
        few = few.groupBy(*of, "a", "b").agg(sorted_.alias("v")).select(*of, F.get("v", F.col("a").cast("int")).alias("at_a"), F.get("v", F.col("b").cast("int")).alias("at_b"))
        ends = state.where("at_a is not null").select(*of, "at_a", "at_b").unionByName(few)
        middle = 0.5 * F.coalesce("__odd_a", "at_a") + 0.5 * F.coalesce("__odd_b", "at_b")
        out = first.join(ends, _same(keys, "__of"), "left").withColumn(name, middle)
        return scratch.keep(out.drop("__n", "__finite", "__under", "__over", "__low", "__high", "__odd_a", "__odd_b", "at_a", "at_b", *of), "medians", last=True)
