"""Joins and numberings whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt_anew(table: DataFrame, *keys: str) -> DataFrame:
    """The table, one row per key, dealt by a hash of its keys' hash.

    A grouped table is already dealt by its keys, so a join on them would read its rows and the
    other side's in one stage that cannot be split.  Dealt like this, both sides are shuffled for
    the join, and adaptive execution splits the partitions that a hot key fills on the other side.
    """
    return table.repartition(F.xxhash64(*keys))


def numbered(rows: DataFrame, name: str, within: list[str], bucket: Column, *order: str) -> DataFrame:
    """Row numbers from 1 by `order`, within equal `within` columns, as column `name`.

    Rows are numbered inside buckets, whose counts are summed before; `bucket` has to ascend with
    the order.  So no task sees more than a bucket's rows, or one row per bucket.
    """
    keys = [*within, "__bucket"]
    rows = rows.withColumn("__bucket", bucket)
    before = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*(F.col(k).alias(f"{k}__of") for k in keys), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}__of")) for k in keys]
    return ranked.join(offsets, same).withColumn(name, (F.col("__before") + F.col("__rank")).cast("long")).drop("__rank", "__before", "__bucket", *(f"{k}__of" for k in keys))
