"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents, shuffled by a hash, are cut into blocks.  With integer weights a and
their sum A, block k of a source of weight a is released at slot ``floor(k A / a)`` and due at
``ceil((k + 1) A / a)``; the earliest deadline first fills each slot.  At every slot a source
then deviates from its share by less than one block.  The schedule repeats every A slots, so one
period is computed (a fold over A slots inside one SQL expression) and each block finds its slot
by arithmetic.  When a source runs dry, its rest is spread over one last, smaller period and
the others go on in proportion to their weights: every document is placed exactly once.

A document's rank within its source comes from counts by (source, hash bucket), so that no
source, however large, passes through one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NO_SOURCE = "(none)"
OUTPUT = ("mix_source", "block", "slot", "release", "deadline", "position")

#: One period: in slot t the released source with the earliest deadline (ties: first in order) runs.  Slots are folded
#: in stretches of 512, whose lists are joined at the end, so that the work is linear in the slots.
_STRETCH = """
aggregate(
  sequence(lo, least(lo + 511L, total - 1L)),
  named_struct('k', s.k, 'o', cast(array() as array<struct<i:int,k:bigint>>)),
  (u, t) -> element_at(transform(
    array(array_min(transform(u.k, (k, i) -> if((k * total) div a[i] <= t, named_struct('due', ((k + 1) * total + a[i] - 1) div a[i], 'i', i), null)))),
    c -> named_struct('k', transform(u.k, (k, i) -> if(i = c.i, k + 1L, k)), 'o', concat(u.o, array(named_struct('i', c.i, 'k', u.k[c.i]))))), 1))
"""
_PERIOD = f"""
aggregate(
  sequence(0L, total - 1L, 512L),
  named_struct('k', transform(a, x -> 0L), 'o', cast(array() as array<array<struct<i:int,k:bigint>>>)),
  (s, lo) -> element_at(transform(array({_STRETCH}), f -> named_struct('k', f.k, 'o', concat(s.o, array(f.o)))), 1),
  s -> flatten(s.o))
"""


@dataclass
class Phase:
    """A run of `periods` periods from slot `start`; a[source] blocks of each source a period."""

    start: int
    periods: int
    a: dict[str, int]
    first: dict[str, int]


def plan_phases(blocks: dict[str, int], weights: dict[str, int]) -> list[Phase]:
    """Phases from the number of blocks and the weight of each source; at most two per source."""
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    done = dict.fromkeys(left, 0)
    phases, slot = [], 0
    while left:
        periods = min(n // weights[s] for s, n in left.items())
        a = {s: min(weights[s], n) if not periods else weights[s] for s, n in left.items()}
        phases.append(Phase(slot, max(1, periods), a, {s: done[s] for s in left}))
        for s in a:
            used = a[s] * max(1, periods)
            done[s] += used
            left[s] -= used
        slot += sum(a.values()) * max(1, periods)
        left = {s: n for s, n in left.items() if n > 0}
    return phases


def _small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of a few planned rows, as literals."""
    cells = [F.struct(*(_literal(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def _literal(v):
    if isinstance(v, list):
        return F.array(*(_literal(x) for x in v))
    return F.lit(v).cast("long") if isinstance(v, int) else F.lit(v)


def schedule_table(spark: SparkSession, phases: list[Phase]) -> DataFrame:
    """(source, first, blocks, a, total, start, periods, slots): what places a source's blocks in a phase.

    `slots` holds the slot within a period of each of the source's a blocks.
    """
    rows = [(i, list(p.a), list(p.a.values()), [p.first[s] for s in p.a], sum(p.a.values()), p.start, p.periods) for i, p in enumerate(phases)]
    table = _small(spark, rows, ["phase", "names", "a", "first", "total", "start", "periods"])
    table = table.withColumn("period", F.expr(_PERIOD))
    each = table.select("total", "start", "periods", "period", F.posexplode(F.arrays_zip("names", "a", "first")).alias("i", "s"))
    slots = F.expr("transform(filter(transform(period, (x, t) -> named_struct('i', x.i, 't', cast(t as bigint))), x -> x.i = i), x -> x.t)")
    return each.select(F.col("s.names").alias("source"), F.col("s.first").alias("first"), (F.col("s.a") * F.col("periods")).alias("blocks"), F.col("s.a").alias("a"), "total", "start", slots.alias("slots"))


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    default_weight: int = 1,
    block_docs: int = 16,
    source_col: str = "source",
    id_col: str = "doc_id",
    seed: int = 3,
    max_sources: int = 500,
    max_total: int = 200_000,
) -> DataFrame:
    """The rows with `mix_source`, `block`, `slot`, `release`, `deadline` and `position`; none is dropped or repeated.

    Reading in the order of `position` (slot, then place in the block) gives the mixture.
    Sources without a weight of their own have ``default_weight``; a null source is a source of
    its own, "(none)".  Rows that repeat an id or have none are placed one by one; weights count by their ratio alone.  An empty table gives an
    empty result.  Columns of the input that bear an output name are replaced.  The plan of at most ``max_sources`` sources and ``max_total`` slots a period
    is all that reaches the driver or is broadcast.
    """
    spark = docs.sparkSession
    weights = weights or {}
    if default_weight < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    keep = [c for c in docs.columns if c not in OUTPUT]
    rows = docs.select(*keep, F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("mix_source"), F.col(id_col).alias("__id"))
    sizes = {x["mix_source"]: x["n"] for x in rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()}
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources; group them first")
    use = {s: int(weights.get(s, default_weight)) for s in sizes}
    common = math.gcd(*use.values()) if use else 1
    use = {s: w // common for s, w in use.items()}
    if sum(use.values()) > max_total:
        raise ValueError(f"weights sum to more than {max_total}; scale them down")
    if not sizes:
        return rows.select(*keep, "mix_source", *(F.lit(0).cast("long").alias(c) for c in OUTPUT[1:]))
    table = schedule_table(spark, plan_phases({s: -(-n // block_docs) for s, n in sizes.items()}, use))
    table = table.select(F.struct("*").alias("__t"))

    buckets = int(max(sizes.values()) ** 0.5) + 1
    # rows without an id are told apart by all they hold
    draw = F.when(F.col("__id").isNull(), F.xxhash64(*(c for c in keep if not docs.schema[c].dataType.simpleString().startswith(("map", "variant"))), F.lit(seed))).otherwise(F.xxhash64(F.col("__id").cast("string"), F.lit(seed)))
    rows = rows.withColumn("__draw", draw).withColumn("__bucket", F.pmod("__draw", F.lit(buckets)))
    before = Window.partitionBy("mix_source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("mix_source", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("mix_source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("mix_source", "__bucket").orderBy("__draw", "__id")
    ranked = rows.withColumn("__r", F.row_number().over(inside)).join(offsets, ["mix_source", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__offset") + F.col("__r") - 1)
    ranked = ranked.withColumn("__block", F.floor(F.col("__rank") / block_docs).cast("long"))
    here = (F.col("mix_source") == F.col("__t.source")) & (F.col("__block") >= F.col("__t.first")) & (F.col("__block") < F.col("__t.first") + F.col("__t.blocks"))
    at = ranked.join(F.broadcast(table), here)
    k, a, total = "(__block - __t.first)", "__t.a", "__t.total"
    slot = F.expr(f"__t.start + ({k} div {a}) * {total} + get(__t.slots, cast({k} % {a} as int))")
    return at.select(
        *keep, "mix_source", F.col("__block").alias("block"), slot.alias("slot"), F.expr(f"__t.start + ({k} * {total}) div {a}").alias("release"),
        F.expr(f"__t.start + (({k} + 1) * {total} + {a} - 1) div {a}").alias("deadline"), (slot * block_docs + F.col("__rank") % block_docs).alias("position"),
    )
