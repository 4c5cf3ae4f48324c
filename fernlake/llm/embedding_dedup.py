"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are collapsed first.  Each tree splits recursively at the median of a random
projection (one direction per tree and level); vectors within ``spill`` of a split go to both
sides.  Stage by stage, every leaf over ``leaf`` rows is split again by up to ``depth`` levels: a
task per leaf fits the thresholds on a sample of its rows, and every vector is then placed.  A
leaf whose sample no threshold shrinks is closed.  Plans are a table joined by leaf: Spark
broadcasts it while it is small and splits large leaves where it is not.  Within a leaf all pairs
are compared in double precision by one matrix product; a pair that meets in several leaves counts
in the one with the smallest label.  Large closed leaves are compared in cells of at most two
blocks.  Links are joined into components.

A label holds its tree in its lowest byte; closed labels are negative.  Vectors of each length
have trees of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlake.operators.components import components
from fernlake.plans.scratch import Scratch
from fernlake.plans.skew import dealt_anew


def directions(seed: int, tree: int, first: int, depth: int, dims: int) -> np.ndarray:
    """Unit directions of the levels first .. first+depth-1 of one tree."""
    out = np.stack([np.random.default_rng([seed, tree, first + k]).normal(size=dims) for k in range(depth)])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit_splits(sample: np.ndarray, axes: np.ndarray, spill: float, least: int) -> dict[int, float]:
    """Thresholds of one subtree as {heap index: median}; nodes that do not shrink stay leaves."""
    cuts: dict[int, float] = {}
    todo = [(1, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        level = node.bit_length() - 1
        if level >= len(axes) or len(rows) <= least:
            continue
        at = sample[rows] @ axes[level]
        cut = float(np.median(at))
        left, right = rows[at <= cut + spill], rows[at > cut - spill]
        if max(len(left), len(right)) > 0.9 * len(rows):
            continue
        cuts[node] = cut
        todo += [(2 * node, left), (2 * node + 1, right)]
    return cuts


def _unit(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each vector length in a column of lists."""
    size = np.asarray(lists.value_lengths())
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.asarray(lists.flatten(), np.float64)
    out = []
    for dims in np.unique(size):
        rows = np.flatnonzero(size == dims)
        v = flat[at[rows][:, None] + np.arange(dims)]
        out.append((rows, v / np.linalg.norm(v, axis=1, keepdims=True)))
    return out


def _fit(seed: int, stage: int, depth: int, spill: float, leaf: int):
    """Plan of one leaf from the sample of its rows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        least = max(8, int(leaf * len(v) / pdf["held"].iloc[0]))
        cuts = fit_splits(v * v.shape[1] ** 0.5, directions(seed, int(key[0]) & 0xFF, stage * depth, depth, v.shape[1]), spill, least)
        return pd.DataFrame({"leaf": [key[0]], "node": [list(cuts)], "cut": [list(cuts.values())]})

    return run


def _project(seed: int, stage: int, depth: int):
    """(h, g, leaf, proj): projections of a vector on this stage's directions, for each of its labels."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(3)
            flat, held = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
            owner = np.repeat(np.arange(batch.num_rows), held)
            proj = np.zeros((len(flat), depth))
            for rows, v in _unit(batch.column(2)):
                place = np.full(batch.num_rows, -1)
                place[rows] = np.arange(len(rows))
                for tree in np.unique(flat & 0xFF):
                    mine = np.flatnonzero((flat & 0xFF == tree) & (place[owner] >= 0))
                    axes = directions(seed, int(tree), stage * depth, depth, v.shape[1])
                    proj[mine] = (v @ axes.T)[place[owner[mine]]] * v.shape[1] ** 0.5
            edge = pa.array(np.arange(len(flat) + 1) * depth, pa.int32())
            columns = [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(flat, pa.int64()), pa.ListArray.from_arrays(edge, pa.array(proj.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "g", "leaf", "proj"])

    return run


def _place(stage: int, spill: float):
    """(h, g, leaf): the sub-leaves of each row by its leaf's plan; no plan keeps the leaf, an empty one closes it."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n = batch.num_rows
            leaf = batch.column(2).to_numpy(zero_copy_only=False)
            proj = np.asarray(batch.column(3).flatten()).reshape(n, -1) if n else np.zeros((0, 1))
            planned = np.asarray(batch.column(4).is_valid())
            rows_out, labels_out = [np.flatnonzero(~planned)], [leaf[~planned]]
            for label in np.unique(leaf[planned]):
                rows = np.flatnonzero(leaf == label)
                one = int(rows[0])
                cuts = dict(zip(batch.column(4)[one].as_py(), batch.column(5)[one].as_py(), strict=True))
                if not cuts:
                    rows_out.append(rows)
                    labels_out.append(np.full(len(rows), -1 - int(label)))
                    continue
                todo = [(1, rows)]
                while todo:
                    node, rows = todo.pop()
                    if node not in cuts:
                        rows_out.append(rows)
                        labels_out.append(np.full(len(rows), _label(int(label), node, stage)))
                        continue
                    x = proj[rows, node.bit_length() - 1]
                    todo += [(2 * node, rows[x <= cuts[node] + spill]), (2 * node + 1, rows[x > cuts[node] - spill])]
            at = pa.array(np.concatenate(rows_out).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(labels_out), pa.int64())], names=["h", "g", "leaf"])

    return run


def _label(parent: int, node: int, stage: int) -> int:
    """A new label for a sub-leaf; unique but for hash collisions, which only merge leaves of a tree."""
    x = (parent * 0x9E3779B97F4A7C15 + node * 0xC2B2AE3D27D4EB4F + stage + 1) & (1 << 64) - 1
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x >> 1) & ~0xFF | parent & 0xFF


def _leaf_links(cosine: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label = int(key[0])
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rep, copies, block = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        diagonal = pdf["diagonal"].to_numpy()
        # which earlier leaves each row also lies in, as bits
        size = pdf["leaves"].map(len).to_numpy()
        flat = np.concatenate(pdf["leaves"].to_list())
        owner = np.repeat(np.arange(len(pdf)), size)[flat < label]
        earlier, at = np.unique(flat[flat < label], return_inverse=True)
        bits = np.zeros((len(pdf), len(earlier) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (owner, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        count, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        ends: list[np.ndarray] = []
        for k in range(0, len(pdf), 1024):
            hit = v[k : k + 1024] @ v.T >= cosine
            i, j = np.nonzero(hit)
            i = i + k
            keep = (i < j) & ((block[i] != block[j]) | diagonal[i])
            ends.append(np.stack([i[keep], j[keep]]))
        i, j = np.concatenate(ends, axis=1)
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            first = ~(bits[a] & bits[b]).any(axis=1)
            a, b = a[first], b[first]
            count += np.bincount(a, copies[b], minlength=len(pdf)).astype(np.int64) + np.bincount(b, copies[a], minlength=len(pdf)).astype(np.int64)
        while len(i):
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if (new == root).all():
                break
            root = new
        # a row's links here (edge false: h, g, n), and one edge to the first row it hangs together with
        some, moved = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(pdf)))
        return pd.DataFrame(
            {
                "h": np.concatenate([pdf["h"].to_numpy()[some], rep[moved]]),
                "g": np.concatenate([pdf["g"].to_numpy()[some], rep[root[moved]]]),
                "n": np.concatenate([count[some], np.zeros(len(moved), np.int64)]),
                "edge": np.concatenate([np.zeros(len(some), bool), np.ones(len(moved), bool)]),
            }
        )

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    cosine: float = 0.95,
    trees: int = 4,
    leaf: int = 1024,
    spill: float = 0.16,
    per_leaf: int = 16,
    depth: int = 8,
    max_stages: int = 12,
    seed: int = 11,
) -> DataFrame:
    """(id, n_links, component_id, kept) per input row.

    Vectors that are null, zero, or hold null or non-finite components link with nothing; so do
    rows with a null id (null component, not kept).  Vectors of different lengths do not link.
    Rows with equal vectors link with each other.  Rows that repeat an id are vectors of their
    own and share its component.  An empty table gives an empty result.  Projections are measured in
    units of their spread, 1 / sqrt(length of the vectors), and so is ``spill``: about 13 % of a node's vectors go to
    both sides, whatever their length.  A leaf's thresholds are
    fitted on about ``per_leaf`` rows for each leaf it will have, so on at most
    ``per_leaf << depth``; all vectors are placed and compared.
    """
    if not 1 <= trees <= 256:
        raise ValueError("from 1 to 256 trees")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    # vectors travel in their own width; all arithmetic on them is in double precision
    single = vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType())
    kind = "array<float>" if single else "array<double>"
    v = F.col(vec_col).cast(kind)
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x).cast("double") < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), good.alias("good"))
    # a vector is known by a 128-bit hash
    named = rows.where("good and id is not null").select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(seed), "v").alias("g"), "v")
    cls = ["h", "g"]
    start = F.array(*(F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.size("v"), F.lit(t)), 9), 8) + F.lit(t) for t in range(trees)))
    classes = named.groupBy(*cls).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"))
    placed = scratch.keep(classes.select(*cls, "v", start.alias("leaves"), "rep", "copies"), "placed")
    members = named.select("id", *cls)

    for stage in range(max_stages):
        label = placed.select(*cls, F.explode("leaves").alias("leaf")).where("leaf >= 0")
        open_ = scratch.keep(label.groupBy("leaf").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > leaf), "open")
        if open_.isEmpty():
            break
        draw = F.shiftrightunsigned(F.xxhash64(*cls, F.lit(seed + stage)), 1) / float(1 << 63)
        want = F.greatest(F.lit(64.0), F.least(F.col("held") / leaf, F.lit(float(1 << depth))) * per_leaf)
        picked = label.join(open_, "leaf").where(draw < want / F.col("held"))
        drawn = picked.join(placed.select(*cls, "v"), cls).select("leaf", "held", "v")
        plans = drawn.groupBy("leaf").applyInPandas(_fit(seed, stage, depth, spill, leaf), "leaf long, node array<int>, cut array<double>")
        none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        plans = scratch.keep(open_.join(plans, "leaf", "left").select("leaf", none("node", "array<int>"), none("cut", "array<double>")), "plans")
        flat = placed.select(*cls, "v", "leaves").mapInArrow(_project(seed, stage, depth), "h long, g long, leaf long, proj array<double>")
        moved = flat.join(plans, "leaf", "left").select(*cls, "leaf", "proj", "node", "cut").mapInArrow(_place(stage, spill), "h long, g long, leaf long")
        leaves = moved.groupBy(*cls).agg(F.collect_set("leaf").alias("leaves"))
        new = scratch.keep(placed.drop("leaves").join(leaves, cls).select(*cls, "v", "leaves", "rep", "copies"), "placed")
        for t in (placed, open_, plans):
            scratch.drop(t)
        placed = new

    cells = placed.withColumn("leaf", F.explode("leaves"))
    held = dealt_anew(cells.groupBy("leaf").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "leaf")
    cells = cells.join(held, "leaf").withColumn("blocks", F.ceil(F.col("held") / (2 * leaf)).cast("int"))
    cells = cells.withColumn("block", F.pmod("h", F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    cells = cells.select("leaf", low, high, *cls, "rep", "copies", "v", "leaves", "block", (F.col("block") == F.col("other")).alias("diagonal"))
    found = scratch.keep(cells.groupBy("leaf", "low", "high").applyInPandas(_leaf_links(cosine), "h long, g long, n long, edge boolean"), "links")
    links = found.where("not edge").groupBy(*cls).agg(F.sum("n").alias("n"))

    # rows that repeat an id share its component
    several = members.groupBy("id").agg(F.min(F.struct(*cls)).alias("a"), F.max(F.struct(*cls)).alias("z")).where("a != z").select("id")
    same = members.join(several, "id").join(placed.select(*cls, "rep"), cls).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = found.where("edge").select(F.col("h").alias("a"), F.col("g").alias("b"))
    comp = components(edges.union(same)).withColumnsRenamed({"node": "rep", "component": "least"})
    by_class = placed.select(*cls, "rep", "copies").join(links, cls, "left").join(comp, "rep", "left")
    by_class = by_class.select(*cls, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    linked = members.join(dealt_anew(by_class, *cls), cls).select(F.col("id").alias(id_col), "n_links", "component_id")
    linked = scratch.keep(linked, "linked", last=True)
    alone = rows.where(~F.col("good") | F.col("id").isNull()).select("id")
    # an id of a vector that cannot link may also name one that can
    named = linked.join(alone.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi").groupBy(id_col).agg(F.min("component_id").alias("c")).withColumnRenamed(id_col, "id")
    alone = alone.join(named, "id", "left").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    out = scratch.keep(linked.union(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))), "result", last=True)
    scratch.close()
    return out
