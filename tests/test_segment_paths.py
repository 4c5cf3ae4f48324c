"""Nodes and paths read from one table of segments: against plain loops, and the bytes that are written."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fernlake.operators import outline
from fernlake.plans.scratch import shared_dir

LINES = "source string, line_number int, line string"


def rows_of(seed):
    rng, rows = random.Random(seed), []
    for s in ("a", "b", None):
        depth = 0
        for n in range(300 if s == "a" else 40):
            depth = max(0, min(12, depth + rng.choice([-3, -1, 0, 0, 1, 1])))
            line = rng.choice(["# h", "## h", "#### h", "- ", "", "---", "- ...", "- ****", "- x > y"]) if rng.random() < 0.25 else f"- x{n}"
            rows.append((s, n, "  " * depth + line if line != "---" else line))
    rows += [("deep", n, "  " * n + f"- d{n}") for n in range(60)] + [("deep", 60, "- end"), ("flat", 0, "- only")] + [("flat", n, "  - kid") for n in range(1, 50)]
    return rows


@pytest.mark.parametrize(("segment", "reach"), [(4, 2), (7, 3), (512, 16)])
def test_paths_of_segments_equal_paths_by_joins(spark, segment, reach):
    lines = spark.createDataFrame(rows_of(segment), LINES).repartition(3)
    apart = outline.outline_parent(outline.outline_depth(outline.line_features(lines), segment), segment=segment, reach=reach)
    names = ["source", "line_number", "line", "indent", "header", "has_unparsed_url", "raw", "clean", "depth", "parent_line", "node_id", "parent_id", "text", "path"]
    want = outline.outline_path(apart).select(names).collect()
    got = outline.outline_path(outline.build_nodes(lines, chain=True, segment=segment, reach=reach)).select(names).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 300
    plain = outline.build_nodes(lines, segment=segment, reach=reach).select(names[:-2]).collect()
    assert sorted(map(repr, plain)) == sorted(repr(r) for r in apart.select(names[:-2]).collect())


def written(spark):
    root = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    return sum(f.stat().st_size for f in root.rglob("*.parquet"))


def test_paths_are_not_written(spark, tmp_path):
    """The lines are written once, packed; paths, raw and clean texts are not."""
    lines = spark.range(60_000).select(F.concat(F.lit("s"), F.floor(F.col("id") / 12)).alias("source"), (F.col("id") % 12).cast("int").alias("line_number"), F.concat(F.repeat(F.lit("  "), (F.col("id") % 6).cast("int")), F.lit("- "), F.sha2(F.col("id").cast("string"), 512)).alias("line"))
    lines.write.parquet(str(tmp_path / "lines"))
    size = sum(f.stat().st_size for f in (tmp_path / "lines").rglob("*.parquet"))
    before = written(spark)
    found = outline.outline_path(outline.build_nodes(spark.read.parquet(str(tmp_path / "lines")), chain=True))
    assert written(spark) - before < 1.2 * size
    assert found.agg(F.sum(F.size("path"))).first()[0] == 60_000 / 6 * sum(range(1, 7))
    shutil.rmtree(tmp_path / "lines")
