"""Outlines nested deeper than any fixed number of levels, and longer than a segment."""

import random

import pytest
from pyspark.sql import functions as F

from fernlake.operators import outline

LINES = "source string, line_number int, line string"


def test_hundred_levels(spark):
    deep = 100
    data = [("s", k, f"s:{k}", f"s:{k - 1}" if k else None, f"t{k}") for k in range(deep)]
    nodes = spark.createDataFrame(data, "source string, line_number int, node_id string, parent_id string, clean string").coalesce(1)
    got = {r.line_number: r for r in outline.outline_path(nodes).collect()}
    assert len(got) == deep
    for k in range(deep):
        assert got[k].text == f"t{k}" and list(got[k].path) == ["s"] + [f"t{j}" for j in range(k)]


def test_two_thousand_levels_in_few_rounds(spark):
    """A round joins once; their number is the logarithm of the depth."""
    deep = 2_000
    nodes = spark.range(deep).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("line_number"), F.col("id").cast("int").alias("depth"), F.concat(F.lit("s:"), "id").alias("node_id"), F.when(F.col("id") > 0, F.concat(F.lit("s:"), F.col("id") - 1)).alias("parent_id"), F.concat(F.lit("t"), "id").alias("clean"))
    found = outline.outline_path(nodes)
    assert found.where(F.size("path") == F.col("line_number") + 1).count() == deep
    last = found.where(f"line_number = {deep - 1}").first()
    assert last.text == f"t{deep - 1}" and list(last.path) == ["s"] + [f"t{k}" for k in range(deep - 1)]


def brute(rows):
    """Depth and parent line of each kept line by plain loops."""
    out, state = {}, {}
    for s, n, line in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        bare = line.strip()
        if not bare or bare.startswith("---"):
            continue
        levels, last, stack = state.setdefault(s, ([], [None], []))
        body = bare.lstrip("-").strip()
        head = len(body) - len(body.lstrip("#")) if body.startswith("#") else 0
        bonus = None
        if head:
            bonus = len({x for x in levels if x < head})
            levels.append(head)
            last[0] = bonus + 1
        depth = (len(line) - len(line.lstrip())) // 2 + (bonus if bonus is not None else last[0] or 0)
        if not bare.lstrip("-*").strip():
            continue
        while stack and stack[-1][0] >= depth:
            stack.pop()
        out[(s, n)] = (depth, stack[-1][1] if stack else None)
        stack.append((depth, n))
    return out


@pytest.mark.parametrize(("segment", "reach"), [(4, 2), (7, 3), (512, 16)])
def test_segments_against_loops(spark, segment, reach):
    rng = random.Random(segment)
    rows = []
    for s in ("a", "b", None):
        depth = 0
        for n in range(300 if s == "a" else 40):
            depth = max(0, min(12, depth + rng.choice([-3, -1, 0, 0, 1, 1])))
            line = rng.choice(["# h", "## h", "#### h", "- ", "", "---"]) if rng.random() < 0.15 else f"- x{n}"
            rows.append((s, n, "  " * depth + line if line != "---" else line))
    rows += [("deep", n, "  " * n + f"- d{n}") for n in range(60)] + [("deep", 60, "- end"), ("flat", 0, "- only")] + [("flat", n, "  - kid") for n in range(1, 50)]
    lines = spark.createDataFrame(rows, LINES).repartition(3)
    features = outline.line_features(lines)
    depths = outline.outline_depth(features, segment)
    got = outline.outline_parent(depths, segment=segment, reach=reach)
    assert {(r.source, r.line_number): (r.depth, r.parent_line) for r in got.collect()} == brute(rows)


def test_one_long_source_is_many_tasks(spark):
    """Lines of one source are dealt over tasks, and no Python runs."""
    lines = spark.range(120_000).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("line_number"), F.concat(F.repeat(F.lit("  "), (F.col("id") % 5).cast("int")), F.lit("- x")).alias("line"))
    depths = outline.outline_depth(outline.line_features(lines))
    plan = depths._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
    got = outline.outline_parent(depths)
    wrong = got.where("not (parent_line <=> case when line_number % 5 > 0 then line_number - 1 end)")
    assert got.count() == 120_000 and wrong.count() == 0
    folded = outline._folded(depths.withColumn("segment", F.floor(F.col("line_number") / outline.SEGMENT)))
    assert folded.count() == 235 and folded.agg(F.max(F.size("lines"))).first()[0] == outline.SEGMENT
