"""The whole ingestion equals its steps one by one, whatever the segments and the linked documents hold."""

import random

import pytest
from pyspark.sql import functions as F

from fernlake.functions import text as tx
from fernlake.operators import outline


def steps(lines, linked):
    """The same by the operators for one step each."""
    nodes = outline.outline_path(outline.outline_parent(outline.outline_depth(outline.line_features(lines))))
    if linked is not None:
        nodes = nodes.withColumn("url", F.when(F.col("has_unparsed_url"), tx.extract_link(F.col("line"))["url"]))
        grafted = outline.graft_documents(nodes, linked).withColumn("has_unparsed_url", F.lit(False))
        nodes = outline.parsed_links(nodes, linked).unionByName(grafted, allowMissingColumns=True)
    return outline.child_counts(outline.prune_empty_leaves(outline.restore_unparsed_text(nodes)))


@pytest.mark.parametrize(("segment", "reach", "kind"), [(5, 2, "none"), (512, 16, "flat"), (6, 3, "deep")])
def test_ingestion_equals_its_steps(spark, segment, reach, kind):
    rng, rows = random.Random(segment), []
    for s in ("a", "b", None):
        depth = 0
        for n in range(120 if s == "a" else 30):
            depth = max(0, min(6, depth + rng.choice([-2, -1, 0, 0, 1, 1])))
            rows.append((s, n, "  " * depth + rng.choice(["- ****", "- x", "# h", "- ...", f"- [r](http://e.com/{rng.randrange(4)})", "- ![](http://e.com/1)", "- **** <!http>"])))
    lines = spark.createDataFrame(rows, "source string, line_number int, line string").repartition(3)
    linked = None
    if kind != "none":
        deep = kind == "deep"
        docs = [(f"http://e.com/{u}", f"p{u}:{n}", n % 3 if deep else 0, f"p{u}:{n - 1}" if deep and n % 3 else None, [f"p{u}"], rng.choice(["", "t", None])) for u in range(3) for n in range(6)]
        docs += [("http://e.com/3", "p3:0", 0, None, ["p3"], "")]
        linked = spark.createDataFrame(docs, "url string, node_id string, depth int, parent_id string, path array<string>, text string")
    want = steps(lines, linked)
    got = outline.ingest_pipeline(lines, linked, segment=segment, reach=reach)
    assert set(got.columns) == set(want.columns)
    names = sorted(want.columns)
    a, b = (sorted(map(repr, x.select(names).collect())) for x in (got, want))
    assert a == b and len(a) > 100
