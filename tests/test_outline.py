"""The window forms against a sequential model of the parser."""

import random

from pyspark.sql import functions as F

from fernlake.functions import text as tx
from fernlake.operators import outline


def model(lines):
    """(line_number, depth, parent) of the kept lines, by a stack."""
    seen, bonus, out, stack = set(), None, [], []
    for n, line in enumerate(lines):
        s = line.strip(" \t\r\n\f\v")
        if not s or s.startswith("---"):
            continue
        indent = (len(line) - len(line.lstrip(" \t\r\n\f\v"))) // 2
        rest = s
        while rest and rest[0] in " \t-":
            rest = rest[1:]
        level = len(rest) - len(rest.lstrip("#"))
        if level:
            here = len({x for x in seen if x < level})
            seen.add(level)
            bonus, depth = here + 1, indent + here
        else:
            depth = indent + (bonus or 0)
        if not s.lstrip("-*").strip():
            continue
        while stack and stack[-1][1] >= depth:
            stack.pop()
        out.append((n, depth, stack[-1][0] if stack else None))
        stack.append((n, depth))
    return out


def test_random_outlines(spark):
    rng = random.Random(1)
    docs = {}
    for k in range(60):
        docs[str(k)] = [rng.choice(["", "  ", "    ", "      "]) + rng.choice(["# a", "## b", "### c", "- d", "* e", "f", "---", "", "-", "- ## g"]) for _ in range(rng.randint(0, 40))]
    rows = [(s, n, line) for s, ls in docs.items() for n, line in enumerate(ls)]
    got = outline.build_nodes(spark.createDataFrame(rows, "source string, line_number int, line string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append((r.line_number, r.depth, r.parent_line))
    for s, ls in docs.items():
        assert sorted(by.get(s, [])) == model(ls), s


def test_no_python_and_windows_by_segment(spark):
    lines = spark.createDataFrame([("a", 0, "# x")], "source string, line_number int, line string")
    plan = outline.outline_depth(outline.line_features(lines))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Window [collect_set(header" in plan and "[source#" in plan and "segment#" in plan


def test_text_cases(spark):
    c = F.col("s")
    cases = [
        (tx.clean_text(c), "  **a**\t[[B|id]]  {{c1::x::hint}} ![alt](u) ", "a B x alt"),
        (tx.extract_link(c)["url"], "see [n](http://u/x) http://v", "http://u/x"),
        (tx.extract_link(c)["name"], "see [http://u](http://u)", None),
        (tx.extract_link(c)["url"], "see http://v) x", "http://v"),
        (tx.fence_strip(c), "```json\n{\"a\": 1}\n```", '{"a": 1}'),
        (tx.smart_truncate(c, 20), "One two three. Four five six seven", "One two three. …[truncated]"),
        (tx.truncate_marked(c, 3), "abcdef", "abc\n... [+3 chars truncated]"),
        (tx.header_level(c), "- ## x", 2),
        (tx.mask_images(tx.clean_text(c), c, "host"), "![](host/1)", "[IMG URL]"),
        (tx.node_text_split(c)["text"], "a > b > c", "c"),
    ]
    for k, (col, given, want) in enumerate(cases):
        got = spark.createDataFrame([(given,)], "s string").select(col.alias("v")).first()[0]
        assert got == want, (k, got)


def test_scan_files(spark, tmp_path):
    from fernlake.sources import tables

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.md").write_text("# a\r\n- b\n")
    (tmp_path / "skip.txt").write_text("x")
    got = tables.scan_outline_files(spark, str(tmp_path)).select("source", "line_number", "line").collect()
    assert [tuple(r) for r in got] == [("note", 0, "# a"), ("note", 1, "- b"), ("note", 2, "")]


def test_scan_runs_json(spark, tmp_path):
    from fernlake.sources import tables

    (tmp_path / "runs.json").write_text('[{"_id": "1", "name": "old", "exported_at": "1"}, {"_id": "1", "name": "new", "exported_at": "2"}]')
    assert [r.name for r in tables.scan_runs_json(spark, str(tmp_path / "runs.json")).collect()] == ["new"]
