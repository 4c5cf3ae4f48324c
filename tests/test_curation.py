"""Curation on hand cases: groups that share a node, groups across subtrees, cycles, children."""

import json

from fernlake.operators import graph, outline


def curate(spark, lines, **decision):
    rows = [("1", k, x) for k, x in enumerate(lines)]
    nodes = outline.build_nodes(spark.createDataFrame(rows, "source string, line_number int, line string"))
    table = spark.createDataFrame([("1:0", json.dumps({"to_merge": [], "to_remove": [], "triplets": []} | decision), 7), ("9:9", "{bad", 5)], "component_id string, decision_json string, tokens long")
    return graph.curate_graph(nodes, table)


LINES = ["- top", "  - p", "    - a", "    - b", "  - q", "    - c", "    - d", "  - r", "    - e", "    - f"]


def state(got):
    return {r.node_id: (r.parent_id, r.clean) for r in got["nodes"].collect()}


def test_groups_across_subtrees_remove_and_redirect(spark):
    got = curate(spark, LINES, to_merge=[["subtree_0_leaf_0", "subtree_1_leaf_0"]])
    assert state(got) == {
        "1:0": (None, "top"), "1:1": ("1:0", "p\na\nq\nc"), "1:3": ("1:1", "b"), "1:6": ("1:1", "d"), "1:7": ("1:0", "r"), "1:8": ("1:7", "e"), "1:9": ("1:7", "f"),
    }
    assert {r.old_id: r.new_id for r in got["redirects"].collect()} == {"1:2": "1:1", "1:4": "1:1", "1:5": "1:1"}
    assert {r.node_id: r.child_ids for r in got["children"].collect()} == {"1:0": ["1:1", "1:7"], "1:1": ["1:3", "1:6"], "1:7": ["1:8", "1:9"]}


def test_two_groups_on_one_node_keep_both_texts(spark):
    got = curate(spark, LINES, to_merge=[["subtree_0_leaf_0", "subtree_1_leaf_0"], ["subtree_0_leaf_1", "subtree_2_leaf_0"]])
    assert state(got) == {"1:0": (None, "top"), "1:1": ("1:0", "p\na\nq\nc\np\nb\nr\ne"), "1:6": ("1:1", "d"), "1:9": ("1:1", "f")}


def test_chained_groups_end_in_one_node(spark):
    got = curate(spark, LINES, to_merge=[["subtree_0_leaf_1", "subtree_0_leaf_0"], ["subtree_0_leaf_0", "subtree_0_leaf_1"]])
    kept = state(got)
    assert set(kept) == {f"1:{k}" for k in range(10)} - {"1:3"} and kept["1:2"][1] == "b\na\na\nb"


def test_merge_into_a_node_below(spark):
    """The survivor takes the place of its own ancestor, whatever lies between."""
    lines = ["- top", "  - p", "    - mid", "      - q", "        - a", "        - b", "    - c"]
    got = curate(spark, lines, to_merge=[["subtree_0_leaf_0", "subtree_1_leaf_0"]])
    assert state(got) == {"1:0": (None, "top"), "1:2": ("1:3", "mid"), "1:3": ("1:0", "q\na\np\nc"), "1:5": ("1:3", "b")}


def test_removals_reach_the_child_lists(spark):
    got = curate(spark, LINES, to_remove=["subtree_0_leaf_0", "subtree_7_leaf_7"])
    assert "1:2" not in state(got) and {r.node_id: r.child_ids for r in got["children"].collect()}["1:1"] == ["1:3"]
    nodes = spark.createDataFrame([("a", None, ["b", "c"]), ("b", "a", None), ("c", "a", None)], "node_id string, parent_id string, child_ids array<string>")
    kept = graph.apply_removals(nodes, spark.createDataFrame([("b",)], "node_id string"))
    assert sorted((r.node_id, r.child_ids) for r in kept.collect()) == [("a", ["c"]), ("c", None)]
    assert graph.apply_removals(nodes.drop("child_ids"), spark.createDataFrame([("b",)], "node_id string")).count() == 2


def test_totals_and_rejects(spark):
    got = curate(spark, LINES)
    assert got["totals"].first().asDict() == {"decisions": 2, "rejects": 1, "tokens": 12}
    assert [r.component_id for r in got["rejects"].collect()] == ["9:9"] and len(state(got)) == len(LINES)


def test_redirect_cycles_and_long_chains(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "a"), ("k1", "k2"), ("k2", "k3"), ("z", "k2"), ("k2", "k9")] + [(f"m{k:03}", f"m{k + 1:03}") for k in range(100)]
    got = {r.old_id: r.new_id for r in graph.redirect_ids(spark.createDataFrame(pairs, "old_id string, new_id string")).collect()}
    want = {"b": "a", "c": "a", "k1": "k3", "k2": "k3", "z": "k3"} | {f"m{k:03}": "m100" for k in range(100)}
    assert got == want


def test_last_of_parallel_edges(spark):
    e = spark.createDataFrame([("a", "Z", "b", 1), ("a", "A", "b", 2)], "src string, rel string, dst string, seq long")
    nodes = spark.createDataFrame([("a", "chunk", None, None, "x"), ("b", "entity", "n", "T", None)], "node_id string, kind string, name string, type string, text string")
    assert [r.rel for r in graph.viz_subgraph(graph.endpoints(e), e, nodes, "seq")[1].collect()] == ["A"]
    assert [r.rel for r in graph.viz_subgraph(graph.endpoints(e), e, nodes)[1].collect()] == ["Z"]
