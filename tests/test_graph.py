"""Graph loops against plain models; the decision rules on hand cases."""

import random

import pytest
from pyspark.sql import functions as F

from fernlake.operators import conversation, graph, retrieval, traces
from fernlake.operators.components import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for x in parent}


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_khop(spark):
    edges = [("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d"), ("c", "MENTIONS", "a"), ("d", "S", "e")]
    got = graph.khop_relations(spark.createDataFrame([(1, 1, "a")], "query_id long, seed_no long, seed string"), spark.createDataFrame(edges, "src string, rel string, dst string"), depth=2)
    assert sorted((r.src, r.dst) for r in got.collect()) == [("a", "b"), ("b", "c")]


def test_redirect_chain(spark):
    got = graph.redirect_ids(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("q", "q")], "old_id string, new_id string"))
    assert sorted((r.old_id, r.new_id) for r in got.collect()) == [("a", "c"), ("b", "c"), ("x", "y")]


def test_curation_hand_case(spark):
    lines = [("1", 0, "- top"), ("1", 1, "  - p"), ("1", 2, "    - a"), ("1", 3, "    - b"), ("1", 4, "  - q"), ("1", 5, "    - c")]
    from fernlake.operators import outline

    nodes = outline.build_nodes(spark.createDataFrame(lines, "source string, line_number int, line string"))
    decision = '{"to_merge": [["subtree_0_leaf_0", "subtree_0_leaf_1"]], "to_remove": ["subtree_1_leaf_0", "subtree_9_leaf_9"], "triplets": [{"subject": "S", "subject_type": "CONCEPT", "predicate": "USES", "object": "O", "object_type": "METHOD", "subject_source_id": "subtree_0_leaf_0", "object_source_id": "subtree_0_leaf_1"}]}'
    table = spark.createDataFrame([("1:0", decision), ("2:0", "{bad")], "component_id string, decision_json string")
    got = graph.curate_graph(nodes, table)
    assert sorted((r.node_id, r.clean) for r in got["nodes"].collect()) == [("1:0", "top"), ("1:1", "p"), ("1:2", "a\nb"), ("1:4", "q")]
    assert [tuple(r) for r in got["redirects"].collect()] == [("1:3", "1:2")]
    assert {r.name: r.source_node_id for r in got["entities"].collect()} == {"S": "1:2", "O": "1:2"}
    assert got["relations"].count() == 3 and got["rejects"].count() == 1


def test_topk_has_no_cross_product_left(spark):
    v = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(50)], "item_id long, embedding array<float>")
    got = retrieval.vector_topk(v.where("item_id < 2").withColumnRenamed("item_id", "query_id"), v, k=3).collect()
    assert len(got) == 6 and all(r.query_id != r.item_id for r in got)


def test_route_rules(spark):
    rows = [
        (1, "", True, True, False, None, "mentor"), (2, "x [RESEARCH_COMPLETE]", False, False, True, None, None), (3, "", False, False, True, None, None), (4, "get_subgraphs_to_visualize", False, False, False, None, None),
        (5, "", False, False, False, None, "visualizer"), (6, "", False, False, False, "[MENTOR]", None), (7, "", False, False, False, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, context string, new_message boolean, sources_exhausted boolean, retriever_empty boolean, last_agent string, decision string")
    got = {r.id: r.next_step for r in conversation.route_turn(df).collect()}
    assert got == {1: "mentor", 2: "analyst", 3: "researcher", 4: "visualizer", 5: "retriever", 6: "__end__", 7: "retriever"}


def test_run_node_depth(spark):
    runs = [(str(k), str(k - 1) if k else None, "n" if k == 0 else None, 5 if k == 0 else None) for k in range(10)]
    got = {r.run_id: r.node for r in traces.run_node(spark.createDataFrame(runs, "run_id string, parent_run_id string, node string, step long")).collect()}
    assert got == {str(k): "n" if k < 8 else "?" for k in range(10)}


def test_register_functions(spark):
    from fernlake.functions import register

    register.register_functions(spark)
    assert spark.sql("select normalize_whitespace('a \t b ') as s, truncate_marked('abcd', 2) as t").first() == ("a b", "ab\n... [+2 chars truncated]")


def test_stream_equals_batch(spark, tmp_path):
    from fernlake.plans import fixtures as fx
    from fernlake.streaming import streams

    events = fx.token_events(spark, "/root/testdata/sf0.001")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    q = streams.token_accumulate_stream(spark.readStream.schema(streams.EVENT_SCHEMA).parquet(str(tmp_path / "in")))
    q = q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    want = {(r.thread_id, r.agent, r.run_no): r.response for r in streams.token_accumulate(events).collect()}
    got = {(r.thread_id, r.agent, r.run_no): r.response for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_embed_default(spark):
    got = {r.k: r.embedding for r in retrieval.embed_batch(spark.createDataFrame([(1, "a b b"), (2, None)], "k long, text string"), dims=8).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and got[2] == [0.0] * 8


def test_embed_hook(spark):
    got = retrieval.embed_batch(spark.createDataFrame([(1, "abc")], "k long, text string"), lambda s: s.map(lambda x: [float(len(x))]))
    assert got.first().embedding == [3.0]


def test_latency_stream_equals_batch(spark, tmp_path):
    from fernlake.plans import fixtures as fx
    from fernlake.streaming import streams

    runs = fx.runs(spark, "/root/testdata/sf0.001").select("run_type", "name", "latency", "start_time")
    runs.write.parquet(str(tmp_path / "in"))
    q = streams.run_latency_stream(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("latencies").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.day, r.name, r.n, r.total, r.least, r.most)
    assert sorted(map(key, spark.table("latencies").collect())) == sorted(map(key, streams.run_latency_stream(runs).collect()))


def brute_khop(seeds, edges, depth, limit):
    use = {e for e in edges if e[1] != "MENTIONS"}
    near = {}
    for a, _, b in use:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for q in sorted({s[0] for s in seeds}):
        rows = set()
        for _, no, seed in (s for s in seeds if s[0] == q):
            ball = {seed}
            for _ in range(depth - 1):
                ball |= {x for n in ball for x in near.get(n, ())}
            rows |= {(no, a, r, b, seed) for a, r, b in use if a in ball or b in ball}
        rows = sorted(rows)
        out += [(q, no, seed, a, r, b) for no, a, r, b, seed in (rows if limit is None else rows[:limit])]
    return sorted(out)


@pytest.mark.parametrize(("depth", "limit"), [(1, 4), (2, 5), (2, None), (3, 9), (2, 400)])
def test_khop_against_brute_force(spark, depth, limit):
    rng = random.Random(depth)
    edges = [(f"n{rng.randrange(40)}", rng.choice(["A", "B", "MENTIONS"]), f"n{rng.randrange(40)}") for _ in range(70)]
    edges += [("hub", "A", f"h{k}") for k in range(200)] + [(f"n{k}", "A", "hub") for k in range(3)] + edges[:10]
    seeds = [(q, no, f"n{rng.randrange(44)}") for q in range(6) for no in range(4)] + [(7, 0, "hub"), (8, 0, "nowhere"), (8, 1, "n1"), (9, 0, "h5")]
    got = graph.khop_relations(spark.createDataFrame(seeds, "query_id long, seed_no long, seed string"), spark.createDataFrame(edges, "src string, rel string, dst string"), depth, limit)
    assert sorted(map(tuple, got.select("query_id", "seed_no", "seed", "src", "rel", "dst").collect())) == brute_khop(seeds, edges, depth, limit)


def test_a_hub_stays_closed(spark):
    """Of a node with many edges only the first ones reach the last join."""
    edges = spark.range(300_000).select(F.lit("hub").alias("src"), F.lit("A").alias("rel"), F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("dst"))
    edges = edges.union(spark.createDataFrame([("s", "A", "hub")], "src string, rel string, dst string"))
    first = graph._first_edges(edges, spark.createDataFrame([("hub",), ("s",)], "node string"), 30)
    assert first.count() == 31
    got = graph.khop_relations(spark.createDataFrame([(1, 0, "s")], "query_id long, seed_no long, seed string"), edges)
    assert [r.dst for r in got.orderBy("src", "rel", "dst").collect()] == [f"x{k:07d}" for k in range(30)]


def test_decisions_of_another_shape_are_rejected(spark):
    good = ['{"to_remove": ["a"], "to_merge": [["a", "b"]], "triplets": []}', "```json\n{}\n```", '{"to_remove": null, "other": 3}', '{"triplets": [{"subject": "x", "object": null}]}', '{"to_merge": [[]]}']
    bad = ["[]", "3", '{"to_merge": "x"}', '{"to_remove": [1]}', '{"to_merge": ["a"]}', '{"triplets": ["x"]}', "{bad", '"text"', "", None, '{"triplets": {"a": 1}}']
    df = spark.createDataFrame([(f"g{k}", x) for k, x in enumerate(good)] + [(f"b{k}", x) for k, x in enumerate(bad)], "component_id string, decision_json string")
    assert {r.component_id for r in graph.parse_decisions(df).collect()} == {f"g{k}" for k in range(len(good))}
    assert {r.component_id for r in graph.rejected_decisions(df).collect()} == {f"b{k}" for k in range(len(bad))}


def test_subtrees_of_one_large_component(spark):
    """One component of many parents, one of which has most leaves; several sources share line numbers."""
    rng = random.Random(4)
    rows = [("root", None, 0, "root")]
    for k in range(300):
        rows.append((f"p{k}", "root", rng.randrange(20_000), f"parent {k}"))
    for k in range(6_000):
        rows.append((f"n{k}", "p7" if k % 2 else f"p{rng.randrange(280)}", rng.randrange(20_000), f"leaf {k}"))
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, line_number int, clean string")
    got = {r.node_id: (r.subtree_no, r.leaf_no, r.label) for r in graph.tail_subtrees(nodes, nodes.select("node_id", F.lit("c").alias("component_id"))).collect()}
    inner = {p for _, p, _, _ in rows if p}
    children = {}
    for node, parent, line, _ in rows:
        if parent and node not in inner:
            children.setdefault(parent, []).append((line, node))
    want = {}
    for s, parent in enumerate(sorted(children, key=lambda p: (min(children[p])[0], p))):
        for n, (_, node) in enumerate(sorted(children[parent])):
            want[node] = (s, n, f"subtree_{s}_leaf_{n}")
    assert got == want
