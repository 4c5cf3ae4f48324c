"""Property-graph operators over nodes(node_id, ...) and edges(src, rel, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake.functions import text as tx
from fernlake.operators.components import components
from fernlake.operators.outline import child_lists
from fernlake.plans.scratch import Scratch
from fernlake.plans.skew import dealt_anew, numbered

DECISION = "struct<to_merge:array<array<string>>,to_remove:array<string>,triplets:array<struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,subject_source_id:string,object_source_id:string>>>"

#: Lines of a stretch within which leaves are numbered by one task.
SPAN = 4096


def implicit_edges(nodes: DataFrame) -> DataFrame:
    """CHILD edges from parent to child and PARENT edges back, from the parent column."""
    rows = nodes.where("parent_id is not null")
    down = rows.select(F.col("parent_id").alias("src"), F.lit("CHILD").alias("rel"), F.col("node_id").alias("dst"))
    return down.union(rows.select(F.col("node_id").alias("src"), F.lit("PARENT").alias("rel"), F.col("parent_id").alias("dst")))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()


def drop_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "node_id", "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node_id, component_id): weakly connected components, named by their smallest node."""
    return components(edges, "src", "dst", sweep=True).withColumnsRenamed({"node": "node_id", "component": "component_id"})


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree; parallel edges of one direction count once."""
    once = edges.select("src", "dst").distinct()
    ends = once.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(once.select("dst", F.lit(0), F.lit(1)))
    out = ends.groupBy("node_id").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    return endpoints(edges).join(edges.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti")


def assert_single_parent(edges: DataFrame) -> DataFrame:
    """Leaves with more than one predecessor, which the curation refuses."""
    pred = edges.select("src", F.col("dst").alias("node_id")).distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("n_parents"))
    return leaves(edges).join(pred.where("n_parents > 1"), "node_id")


def tail_subtrees(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Leaves grouped by parent: component, subtree and leaf numbers and the label of each leaf.

    `nodes` has node_id, parent_id, line_number and, if wanted, clean; `placed` is (node_id, component_id).  Parents and
    leaves are numbered in stretches of lines, so that no task holds a component or a parent's children.
    """
    inner = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    leaf = nodes.where("parent_id is not null").join(inner, "node_id", "left_anti").join(placed, "node_id")
    clean = ["clean"] if "clean" in nodes.columns else []
    leaf = leaf.select("component_id", "node_id", "parent_id", "line_number", *clean)
    stretch = lambda c: F.floor(F.col(c) / SPAN)
    parents = leaf.groupBy("component_id", "parent_id").agg(F.min("line_number").alias("first_line"))
    parents = numbered(parents, "subtree_no", ["component_id"], stretch("first_line"), "first_line", "parent_id")
    parents = dealt_anew(parents.select("component_id", "parent_id", F.expr("int(subtree_no - 1)").alias("subtree_no")), "component_id", "parent_id")
    out = numbered(leaf, "leaf_no", ["component_id", "parent_id"], stretch("line_number"), "line_number", "node_id").withColumn("leaf_no", F.expr("int(leaf_no - 1)"))
    out = out.join(parents, ["component_id", "parent_id"])
    label = F.concat(F.lit("subtree_"), F.col("subtree_no"), F.lit("_leaf_"), F.col("leaf_no"))
    return out.select("component_id", "subtree_no", "leaf_no", "node_id", "parent_id", "line_number", *clean, label.alias("label"))


def subtree_blocks(subtrees: DataFrame) -> DataFrame:
    """One text per component: a heading per subtree and a line per leaf."""
    line = F.concat(F.lit("leaf_"), F.col("leaf_no"), F.lit(": (line "), F.col("line_number"), F.lit(') "'), F.col("clean"), F.lit('"'))
    rows = F.array_sort(F.collect_list(F.struct("leaf_no", line.alias("line"))))
    each = subtrees.groupBy("component_id", "subtree_no").agg(F.array_join(rows["line"], "\n").alias("body"))
    each = each.withColumn("block", F.concat(F.lit("subtree_"), F.col("subtree_no"), F.lit(":\n"), F.col("body")))
    whole = F.array_sort(F.collect_list(F.struct("subtree_no", "block")))
    return each.groupBy("component_id").agg(F.array_join(whole["block"], "\n\n").alias("block"))


def _shaped() -> Column:
    """Whether a text is a JSON object whose known fields are of their types; an absent or null field is an empty one."""
    kind = lambda path: F.expr(f"schema_of_variant(try_variant_get(v, '{path}', 'variant'))")
    texts = ("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    ok = F.expr("v is not null") & F.expr("schema_of_variant(v)").startswith("OBJECT<") & F.coalesce(kind("$.to_remove").isin(*texts), F.lit(True))
    ok = ok & F.coalesce(kind("$.to_merge").isin("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>", *texts[1:]), F.lit(True))
    t = kind("$.triplets")
    return ok & F.coalesce(t.isin("ARRAY<VOID>", "VOID") | t.rlike("^ARRAY<OBJECT<([a-z_]+: (STRING|VOID)(, )?)*>>$"), F.lit(True))


def _judged(decisions: DataFrame) -> DataFrame:
    rows = decisions.withColumn("bare", tx.fence_strip(F.col("decision_json"))).withColumn("v", F.expr("try_parse_json(bare)"))
    return rows.withColumn("good", F.coalesce(_shaped(), F.lit(False))).drop("v")


def parse_decisions(decisions: DataFrame) -> DataFrame:
    """(component_id, decision); rows that are no JSON, or JSON of another shape, are left out.

    A decision is an object: `to_remove` lists labels, `to_merge` lists lists of labels, `triplets`
    lists objects of texts.  Absent fields are empty; unknown ones are ignored.
    """
    return _accepted(_judged(decisions))


def _accepted(judged: DataFrame) -> DataFrame:
    return judged.where("good").select("component_id", F.from_json(tx.fence_strip(F.col("decision_json")), DECISION).alias("decision"))


def rejected_decisions(decisions: DataFrame) -> DataFrame:
    """(component_id, decision_json) of the rows that `parse_decisions` leaves out."""
    return _judged(decisions).where(~F.col("good")).select("component_id", "decision_json")


def removed_nodes(parsed: DataFrame, subtrees: DataFrame) -> DataFrame:
    """(node_id) of labelled nodes to remove; labels that the component lacks are ignored."""
    gone = parsed.select("component_id", F.explode("decision.to_remove").alias("label")).distinct()
    return gone.join(subtrees, ["component_id", "label"]).select("node_id").distinct()


def apply_removals(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """The nodes without the removed ones; where nodes list their children (`child_ids`), these go from the lists too."""
    kept = nodes.join(removed, "node_id", "left_anti")
    if "child_ids" not in nodes.columns:
        return kept
    gone = nodes.where("parent_id is not null").join(removed, "node_id", "left_semi").groupBy("parent_id").agg(F.collect_set("node_id").alias("__gone"))
    kept = kept.join(gone.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
    less = F.filter("child_ids", lambda x: ~F.array_contains("__gone", x))
    return kept.withColumn("child_ids", F.when(F.col("__gone").isNull(), F.col("child_ids")).otherwise(less)).drop("__gone")


def merge_groups(parsed: DataFrame, subtrees: DataFrame) -> DataFrame:
    """One row per member of a merge group: group, position, node; groups of one known label are ignored."""
    groups = parsed.select("component_id", F.posexplode("decision.to_merge").alias("group_no", "labels"))
    member = groups.select("component_id", "group_no", F.posexplode("labels").alias("pos", "label"))
    known = member.join(subtrees, ["component_id", "label"])
    size = Window.partitionBy("component_id", "group_no")
    known = known.withColumn("n", F.count(F.lit(1)).over(size)).withColumn("n_subtrees", F.size(F.collect_set("subtree_no").over(size)))
    return known.where("n > 1").drop("n")


def merge_in_subtree(groups: DataFrame) -> DataFrame:
    """Groups within one subtree: the first node keeps all texts, one per line."""
    part = F.array_sort(F.collect_list(F.struct("pos", "clean", "node_id")))
    out = groups.where("n_subtrees = 1").groupBy("component_id", "group_no").agg(part.alias("m"))
    return out.select("component_id", "group_no", F.col("m")[0]["node_id"].alias("node_id"), F.array_join(F.col("m.clean"), "\n").alias("text"), F.slice(F.col("m.node_id"), 2, 1 << 30).alias("merged"))


def merge_across_subtrees(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups over several subtrees: the first leaf's parent keeps all texts.

    Whenever the subtree changes, the parent's own text leads its leaves' texts.  `merged` lists
    what goes: the leaves of the group and the other parents.
    """
    parent = nodes.select(F.col("node_id").alias("parent_id"), F.col("clean").alias("parent_text"))
    rows = groups.where("n_subtrees > 1").join(parent, "parent_id")
    order = Window.partitionBy("component_id", "group_no").orderBy("pos")
    rows = rows.withColumn("before", F.lag("subtree_no").over(order))
    piece = F.when(F.col("before").eqNullSafe(F.col("subtree_no")), F.col("clean")).otherwise(F.concat_ws("\n", "parent_text", "clean"))
    part = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"), "parent_id", "node_id")))
    out = rows.groupBy("component_id", "group_no").agg(part.alias("m"))
    first = F.col("m")[0]["parent_id"]
    gone = F.array_sort(F.array_except(F.array_union(F.col("m.node_id"), F.col("m.parent_id")), F.array(first)))
    return out.select("component_id", "group_no", first.alias("node_id"), F.array_join(F.col("m.piece"), "\n").alias("text"), gone.alias("merged"))


def redirect_ids(pairs: DataFrame) -> DataFrame:
    """(old_id, new_id) with chains of redirects followed to their end.

    Of several targets of one id the smallest counts.  A cycle has no end: all ids that lead into
    it go to the smallest of them.  Chains that meet end alike, so an end is looked up by component.
    """
    one = pairs.where("old_id != new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    with Scratch(pairs.sparkSession, sweep=True) as scratch:
        one = scratch.keep(one, "pairs")
        placed = components(one, "old_id", "new_id", sweep=True)
        ends = one.select(F.col("new_id").alias("node")).distinct().join(one.select(F.col("old_id").alias("node")), "node", "left_anti")
        ends = ends.join(placed, "node").select("component", F.col("node").alias("end"))
        out = placed.join(ends, "component", "left").select(F.col("node").alias("old_id"), F.coalesce("end", "component").alias("new_id"))
        return scratch.keep(out.where("old_id != new_id"), "redirects", last=True)


def reparent(nodes: DataFrame, redirects: DataFrame) -> DataFrame:
    """The nodes that stay, with parents that were merged away replaced by the nodes they were merged into.

    A node that took in some of its own ancestors takes the place of the topmost of them.
    """
    to = redirects.select(F.col("old_id").alias("parent_id"), F.col("new_id").alias("__new"))
    kind = nodes.schema["node_id"].dataType.simpleString()
    with Scratch(nodes.sparkSession, sweep=True) as scratch:
        inner = nodes.select(F.col("parent_id").alias("old_id")).distinct()
        took = redirects.join(inner, "old_id", "left_semi").select(F.col("new_id").alias("node_id")).distinct()
        tops = None
        if not took.limit(1).isEmpty():
            # (at, above, tops) of each inner node: `tops` maps a node to what lies above the topmost one it took in, of `at` and its
            # ancestors below `above`; by doubling, `above` moves twice as far up each round
            into = redirects.select(F.col("old_id").alias("at"), F.col("new_id").alias("into"))
            links = nodes.select(F.col("node_id").alias("at"), F.col("parent_id").alias("above")).join(inner.withColumnRenamed("old_id", "at"), "at", "left_semi").join(into, "at", "left")
            none = F.expr(f"cast(map() as map<{kind},struct<above:{kind}>>)")
            tops = F.when(F.col("into").isNotNull(), F.create_map("into", F.struct("above"))).otherwise(none)
            links = scratch.keep(links.select("at", "above", tops.alias("tops")), "links")
            while not links.where("above is not null").limit(1).isEmpty():
                up = dealt_anew(links.select(F.col("at").alias("above"), F.col("above").alias("beyond"), F.col("tops").alias("higher")), "above")
                far = links.join(up, "above", "left")
                both = F.when(F.col("higher").isNull(), F.col("tops")).otherwise(F.map_concat("higher", F.map_filter("tops", lambda k, v: ~F.map_contains_key("higher", k))))
                new = scratch.keep(far.select("at", F.col("beyond").alias("above"), both.alias("tops")), "links")
                scratch.drop(links)
                links = new
            start = nodes.select("node_id", F.col("parent_id").alias("at")).join(took, "node_id", "left_semi").where("at is not null")
            tops = start.join(dealt_anew(links, "at"), "at").select("node_id", F.col("tops")[F.col("node_id")].alias("t")).where("t is not null")
        out = nodes.join(redirects.select(F.col("old_id").alias("node_id")), "node_id", "left_anti")
        if tops is not None:
            top = tops.select("node_id", F.col("t.above").alias("above"), F.lit(True).alias("__top"))
            out = out.join(top, "node_id", "left").withColumn("parent_id", F.when(F.col("__top"), F.col("above")).otherwise(F.col("parent_id"))).drop("above", "__top")
        out = out.join(to, "parent_id", "left").withColumn("parent_id", F.coalesce("__new", "parent_id")).select(*nodes.columns)
        return scratch.keep(out, "nodes", last=True)


def triplet_rows(parsed: DataFrame, subtrees: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Triplets with the ids of their source chunks, resolved through labels and redirects."""
    t = parsed.select("component_id", F.posexplode("decision.triplets").alias("triplet_no", "t")).select("component_id", "triplet_no", "t.*")
    at = subtrees.select("component_id", "label", "node_id")
    for end in ("subject", "object"):
        t = t.join(at.select("component_id", F.col("label").alias(f"{end}_source_id"), F.col("node_id").alias(f"{end}_chunk")), ["component_id", f"{end}_source_id"])
        if redirects is not None:
            r = redirects.select(F.col("old_id").alias(f"{end}_chunk"), F.col("new_id").alias("r"))
            t = t.join(r, f"{end}_chunk", "left").withColumn(f"{end}_chunk", F.coalesce("r", f"{end}_chunk")).drop("r")
        t = t.withColumn(f"{end}_id", tx.entity_id(F.col(f"{end}_type"), F.col(end)))
    return t


def upsert_entities(triplets: DataFrame) -> DataFrame:
    """Entities distinct by id; the first source by (component, triplet) wins."""
    ends = None
    for k, end in enumerate(("subject", "object")):
        part = triplets.select(F.col(f"{end}_id").alias("entity_id"), F.col(f"{end}_type").alias("label"), F.col(end).alias("name"), F.col(f"{end}_chunk").alias("source_node_id"), "component_id", "triplet_no", F.lit(k).alias("side"))
        ends = part if ends is None else ends.union(part)
    first = F.min_by("source_node_id", F.struct("component_id", "triplet_no", "side"))
    return ends.groupBy("entity_id", "label", "name").agg(first.alias("source_node_id"))


def upsert_triplets(triplets: DataFrame) -> DataFrame:
    """Relations between entities, and MENTIONS from each source chunk; distinct by (src, rel, dst)."""
    rel = triplets.select(F.col("subject_id").alias("src"), F.col("predicate").alias("rel"), F.col("object_id").alias("dst"))
    for end in ("subject", "object"):
        rel = rel.union(triplets.select(F.col(f"{end}_chunk"), F.lit("MENTIONS"), F.col(f"{end}_id")))
    return rel.distinct()


def _touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, src, rel, dst): the edges at some nodes, by each end that is among them."""
    end = lambda c: F.struct(F.col(c).alias("node"), "src", "rel", "dst")
    return edges.select(F.inline(F.array(end("src"), end("dst")))).join(nodes, "node", "left_semi")


def _first_edges(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The first distinct edges at each of some nodes; all but `most` of a hub's are left out before the shuffle by node."""
    order = Window.partitionBy("node").orderBy("src", "rel", "dst")
    once = _touching(edges, nodes).distinct()
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def khop_relations(seeds: DataFrame, edges: DataFrame, depth: int = 2, limit: int | None = 30, forbidden: str = "MENTIONS", ignore_rels: tuple[str, ...] = ()) -> DataFrame:
    """Relations on undirected paths of length 1..depth from each seed, without forbidden relations.

    `seeds` has query_id, seed_no, seed.  Per query at most `limit` rows, in order of seed_no, src, rel,
    dst; `ignore_rels` are dropped after the limit.  With a limit, only what can be among a query's
    first rows is expanded: a seed is left out when the edges at earlier seeds alone
    reach the limit; of the nodes within depth - 1 those count whose first edges are the `limit` least,
    and of these the first `limit` edges each.  So a hub near a seed stays closed but for its first edges, and
    no copy of the edges is made.
    """
    spark, keys = seeds.sparkSession, ["query_id", "seed_no", "seed"]
    use = edges.where(F.col("rel") != forbidden).select("src", "rel", "dst")
    nodes = lambda df, c="node": df.select(F.col(c).alias("node")).distinct()
    with Scratch(spark) as scratch:
        start = scratch.keep(seeds.select(*keys).distinct(), "seeds")
        if limit is not None:
            degree = _first_edges(use, nodes(start, "seed"), limit).groupBy(F.col("node").alias("seed")).agg(F.count(F.lit(1)).alias("degree"))
            placed = start.join(degree, "seed")
            before = Window.partitionBy("query_id").orderBy("seed_no").rowsBetween(Window.unboundedPreceding, -1)
            enough = placed.groupBy("query_id", "seed_no").agg(F.sum("degree").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            enough = enough.where(F.col("before") < limit).select(F.col("query_id").alias("q"), F.col("seed_no").alias("s"))
            start = placed.join(enough, F.col("query_id").eqNullSafe(F.col("q")) & F.col("seed_no").eqNullSafe(F.col("s")), "left_semi").select(*keys)
        ball = scratch.keep(start.withColumn("node", F.col("seed")), "ball")
        edge = ball
        for _ in range(depth - 1):
            near = _touching(use, nodes(edge)).select("node", F.when(F.col("src") == F.col("node"), F.col("dst")).otherwise(F.col("src")).alias("to")).distinct()
            step = edge.join(near, "node").select(*keys, F.col("to").alias("node")).distinct()
            edge = scratch.keep(step.join(ball, [*keys, "node"], "left_anti"), "frontier")
            ball = ball.unionByName(edge)
        if limit is None:
            touch = ball.join(_touching(use, nodes(ball)), "node")
        else:
            first = _touching(use, nodes(ball)).groupBy("node").agg(F.min(F.struct("src", "rel", "dst")).alias("first"))
            order = Window.partitionBy("query_id", "seed_no").orderBy("first")
            near = ball.join(first, "node").withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= limit).select(*keys, "node")
            near = scratch.keep(near, "near")
            touch = near.join(_first_edges(use, nodes(near), limit), "node")
        touch = touch.select(*keys, "src", "rel", "dst").distinct()
        if limit is not None:
            order = Window.partitionBy("query_id").orderBy("seed_no", "src", "rel", "dst")
            touch = touch.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
        if ignore_rels:
            touch = touch.where(~F.col("rel").isin(*ignore_rels))
        return scratch.keep(touch, "relations", last=True)


def node_labels(nodes: DataFrame, most: int = 60) -> DataFrame:
    """Display label of each node: entities by name and type, chunks by their first line, others by id."""
    name = F.when(F.coalesce("type", F.lit("")) != "", F.concat("name", F.lit(" ["), "type", F.lit("]"))).otherwise(F.col("name"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: tx.strip(F.regexp_replace(tx.strip(x), "^#+", ""))), lambda x: x != "")
    bare = F.regexp_replace("node_id", r"\(Label:[^)]*\)$", "")
    label = F.when(F.col("kind") == "entity", name).when(F.col("kind") == "chunk", F.coalesce(F.get(lines, F.lit(0)), bare)).otherwise(bare)
    out = nodes.withColumn("label", label)
    return out.withColumn("short", F.when(F.length("label") > most, F.concat(F.substring("label", 1, most - 1), F.lit("…"))).otherwise(F.col("label")))


def viz_subgraph(ids: DataFrame, triplets: DataFrame, nodes: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to draw: listed ids and triplet ends; of parallel edges the last by `order` stays, or by name without one."""
    want = ids.select("node_id").union(endpoints(triplets)).distinct()
    drawn = node_labels(want.join(nodes, "node_id", "left"))
    last = F.max_by("rel", F.struct(order, "rel")) if order else F.max("rel")
    edges = triplets.groupBy("src", "dst").agg(last.alias("rel"))
    return drawn, edges


def viz_tables(drawn: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chart rows: nodes with their degree, edges with a hover text and readable tree relations."""
    rows = drawn.join(degrees(edges).select("node_id", "degree"), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rel = F.when(F.col("rel") == "CHILD", "HAS CHILD").when(F.col("rel") == "PARENT", "HAS PARENT").otherwise(F.col("rel"))
    names = drawn.select("node_id", "short")
    out = edges.join(names.withColumnsRenamed({"node_id": "src", "short": "a"}), "src").join(names.withColumnsRenamed({"node_id": "dst", "short": "b"}), "dst")
    return rows, out.select("src", "dst", rel.alias("rel"), F.concat("a", F.lit(" → "), rel, F.lit(" → "), "b").alias("hover"))


def node_lookup(nodes: DataFrame, ids: DataFrame | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """Nodes by id and by exact property values, with their kind; null properties are removed.

    `nodes` has node_id, labels array, props map.
    """
    out = nodes.where("node_id is not null")
    if ids is not None:
        out = out.join(ids.select("node_id").distinct(), "node_id", "left_semi")
    for k, v in (properties or {}).items():
        out = out.where(F.col("props")[k] == v)
    label = F.get(F.filter("labels", lambda x: ~x.isin("__Node__", "__Entity__")), F.lit(0))
    out = out.withColumn("label", label).withColumn("props", F.map_filter("props", lambda k, v: v.isNotNull()))
    return out.withColumn("kind", F.when(F.map_contains_key("props", "text") | F.col("label").isNull(), "chunk").otherwise("entity")).drop("labels")


def attr_lookup(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text, path and line of each id; ids that are unknown keep nulls."""
    return ids.join(nodes.select("node_id", "clean", "line_number", "source"), "node_id", "left")


def curate_graph(nodes: DataFrame, decisions: DataFrame, placed: DataFrame | None = None) -> dict[str, DataFrame]:
    """All components at once: nodes that stay, child lists, entities, relations, redirects, rejects and totals.

    `nodes` has the columns of the outline with `child_ids` where wanted; `placed` is (node_id, component_id) where it is
    known.  Texts of several merge groups that end in one node are joined in the order of the groups.  Decisions that are
    no valid JSON, or of another shape, are rejected, their components stay as they are.  `totals` counts decisions,
    rejects and, where decisions have a column `tokens`, their tokens.

    What happens to each node is found on ids alone, and of texts only those of merge groups are read.  `nodes` is not copied:
    the nodes that stay are read from it, joined with what has changed, when they are read.
    """
    scratch = Scratch(nodes.sparkSession, sweep=True)
    links = scratch.keep(nodes.select("node_id", "parent_id", "line_number"), "links", last=True)
    if placed is None:
        placed = connected_components(implicit_edges(links).where("rel = 'CHILD'"))
    subtrees = scratch.keep(tail_subtrees(links, placed), "subtrees", last=True)
    # written, so that each decision is judged once, and not before `decisions` is made distinct
    judged = scratch.keep(_judged(decisions).drop("bare"), "judged", last=True)
    parsed = scratch.keep(_accepted(judged), "parsed", last=True)
    groups = scratch.keep(merge_groups(parsed, subtrees), "groups", last=True)
    wanted = groups.select("node_id").union(groups.select("parent_id")).distinct()
    texts = scratch.keep(nodes.select("node_id", "clean").join(wanted, "node_id", "left_semi"), "texts")
    groups = groups.join(texts, "node_id")
    merged = scratch.keep(merge_in_subtree(groups).union(merge_across_subtrees(groups, texts)), "merged", last=True)
    scratch.close()
    redirects = redirect_ids(merged.select(F.explode("merged").alias("old_id"), F.col("node_id").alias("new_id")))
    triplets = triplet_rows(parsed, subtrees, redirects)
    end = merged.join(redirects.select(F.col("old_id").alias("node_id"), F.col("new_id").alias("end")), "node_id", "left")
    each = F.array_sort(F.collect_list(F.struct("component_id", "group_no", "text")))
    new_text = end.groupBy(F.coalesce("end", "node_id").alias("node_id")).agg(F.array_join(each["text"], "\n").alias("merged_text"))
    removed = removed_nodes(parsed, subtrees)
    moved = reparent(links, redirects)
    stay = apply_removals(moved, removed).select("node_id", F.col("parent_id").alias("__parent")).join(new_text, "node_id", "left")
    if "child_ids" in nodes.columns:
        gone = moved.where("parent_id is not null").join(removed, "node_id", "left_semi").groupBy(F.col("parent_id").alias("node_id")).agg(F.collect_set("node_id").alias("__gone"))
        stay = stay.join(gone, "node_id", "left")
    stay = scratch.keep(stay, "stay", last=True)
    kept = nodes.join(stay, "node_id").withColumn("parent_id", F.col("__parent")).withColumn("clean", F.coalesce("merged_text", "clean"))
    if "child_ids" in nodes.columns:
        less = F.filter("child_ids", lambda x: ~F.array_contains("__gone", x))
        kept = kept.withColumn("child_ids", F.when(F.col("__gone").isNull(), F.col("child_ids")).otherwise(less))
    kept = kept.select(*nodes.columns)
    rejects = judged.where(~F.col("good")).select("component_id", "decision_json")
    tokens = F.sum("tokens") if "tokens" in decisions.columns else F.max(F.lit(None))
    totals = judged.agg(F.count(F.lit(1)).alias("decisions"), F.count_if(~F.col("good")).alias("rejects"), tokens.cast("long").alias("tokens"))
    return {
        "nodes": kept, "children": child_lists(kept), "entities": upsert_entities(triplets), "relations": upsert_triplets(triplets), "redirects": redirects,
        "rejects": rejects, "totals": totals,
    }
