"""Reply trees to conversations, in DataFrame operations only.

A reply table has a node id, its parent's id, a role, a text and a score.  Paths from root to
leaf are enumerated by self-joins that double: every node points to an ancestor and, in each
round, to that ancestor's ancestor, so a thread of depth d takes log2(d) rounds.  Branches are
ranked by the summed score of their path, and each chosen path becomes one string.

Template: ``### role: text</turn>`` and a line feed per turn.  In roles and texts a backslash, ``<``
and ``#`` are written as backslash and b, l or h (in roles a colon as backslash and c); no control
string can then occur inside, and the text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake.plans.scratch import Scratch

#: Fixed values of the template.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def reply_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, pos, node): the nodes of each root-to-leaf path, best branches first.

    `nodes` has tree, node, parent, score; node ids are unique within a tree.  A node whose
    parent is null or absent is a root.  A null score counts as 0.  Branches of a tree are ranked
    by the sum of scores along the path, ties by leaf id; `best` keeps that many per tree.
    Nodes on or below a cycle have no root and are on no path: the rounds end after log2 of the
    largest tree, by when every other node has met its root.
    """
    spark = nodes.sparkSession
    with Scratch(spark) as scratch:
        base = scratch.keep(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
        known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
        up = base.join(known, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).select("tree", "node", "parent", "score")
        total = scratch.keep(base.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
        rounds = (total.agg(F.max("n")).first()[0] or 1).bit_length() + 1
        # pointer doubling: depth and path score of every node
        depth = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
        cur = scratch.keep(up.select("tree", "node", F.col("parent").alias("anc"), depth.alias("depth"), "score"), "jump")
        for _ in range(rounds):
            if cur.where("anc is not null").limit(1).isEmpty():
                break
            done, open_ = cur.where("anc is null"), cur.where("anc is not null")
            far = cur.select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("d2"), F.col("score").alias("s2"))
            step = open_.join(far, ["tree", "anc"]).select("tree", "node", F.col("anc2").alias("anc"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("score") + F.col("s2")).alias("score"))
            new = scratch.keep(done.select("tree", "node", "anc", "depth", "score").union(step), "jump")
            scratch.drop(cur)
            cur = new
        rooted = cur.where("anc is null").select("tree", "node", "depth", "score")
        inner = base.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
        leaves = rooted.join(inner, ["tree", "node"], "left_anti")
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
        ranked = leaves.withColumn("rank", F.row_number().over(order))
        if best is not None:
            ranked = ranked.where(F.col("rank") <= best)
        # a tree of one path is the path: its nodes by depth; others climb by doubling from each leaf
        ranked = scratch.keep(ranked.select("tree", F.col("node").alias("leaf"), "rank", "depth", "score"), "leaves")
        single = ranked.join(total, "tree").where("n = depth + 1").select("tree", "leaf", "rank")
        straight = rooted.join(single, "tree").select("tree", "leaf", "rank", F.col("depth").alias("pos"), "node")
        bent = ranked.join(total, "tree").where("n > depth + 1").select("tree", "leaf", "rank", F.col("leaf").alias("node"), "depth")
        if bent.limit(1).isEmpty():
            return scratch.keep(straight, "paths", last=True)
        links = up.where("parent is not null").join(bent.select("tree").distinct(), "tree", "left_semi")
        return scratch.keep(straight.union(_climb(scratch, bent, links, rounds)), "paths", last=True)


def _climb(scratch: Scratch, leaves: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """All ancestors of each leaf with their depth; the set of found nodes doubles each round."""
    jump = scratch.keep(links.select("tree", "node", F.col("parent").alias("anc")), "links")
    found = scratch.keep(leaves.select("tree", "leaf", "rank", F.col("depth").alias("pos"), "node"), "climb")
    far = 1
    for _ in range(rounds):
        if jump.limit(1).isEmpty():
            break
        more = found.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", (F.col("pos") - far).alias("pos"), F.col("anc").alias("node"))
        new = scratch.keep(found.union(more), "climb")
        scratch.drop(found)
        found = new
        second = jump.select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        nxt = scratch.keep(jump.join(second, ["tree", "anc"]).select("tree", "node", F.col("anc2").alias("anc")), "links")
        scratch.drop(jump)
        jump = nxt
        far *= 2
    return found.select("tree", "leaf", "rank", "pos", "node")


def format_paths(paths: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per path: keys, formatted text and loss spans (code points) of assistant texts.

    `paths` has the keys, tree, pos and node; `turns` has tree, node, role and text.  Null roles
    and texts count as empty.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(":"), F.lit("\\c"))
    head = F.concat(F.lit(OPEN), role, F.lit(COLON))
    body = escape(F.coalesce("text", F.lit("")))
    rows = paths.join(turns.select("tree", "node", "role", "text"), ["tree", "node"])
    rows = rows.select(*keys, "pos", head.alias("head"), body.alias("body"), F.coalesce(F.lower("role") == "assistant", F.lit(False)).alias("learn"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))
    part = F.struct("pos", "piece", F.when(F.col("learn"), span).alias("span"))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda x: x.isNotNull())
    return whole.select(*keys, F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(p):
        inner = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        at = F.locate(COLON, inner)
        role = F.replace(F.substring(inner, F.lit(1), at - 1), F.lit("\\c"), F.lit(":"))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(inner, at + len(COLON), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A flat message table as a reply table: each row answers the row before it in its conversation.

    Order is by turn, then role, then text, nulls first; repeated rows stay turns of their own.
    """
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    rows = messages.select(F.col(conv).alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def format_conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans of every chosen path of each conversation.

    Conversations with a null id form one conversation with a null id.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    spark = messages.sparkSession
    with Scratch(spark) as scratch:
        named = messages.withColumn("conv_id", F.struct("conv_id"))  # a struct, so that a null id joins
        nodes = scratch.keep(threads(named), "turns", last=True)
        paths = reply_paths(nodes, best)
        out = format_paths(paths, nodes, ["tree", "leaf", "rank"])
        return out.select(F.col("tree.conv_id").alias("conv_id"), "leaf", "rank", "formatted", "loss_spans")
