"""Outlines to trees: indented lines to nodes with depth, parent and breadcrumb path.

Lines are taken in segments, so that one long source is the work of many tasks.  Within a segment
a line's depth follows from windows and its parent from a fold with a stack of open lines; what a
segment leaves open is a short summary, and summaries are folded in the same way.

``build_nodes`` writes one table, of segments with their lines as they came, and depths and ancestors as
numbers.  Texts, paths and counts are worked out as that table is read, so that no text is written or
shuffled a second time but in sources of several segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake.functions import text as tx
from fernlake.plans.scratch import Scratch
from fernlake.plans.skew import dealt_anew

#: Lines that are folded together.
SEGMENT = 512


def outline_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(source, line_number, line) of each line, numbered from 0."""
    return docs.select(F.col(id_col).cast("string").alias("source"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_number", "line"))


def drop_blank_rules(lines: DataFrame) -> DataFrame:
    bare = tx.strip(F.col("line"))
    return lines.where((bare != "") & ~bare.startswith("---"))


def line_features(lines: DataFrame, image_host: str | None = None, check_url: bool = True) -> DataFrame:
    """Kept lines with indent, header level, raw and clean text and the URL flag.

    A line that is nothing but an image of `image_host` gets a mark as its text; without a host none does.
    """
    return _described(drop_blank_rules(lines), image_host, check_url)


def _described(rows: DataFrame, image_host: str | None, check_url: bool = True) -> DataFrame:
    out = rows.withColumn("indent", tx.indent_level(F.col("line"))).withColumn("header", tx.header_level(F.col("line")))
    out = out.withColumn("has_unparsed_url", F.col("line").contains("http") if check_url else F.lit(False))
    return out.withColumn("raw", tx.strip_bullets(F.col("line"))).withColumn("clean", _clean(F.col("raw"), image_host))


def _clean(raw: Column, image_host: str | None) -> Column:
    clean = tx.clean_text(raw)
    return clean if image_host is None else tx.mask_images(clean, raw, image_host)


def _carried(headers: DataFrame) -> DataFrame:
    """(source, segment, before, carried): header levels in earlier segments, and the last bonus there.

    `headers` has source, segment, line_number and header of all lines; only sources of several segments are read on.
    """
    several = headers.where("segment > 0").select(F.col("source").alias("of")).distinct()
    rows = headers.join(several, F.col("source").eqNullSafe(F.col("of")), "left_semi")
    first = rows.where("header is not null").groupBy("source", "header").agg(F.min("segment").alias("first"))
    levels = first.groupBy(F.col("source").alias("of")).agg(F.collect_list(F.struct("header", "first")).alias("levels"))
    inside = F.array_sort(F.collect_list(F.when(F.col("header").isNotNull(), F.struct("line_number", "header"))))["header"]
    each = rows.groupBy("source", "segment").agg(inside.alias("inside")).join(levels, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    none = F.expr("cast(array() as array<int>)")
    before = F.coalesce(F.transform(F.filter("levels", lambda x: x["first"] < F.col("segment")), lambda x: x["header"]), none)
    n = F.size("inside")
    seen = F.array_union("before", F.slice("inside", F.lit(1), F.greatest(n - 1, F.lit(0))))
    bonus = F.when(n > 0, F.size(F.filter(seen, lambda x: x < F.element_at("inside", -1))))
    each = each.withColumn("before", before).withColumn("bonus", bonus)
    earlier = Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    out = each.withColumn("carried", F.last("bonus", ignorenulls=True).over(earlier))
    return out.select(F.col("source").alias("of"), F.col("segment").alias("at"), "before", "carried")


def outline_depth(features: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """depth = indent + bonus; rows whose raw text is empty are dropped after the headers were tracked.

    A header of level L has as bonus the number of distinct smaller levels before it; other
    lines have the last header's bonus + 1, or 0 before any header.  Windows run over segments of lines, and
    what earlier segments of a long source hold is joined to them.
    """
    rows = features.withColumn("segment", F.floor(F.col("line_number") / segment))
    carried = _carried(rows.select("source", "segment", "line_number", "header")).where("at > 0")
    rows = rows.join(carried, F.col("source").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("at")), "left")
    w = Window.partitionBy("source", "segment").orderBy("line_number")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    levels = F.array_union(F.coalesce("before", F.expr("cast(array() as array<int>)")), F.collect_set("header").over(before))
    seen = F.size(F.filter(levels, lambda x: x < F.col("header")))
    out = rows.withColumn("bonus", F.when(F.col("header").isNotNull(), seen))
    last = F.coalesce(F.last(F.col("bonus") + 1, ignorenulls=True).over(upto), F.col("carried") + 1, F.lit(0))
    out = out.withColumn("depth", F.col("indent") + F.coalesce("bonus", last))
    return out.where("raw != ''").drop("bonus", "segment", "of", "at", "before", "carried")


#: A fold over lines in order: `s` has the lines still open, `p` the parent of each line and `a` the places of its ancestors in `lines`.
_FOLD = """
aggregate(lines, named_struct('s', cast(array() as array<struct<d:int,l:bigint,i:int>>), 'p', cast(array() as array<bigint>), 'a', cast(array() as array<array<int>>)),
  (a, x) -> element_at(transform(array(filter(a.s, y -> y.d < x.depth)), open -> named_struct(
    's', concat(open, array(named_struct('d', x.depth, 'l', cast(x.line_number as bigint), 'i', size(a.p)))), 'p', concat(a.p, array(try_element_at(open, -1).l)), 'a', concat(a.a, array(open.i)))), 1))
"""

#: What is added to the indent of each line: by the levels seen and the last header's bonus, as in `outline_depth`.
_ADDED = """
aggregate(lines, named_struct('v', coalesce(before, cast(array() as array<int>)), 'b', coalesce(carried + 1, 0), 'd', cast(array() as array<int>)),
  (a, x) -> element_at(transform(array(if(x.header is null, a.b, size(filter(a.v, y -> y < x.header)))), own -> named_struct(
    'v', if(x.header is null, a.v, array_union(a.v, array(x.header))), 'b', if(x.header is null, a.b, own + 1), 'd', concat(a.d, array(x.indent + own)))), 1)).d
"""


def _folded(rows: DataFrame, *names: str) -> DataFrame:
    """(source, segment, lines, open, parents) of each segment; `lines` are structs of line_number, depth and `names`."""
    lines = F.array_sort(F.collect_list(F.struct("line_number", "depth", *names))).alias("lines")
    out = rows.groupBy("source", "segment").agg(lines).withColumn("f", F.expr(_FOLD))
    return out.select("source", "segment", "lines", F.col("f.s").alias("open"), F.col("f.p").alias("parents"))


def _far(scratch: Scratch, cur: DataFrame, reach: int) -> DataFrame | None:
    """(of, at, far): the parent of each line that has one in an earlier segment, by source and line number; None without such lines.

    `cur` holds folded segments.  A line without a parent in its segment is looked up among the lines that
    earlier segments leave open: these and the lines in question form a much shorter outline, which is folded
    in segments again, `reach` old ones to a new one, until each source is one segment.
    """
    found = None
    rows = cur.select("source", "segment", F.inline(F.arrays_zip(F.col("lines.line_number").alias("line_number"), F.col("lines.depth").alias("depth"), F.col("parents").alias("parent_line"))))
    seeking = rows.where("parent_line is null and segment > 0").select("source", "segment", F.col("line_number").cast("long").alias("line_number"), "depth")
    while not seeking.limit(1).isEmpty():
        left_open = cur.select("source", "segment", F.inline("open")).select("source", "segment", F.col("l").alias("line_number"), F.col("d").alias("depth"), F.lit(False).alias("seeks"))
        rows = seeking.withColumn("seeks", F.lit(True)).unionByName(left_open).groupBy("source", "segment", "line_number", "depth").agg(F.max("seeks").alias("seeks"))
        cur = scratch.keep(_folded(rows.withColumn("segment", F.floor(F.col("segment") / reach)), "seeks"), "open")
        flat = cur.select("source", "segment", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("parents").alias("parent_line")))).where("line.seeks")
        got = flat.where("parent_line is not null").select(F.col("source").alias("of"), F.col("line.line_number").alias("at"), F.col("parent_line").alias("far"))
        found = got if found is None else found.union(got)
        seeking = flat.where("parent_line is null and segment > 0").select("source", "segment", F.col("line.line_number").alias("line_number"), F.col("line.depth").alias("depth"))
    return found


def _named(nodes: DataFrame) -> DataFrame:
    node = lambda c: F.concat_ws(":", "source", F.col(c).cast("string"))
    return nodes.withColumn("node_id", node("line_number")).withColumn("parent_id", F.when(F.col("parent_line").isNotNull(), node("parent_line")))


def outline_parent(nodes: DataFrame, max_depth: int | None = None, segment: int = SEGMENT, reach: int = 16) -> DataFrame:
    """parent_line: the nearest earlier line of the same source with a smaller depth.

    Segments of `segment` lines are folded with a stack each; what they leave open is folded again (`_far`).
    With a small known `max_depth` one running maximum per depth does it without folds.
    """
    kind = nodes.schema["line_number"].dataType
    if max_depth is not None:
        w = Window.partitionBy("source").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
        terms = [F.when(F.col("depth") > k, F.max(F.when(F.col("depth") == k, F.col("line_number"))).over(w)) for k in range(max_depth)]
        return _named(nodes.withColumn("parent_line", F.greatest(*terms) if len(terms) > 1 else terms[0] if terms else F.lit(None).cast(kind)))
    spark = nodes.sparkSession
    others = [c for c in nodes.columns if c not in ("source", "line_number", "depth")]
    with Scratch(spark) as scratch:
        cur = scratch.keep(_folded(nodes.withColumn("segment", F.floor(F.col("line_number") / segment)), *others), "segments")
        flat = cur.select("source", "segment", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("parents").alias("parent_line"))))
        out = flat.select("source", F.col("line.*"), F.col("parent_line").cast(kind).alias("parent_line"))
        found = _far(scratch, cur, reach)
        if found is not None:
            far = F.col("source").eqNullSafe(F.col("of")) & (F.col("line_number") == F.col("at"))
            out = out.join(found, far, "left").withColumn("parent_line", F.coalesce("parent_line", F.col("far").cast(kind))).drop("of", "at", "far")
        return scratch.keep(_named(out.select(*nodes.columns, "parent_line")), "nodes", last=True)


_SAME = lambda of, at: F.col("source").eqNullSafe(F.col(of)) & (F.col("segment") == F.col(at))


def _segmented(scratch: Scratch, lines: DataFrame, image_host: str | None, segment: int = SEGMENT, reach: int = 16) -> tuple[DataFrame, DataFrame | None]:
    """The table of folded segments, and what segments of long sources need of earlier ones (None where no line does).

    Segments have source, segment, several (whether the source has more of them), lines (structs of line_number, depth, line
    and further columns), open, parents and ancestors.  What they need: of, on, `seeks` from a line to its parent in an
    earlier segment, and `chains` from that parent to its clean text and those above it.
    """
    others = [c for c in lines.columns if c not in ("source", "line_number")]
    rows = drop_blank_rules(lines).withColumn("segment", F.floor(F.col("line_number") / segment)).withColumn("header", tx.header_level(F.col("line")))
    headers = scratch.keep(rows.select("source", "segment", "line_number", "header"), "headers")
    earlier = _carried(headers).select(F.col("of").alias("source"), F.col("at").alias("segment"), "before", "carried", F.lit(True).alias("several"))
    one = F.struct("line_number", tx.indent_level(F.col("line")).alias("indent"), "header", (tx.strip_bullets(F.col("line")) != "").alias("kept"), *others)
    # what earlier segments hold is one more row of the segment, so that lines are shuffled once
    rows = rows.select("source", "segment", one.alias("one")).unionByName(earlier, allowMissingColumns=True)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    rows = rows.groupBy("source", "segment").agg(F.array_sort(F.collect_list("one")).alias("lines"), first("before"), first("carried"), F.coalesce(F.max("several"), F.lit(False)).alias("several"))
    rows = rows.withColumn("depths", F.expr(_ADDED))
    placed = F.zip_with("lines", "depths", lambda x, d: F.struct(x["line_number"].alias("line_number"), d.alias("depth"), x["kept"].alias("kept"), *(x[c].alias(c) for c in others)))
    rows = rows.select("source", "segment", "several", F.filter(placed, lambda x: x["kept"]).alias("lines")).withColumn("f", F.expr(_FOLD))
    segments = scratch.keep(rows.select("source", "segment", "several", "lines", F.col("f.s").alias("open"), F.col("f.p").alias("parents"), F.col("f.a").alias("ancestors")), "segments", last=True)
    found = _far(scratch, segments, reach)
    if found is None:
        return segments, None
    found = scratch.keep(found.groupBy("of", "at").agg(F.max("far").alias("far")), "far")
    # lines left open are each other's ancestors; only those that later segments look for are taken
    up_to = _with_texts(image_host, lambda t: F.transform("open", lambda y, k: F.struct(y["l"].alias("l"), F.col("open")[0]["l"].alias("root"), F.transform(F.slice("open", 1, k + 1), lambda z: F.get(t, z["i"])).alias("piece"))))
    pieces = segments.where("several").select("source", F.inline(up_to))
    same = lambda of, l, at: F.col("source").eqNullSafe(F.col(of)) & (F.col(l) == F.col(at))
    wanted = found.select(F.col("of").alias("wanted_of"), F.col("far").alias("wanted")).distinct()
    pieces = pieces.join(wanted, same("wanted_of", "l", "wanted"), "left_semi").join(found, same("of", "root", "at"), "left")
    pieces = scratch.keep(pieces.groupBy("source", "l").agg(F.max(F.struct("piece", F.col("far").alias("above"))).alias("x")).select("source", "l", "x.*"), "pieces")
    while not pieces.where("above is not null").limit(1).isEmpty():
        head = pieces.select(F.col("source").alias("head_of"), F.col("l").alias("head"), F.col("piece").alias("head_piece"), F.col("above").alias("beyond"))
        far = pieces.join(dealt_anew(head, "head_of", "head"), same("head_of", "above", "head"), "left")
        new = scratch.keep(far.select("source", "l", F.when(F.col("head").isNull(), F.col("piece")).otherwise(F.concat("head_piece", "piece")).alias("piece"), F.col("beyond").alias("above")), "pieces")
        scratch.drop(pieces)
        pieces = new
    needs = found.withColumn("on", F.floor(F.col("at") / segment))
    seeks = needs.groupBy("of", "on").agg(F.map_from_entries(F.collect_list(F.struct("at", "far"))).alias("seeks"))
    chains = needs.select(F.col("of").alias("source"), "on", "far").distinct().join(pieces.withColumnRenamed("source", "piece_of"), same("piece_of", "far", "l"))
    chains = chains.groupBy(F.col("source").alias("chain_of"), F.col("on").alias("chain_on")).agg(F.map_from_entries(F.collect_list(F.struct("far", "piece"))).alias("chains"))
    needs = seeks.join(chains, F.col("of").eqNullSafe(F.col("chain_of")) & (F.col("on") == F.col("chain_on"))).select("of", "on", "seeks", "chains")
    needs = scratch.keep(needs, "needs", last=True)
    for table in (found, pieces):
        scratch.drop(table)
    return segments, needs


def _with_texts(image_host: str | None, use) -> Column:
    """What `use` makes of the array of a segment's clean texts, which are worked out once."""
    texts = F.transform("lines", lambda x: _clean(tx.strip_bullets(x["line"]), image_host))
    return F.transform(F.array(texts), use)[0]


def _flat(segments: DataFrame, needs: DataFrame | None, names: list[str], image_host: str | None, chain: bool, facts: DataFrame | None = None) -> DataFrame:
    """The nodes of a table of segments, worked out as it is read; with `chain` a column of the clean texts from the root to the node.

    `facts` has of, on and `facts`, a map from line numbers to a struct, which becomes a column.
    """
    kind = segments.schema["lines"].dataType.elementType["line_number"].dataType
    inside = lambda t: F.zip_with("ancestors", t, lambda a, own: F.concat(F.transform(a, lambda i: F.get(t, i)), F.array(own)))
    root = lambda a, k: F.get("lines", F.coalesce(F.get(a, F.lit(0)), k))["line_number"].cast("long")
    sought = lambda at: F.try_element_at(F.col("seeks"), at)
    columns = ["source", "segment", "lines", "parents", *(["ancestors"] if chain else [])]

    def worked_out(part: DataFrame, far: bool) -> DataFrame:
        parents = F.zip_with("parents", "lines", lambda p, x: F.coalesce(p, sought(x["line_number"].cast("long")))) if far else F.col("parents")
        out = part.withColumn("parents", parents)
        if not chain:
            return out.select(*columns)
        out = out.withColumn("chain", _with_texts(image_host, inside))
        if far:
            above = F.transform("ancestors", lambda a, k: F.coalesce(F.try_element_at(F.col("chains"), sought(root(a, k))), F.expr("cast(array() as array<string>)")))
            out = out.withColumn("chain", F.zip_with(above, "chain", lambda a, own: F.concat(a, own)))
        return out.select(*columns, "chain")

    def joined(part: DataFrame) -> DataFrame:
        return part if facts is None else part.join(facts.withColumnsRenamed({"of": "fact_of", "on": "fact_on"}), _SAME("fact_of", "fact_on"), "left")

    columns += ["facts"] * (facts is not None)
    if needs is None:
        rows = worked_out(joined(segments), False)
    else:
        rows = worked_out(joined(segments.where("not several")), False)
        rows = rows.unionByName(worked_out(joined(segments.where("several").join(needs, _SAME("of", "on"), "left")), True))
    parts = [F.col("lines").alias("line"), F.col("parents").alias("parent_line")] + [F.col("chain")] * chain
    if facts is not None:
        parts.append(F.transform("lines", lambda x: F.try_element_at(F.col("facts"), x["line_number"].cast("long"))).alias("fact"))
    rows = rows.select("source", F.inline(F.arrays_zip(*parts)))
    others = [c for c in names if c not in ("source", "line_number")]
    rows = rows.select(
        "source", *(F.col(f"line.{c}").alias(c) for c in ("line_number", "depth", *others)), F.col("parent_line").cast(kind).alias("parent_line"), *(["chain"] if chain else []), *(["fact"] if facts is not None else [])
    )
    return _named(_described(rows, image_host))


def outline_path(nodes: DataFrame) -> DataFrame:
    """crumbs, text and path: source, the ancestors' clean texts and the own, without '...' items.

    Nodes with a column `chain`, of these texts, have their path from it, and nothing is written.  Of others, a node's piece of path grows by that of the ancestor it has reached, which then points twice as far
    up; the number of rounds is logarithmic in the greatest depth.  The whole is split on '>' again.
    """
    spark = nodes.sparkSession
    shown = lambda c: F.filter(c, lambda x: x.isNull() | (x != "..."))
    split = lambda piece: tx.node_text_split(F.array_join(F.concat(shown(F.array("source")), piece), " > "))
    if "chain" in nodes.columns:
        got = nodes.withColumn("__split", split(shown(F.col("chain"))))
        return got.withColumn("text", F.col("__split.text")).withColumn("path", F.col("__split.path")).drop("chain", "__split")
    with Scratch(spark) as scratch:
        base = scratch.keep(nodes.select("node_id", "source", F.col("parent_id").alias("above"), shown(F.array("clean")).alias("piece")), "pieces")
        # a parent's depth is the smaller one, so that chains have no more nodes than there are depths
        deepest = nodes.agg(F.max(F.col("depth") - F.lit(0))).first()[0] if "depth" in nodes.columns else None
        span, done = 1, [base.where("above is null")]
        cur = base.where("above is not null")
        while deepest is None or span <= deepest:
            if deepest is None and cur.limit(1).isEmpty():
                break
            up = dealt_anew(base.select(F.col("node_id").alias("above"), F.col("above").alias("beyond"), F.col("piece").alias("head")), "above")
            new = cur.join(up, "above").select("node_id", "source", F.col("beyond").alias("above"), F.concat("head", "piece").alias("piece"))
            new = scratch.keep(new, "pieces")
            done.append(new.where("above is null"))
            cur = new.where("above is not null")
            base, span = base.where("above is null").unionByName(new), 2 * span
        whole = done[0]
        for d in done[1:]:
            whole = whole.unionByName(d)
        paths = whole.select(F.col("node_id").alias("__id"), split(F.col("piece"))["text"].alias("text"), split(F.col("piece"))["path"].alias("path"))
        return scratch.keep(nodes.join(paths, F.col("node_id") == F.col("__id")).drop("__id"), "paths", last=True)


def child_lists(nodes: DataFrame) -> DataFrame:
    """(node_id, child_ids, child_texts) per parent, children in line order."""
    listed = lambda c, *names: F.array_sort(F.collect_list(F.struct("line_number", "node_id", *names)))[c]
    kids = nodes.where("parent_id is not null").groupBy("parent_id")
    # two lists, so that a reader of the ids alone needs no texts
    return kids.agg(listed("node_id").alias("child_ids"), listed("clean", "clean").alias("child_texts")).withColumnRenamed("parent_id", "node_id")


def child_counts(nodes: DataFrame) -> DataFrame:
    n = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, "node_id", "left").withColumn("n_children", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def restore_unparsed_text(nodes: DataFrame) -> DataFrame:
    """An empty text with an unparsed URL falls back to the raw line."""
    return nodes.withColumn("text", F.when((F.col("text") == "") & F.col("has_unparsed_url"), F.col("raw")).otherwise(F.col("text")))


def prune_empty_leaves(nodes: DataFrame) -> DataFrame:
    """Drop nodes without text, URL and children, once; a node emptied by this stays.

    Nodes without text alone are looked up among the parents; the others are not shuffled.
    """
    blank = F.coalesce(F.expr("text = '' and not has_unparsed_url and node_id is not null"), F.lit(False))
    inner = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    return nodes.where(~blank).unionByName(nodes.where(blank).join(inner, "node_id", "left_semi").select(*nodes.columns))


def graft_documents(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """Attach linked documents below the nodes that link to them.

    `nodes` has node_id, source, line_number, depth, path, text and url; `linked` has url and its own
    node_id, depth, parent_id, path, text.  A grafted node's depth grows by the linking depth + 1,
    its path follows the linking path, and its roots get the linking node as parent.  A column n_children
    of `linked` stays.
    """
    host = nodes.where("url is not null").select(
        F.col("node_id").alias("host_id"), "url", F.col("source").alias("host_source"), F.col("line_number").alias("host_line"), F.col("depth").alias("host_depth"), F.col("path").alias("host_path")
    )
    got = linked.join(host, "url")
    name = lambda c: F.concat_ws("/", "host_id", c)
    return got.select(
        name("node_id").alias("node_id"), F.col("host_source").alias("source"), F.col("host_line").alias("line_number"),
        (F.col("depth") + F.col("host_depth") + 1).alias("depth"), F.concat("host_path", "path").alias("path"), "text",
        F.when(F.col("parent_id").isNull(), F.col("host_id")).otherwise(name("parent_id")).alias("parent_id"), F.lit(True).alias("from_external"),
        *(["n_children"] if "n_children" in linked.columns else []),
    )


def parsed_links(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """The nodes with has_parsed_url set, and has_unparsed_url cleared, where a linked document exists; those without a url are not shuffled."""
    there = linked.select("url").distinct().withColumn("found", F.lit(True))
    out = nodes.where("url is not null").join(there, "url", "left").withColumn("has_parsed_url", F.coalesce("found", F.lit(False))).drop("found")
    out = out.unionByName(nodes.where("url is null").withColumn("has_parsed_url", F.lit(False)))
    return out.withColumn("has_unparsed_url", F.col("has_unparsed_url") & ~F.col("has_parsed_url"))


def build_nodes(lines: DataFrame, image_host: str | None = None, chain: bool = False, segment: int = SEGMENT, reach: int = 16) -> DataFrame:
    """Lines to nodes with depth and parent, as `outline_depth` and `outline_parent` make them, from one table of segments.

    What is written are the kept lines as they came, with numbers; all else is worked out when the result is read.  With
    `chain` nodes have the clean texts from their root to themselves, from which `outline_path` makes paths without a join.
    """
    with Scratch(lines.sparkSession, sweep=True) as scratch:
        segments, needs = _segmented(scratch, lines, image_host, segment, reach)
    return _flat(segments, needs, lines.columns, image_host, chain)


def _finished(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linked documents without their empty leaves and with n_children, and (at_url, roots, kept_roots) of each url.

    What is grafted below a host is a whole document, so its leaves and children are found once for all hosts.
    """
    inner = linked.where("parent_id is not null").select(F.col("url").alias("in_url"), F.col("parent_id").alias("in_id")).distinct()
    blank, flat = F.coalesce(F.col("text") == "", F.lit(False)), inner.limit(1).isEmpty()
    root, none = F.col("parent_id").isNull().cast("long"), F.lit(0).cast("long")
    kept = linked.where(~blank)
    if flat:
        counted = kept.withColumn("n_children", none)
        each = linked.select("url", root.alias("roots"), F.when(blank, none).otherwise(root).alias("kept_roots"))
    else:
        same = lambda of, at: (F.col("url") == F.col(of)) & (F.col("node_id") == F.col(at))
        kept = kept.unionByName(linked.where(blank).join(inner, same("in_url", "in_id"), "left_semi"))
        kids = kept.where("parent_id is not null").groupBy(F.col("url").alias("of_url"), F.col("parent_id").alias("of_id")).agg(F.count(F.lit(1)).alias("n"))
        counted = kept.join(kids, same("of_url", "of_id"), "left").withColumn("n_children", F.coalesce("n", none)).drop("of_url", "of_id", "n")
        each = linked.select("url", root.alias("roots"), none.alias("kept_roots")).union(kept.select("url", none, root))
    return counted, each.where("url is not null").groupBy(F.col("url").alias("at_url")).agg(F.sum("roots").alias("roots"), F.sum("kept_roots").alias("kept_roots"))


def _facts(nodes: DataFrame, urls: DataFrame | None, segment: int = SEGMENT) -> DataFrame:
    """(of, on, facts): by segment, a map from lines to whether their link is parsed, whether they are pruned, and their children that stay.

    `nodes` has source, line_number, parent_line, blank, has_unparsed_url and url, and no text.
    """
    none = F.lit(0).cast("long")
    apart = {"parsed": F.lit(False), "roots": none, "kept_roots": none}
    if urls is None:
        rows = nodes.withColumns(apart)
    else:
        hosts = nodes.where("url is not null").join(urls, F.col("url") == F.col("at_url"), "left").withColumn("parsed", F.col("at_url").isNotNull())
        hosts = hosts.withColumns({c: F.coalesce(c, none) for c in ("roots", "kept_roots")}).drop("at_url")
        rows = hosts.unionByName(nodes.where("url is null").withColumns(apart))
    empty = F.coalesce(F.expr("blank and (not has_unparsed_url or parsed) and roots = 0"), F.lit(False))
    inner = nodes.where("parent_line is not null").select(F.col("source").alias("in_source"), F.col("parent_line").alias("in_line")).distinct()
    leaf = F.col("source").eqNullSafe(F.col("in_source")) & (F.col("line_number") == F.col("in_line"))
    rows = rows.withColumn("empty", empty)
    gone = rows.where("empty").join(inner, leaf, "left_anti").withColumn("gone", F.lit(True))
    stay = rows.where("not empty").unionByName(rows.where("empty").join(inner, leaf, "left_semi")).withColumn("gone", F.lit(False))
    own = gone.unionByName(stay).select("source", "line_number", "parsed", "gone", F.col("kept_roots").alias("n")).where("parsed or gone or n > 0")
    kids = stay.where("parent_line is not null").select("source", F.col("parent_line").alias("line_number"), F.lit(False).alias("parsed"), F.lit(False).alias("gone"), F.lit(1).cast("long").alias("n"))
    each = own.unionByName(kids).groupBy("source", "line_number").agg(F.max("parsed").alias("parsed"), F.max("gone").alias("gone"), F.sum("n").alias("n"))
    one = F.struct(F.col("line_number").cast("long").alias("l"), F.struct("parsed", "gone", "n").alias("fact"))
    return each.groupBy(F.col("source").alias("of"), F.floor(F.col("line_number") / segment).alias("on")).agg(F.map_from_entries(F.collect_list(one)).alias("facts"))


def ingest_pipeline(
    lines: DataFrame, linked: DataFrame | None = None, stored: DataFrame | None = None, image_host: str | None = None, segment: int = SEGMENT, reach: int = 16
) -> DataFrame:
    """Lines to the finished tree: paths, linked documents grafted, texts restored, empty leaves pruned, children counted.

    `linked` is as for `graft_documents`.  A store that already has rows is returned as it is;
    an outcome without rows is an error.  Leaves are pruned and children counted on numbers alone, as
    `prune_empty_leaves` and `child_counts` would; what they find meets the texts by segments, before paths are made.
    """
    if stored is not None and not stored.limit(1).isEmpty():
        return stored
    with Scratch(lines.sparkSession, sweep=True) as scratch:
        segments, needs = _segmented(scratch, lines, image_host, segment, reach)
        url = lambda df: df if linked is None else df.withColumn("url", F.when(F.col("has_unparsed_url"), tx.extract_link(F.col("line"))["url"]))
        nodes = url(outline_path(_flat(segments, needs, lines.columns, image_host, True)))
        counted, urls = (None, None) if linked is None else _finished(linked)
        light = ["source", "line_number", "parent_line", (F.col("text") == "").alias("blank"), "has_unparsed_url"]
        if linked is None:
            light = scratch.keep(nodes.select(*light, F.lit(None).cast("string").alias("url")), "light")
        else:
            light = scratch.keep(nodes.select(*light, "url", "node_id", "depth", F.when(F.col("url").isNotNull(), F.col("path")).alias("path")), "light", last=True)
        facts = scratch.keep(_facts(light.drop("node_id", "depth", "path"), urls, segment), "facts", last=True)
        bare = light.where("not blank or blank is null").limit(1).isEmpty()
    out = url(outline_path(_flat(segments, needs, lines.columns, image_host, True, facts))).where("not coalesce(fact.gone, false)")
    out = out.withColumn("n_children", F.coalesce("fact.n", F.lit(0)).cast("long"))
    if linked is not None:
        out = out.withColumn("has_parsed_url", F.coalesce("fact.parsed", F.lit(False))).withColumn("has_unparsed_url", F.col("has_unparsed_url") & ~F.col("has_parsed_url"))
    out = restore_unparsed_text(out.drop("fact"))
    if linked is not None:
        grafted = graft_documents(light, counted).withColumn("has_unparsed_url", F.lit(False))
        out = out.unionByName(grafted, allowMissingColumns=True)
    if bare and out.limit(1).isEmpty():
        raise ValueError("the outlines hold no text")
    return out
