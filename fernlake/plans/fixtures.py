"""Inputs derived from the supplied tables, once for Spark and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.operators import outline


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Documents as outlines: the mark-up of a line follows from its number.

_MARKUP = """case when line_number % 24 = 0 then concat('# ', line) when line_number % 24 = 5 then '' when line_number % 24 = 17 then concat('### ', line) when line_number % 6 = 5 then '---'
 when line_number % 6 = 0 then concat('- ', line) when line_number % 6 = 1 then concat('  - **', line, '**') when line_number % 6 = 2 then concat('    - ', line)
 when line_number % 6 = 3 then concat('    - [[', line, '|rem1]] {{c1::', line, '::hint}}') else concat('  - see [ref', source, '](http://example.com/', source, ')') end"""

W = "(' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11))"
WS = r"[ \t\r\n\f\v]"

LINES_SQL = rf"""
raw as (select cast(doc_id as varchar) as source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_number from documents),
lines as (select source, line_number, {_MARKUP} as line from raw)"""


#: The same with lines that clean to nothing, as leaves and as parents.
GAPS = _MARKUP.replace("case when", "case when line_number % 24 in (13, 15) then '  - ****' when", 1)


def with_gaps(sql: str) -> str:
    return sql.replace(_MARKUP, GAPS)


def lines(spark: SparkSession, sf_dir: str, markup: str = _MARKUP) -> DataFrame:
    rows = outline.outline_lines(table(spark, sf_dir, "documents"))
    return rows.select("source", "line_number", F.expr(markup).alias("line"))


def d_strip(x: str) -> str:
    return f"trim({x}, {W})"


def d_norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def d_refs(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\[\[(.*?)\|.*?\]\]', '\1', 'g'), '\[\[(.*?)\]\]', '\1', 'g')"


def d_clozes(x: str) -> str:
    return rf"regexp_replace({x}, '\{{\{{c\d+::(.*?)(::.*?)?\}}\}}', '\1', 'g')"


def d_markdown(x: str) -> str:
    return rf"regexp_replace(replace(replace({x}, '**', ''), '__', ''), '!\[(.*?)\]\(.*?\)', '\1', 'g')"


def d_clean(x: str) -> str:
    return d_strip(d_markdown(d_clozes(d_refs(d_norm(x)))))


FEATURES_SQL = rf"""{LINES_SQL},
feat as (select source, line_number, line, (length(line) - length(ltrim(line, {W}))) // 2 as indent,
  nullif(length(regexp_extract({d_strip("line")}, '^[ \t\r\n\f\v-]*(#+)', 1)), 0) as header, contains(line, 'http') as has_unparsed_url,
  {d_strip(f"regexp_replace({d_strip('line')}, '^[-*]+', '')")} as raw
  from lines where {d_strip("line")} <> '' and not starts_with({d_strip("line")}, '---'))"""

NODES_SQL = rf"""{FEATURES_SQL},
d1 as (select f.*, case when header is not null then (select count(distinct b.header) from feat b where b.source = f.source and b.line_number < f.line_number and b.header < f.header) end as bonus from feat f),
d2 as (select *, indent + coalesce(bonus, last_value(bonus + 1 ignore nulls) over (partition by source order by line_number rows between unbounded preceding and current row), 0) as depth from d1),
d3 as (select source, line_number, line, indent, header, has_unparsed_url, raw, {d_clean("raw")} as clean, depth from d2 where raw <> ''),
nodes as (select n.*, (select max(p.line_number) from d3 p where p.source = n.source and p.line_number < n.line_number and p.depth < n.depth) as parent_line,
  n.source || ':' || n.line_number as node_id from d3 n),
tree as (select *, case when parent_line is not null then source || ':' || parent_line end as parent_id from nodes)"""

PATHS_SQL = rf"""{NODES_SQL},
chain as (
  select node_id, [source, clean] as chain, node_id as root from tree where parent_id is null
  union all select t.node_id, list_append(c.chain, t.clean), c.root from tree t join chain c on t.parent_id = c.node_id),
crumbs as (select node_id, root, list_transform(string_split(array_to_string(list_filter(chain, lambda x: x <> '...'), ' > '), '>'), lambda x: {d_strip("x")}) as parts from chain),
paths as (select t.*, c.root, c.parts[-1] as text, c.parts[1:-2] as path from tree t join crumbs c using (node_id))"""

PLACED_SQL = rf"""{PATHS_SQL},
placed as (select node_id, min(node_id) over (partition by root) as component_id from paths where root in (select root from paths group by root having count(*) > 1))"""

SUBTREES_SQL = rf"""{PLACED_SQL},
leaf as (select p.component_id, t.parent_id, t.node_id, t.line_number, t.clean, min(t.line_number) over (partition by p.component_id, t.parent_id) as first_line
  from tree t join placed p using (node_id) where t.parent_id is not null and t.node_id not in (select parent_id from tree where parent_id is not null)),
numbered as (select *, dense_rank() over (partition by component_id order by first_line, parent_id) - 1 as subtree_no, row_number() over (partition by component_id, parent_id order by line_number, node_id) - 1 as leaf_no from leaf),
subtrees as (select component_id, subtree_no, leaf_no, node_id, parent_id, line_number, clean, 'subtree_' || subtree_no || '_leaf_' || leaf_no as label from numbered)"""

_DECISION = """case when doc % 11 = 0 then '{bad' when doc % 3 = 0 then concat('```json', chr(10), body, chr(10), '```') else body end"""
_BODY = """concat('{"to_merge": [["subtree_0_leaf_0", "subtree_0_leaf_1"], ["subtree_1_leaf_0", "subtree_2_leaf_0"]], "to_remove": ["subtree_3_leaf_0"], "triplets": [{"subject_source_id": "subtree_0_leaf_0", "object_source_id": "subtree_0_leaf_1", "subject": "Topic ', doc % 20, '", "subject_type": "CONCEPT", "predicate": "USES", "object": "Method ', doc % 7, '", "object_type": "METHOD"}]}')"""

DECISIONS_SQL = rf"""{SUBTREES_SQL},
dec0 as (select component_id, cast(split_part(component_id, ':', 1) as bigint) as doc from (select distinct component_id from placed)),
dec1 as (select component_id, doc, {_BODY} as body from dec0),
decisions as (select component_id, {_DECISION} as decision_json from dec1),
parsed as (select component_id, doc from dec1 where doc % 11 <> 0)"""


def decisions(placed: DataFrame) -> DataFrame:
    rows = placed.select("component_id").distinct().withColumn("doc", F.split("component_id", ":")[0].cast("long"))
    return rows.withColumn("body", F.expr(_BODY)).select("component_id", F.expr(_DECISION).alias("decision_json"))


# Events as run records.

RUNS_SQL = """
runs0 as (select cast(event_id as varchar) as run_id, event_id, user_id || '-' || cast(floor(day(ts) / 7.0) as int) as trace_id,
  case when event_type in ('click', 'signup') then 'llm' when event_type in ('view', 'purchase') then 'tool' else 'chain' end as run_type,
  'tool_' || (event_id % 4) as name, ts as start_time, ts + to_microseconds(cast(round(value * 1000000) as bigint)) as end_time, round(value, 6) as latency,
  case when event_id % 4 = 0 then case event_id % 3 when 0 then 'retriever' when 1 then 'analyst' else 'mentor' end end as node, event_id % 3 as step,
  nullif(cast(json_extract(props, '$.k') as bigint), 0) as prompt_tokens, user_id % 5 as completion_tokens, case when event_type = 'error' then 'error' else 'success' end as status from events),
runs as (select *, lag(run_id) over (partition by trace_id order by start_time, event_id) as parent_run_id from runs0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.selectExpr(
        "cast(event_id as string) as run_id", "event_id", "concat(user_id, '-', cast(floor(day(ts) / 7.0) as int)) as trace_id",
        "case when event_type in ('click', 'signup') then 'llm' when event_type in ('view', 'purchase') then 'tool' else 'chain' end as run_type",
        "concat('tool_', event_id % 4) as name", "ts as start_time", "ts + make_dt_interval(0, 0, 0, cast(value as decimal(18, 6))) as end_time", "round(value, 6) as latency",
        "case when event_id % 4 = 0 then case event_id % 3 when 0 then 'retriever' when 1 then 'analyst' else 'mentor' end end as node", "event_id % 3 as step",
        "nullif(cast(get_json_object(props, '$.k') as bigint), 0) as prompt_tokens", "user_id % 5 as completion_tokens", "case when event_type = 'error' then 'error' else 'success' end as status",
    )
    return rows.withColumn("parent_run_id", F.expr("lag(run_id) over (partition by trace_id order by start_time, event_id)"))


# The order tables as a typed graph.

EDGES_SQL = """
edges as (select distinct src, rel, dst from (
  select concat('n', n_nationkey) as src, 'PART_OF' as rel, concat('r', n_regionkey) as dst from nation
  union all select concat('c', c_custkey), 'IS_A', concat('n', c_nationkey) from customer
  union all select concat('s', s_suppkey), 'IS_A', concat('n', s_nationkey) from supplier
  union all select concat('o', o_orderkey), 'USES', concat('c', o_custkey) from orders
  union all select concat('p', l_partkey), 'MENTIONS', concat('s', l_suppkey) from lineitem) e)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    e = t("nation").selectExpr("concat('n', n_nationkey) as src", "'PART_OF' as rel", "concat('r', n_regionkey) as dst")
    e = e.union(t("customer").selectExpr("concat('c', c_custkey)", "'IS_A'", "concat('n', c_nationkey)"))
    e = e.union(t("supplier").selectExpr("concat('s', s_suppkey)", "'IS_A'", "concat('n', s_nationkey)"))
    e = e.union(t("orders").selectExpr("concat('o', o_orderkey)", "'USES'", "concat('c', o_custkey)"))
    return e.union(t("lineitem").selectExpr("concat('p', l_partkey)", "'MENTIONS'", "concat('s', l_suppkey)")).distinct()


NODE_TABLE_SQL = """
gnodes as (select concat('c', c_custkey) as node_id, 'entity' as kind, c_name as name, c_mktsegment as type, cast(null as varchar) as text from customer
  union all select concat('o', o_orderkey), 'chunk', null, null, concat('# Order', chr(10), o_orderstatus, ' ', o_orderdate) from orders)"""


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as node_id", "'entity' as kind", "c_name as name", "c_mktsegment as type", "cast(null as string) as text")
    o = table(spark, sf_dir, "orders")
    return c.union(o.selectExpr("concat('o', o_orderkey)", "'chunk'", "cast(null as string)", "cast(null as string)", "concat('# Order', chr(10), o_orderstatus, ' ', cast(o_orderdate as string))"))


# Scored evidence from documents.

_EVIDENCE = """doc_id % 50 as request_id, doc_id % 3 as query_no, doc_id as rank, case (doc_id // 3) % 3 when 0 then 'RELATION' when 1 then 'SOURCE' else 'SOURCE PATH' end as kind,
 text as body, case when doc_id % 7 = 0 then null else (doc_id % 100) / 100.0 end as score, case doc_id % 5 when 0 then 'CHILD' when 1 then 'PARENT' else 'USES' end as rel"""

EVIDENCE_SQL = f"evidence as (select {_EVIDENCE.replace('/ 100.0', '/ cast(100 as double)')} from documents)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _EVIDENCE.replace(" // ", " div ").replace("/ 100.0", "/ cast(100 as double)")
    return table(spark, sf_dir, "documents").selectExpr(*(x.strip() for x in _split(text)))


def _split(text: str) -> list[str]:
    """Items of a select list; commas inside parentheses or cases do not occur."""
    return text.replace("\n", " ").split(", ")


# Conversations as turns.

_CONTEXT = """case conv_id % 8 when 0 then '' when 1 then '{"search_knowledge_base": "x"}' when 2 then '{"get_subgraphs_to_visualize": "x"}' when 3 then '## Web Research Findings'
 when 4 then 'text [RESEARCH_COMPLETE]' when 5 then 'Visual artifact generated' when 6 then '"no_results": true' else '"all_sources_exhausted": true' end"""
_LAST = "case when role = 'user' then null when conv_id % 3 = 0 then '[ANALYST]' else '[TOOL]' end"

TURNS_SQL = f"""
turns as (select conv_id, turn, role, role = 'user' as new_message, {_CONTEXT} as context, conv_id % 8 = 7 as sources_exhausted, conv_id % 8 = 6 as retriever_empty,
  {_LAST} as last_agent, case when conv_id % 5 = 0 then null when conv_id % 5 = 1 then 'visualizer' else 'mentor' end as decision from conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "role = 'user' as new_message", f"{_CONTEXT} as context", "conv_id % 8 = 7 as sources_exhausted", "conv_id % 8 = 6 as retriever_empty",
        f"{_LAST} as last_agent", "case when conv_id % 5 = 0 then null when conv_id % 5 = 1 then 'visualizer' else 'mentor' end as decision",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assistant messages; as in `turns`, threads whose id is not divisible by 3 have a tool's only."""
    agent = "case when conv_id % 3 <> 0 then 'tool' when turn % 4 < 2 then 'analyst' else 'mentor' end as agent"
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id as thread_id", agent, "turn as seq", "text")


# Conversations as token events: a start, the words, an end for each message.

TOKENS_SQL = """
tok0 as (select conv_id as thread_id, turn, case when turn % 2 = 0 then 'analyst' else 'mentor' end as agent, string_split('<s> ' || coalesce(text, '') || ' <e>', ' ') as w from conversations),
tok1 as (select thread_id, turn, agent, unnest(w) as word, generate_subscripts(w, 1) as i, len(w) as n from tok0),
events_ as (select thread_id, turn * 1000000 + i as seq, case when i = 1 then 'start' when i = n then 'end' else 'token' end as type, agent, case when i > 1 and i < n then word || ' ' end as chunk from tok1)"""


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as thread_id", "turn", "case when turn % 2 = 0 then 'analyst' else 'mentor' end as agent", "split(concat('<s> ', coalesce(text, ''), ' <e>'), ' ', -1) as w"
    )
    rows = c.select("thread_id", "turn", "agent", F.size("w").alias("n"), F.posexplode("w").alias("p", "word")).withColumn("i", F.col("p") + 1)
    return rows.selectExpr(
        "thread_id", "timestamp_seconds(turn * 1000000 + i) as ts", "turn * 1000000 + i as seq", "case when i = 1 then 'start' when i = n then 'end' else 'token' end as type", "agent",
        "case when i > 1 and i < n then concat(word, ' ') end as chunk",
    )
