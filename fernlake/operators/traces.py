"""Trace analytics over run records.

Flat runs have run_id, trace_id, parent_run_id, run_type, name, node, step, start_time, end_time,
latency, prompt_tokens, completion_tokens, status; nested parts arrive as JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.functions import text as tx
from fernlake.plans.scratch import Scratch
from fernlake.plans.selection import with_median
from fernlake.plans.skew import dealt_anew, numbered

#: Prompt headers and the section each opens.
SECTIONS = {
    "# Current context": "context",
    "# Ground truth context": "context",
    "# Conversation history": "history",
    "# User last message": "user_last",
    "# User previous message": "user_prev",
}
RETRIEVER_KEYS = ("search_knowledge_base", "get_subgraphs_to_visualize")


def runs_from_source(runs: DataFrame) -> DataFrame:
    """Flat records: ids and costs as strings, latency in seconds, null when either end is null."""
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    return runs.withColumn("run_id", F.col("run_id").cast("string")).withColumn("latency", F.round(seconds, 6)).withColumn("total_cost", F.col("total_cost").cast("string"))


def trace_order(runs: DataFrame) -> DataFrame:
    """Traces numbered by their first start, hour by hour."""
    first = runs.groupBy("trace_id").agg(F.min("start_time").alias("first_start"))
    return numbered(first, "trace_no", [], F.date_trunc("hour", "first_start"), "first_start", "trace_id")


def trace_summary(runs: DataFrame) -> DataFrame:
    """Per trace: first start, end of the last-started run, greatest end, LLM runs and tokens."""
    key = F.struct("start_time", "run_id")
    llm = F.col("run_type") == "llm"
    tokens = lambda c: F.coalesce(F.sum(F.when(llm, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("long")
    return runs.groupBy("trace_id").agg(
        F.min_by("name", key).alias("session"), F.min("start_time").alias("start_ts"), F.max_by("end_time", key).alias("end_ts"), F.max("end_time").alias("max_end_ts"),
        F.count_if(llm).alias("llm_runs"), tokens("prompt_tokens").alias("prompt_tokens"), tokens("completion_tokens").alias("completion_tokens"),
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def run_children(runs: DataFrame) -> DataFrame:
    return runs.where("parent_run_id is not null").groupBy(F.col("parent_run_id").alias("run_id")).agg(F.array_sort(F.collect_list("run_id")).alias("children"))


def run_node(runs: DataFrame, lookups: int = 8) -> DataFrame:
    """(run_id, node, step): those of the nearest labelled run up the parent chain, else '?' and null.

    Resolved rows leave the loop, so that each round joins only what is still open.
    """
    spark = runs.sparkSession
    with Scratch(spark) as scratch:
        base = scratch.keep(runs.select("run_id", "parent_run_id", F.nullif("node", F.lit("")).alias("node"), "step"), "runs")
        done = [base.where("node is not null").select("run_id", "node", "step")]
        up = base.select(F.col("run_id").alias("at"), F.col("parent_run_id").alias("next"), F.col("node").alias("found"), F.col("step").alias("found_step"))
        open_ = base.where("node is null").select("run_id", F.col("parent_run_id").alias("at"))
        for _ in range(lookups - 1):
            step = scratch.keep(open_.join(up, "at", "left"), "open")
            done.append(step.where("found is not null").select("run_id", F.col("found").alias("node"), F.col("found_step").alias("step")))
            open_ = step.where("found is null").select("run_id", F.col("next").alias("at"))
        done.append(open_.select("run_id", F.lit("?").alias("node"), F.lit(None).cast(base.schema["step"].dataType).alias("step")))
        out = done[0]
        for d in done[1:]:
            out = out.union(d)
        return scratch.keep(out, "nodes", last=True)


def llm_steps(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per LLM run in start order within its trace, under its node's name."""
    rows = runs.where("run_type = 'llm'").drop("node", "step").join(nodes, "run_id")
    order = Window.partitionBy("trace_id").orderBy("start_time", "run_id")
    return rows.select("trace_id", F.row_number().over(order).alias("step_no"), "run_id", F.upper("node").alias("node"), "start_time", "latency", "prompt_tokens", "status")


def tool_runs_for_step(runs: DataFrame, nodes: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """(llm_run_id, tool_run_id, seq): tool runs of the same trace, node and step that start no earlier."""
    n = nodes if keep_unknown else nodes.where("node != '?'")
    rows = runs.drop("node", "step").join(n, "run_id")
    llm = rows.where("run_type = 'llm'").select("trace_id", "node", "step", F.col("run_id").alias("llm_run_id"), F.col("start_time").alias("since"))
    tool = rows.where("run_type = 'tool'").select("trace_id", "node", "step", F.col("run_id").alias("tool_run_id"), "start_time")
    both = llm.join(tool, ["trace_id", "node", "step"]).where("start_time >= since")
    order = Window.partitionBy("llm_run_id").orderBy("start_time", "tool_run_id")
    return both.select("llm_run_id", "tool_run_id", F.row_number().over(order).alias("seq"))


def _latency(rows: DataFrame, *keys: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    x = F.col("latency")
    stats = [F.count(x).alias("n"), r(F.sum(x)).alias("total"), r(F.avg(x)).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most")]
    return with_median(rows, list(keys), "latency", stats).select(*keys, "n", "total", "mean", r(F.col("median")).alias("median"), "least", "most")


def latency_by_node(runs: DataFrame) -> DataFrame:
    """Latency statistics of LLM runs by their own node label; the median is exact, however many runs a label has."""
    rows = runs.where("run_type = 'llm' and latency is not null")
    return _latency(rows.select(F.coalesce("node", F.lit("unknown")).alias("node"), "latency"), "node")


def latency_by_tool(runs: DataFrame) -> DataFrame:
    """Latency statistics of tool runs by name, with exact medians."""
    return _latency(runs.where("run_type = 'tool' and latency is not null").select(F.col("name").alias("tool"), "latency"), "tool")


def latency_overall(runs: DataFrame) -> DataFrame:
    """Both breakdowns and the total; scope is node, tool or all."""
    rows = runs.where("run_type in ('llm', 'tool') and latency is not null")
    llm = F.col("run_type") == "llm"
    own = F.struct(F.when(llm, "node").otherwise("tool").alias("scope"), F.when(llm, F.coalesce("node", F.lit("unknown"))).otherwise(F.col("name")).alias("label"))
    whole = F.struct(F.lit("all").alias("scope"), F.lit("all").alias("label"))
    return _latency(rows.select("latency", F.inline(F.array(own, whole))), "scope", "label")


def block_dedup(blocks: DataFrame, preview: int = 90, stretch: int = 100_000) -> DataFrame:
    """Label of each block: PREFIX_n at its first occurrence, the same label with a preview later.

    `blocks` has seq, prefix and text; equal texts share one fingerprint whatever their prefix.
    Labels are numbered within the prefix over the distinct blocks alone, by stretches of seq.
    """
    rows = blocks.withColumn("fingerprint", F.substring(F.md5("text"), 1, 10))
    first = rows.groupBy("fingerprint").agg(F.min("seq").alias("first_seq"), F.min_by("prefix", "seq").alias("first_prefix"))
    first = numbered(first, "number", ["first_prefix"], F.floor(F.col("first_seq") / stretch), "first_seq")
    first = first.withColumn("label", F.concat_ws("_", "first_prefix", F.col("number").cast("string"))).drop("number")
    out = rows.join(dealt_anew(first, "fingerprint"), "fingerprint")
    is_first = F.col("seq") == F.col("first_seq")
    return out.select("seq", "fingerprint", "label", is_first.alias("is_first"), F.when(~is_first, F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, preview)).alias("preview"))


def retriever_block_trim(texts: DataFrame, most: int = 400, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Retriever output with each [SOURCE block cut; other lines stay.

    A line that starts with [SOURCE opens a block, a relation, query or header line ends it.  A
    null text stays null.
    """
    lines = texts.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line"))
    bare = tx.strip(F.col("line"))
    opens = bare.startswith("[SOURCE")
    ends = bare.startswith("[RELATION]") | bare.startswith("QUERY:") | bare.startswith("RETRIEVER RESULTS")
    w = Window.partitionBy(id_col).orderBy("n")
    lines = lines.withColumn("mark", F.when(opens, 1).when(ends, 0))
    lines = lines.withColumn("inside", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(0)))
    lines = lines.withColumn("block", F.sum(F.when(opens | (F.col("inside") == 0), 1).otherwise(0)).over(w))
    part = F.array_sort(F.collect_list(F.struct("n", "line")))
    block = lines.groupBy(id_col, "block").agg(F.array_join(part["line"], "\n").alias("body"), F.max("inside").alias("inside"))
    cut = F.concat(F.substring("body", 1, most), F.lit(" ... [+"), (F.length("body") - most).cast("string"), F.lit(" chars SOURCE TRUNCATED]"))
    block = block.withColumn("body", F.when((F.col("inside") == 1) & (F.length("body") > most), cut).otherwise(F.col("body")))
    whole = F.array_sort(F.collect_list(F.struct("block", "body")))
    out = block.groupBy(id_col).agg(F.array_join(whole["body"], "\n").alias(text_col))
    return out.union(texts.where(F.col(text_col).isNull()).select(id_col, text_col))


#: What is read of a run's messages and of its first generation.
MESSAGE = "struct<type:string,id:array<string>,content:string,kwargs:struct<content:string>>"
OUTPUT = "struct<generations:array<array<struct<text:string,message:struct<content:string,kwargs:struct<content:string,tool_calls:array<struct<name:string,args:string>>>>>>>>"


def extract_messages(runs: DataFrame, col: str = "inputs") -> DataFrame:
    """system and human texts of an LLM run's input messages, nested or flat, of either form; the last of each wins.

    The object is parsed once, down to its messages as texts, and each message once.
    """
    out = runs.withColumn("__raw", F.from_json(col, "struct<messages:array<string>>")["messages"])
    lead = F.get("__raw", F.lit(0))
    flat = F.transform("__raw", lambda m: F.from_json(m, MESSAGE))
    out = out.withColumn("messages", F.when(lead.startswith("["), F.from_json(lead, f"array<{MESSAGE}>")).otherwise(flat))
    kind = lambda m: F.when(m["type"] == "constructor", F.array_join(m["id"], ".")).otherwise(m["type"])
    text = lambda m: F.when(m["type"] == "constructor", m["kwargs"]["content"]).otherwise(m["content"])
    last = lambda test: F.coalesce(text(F.try_element_at(F.filter("messages", test), F.lit(-1))), F.lit(""))
    system = last(lambda m: kind(m).contains("SystemMessage") | (kind(m) == "system"))
    human = last(lambda m: kind(m).contains("HumanMessage") | kind(m).isin("human", "user"))
    return out.withColumn("system_text", system).withColumn("human_text", human).drop("messages", "__raw")


def split_sections(prompts: DataFrame, col: str = "human_text") -> DataFrame:
    """context, history, user_last, user_prev of a prompt, by its headers in order of position; the later of two wins."""
    c = F.col(col)
    hits = F.array(*(F.struct(F.locate(h, c).alias("at"), F.lit(len(h)).alias("len"), F.lit(k).alias("key")) for h, k in SECTIONS.items()))
    out = prompts.withColumn("hits", F.array_sort(F.filter(hits, lambda h: h["at"] > 0)))
    ends = F.concat(F.transform(F.slice("hits", F.lit(2), F.lit(len(SECTIONS))), lambda h: h["at"]), F.array(F.length(c) + 1))

    def body(h, i):
        start = h["at"] + h["len"]
        inner = F.substring(c, start, F.get(ends, i) - start)
        inner = F.regexp_replace(inner, r"^[ \t\r\n\f\x0B-]*\n", "")
        tail = F.rtrim(F.rtrim(F.rtrim(inner, F.lit(tx.BLANK)), F.lit("-")), F.lit(tx.BLANK))
        return F.struct(h["key"].alias("key"), tx.strip(tail).alias("body"))

    out = out.withColumn("parts", F.transform("hits", body))
    pick = lambda k: F.try_element_at(F.filter("parts", lambda p: p["key"] == k), F.lit(-1))["body"]
    none = F.size("hits") == 0
    chat = c.contains("<message role=")
    out = out.withColumn("context", F.when(none & ~chat, tx.strip(c)).otherwise(pick("context"))).withColumn("history", F.when(none & chat, tx.strip(c)).otherwise(pick("history")))
    return out.withColumn("user_last", pick("user_last")).withColumn("user_prev", pick("user_prev")).drop("hits", "parts")


def _generation(runs: DataFrame, col: str) -> DataFrame:
    """The runs with their first generation as `__g`, from one parse; its tool calls keep the order of their arguments."""
    outer = F.get(F.from_json(col, OUTPUT)["generations"], F.lit(0))
    return runs.withColumn("__g", F.get(outer, F.lit(0)))


def extract_response(runs: DataFrame, col: str = "outputs") -> DataFrame:
    """Text of the first generation; empty where there is none."""
    g = F.col("__g")
    inner = F.coalesce(F.nullif(g["message"]["kwargs"]["content"], F.lit("")), g["message"]["content"])
    plain = F.when(g["message"].isNull(), g["text"])
    return _generation(runs, col).withColumn("response", F.coalesce(inner, plain, F.lit(""))).drop("__g")


def extract_tool_calls(runs: DataFrame, col: str = "outputs", most: int = 600) -> DataFrame:
    """tool_calls: one line per structured call with its arguments cut."""
    calls = F.col("__g")["message"]["kwargs"]["tool_calls"]
    line = lambda x: F.concat(F.lit("TOOL CALL: "), F.coalesce(x["name"], F.lit("?")), F.lit("("), tx.truncate_marked(F.coalesce(x["args"], F.lit("{}")), most), F.lit(")"))
    return _generation(runs, col).withColumn("tool_calls", F.coalesce(F.array_join(F.transform(calls, line), "\n"), F.lit(""))).drop("__g")


def routing_decisions(runs: DataFrame, col: str = "response") -> DataFrame:
    """(next_step, reasoning) of responses that are routing JSON, fenced or plain; others are left out."""
    bare = tx.fence_strip(F.col(col))
    rows = runs.withColumn("__d", F.from_json(bare, "struct<next_step:string,reasoning:string>"))
    return rows.withColumn("next_step", F.col("__d.next_step")).withColumn("reasoning", F.col("__d.reasoning")).drop("__d").where("next_step is not null")


def tool_run_table(runs: DataFrame, most_input: int = 600, most_output: int = 4000) -> DataFrame:
    """One row per tool run: name, start, latency, status, input and output cut."""
    rows = runs.where("run_type = 'tool'")
    trimmed = retriever_block_trim(rows.select(F.col("run_id").alias("id"), F.coalesce("output", F.lit("")).alias("text"))).withColumnsRenamed({"id": "run_id", "text": "trimmed"})
    out = rows.join(trimmed, "run_id", "left")
    return out.select("run_id", "name", "start_time", "latency", "status", tx.truncate_marked(F.coalesce("input", F.lit("")), most_input).alias("input"), tx.truncate_marked(F.coalesce("trimmed", F.lit("")), most_output).alias("output"))


def context_entries(contexts: DataFrame, most: int = 4000) -> DataFrame:
    """(id, key, value) of a context object, values cut and retriever results trimmed; invalid JSON is one raw row."""
    parsed = contexts.withColumn("object", F.from_json(tx.strip(F.col("context")), "map<string,string>")).withColumn("ok", F.expr("try_parse_json(trim(context)) is not null"))
    rows = parsed.where("ok").select("id", F.explode("object").alias("key", "value"))
    hot = rows.where(F.col("key").isin(*RETRIEVER_KEYS)).select(F.concat_ws("\x1f", F.col("id").cast("string"), "key").alias("rid"), "id", "key", "value")
    trimmed = retriever_block_trim(hot.select("rid", "value"), id_col="rid", text_col="value").join(hot.select("rid", "id", "key"), "rid").select("id", "key", "value")
    whole = rows.where(~F.col("key").isin(*RETRIEVER_KEYS)).union(trimmed).union(parsed.where("not ok").select("id", F.lit(None).cast("string"), tx.strip(F.col("context"))))
    return whole.select("id", "key", tx.truncate_marked(F.col("value"), most).alias("value"))


def history_parse(texts: DataFrame, most: int = 600) -> DataFrame:
    """(id, pos, role, content) of marked history text; text without marks is one raw row, cut at four times the limit."""
    pattern = F.lit(r"(?s)<message\s+role=(\w+)>\s*<content>(.*?)</content>\s*</message>")
    pairs = F.arrays_zip(F.regexp_extract_all("history", pattern, 1).alias("role"), F.regexp_extract_all("history", pattern, 2).alias("content"))
    rows = texts.withColumn("pairs", pairs)
    found = rows.select("id", F.posexplode("pairs").alias("pos", "p")).select("id", "pos", F.upper("p.role").alias("role"), tx.truncate_marked(tx.strip(F.col("p.content")), most).alias("content"))
    raw = rows.where((F.size("pairs") == 0) & (tx.strip(F.col("history")) != ""))
    return found.union(raw.select("id", F.lit(0), F.lit(None).cast("string"), tx.truncate_marked(F.col("history"), 4 * most)))
