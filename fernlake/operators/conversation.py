"""Conversation-state rules over tables of messages and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Notices shown when no agent answered; a caller may give others.
FALLBACKS = {
    "exhausted": "All available sources were searched without a useful result.",
    "visual": "The visualization could not be produced.",
    "empty": "Nothing relevant was found in the knowledge base.",
    "default": "No answer could be produced for this question.",
}


def role_name(c: str = "role"):
    return F.when(F.col(c) == "user", "human").otherwise("ai")


def last_user_message(messages: DataFrame) -> DataFrame:
    """(conv_id, text) of each conversation's latest user message."""
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def history_window(messages: DataFrame, last: int = 4) -> DataFrame:
    """(conv_id, history): the last messages as marked text, oldest first."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("n", F.row_number().over(back)).where(F.col("n") <= last)
    piece = F.concat(F.lit("<message role="), role_name(), F.lit(">\n<content>\n"), F.coalesce("text", F.lit("")), F.lit("\n</content>\n</message>"))
    part = F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece"))))
    return rows.groupBy("conv_id").agg(F.array_join(part["piece"], "").alias("history"))


def route_turn(turns: DataFrame) -> DataFrame:
    """next_step of each turn by fixed rules, then the supplied decision, then the guards.

    Columns: context, new_message (a human message opens the turn), sources_exhausted,
    retriever_empty, last_agent, decision.
    """
    ctx = F.coalesce("context", F.lit(""))
    fresh = F.col("new_message") & (ctx == "")
    exhausted, empty = F.col("sources_exhausted") & ~fresh, F.col("retriever_empty") & ~fresh
    rule = (
        F.when(exhausted, "__end__")
        .when(ctx.contains("[RESEARCH_COMPLETE]"), "analyst")
        .when(empty, "researcher")
        .when(ctx.contains("Visual artifact generated"), "__end__")
        .when(F.col("last_agent").isin("[ANALYST]", "[MENTOR]"), "__end__")
        .when(ctx.contains("get_subgraphs_to_visualize"), "visualizer")
        .when(ctx.contains("search_knowledge_base"), "analyst")
        .when(ctx.contains("## Web Research Findings"), "analyst")
    )
    step = F.coalesce(rule, F.col("decision"))
    guarded = F.when(step.isNull() | ((step == "visualizer") & ~ctx.contains("get_subgraphs_to_visualize")), "retriever").otherwise(step)
    return turns.withColumn("by_rule", rule.isNotNull()).withColumn("next_step", guarded)


def final_response(threads: DataFrame, responses: DataFrame, notices: dict[str, str] = FALLBACKS) -> DataFrame:
    """Per thread the analyst's and mentor's responses in order, else a notice chosen from the context."""
    part = F.array_sort(F.collect_list(F.struct("seq", "text")))
    got = responses.where("agent in ('analyst', 'mentor')").groupBy("thread_id").agg(F.array_join(part["text"], "\n\n").alias("response"))
    ctx = F.coalesce("context", F.lit(""))
    notice = (
        F.when(ctx.contains('"all_sources_exhausted": true'), notices["exhausted"])
        .when(ctx.contains("Visualization failed"), notices["visual"])
        .when(ctx.contains('"no_results": true'), notices["empty"])
        .otherwise(notices["default"])
    )
    out = threads.join(got, "thread_id", "left")
    return out.select("thread_id", F.coalesce("response", notice).alias("response"), F.col("response").isNull().alias("is_fallback"))
