"""Library functions under names for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.functions import text as tx


#: Name -> the library's function on columns, for callers that build plans by name.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "clean_text": tx.clean_text, "normalize_whitespace": tx.normalize_whitespace, "smart_truncate": tx.smart_truncate, "truncate_marked": tx.truncate_marked,
    "entity_id": tx.entity_id, "extract_link": tx.extract_link, "link_slug": tx.link_slug, "fence_strip": tx.fence_strip, "token_count": tx.token_count,
}

#: SQL bodies of the registered functions: name -> (parameters, body).  `w` is a class of blanks, `b` the blanks themselves.
_SQL = {
    "normalize_whitespace": ("s string", "btrim(regexp_replace(s, r'{w}+', ' '), ' ')"),
    "clean_text": (
        "s string",
        r"""btrim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(normalize_whitespace(s), r'\[\[(.*?)\|.*?\]\]', '$1'), r'\[\[(.*?)\]\]', '$1'),
        r'\{\{c\d+::(.*?)(::.*?)?\}\}', '$1'), '**', ''), '__', ''), r'!\[(.*?)\]\(.*?\)', '$1'), {b})""",
    ),
    "entity_id": ("label string, name string", "substring(sha2(case when coalesce(label, '') = '' then name else concat(label, ':', name) end, 256), 1, 16)"),
    "truncate_marked": ("s string, n int", r"case when length(s) <= n then s else concat(substring(s, 1, n), '\n... [+', cast(length(s) - n as string), ' chars truncated]') end"),
    "sentence_cut": (
        "head string, n int",
        """case when locate(' .', reverse(head)) > 0 and (length(head) - locate(' .', reverse(head)) - 1) * 10 >= n * 6 then substring(head, 1, length(head) - locate(' .', reverse(head)))
        when locate(' !', reverse(head)) > 0 and (length(head) - locate(' !', reverse(head)) - 1) * 10 >= n * 6 then substring(head, 1, length(head) - locate(' !', reverse(head)))
        when locate(' ?', reverse(head)) > 0 and (length(head) - locate(' ?', reverse(head)) - 1) * 10 >= n * 6 then substring(head, 1, length(head) - locate(' ?', reverse(head)))
        when locate(chr(10), reverse(head)) > 0 and (length(head) - locate(chr(10), reverse(head))) * 10 >= n * 6 then substring(head, 1, length(head) - locate(chr(10), reverse(head)) + 1) else head end""",
    ),
    "smart_truncate": ("s string, n int", "case when length(s) <= n then s else concat(trim(trailing {b} from sentence_cut(substring(s, 1, n), n)), ' …[truncated]') end"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions in plain SQL, so that they stay inside the optimizer."""
    for name, (params, body) in _SQL.items():
        body = body.replace("{w}", r"[ \t\r\n\f\x0B]").replace("{b}", "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))")
        spark.sql(f"create or replace temporary function {name}({params}) returns string return {body}")
    return list(_SQL)


def token_counter(count: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A caller's batch tokenizer as a column function on Arrow batches."""
    return F.pandas_udf(count, "long")


def token_budget_filter(df: DataFrame, tokens: Column, budget: int = 8000) -> DataFrame:
    return df.where(tokens <= budget)
