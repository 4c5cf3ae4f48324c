"""Exact token counts by an aggregated length histogram.

Each document's whole text is encoded by a public vocabulary and only its number of tokens
leaves the task.  Documents are counted by length; sums over all longer lengths then answer,
for every context limit, how many documents exceed it, the tokens that remain after truncation
and the quantile at it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.llm import encoding
from fernlake.llm import textkernel as tk
from fernlake.plans.scratch import Scratch

def document_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) per row; a null or empty text has 0 tokens.  Strings of special tokens are plain text.

    `vocabulary` is a tokenizer file (default: the supplied one); executors read it by the path given,
    so on a cluster it lies in a folder they share or comes with the job's files.  Texts of any length
    and shape are encoded whole.  Repeated rows and null ids come back as they are.
    """

    path = vocabulary or encoding.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]):
        own = encoding.encoder(path)
        for batch in batches:
            n = [own.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    tk.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs: documents of it, and suffix sums over all lengths at or above it.

    Columns: n_tokens, n_docs, docs_from (documents this long or longer), tokens_from (their
    tokens), tokens_kept (all tokens left if texts are cut to this limit), docs_cut (documents
    that the limit cuts) and share_within (share of documents within the limit, an exact
    quantile).  Null lengths are left out.  An empty table gives an empty result.  Sums run within
    ranges of lengths and across their totals, so no task sees all lengths.
    """
    n = F.col(length_col).cast("long")
    hist = lengths.where(n.isNotNull()).groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    # the histogram is read three times below; its table keeps the texts from being encoded again
    hist = Scratch(lengths.sparkSession).keep(hist, "histogram", last=True)
    hist = hist.withColumn("part", F.floor(F.sqrt(F.col("n_tokens").cast("double"))).cast("long"))
    totals = hist.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select("part", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    whole = totals.agg(F.sum("d").alias("d_all"), F.sum("t").alias("t_all"))
    inside = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("t_in", F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside))
    out = out.join(sums, "part").join(F.broadcast(whole), F.lit(True))
    out = out.withColumn("docs_from", F.col("d_in") + F.col("d_above")).withColumn("tokens_from", F.col("t_in") + F.col("t_above"))
    cut = F.col("docs_from") - F.col("n_docs")
    kept = F.col("t_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")
    share = (F.col("d_all") - cut) / F.col("d_all")
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from", kept.alias("tokens_kept"), cut.alias("docs_cut"), share.alias("share_within"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_cut, tokens_kept) for each context limit, from the suffix sums at the next longer length.

    Where no text is longer, nothing is cut; an empty histogram has no tokens to keep.
    """
    n = F.col("n_tokens")
    beyond = lambda x: F.min_by(F.struct("docs_from", "tokens_from"), F.when(n > x, n))
    one = histogram.agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("whole"), *(beyond(x).alias(f"after_{k}") for k, x in enumerate(limits)))
    each = F.array(*(F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"after_{k}").alias("after")) for k, x in enumerate(limits)))
    rows = one.select("whole", F.inline(each))
    cut = F.coalesce("after.docs_from", F.lit(0)).cast("long")
    kept = F.col("whole") - F.coalesce("after.tokens_from", F.lit(0)) + cut * F.col("context_limit")
    return rows.select("context_limit", cut.alias("docs_cut"), kept.cast("long").alias("tokens_kept"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length within which at least that share of the documents lies; null without documents."""
    within = [F.min(F.when(F.col("share_within") >= q, F.col("n_tokens"))).alias(f"q_{k}") for k, q in enumerate(shares)]
    each = F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q_{k}").alias("n_tokens")) for k, q in enumerate(shares)))
    return histogram.agg(*within).select(F.inline(each))
