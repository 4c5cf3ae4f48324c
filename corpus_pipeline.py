"""A training corpus from `documents` in five stages, each written as Parquet and read again.

All stages but the last return the columns of `documents`; other columns, which may bear any name,
are not carried on.  An empty table stays empty, and repeated rows are decided alike, each by its
own text or, in the near-duplicate stage, by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernlake.llm import decontaminate, mixing, ngram_jaccard, quality, registry, secrets
from fernlake.plans.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the model learns from the labelled rows.

    A null or empty text has the model's score of an empty text; ids are not read.
    """
    model = registry.quality_model(spark, sf_dir)
    return quality.keep_good(docs.select(*COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8) the smallest id stays.

    Null and wordless texts, and rows with a null id, are in no group and stay.
    """
    return ngram_jaccard.keep_one(docs.select(*COLUMNS), size=5, num=80, den=100).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and wordless texts hold none; a row with a null id stays.  Without items all stay.
    """
    items = registry.table(spark, sf_dir, "benchmark")
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), items).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by marks of their kind, and `n_chars` follows; null texts stay null."""
    return secrets.redact(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in a stream that follows the target weights of the sources.

    A null source is a source of its own; rows with repeated or null ids are placed one by one.
    """
    return mixing.mix(docs.select(*COLUMNS), registry.MIX_WEIGHTS)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL can express neither the classifier nor the latent search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder that the next one reads."""
    scratch = Scratch(spark)
    docs = registry.table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        last = k == len(STAGES) - 1
        new = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}", last=last)
        scratch.drop(docs)
        docs = new
    return docs
