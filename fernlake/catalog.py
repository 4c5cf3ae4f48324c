"""Registry of the library's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernlake.queries import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL twins; those with a recursive part say so at their head."""
    return {k: v.replace("with ", "with recursive ", 1) if v.lstrip().startswith("with ") and "recursive" not in v[:20] else v for k, v in ORACLES.items()}
