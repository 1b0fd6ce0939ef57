"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepframe.llm import query_defs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(query_defs.QUERIES)
ORACLE_SQL: dict[str, str] = dict(query_defs.ORACLE_SQL)


def pipeline_query() -> tuple[Callable[[SparkSession, str], DataFrame], str | None]:
    """The pipeline at the repository's top: its run and its SQL."""
    module = importlib.import_module("corpus_pipeline")
    return module.run, module.ORACLE_SQL
