"""All registered queries of the library's operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.plans import analysis, kernels, reads, reports, scalar, stores, stream

MODULES = (scalar, reads, analysis, reports, kernels, stream, stores)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
