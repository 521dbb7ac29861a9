"""All core queries and their oracles by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.plans import conversion, formats, graphs, maintenance, matching, problems, reconciliation, records, reporting, scalars, validation

CATALOGS = [scalars.CATALOG, graphs.CATALOG, reconciliation.CATALOG, validation.CATALOG, maintenance.CATALOG, reporting.CATALOG, conversion.CATALOG, matching.CATALOG, records.CATALOG, formats.CATALOG]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**problems.QUERIES, **{k: v for c in CATALOGS for k, v in c.queries.items()}}


def oracle_sql() -> dict[str, str]:
    return {**problems.ORACLE_SQL, **{k: v for c in CATALOGS for k, v in c.sql.items()}}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.record_edges(spark, sf)
