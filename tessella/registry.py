"""Named queries of the library and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.queries import catalog, dialogue, flow, history, kept, machines, pictures, profile, records, regions, remote, stores, taste

MODULES = (catalog, taste, dialogue, flow, profile, records, stores, remote, machines, pictures, kept, history, regions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the catalog and preference model."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can state."""
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
