"""Registry of named queries and their DuckDB oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the driver's
tables (through the panel views in :mod:`panelkit.fixtures`).  Its oracle
is plain SQL over the same base tables, with the panel views prefixed as
CTEs, so both sides compute from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelkit.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (),
          headline: bool = False):
    """Register ``fn`` under ``name`` with its oracle SQL (None = no SQL
    equivalent; the driver then checks row counts only)."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        if headline:
            HEADLINE.append(name)
        fn.query_name = name
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    import importlib
    for mod in ("panelkit.plans.linkage", "panelkit.plans.verbs", "panelkit.plans.panel",
                "panelkit.plans.casework", "panelkit.plans.storage", "panelkit.plans.calendar",
                "panelkit.plans.stored",
                "panelkit.streaming.plans"):
        try:
            importlib.import_module(mod)
        except ModuleNotFoundError as e:
            if e.name != mod:
                raise
