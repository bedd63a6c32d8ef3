"""Registry of runnable queries over the standard tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowmend.sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is checked by tests on fixtures instead."""
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str],
            where: str | None = None, needs: list[str] | None = None) -> DataFrame:
    """Projection written in the SQL both engines read.

    `needs` marks costly row-wise work and names the source columns it takes.
    """
    source = table(spark, sf_dir, name)
    source = source.where(where) if where else source
    if needs:
        source = spread(source.select(needs))
    return source.selectExpr(*[f"{text} AS `{alias}`" for alias, text in columns.items()])


def derived_sql(name: str, columns: dict[str, str], where: str | None = None) -> str:
    listed = ", ".join(f'{text} AS "{alias}"' for alias, text in columns.items())
    return f"SELECT {listed} FROM {name}" + (f" WHERE {where}" if where else "")
