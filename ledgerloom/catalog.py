"""Every registered query over the derived ledger, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import ledger_queries, limit_queries, page_queries, source_queries, store_queries, stream_queries, usage_queries
from ledgerloom.plans.usage_queries import Query
from ledgerloom.session import ship_package

_ALL: dict[str, tuple[Query, str | None]] = {**usage_queries.QUERIES, **ledger_queries.QUERIES, **page_queries.QUERIES, **source_queries.QUERIES, **store_queries.QUERIES, **stream_queries.QUERIES, **limit_queries.QUERIES}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ALL["series_day"][0](spark, sf_dir)


def _with_package(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _with_package(query) for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
