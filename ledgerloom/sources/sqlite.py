"""SQLite files as a Spark data source: one partition for each file, rows streamed from a read-only connection.

Read through spark.read.format("sqlite_rows").option("query", ...).schema(...).load(paths). The files are small local
artifacts of tools; on a cluster they have to lie where the executors can open them.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.functions.formats import absolute_project, epoch, iso_epoch
from ledgerloom.sources.lines import zero
from ledgerloom.sources.records import ledger_rows


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[_File]:
        return [_File(p) for pattern in self.options["path"].split(",") for p in sorted(glob.glob(pattern) or [pattern]) if os.path.isfile(p)]

    def read(self, partition: _File) -> Iterator[tuple]:
        import sqlite3

        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as db:
            rows = db.execute(f"SELECT * FROM ({self.options['query']})")
            there = {c[0]: i for i, c in enumerate(rows.description)}
            missing = [n for n in self.names if n != "file" and n not in there]
            if missing:
                raise ValueError(f"{partition.path}: no column {', '.join(missing)}")
            for row in rows:
                yield tuple(partition.path if n == "file" else row[there[n]] for n in self.names)


class SqliteRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        raise ValueError("give the schema")

    def reader(self, schema) -> _Reader:
        return _Reader(schema, self.options)


def sqlite_rows(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query over each file of a path pattern; `file` in the schema is the file's path."""
    spark.dataSource.register(SqliteRows)
    return spark.read.format("sqlite_rows").option("query", query).schema(schema).load(path)


def _session_sums(rows: DataFrame, source: str, key: str, time: Column, **more: Column) -> DataFrame:
    """Tables that hold one row of sums for each session; their output lacks the reasoning."""
    return ledger_rows(
        rows, source, dedup_key=F.concat(F.lit(key), F.col("id")), timestamp=time, project=absolute_project(F.col("cwd")), input_tokens="input_tokens", output_tokens=zero(F.col("output_tokens")) + zero(F.col("reasoning_tokens")),
        cache_read_tokens="cache_read_tokens", cache_write_5m_tokens="cache_write_tokens", source_file="file", session_id="id", reasoning_tokens="reasoning_tokens", **more,
    )


_SUMS = "input_tokens bigint, output_tokens bigint, reasoning_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint"


def hermes_records(spark: SparkSession, path: str) -> DataFrame:
    rows = sqlite_rows(spark, path, "SELECT id, model, CAST(started_at AS INTEGER) started_at, input_tokens, output_tokens, reasoning_tokens, cache_read_tokens, cache_write_tokens, api_call_count, cwd FROM sessions", f"file string, id string, model string, started_at bigint, {_SUMS}, api_call_count bigint, cwd string")
    return _session_sums(rows, "hermes", "hermes:", epoch(F.col("started_at")), model=F.col("model"), api_calls=F.greatest(zero(F.col("api_call_count")), F.lit(1)))


def kilo_records(spark: SparkSession, path: str) -> DataFrame:
    rows = sqlite_rows(
        spark, path, "SELECT id, directory cwd, time_created, time_updated, model, tokens_input input_tokens, tokens_output output_tokens, tokens_reasoning reasoning_tokens, tokens_cache_read cache_read_tokens, tokens_cache_write cache_write_tokens FROM session",
        f"file string, id string, cwd string, time_created bigint, time_updated bigint, model string, {_SUMS}",
    )
    model = F.coalesce(F.get_json_object("model", "$.modelID"), F.get_json_object("model", "$.id"))
    return _session_sums(rows, "kilo", "kilo:session:", epoch(F.coalesce("time_updated", "time_created")), model=model)


def copilot_records(spark: SparkSession, path: str) -> DataFrame:
    """The details' exact counts where they add up to the input; else the cache is taken out of the input as far as it goes."""
    rows = sqlite_rows(spark, path, "SELECT id, session_id, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, token_details_json, created_at FROM assistant_usage_events", f"file string, id bigint, session_id string, model string, {_SUMS}, token_details_json string, created_at string")
    rows = rows.withColumn("d", F.from_json("token_details_json", "array<struct<tokenType: string, tokenCount: bigint>>"))
    of = lambda kind: F.aggregate(F.filter("d", lambda x: x["tokenType"] == kind), F.lit(0).cast("long"), lambda s, x: s + x["tokenCount"])
    exact = F.coalesce(F.col("d").isNotNull() & (of("input") + of("cache_read") + of("cache_write") == F.col("input_tokens")), F.lit(False))
    read = F.least(zero(F.col("cache_read_tokens")), zero(F.col("input_tokens")))
    written = F.least(zero(F.col("cache_write_tokens")), zero(F.col("input_tokens")) - read)
    pick = lambda kind, other: F.when(exact, of(kind)).otherwise(other)
    return ledger_rows(
        rows, "copilot", dedup_key=F.concat_ws(":", F.lit("copilot"), "session_id", F.col("id").cast("string")), timestamp=iso_epoch(F.replace(F.col("created_at"), F.lit(" "), F.lit("T"))), model="model", input_tokens=pick("input", zero(F.col("input_tokens")) - read - written),
        output_tokens="output_tokens", cache_read_tokens=pick("cache_read", read), cache_write_5m_tokens=pick("cache_write", written), source_file="file", session_id="session_id", reasoning_tokens="reasoning_tokens",
    )


#: Fixed value: versions of the session store that are understood.
GOOSE_VERSIONS = range(1, 16)


def goose_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, name): the tables of each store."""
    return sqlite_rows(spark, path, "SELECT name FROM sqlite_master WHERE type = 'table'", "file string, name string")


def goose_store(spark: SparkSession, path: str) -> DataFrame:
    """`goose_records` of one store, after a look at its schema: an unknown version, or none of its sessions, is an error; the usage
    ledger may be missing."""
    names = {r.name for r in goose_tables(spark, path).collect()}  # a row a table
    if "schema_version" in names:
        version = sqlite_rows(spark, path, "SELECT max(version) AS version FROM schema_version", "version bigint").first().version
        if version not in GOOSE_VERSIONS:
            raise ValueError(f"goose: schema version {version} is not known ({GOOSE_VERSIONS[0]} to {GOOSE_VERSIONS[-1]} are)")
    if "sessions" not in names:
        raise ValueError("goose: the store has no sessions")
    return goose_records(spark, path, "usage_ledger" in names)


def goose_records(spark: SparkSession, path: str, has_ledger: bool = True) -> DataFrame:
    """Rows of the usage ledger with their session's folder; sessions without such rows count by their own sums."""
    none = "SELECT NULL id, NULL session_id, NULL created_timestamp, NULL model, NULL input_tokens, NULL output_tokens, NULL cache_read_tokens, NULL cache_write_tokens, NULL working_dir LIMIT 0"
    booked = sqlite_rows(spark, path, none if not has_ledger else "SELECT u.id, u.session_id, u.created_timestamp, u.model, u.input_tokens, u.output_tokens, u.cache_read_tokens, u.cache_write_tokens, s.working_dir FROM usage_ledger u LEFT JOIN sessions s ON s.id = u.session_id", "file string, id bigint, session_id string, created_timestamp bigint, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, working_dir string")
    counters = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    sums = ", ".join(f"COALESCE(NULLIF(accumulated_{c}, 0), {c}, 0) {c}" for c in counters)
    alone = sqlite_rows(spark, path, f"SELECT id, working_dir, COALESCE(updated_at, created_at) at, {sums} FROM sessions", "file string, id string, working_dir string, at string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint")
    plain = zero(F.col("input_tokens")) - zero(F.col("cache_read_tokens")) - zero(F.col("cache_write_tokens"))
    common = {"project": absolute_project(F.col("working_dir")), "input_tokens": plain, "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_tokens", "cache_write_5m_tokens": "cache_write_tokens", "source_file": "file"}
    first = ledger_rows(booked, "goose", dedup_key=F.concat_ws(":", F.lit("goose:usage"), "session_id", F.col("id").cast("string")), timestamp=epoch(F.col("created_timestamp")), model="model", session_id="session_id", **common)
    rest = alone.join(booked.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti")
    return first.unionByName(ledger_rows(rest, "goose", dedup_key=F.concat(F.lit("goose:session:"), F.col("id")), timestamp=iso_epoch(F.replace(F.col("at"), F.lit(" "), F.lit("T"))), session_id="id", **common))
