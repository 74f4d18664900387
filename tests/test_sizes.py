"""Queries over tables with larger keys or more repeats than the test tables have, against their SQL."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.operators import folds
from ledgerloom.plans import fixtures
from ledgerloom.sources import growing
from ledgerloom.streaming import ledger


def against_sql(spark, folder, name: str, tables: list[str]) -> None:
    df = catalog.queries()[name](spark, str(folder))
    names, db = sorted(df.columns), duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in names)) for r in want.fetchall())


@pytest.mark.parametrize("first", [999_990, 5_000_000_000])
def test_spans_of_large_keys(spark, tmp_path, first):
    spark.range(first, first + 40).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    against_sql(spark, tmp_path, "date_spans", ["orders"])


def test_line_items_are_shuffled_twice(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.usage(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(l_(?:order|part)key", plan)) == 2 and "Exchange hashpartitioning(o_custkey" in plan and "Exchange hashpartitioning(l_orderkey#" in plan


@pytest.mark.parametrize("unit", ["day", "week", "month"])
def test_a_filled_trend_reads_the_ledger_once(spark, small, unit):
    filled = catalog.queries()[f"trend_{unit}"](spark, small)
    assert "lineitem" not in filled._jdf.queryExecution().executedPlan().toString()


def test_a_merge_reads_its_rows_once(spark):
    rows = spark.range(8).select(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("dedup_key"), "id", F.col("id").alias("seq"), (F.col("id") % 4).alias("output_tokens"), F.lit("s").alias("source"))
    found = ledger.merged(rows.drop("id"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
    assert sorted((r.dedup_key, r.output_tokens, r.seq) for r in found.collect()) == [("k0", 3, 6), ("k1", 3, 7), ("k2", 2, 5)]


def test_small_logs_share_a_task(tmp_path):
    for n in range(300):
        (tmp_path / f"{n:03}.jsonl").write_bytes(b'{"n":%d}\n' % n * 3)
    reader = growing.GrowingReader({"path": str(tmp_path), "state": str(tmp_path / "s")})
    packs = reader.partitions({"n": 0}, reader.latestOffset())
    got = [line for p in packs for b in reader.read(p) for line in b.column(5).to_pylist()]
    assert len(packs) <= growing.SHARE and got == [f'{{"n":{n}}}' for n in range(300) for _ in range(3)]
    large = growing.packed([growing._Piece("i", "f", "f", 0, 0, a, a + growing.PIECE, 1 << 40) for a in range(0, 10 * growing.PIECE, growing.PIECE)])
    assert [len(p.pieces) for p in large] == [1] * 10  # no task reads more than before


@pytest.mark.parametrize("name", ["heatmap_days", "heatmap_levels", "heat_streak", "peak_day", "profile", "bucket_rank", "model_split", "split_topn", "bucket_csv"])
def test_days_and_models_shuffle_totals_only(spark, small, name):
    plan = catalog.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" in plan or "l_orderkey" in plan
    assert not re.search("cache_read_tokens|output_tokens", plan)


def test_ownership_reads_the_ledger_once(spark, small):
    plan = catalog.queries()["tool_ownership"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*l_linestatus", plan)) == 1
    rows = [("a", "f2", 1), ("a", "f1", 2), ("a", "f1", 2), ("b", "f3", 4), (None, "f1", 8), (None, "f1", 8), (None, None, 16), ("c", None, 32)]
    got = folds.owned(spark.createDataFrame(rows, "ident string, file string, n long")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows[1:]))
