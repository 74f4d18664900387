"""A usage ledger derived from the test tables, and the same derivation as SQL.

Money is kept in whole nano-dollars, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.operators.usage import TOKENS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, source, model, tokens) of the usage records: their total is worked out before the line items are shuffled."""
    return usage(spark, sf_dir, total=True).select("timestamp", "source", "model", "tokens")


def usage(spark: SparkSession, sf_dir: str, ordered: bool = False, total: bool = False) -> DataFrame:
    """One usage record for each line item, in USAGE_SCHEMA's columns; ordered: and `seq`, its order of arrival; total: and `tokens`.

    Line items are shuffled twice, by part and by order; orders, a quarter as many, find their customer's place first. What a
    record counts is worked out before that, so that small whole numbers are shuffled and not prices, unless `seq` has those."""
    long = lambda c: c.cast("long")
    num = F.col("l_linenumber")
    counts = {
        "timestamp": _epoch("l_shipdate"), "api_calls": long(num % 3 + 1), "input_tokens": long(F.floor(F.col("l_quantity") * 100)), "output_tokens": long(F.floor(F.col("l_extendedprice") / 100)),
        "cache_read_tokens": long(F.round(F.col("l_discount") * 1000)), "cache_write_5m_tokens": long(F.round(F.col("l_tax") * 1000)), "cache_write_1h_tokens": long(num % 3),
        "reasoning_tokens": F.when(F.col("l_returnflag") != "R", long(F.floor(F.col("l_extendedprice") / 1000))),
    }
    if total:
        counts["tokens"] = sum((counts[c] for c in TOKENS[1:]), counts[TOKENS[0]])
    line = table(spark, sf_dir, "lineitem")
    if not ordered:
        line = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", *[c.alias(n) for n, c in counts.items()])
        counts = {n: F.col(n) for n in counts}
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") != 1, F.col("p_brand")).alias("model"))
    place = (
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.when(F.col("n_name") != "NATION_7", F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"))).alias("project"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "P").alias("partial"), F.lower("o_orderpriority").alias("source"))
    orders = orders.join(place, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Ties are rows that are equal in every column a query reads.
    seq = F.struct(counts["timestamp"].alias("t"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("seq")
    return joined.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), num.cast("string")).alias("dedup_key"), "source", counts["timestamp"].alias("timestamp"), "model", "project",
        *[counts[c].alias(c) for c in ("api_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens")],
        F.concat("l_linestatus", F.lit("/"), F.col("l_suppkey").cast("string")).alias("source_file"),
        F.when(~(F.col("partial") & (num == 7)), F.col("l_orderkey").cast("string")).alias("session_id"),
        counts["reasoning_tokens"].alias("reasoning_tokens"), *([seq] if ordered else []), *([counts["tokens"].alias("tokens")] if total else []),
    )


USAGE_SQL = """usage AS (
  SELECT l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR AS dedup_key, lower(o_orderpriority) AS source,
    epoch_us(l_shipdate) // 1000000 AS timestamp, CASE WHEN p_size <> 1 THEN p_brand END AS model,
    CASE WHEN n_name <> 'NATION_7' THEN '/' || r_name || '/' || n_name END AS project, (l_linenumber % 3 + 1)::BIGINT AS api_calls,
    floor(l_quantity * 100)::BIGINT AS input_tokens, floor(l_extendedprice / 100)::BIGINT AS output_tokens,
    round(l_discount * 1000)::BIGINT AS cache_read_tokens, round(l_tax * 1000)::BIGINT AS cache_write_5m_tokens, (l_linenumber % 3)::BIGINT AS cache_write_1h_tokens,
    l_linestatus || '/' || l_suppkey::VARCHAR AS source_file,
    CASE WHEN NOT (o_orderstatus = 'P' AND l_linenumber = 7) THEN l_orderkey::VARCHAR END AS session_id,
    CASE WHEN l_returnflag <> 'R' THEN floor(l_extendedprice / 1000)::BIGINT END AS reasoning_tokens,
    epoch_us(l_shipdate) // 1000000 AS k1, l_partkey AS k2, l_suppkey AS k3, l_quantity AS k4, l_extendedprice AS k5, l_discount AS k6, l_tax AS k7, l_returnflag AS k8, l_linestatus AS k9
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def rates(spark: SparkSession) -> DataFrame:
    """Catalog rates in nano-dollars a token, for brands 1 to 25; every fifth brand has none."""
    n = F.col("n")
    brands = spark.range(1, 26).select(F.col("id").alias("n")).filter("n % 5 <> 0")
    return brands.select(
        F.concat(F.lit("Brand#"), n.cast("string")).alias("model"), (1000 * n).alias("input"), (5000 * n).alias("output"),
        F.when(n % 4 == 0, 0).otherwise(100 * n).alias("cache_read"), (1250 * n).alias("cache_write_5m"), (2000 * n).alias("cache_write_1h"),
        F.when(n % 3 == 0, "publisher").when(n % 3 == 1, "litellm").otherwise("openrouter").alias("catalog"),
    )


def overrides(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('Brand#1', 7000L, 9000L, 10L, CAST(NULL AS BIGINT)), ('Brand#2', 100L, 200L, CAST(NULL AS BIGINT), 300L) AS o(model, input, output, cache_read, cache_write)")


RATES_SQL = """rates AS (
  SELECT model, input, output, cache_read, cache_write_5m, cache_write_1h, origin FROM (
    SELECT 'Brand#' || n::VARCHAR AS model, 1000 * n AS input, 5000 * n AS output, CASE WHEN n % 4 = 0 THEN 0 ELSE 100 * n END AS cache_read,
      1250 * n AS cache_write_5m, 2000 * n AS cache_write_1h, CASE n % 3 WHEN 0 THEN 'publisher' WHEN 1 THEN 'litellm' ELSE 'openrouter' END AS origin
    FROM (SELECT unnest(range(1, 26)) AS n) WHERE n % 5 <> 0) WHERE model NOT IN ('Brand#1', 'Brand#2')
  UNION ALL SELECT 'Brand#1', 7000, 9000, 10, 0, 0, 'override' UNION ALL SELECT 'Brand#2', 100, 200, 0, 300, 300, 'override')"""


def hourly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger with times of day, from the events table."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("dedup_key"), F.col("event_type").alias("source"), _epoch("ts").alias("timestamp"),
        F.when(k % 7 != 0, F.concat(F.lit("m"), (k % 7).cast("string"))).alias("model"), F.col("user_id").cast("string").alias("session_id"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), k.alias("output_tokens"),
    )


HOURLY_SQL = """hourly AS (
  SELECT event_id::VARCHAR AS dedup_key, event_type AS source, epoch_us(ts) // 1000000 AS timestamp,
    CASE WHEN k % 7 <> 0 THEN 'm' || (k % 7)::VARCHAR END AS model, user_id::VARCHAR AS session_id, floor(value * 100)::BIGINT AS input_tokens, k AS output_tokens
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit readings from the events table: each source's day fills a window from 0 to 99 percent."""
    day = W.Window.partitionBy("source", "d")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("d"), F.col("ts"), "event_id", "user_id", _epoch("ts").alias("observed_at"))
    rows = rows.withColumn("rn", F.row_number().over(day.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(day))
    return rows.select(
        "source", F.lit("w1440").alias("window_key"), F.lit(1440).cast("long").alias("window_minutes"), F.expr("(99 * rn) div n").cast("double").alias("used_pct"),
        F.unix_seconds(F.date_add("d", 1).cast("timestamp")).alias("resets_at"), "observed_at", F.col("event_id").alias("source_order"),
        F.when(F.col("user_id") % 10 != 0, "acct").alias("account_id"), F.lit("plan").alias("plan"), F.lit("regime").alias("metering_regime"),
        F.concat(F.col("source"), F.lit(":limit")).alias("limit_id"), F.lit("all").alias("model_scope"),
        F.min("observed_at").over(W.Window.partitionBy("source")).alias("covered_from"), F.lit(None).cast("string").alias("external_activity"),
    )


READINGS_SQL = """readings AS (
  SELECT source, 'w1440' AS window_key, 1440::BIGINT AS window_minutes, ((99 * rn) // n)::DOUBLE AS used_pct, epoch_us((d + 1)::TIMESTAMP) // 1000000 AS resets_at,
    observed_at, event_id AS source_order, CASE WHEN user_id % 10 <> 0 THEN 'acct' END AS account_id
  FROM (SELECT event_type AS source, ts::DATE AS d, epoch_us(ts) // 1000000 AS observed_at, event_id, user_id,
    row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type, ts::DATE) AS n FROM events))"""
