"""Limits under harder readings: percents that fall, resets that wander within and beyond the jitter, two accounts that take turns
and readings without one; and records that name their account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.operators import limits
from ledgerloom.plans import fixtures


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    day = W.Window.partitionBy("source", "d")
    rows = fixtures.table(spark, sf, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("d"), "ts", "event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("observed_at"))
    rows = rows.withColumn("rn", F.row_number().over(day.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(day))
    pct = F.greatest(F.expr("(102 * rn) div n") - F.when(F.col("rn") % 17 == 0, 9).otherwise(0), F.lit(0))
    moved = (F.col("rn") % 4) * 150 + F.when(F.col("rn") % 97 == 0, 2000).otherwise(0)
    return rows.select(
        "source", F.lit("w1440").alias("window_key"), F.lit(1440).cast("long").alias("window_minutes"), pct.cast("double").alias("used_pct"), (F.unix_seconds(F.date_add("d", 1).cast("timestamp")) + moved).alias("resets_at"), "observed_at", F.col("event_id").alias("source_order"),
        F.when(F.col("user_id") % 10 != 0, F.when(F.expr("(rn div 40) % 3 = 0"), "b").otherwise("a")).alias("account_id"), F.lit("plan").alias("plan"), F.lit("regime").alias("metering_regime"), F.concat(F.col("source"), F.lit(":limit")).alias("limit_id"),
        F.when(F.col("source") < "d", '["m1","m2"]').otherwise("all").alias("model_scope"), F.min("observed_at").over(W.Window.partitionBy("source")).alias("covered_from"), F.lit(None).cast("string").alias("external_activity"),
    )


def _walked(spark: SparkSession, sf: str) -> DataFrame:
    out = limits.walk(_readings(spark, sf))
    grouped = out.groupBy("source", "account_id", "epoch", "from_pct", "to_pct", "t0", "t1", "reason").agg(F.sum("n").alias("n"))
    return grouped


#: The walk, reading by reading. ea, ha, eb, hb: the open epoch of either account and its highest percent; sa, se: the account and
#: epoch of the open stretch; act: what the reading is to it.
_WALK_SQL = """h AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY observed_at, resets_at, event_id, pct) AS i, pct, resets_at, observed_at, acc FROM (
    SELECT source, observed_at, event_id, greatest(0, (102 * rn) // n - CASE WHEN rn % 17 = 0 THEN 9 ELSE 0 END) AS pct0, least(100, greatest(0, (102 * rn) // n - CASE WHEN rn % 17 = 0 THEN 9 ELSE 0 END))::BIGINT AS pct, epoch_us((d + 1)::TIMESTAMP) // 1000000 + (rn % 4) * 150 + CASE WHEN rn % 97 = 0 THEN 2000 ELSE 0 END AS resets_at,
      CASE WHEN user_id % 10 <> 0 THEN CASE WHEN (rn // 40) % 3 = 0 THEN 'b' ELSE 'a' END END AS acc
    FROM (SELECT event_type AS source, ts::DATE AS d, epoch_us(ts) // 1000000 AS observed_at, event_id, user_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type, ts::DATE) AS n FROM events))),
  w AS (SELECT source, 0::BIGINT AS i, NULL::BIGINT AS ea, 0::BIGINT AS ha, NULL::BIGINT AS eb, 0::BIGINT AS hb, NULL::VARCHAR AS sa, NULL::BIGINT AS se, 0::BIGINT AS anchor, 0::BIGINT AS highest, 0::BIGINT AS t0, NULL::VARCHAR AS lacks, NULL::VARCHAR AS reason, NULL::BIGINT AS from_pct, NULL::BIGINT AS to_pct, NULL::BIGINT AS was, NULL::BIGINT AS now, NULL::VARCHAR AS acc, NULL::BIGINT AS epoch
      FROM (SELECT DISTINCT source FROM h)
    UNION ALL
    SELECT source, i, CASE WHEN acc = 'a' THEN e ELSE ea END, CASE WHEN acc = 'a' THEN hi ELSE ha END, CASE WHEN acc = 'b' THEN e ELSE eb END, CASE WHEN acc = 'b' THEN hi ELSE hb END,
      CASE WHEN acc IS NULL THEN CASE WHEN act IN ('percentage-decrease', 'percentage-saturation') THEN NULL ELSE sa END WHEN act = 'same' THEN sa ELSE acc END,
      CASE WHEN acc IS NULL THEN CASE WHEN act IN ('percentage-decrease', 'percentage-saturation') THEN NULL ELSE se END WHEN act = 'same' THEN se ELSE e END,
      CASE WHEN acc IS NULL OR act = 'same' THEN anchor ELSE pct END, CASE WHEN acc IS NULL THEN CASE WHEN sa IS NULL THEN highest ELSE greatest(highest, pct) END WHEN act = 'same' THEN highest ELSE pct END,
      CASE WHEN acc IS NULL OR act = 'same' THEN t0 ELSE observed_at END, CASE WHEN acc IS NULL THEN 'missing-account-identity' END, CASE WHEN act NOT IN ('same', 'anchor', 'interval') THEN act END,
      CASE WHEN act = 'interval' THEN anchor END, CASE WHEN act = 'interval' THEN pct END, CASE WHEN act = 'interval' THEN t0 END, CASE WHEN act = 'interval' THEN observed_at END, CASE WHEN act = 'interval' THEN acc END, CASE WHEN act = 'interval' THEN e END
    FROM (SELECT *, CASE WHEN acc IS NULL THEN CASE WHEN sa IS NULL THEN 'same' WHEN pct < highest THEN 'percentage-decrease' WHEN pct >= 100 THEN 'percentage-saturation' ELSE 'same' END WHEN sa IS NULL THEN 'anchor' WHEN sa <> acc THEN 'identity-change' WHEN se <> e THEN 'reset-boundary'
        WHEN pct < highest THEN 'percentage-decrease' WHEN pct = anchor THEN 'same' WHEN pct >= 100 THEN 'percentage-saturation' WHEN t0 = observed_at THEN 'ambiguous-reading-order' ELSE 'interval' END AS act
      FROM (SELECT *, CASE WHEN stays THEN oe ELSE resets_at END AS e, CASE WHEN stays THEN greatest(oh, pct) ELSE pct END AS hi
        FROM (SELECT *, coalesce(oe IS NOT NULL AND (resets_at = oe OR (abs(resets_at - oe) <= 600 AND pct >= oh)), FALSE) AS stays
          FROM (SELECT w.source, h.i, w.ea, w.ha, w.eb, w.hb, w.sa, w.se, w.anchor, w.highest, w.t0, h.pct, h.resets_at, h.observed_at, h.acc, CASE h.acc WHEN 'a' THEN w.ea WHEN 'b' THEN w.eb END AS oe, CASE h.acc WHEN 'a' THEN w.ha WHEN 'b' THEN w.hb END AS oh FROM w JOIN h ON h.source = w.source AND h.i = w.i + 1)))))"""
WALKED_SQL = f"""WITH RECURSIVE {_WALK_SQL}, x AS (SELECT source, acc AS account_id, epoch, from_pct, to_pct, was AS t0, now AS t1, NULL::VARCHAR AS reason FROM w WHERE from_pct IS NOT NULL
    UNION ALL SELECT source, NULL, NULL, NULL, NULL, NULL, NULL, lacks FROM w WHERE lacks IS NOT NULL UNION ALL SELECT source, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM w WHERE reason IS NOT NULL)
  SELECT *, count(*)::BIGINT AS n FROM x GROUP BY ALL"""


def _used(spark: SparkSession, sf: str) -> DataFrame:
    """A record for each event, of one of three accounts or none, and of one of four models or none."""
    n = F.col("event_id")
    return fixtures.table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.when(n % 5 < 3, F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3).cast("int"))).alias("account_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(n % 211 != 0, F.concat(F.lit("m"), (n % 4).cast("string"))).alias("model"), (n % 7).alias("tokens"),
    )


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    rows = limits.with_usage(limits.walk(_readings(spark, sf)).filter("reason is null"), _used(spark, sf))
    return rows.select("source", "account_id", "model_scope", "epoch", "from_pct", "to_pct", "t0", "t1", "tokens", "reason")


ACCOUNTS_SQL = f"""WITH RECURSIVE {_WALK_SQL},
  u AS (SELECT event_type AS source, CASE WHEN event_id % 5 < 3 THEN ['a', 'b', 'c'][event_id % 3 + 1] END AS account, epoch_us(ts) // 1000000 AS t, CASE WHEN event_id % 211 <> 0 THEN 'm' || (event_id % 4) END AS model, event_id % 7 AS tokens FROM events),
  x AS (SELECT source, acc AS account_id, CASE WHEN source < 'd' THEN '["m1","m2"]' ELSE 'all' END AS model_scope, epoch, from_pct, to_pct, was AS t0, now AS t1 FROM w WHERE from_pct IS NOT NULL),
  s AS (SELECT x.*, coalesce(sum(u.tokens) FILTER (model_scope = 'all' OR u.model IN ('m1', 'm2')), 0)::BIGINT AS tokens, count(*) FILTER (model_scope <> 'all' AND u.t IS NOT NULL AND u.model IS NULL) AS nameless
    FROM x LEFT JOIN u ON u.source = x.source AND (u.account IS NULL OR u.account = x.account_id) AND u.t > x.t0 AND u.t <= x.t1 GROUP BY ALL)
  SELECT source, account_id, model_scope, epoch, from_pct, to_pct, t0, t1, tokens, CASE WHEN nameless > 0 THEN 'unattributed-model-usage' WHEN tokens = 0 THEN 'zero-local-usage' END AS reason FROM s"""

QUERIES = {
    "limit_walk_hard": (_walked, WALKED_SQL),
    "limit_usage_accounts": (_accounts, ACCOUNTS_SQL),
}
