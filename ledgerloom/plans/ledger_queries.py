"""Queries that merge records into a ledger, and that estimate limits from readings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.operators import limits, merge, usage
from ledgerloom.plans import fixtures
from ledgerloom.plans.fixtures import READINGS_SQL, USAGE_SQL

_KEYS = "k1, k2, k3, k4, k5, k6, k7, k8, k9"
_RN = f"{USAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {_KEYS}) AS rn FROM usage)"
_SHOWN = ["dedup_key", "source", "timestamp", "model", "input_tokens", "output_tokens", "session_id", "reasoning_tokens"]


def insert_sql(rows: str = "r", order: str = "rn") -> str:
    one = ", ".join(f"arg_min_null({c}, {order}) AS {c}" for c in ("source", "timestamp", "model", "input_tokens", "output_tokens"))
    return f"SELECT dedup_key, {one}, arg_max(session_id, {order}) FILTER (session_id IS NOT NULL) AS session_id, arg_max(reasoning_tokens, {order}) FILTER (reasoning_tokens IS NOT NULL) AS reasoning_tokens FROM {rows} GROUP BY dedup_key"


def _insert(spark: SparkSession, sf: str) -> DataFrame:
    return merge.insert(fixtures.usage(spark, sf, ordered=True).select(*_SHOWN, "seq")).select(*_SHOWN)


def _replace(spark: SparkSession, sf: str) -> DataFrame:
    return merge.replace(fixtures.usage(spark, sf, ordered=True).select(*_SHOWN, "seq")).select(*_SHOWN)


def _keep_max(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.usage(spark, sf, ordered=True).drop("ctx_messages")
    return merge.keep_max_output(rows, ["source", "timestamp", "input_tokens"], ["project", "session_id"], ["reasoning_tokens"], ["model"])


KEEP_MAX_SQL = f"""WITH {_RN}, h AS (SELECT *, max(output_tokens) OVER (PARTITION BY dedup_key ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, max(output_tokens) OVER (PARTITION BY dedup_key) AS most FROM r),
  a AS (SELECT *, output_tokens = most AS top FROM h WHERE high IS NULL OR output_tokens >= high)
  SELECT dedup_key, max(most) AS output_tokens, arg_min(source, rn) FILTER (top) AS source, arg_min(timestamp, rn) FILTER (top) AS timestamp, arg_min(input_tokens, rn) FILTER (top) AS input_tokens,
    arg_min(project, rn) FILTER (project IS NOT NULL) AS project, arg_min(session_id, rn) FILTER (session_id IS NOT NULL) AS session_id, arg_min(reasoning_tokens, rn) FILTER (top AND reasoning_tokens IS NOT NULL) AS reasoning_tokens, arg_max_null(model, rn) FILTER (top) AS model
  FROM a GROUP BY dedup_key"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Old rows are of status O, new ones of status F."""
    rows = fixtures.usage(spark, sf, ordered=True)
    return tuple(rows.filter(F.col("source_file").startswith(status)).select(*_SHOWN, "seq") for status in "OF")


def _supersede(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    keys = new.filter("source = '1-urgent'").select(F.col("dedup_key").alias("key"))
    prefixes = new.filter("source = '2-high'").select(F.concat("session_id", F.lit(":")).alias("prefix")).filter("prefix is not null")
    return merge.supersede(old, new, keys, prefixes).select(*_SHOWN)


SUPERSEDE_SQL = f"""WITH {_RN}, o AS (SELECT * FROM r WHERE source_file LIKE 'O%'), n AS (SELECT * FROM r WHERE source_file LIKE 'F%'),
  k AS (SELECT * FROM o WHERE dedup_key NOT IN (SELECT dedup_key FROM n WHERE source = '1-urgent') AND split_part(dedup_key, ':', 1) NOT IN (SELECT session_id FROM n WHERE source = '2-high' AND session_id IS NOT NULL)),
  u AS (SELECT * FROM k UNION ALL SELECT * FROM n) {insert_sql("u")}"""


def _replace_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.usage(spark, sf, ordered=True).select(*_SHOWN, "source_file", "seq")
    return merge.replace_files(rows.filter("timestamp < 883612800"), rows.filter("timestamp >= 978307200")).select(*_SHOWN)


REPLACE_FILES_SQL = f"""WITH {_RN}, n AS (SELECT * FROM r WHERE timestamp >= 978307200), u AS (SELECT * FROM r WHERE timestamp < 883612800 AND source_file NOT IN (SELECT source_file FROM n) UNION ALL SELECT * FROM n) {insert_sql("u")}"""


def _reread(spark: SparkSession, sf: str) -> DataFrame:
    """Readings that were read again with more or other identity, in a total order."""
    rows = fixtures.readings(spark, sf).withColumn("seq", F.col("source_order")).drop("window_minutes", "source_order")
    later = rows.filter("seq % 3 = 0").withColumn("seq", F.col("seq") + 10_000_000).withColumn("account_id", F.when(F.col("seq") % 2 == 0, "other").otherwise("acct")).withColumn("plan", F.lit("newer"))
    return rows.unionByName(later)


def _merge_readings(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_readings(_reread(spark, sf)).select("source", "window_key", "resets_at", "observed_at", "used_pct", "account_id", "plan")


MERGE_SQL = f"""WITH {READINGS_SQL}, b AS (SELECT source, window_key, resets_at, observed_at, used_pct, account_id, source_order AS seq, 'plan' AS plan FROM readings),
  u AS (SELECT * FROM b UNION ALL SELECT source, window_key, resets_at, observed_at, used_pct, CASE WHEN (seq + 10000000) % 2 = 0 THEN 'other' ELSE 'acct' END, seq + 10000000, 'newer' FROM b WHERE seq % 3 = 0),
  f AS (SELECT *, first_value(account_id IGNORE NULLS) OVER (PARTITION BY source, window_key, resets_at, observed_at, used_pct ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM u)
  SELECT source, window_key, resets_at, observed_at, used_pct, arg_min(account_id, seq) FILTER (account_id IS NOT NULL) AS account_id, arg_max(plan, seq) AS plan FROM f WHERE account_id IS NULL OR account_id = known GROUP BY ALL"""


def _additive(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.usage(spark, sf).select("source", "source_file", usage.bucket(F.col("timestamp")).alias("day"), F.col("input_tokens").alias("est_tokens"), F.col("api_calls").alias("calls"))
    return merge.add_up(rows, ["source", "source_file", "day"], ["est_tokens", "calls"])


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.usage(spark, sf, ordered=True).filter("session_id is not null").select("source", "session_id", "project", "model", F.col("timestamp").alias("updated_at"), "seq")
    return merge.latest_known(rows.withColumn("seq", F.struct("seq", "model")), ["source", "session_id"]).select("source", "session_id", "project", "updated_at")


def _unbooked(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.usage(spark, sf).groupBy(F.col("source_file").alias("path"), "timestamp").agg(F.min("source").alias("source"), (F.sum("api_calls") % 5).alias("requests"))
    return merge.unbooked(rows.select("path", "source", "requests", (F.col("timestamp") - 60).alias("first_at"), F.col("timestamp").alias("last_at"), F.col("timestamp").alias("seq")))


UNBOOKED_SQL = f"""WITH {USAGE_SQL}, g AS (SELECT source_file AS path, timestamp, min(source) AS source, (sum(api_calls) % 5)::BIGINT AS requests FROM usage GROUP BY ALL), l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY path ORDER BY timestamp DESC) = 1)
  SELECT source, sum(requests)::BIGINT AS requests, min(timestamp - 60) AS first_at, max(timestamp) AS last_at FROM l WHERE requests > 0 GROUP BY source"""


def _unbooked_only(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without a booked record of theirs: an anti join."""
    booked = fixtures.usage(spark, sf).filter("timestamp >= 883612800 and session_id is not null").select(F.col("session_id")).distinct()
    orders = fixtures.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.lower("o_orderpriority").alias("source"))
    return orders.join(booked, "session_id", "left_anti").groupBy("source").agg(F.count("*").alias("sessions"))


def _displayed(spark: SparkSession, sf: str) -> DataFrame:
    return limits.window_view(limits.displayed_windows(fixtures.readings(spark, sf)), 1706500000)


DISPLAYED_SQL = f"""WITH {READINGS_SQL}, n AS (SELECT *, max(resets_at) OVER (PARTITION BY source, window_key) AS newest FROM readings),
  d AS (SELECT source, window_key, max(window_minutes) AS window_minutes, max(used_pct) AS used_pct, max(resets_at) AS resets_at, max(observed_at) AS observed_at FROM n WHERE resets_at >= newest - 600 GROUP BY ALL)
  SELECT *, 100 - used AS left, CASE WHEN 100 - used > 50 THEN 'ok' WHEN 100 - used > 20 THEN 'low' ELSE 'dry' END AS tone FROM (SELECT *, CASE WHEN resets_at <= 1706500000 THEN 0 ELSE floor(used_pct + 0.5) END::BIGINT AS used FROM d)"""


#: The instant at which limits are estimated: 2024-01-28, 11:06 UTC.
EVALUATED = 1706440000


def limit_usage(readings: DataFrame) -> DataFrame:
    """Records at the seconds of readings with an account: 1000 tokens for each percent since the reading before, on odd days
    of clicks twice that."""
    rows = readings.filter("account_id is not null")
    before = F.lag("used_pct", 1, 0.0).over(W.Window.partitionBy("source", "resets_at").orderBy("observed_at", "source_order"))
    rate = F.when((F.col("source") == "click") & (F.floor(F.col("resets_at") / 86400) % 2 == 1), 2000).otherwise(1000)
    return rows.select("source", F.lit(None).cast("string").alias("account_id"), F.col("observed_at").alias("timestamp"), F.lit("m1").alias("model"), (rate * (F.col("used_pct") - before)).cast("long").alias("tokens"))


_LIMIT_USAGE_SQL = f"""{READINGS_SQL}, pr AS (SELECT * FROM readings WHERE account_id IS NOT NULL),
  lu AS (SELECT source, observed_at AS timestamp, (CASE WHEN source = 'click' AND (resets_at // 86400) % 2 = 1 THEN 2000 ELSE 1000 END * (used_pct - lag(used_pct, 1, 0.0) OVER (PARTITION BY source, resets_at ORDER BY observed_at, source_order)))::BIGINT AS tokens FROM pr),
  g AS (SELECT *, lag(used_pct) OVER w AS from_pct, lag(observed_at) OVER w AS t0 FROM (SELECT * FROM pr QUALIFY used_pct IS DISTINCT FROM lag(used_pct) OVER (PARTITION BY source, resets_at ORDER BY observed_at, source_order)) WINDOW w AS (PARTITION BY source, resets_at ORDER BY observed_at, source_order))"""


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.readings(spark, sf)
    return limits.intervals(rows, limit_usage(rows)).select("source", "epoch", "from_pct", "to_pct", "t0", "t1", "tokens", "reason")


#: Percents only rise within a day here, so the walk's intervals are pairs of successive different percents of readings with
#: an account, but for pairs of one second.
INTERVALS_SQL = f"""WITH {_LIMIT_USAGE_SQL}, i AS (SELECT source, resets_at AS epoch, from_pct::BIGINT AS from_pct, used_pct::BIGINT AS to_pct, t0, observed_at AS t1 FROM g WHERE t0 IS NOT NULL AND used_pct < 100 AND t0 < observed_at)
  SELECT i.*, coalesce((SELECT sum(tokens)::BIGINT FROM lu WHERE lu.source = i.source AND lu.timestamp > i.t0 AND lu.timestamp <= i.t1), 0)::BIGINT AS tokens,
    CASE WHEN coalesce((SELECT sum(tokens) FROM lu WHERE lu.source = i.source AND lu.timestamp > i.t0 AND lu.timestamp <= i.t1), 0) = 0 THEN 'zero-local-usage' END AS reason FROM i"""


def _found_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.readings(spark, sf)
    return limits.runs(limits.intervals(rows, limit_usage(rows)).filter("reason is null"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return _found_runs(spark, sf).select("source", "epoch", "t0", "t1", "tokens", "movement", "moves", "qualifies")


RUNS_SQL = f"""WITH iv AS ({INTERVALS_SQL}), f AS (SELECT *, CASE WHEN lag(t1) OVER w = t0 AND lag(to_pct) OVER w = from_pct THEN 0 ELSE 1 END AS fresh FROM iv WHERE reason IS NULL WINDOW w AS (PARTITION BY source, epoch ORDER BY t0)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY source, epoch ORDER BY t0) AS run FROM f)
  SELECT source, epoch, min(t0) AS t0, max(t1) AS t1, sum(tokens)::BIGINT AS tokens, sum(to_pct - from_pct)::BIGINT AS movement, count(*)::BIGINT AS moves, count(*) >= 2 AND sum(to_pct - from_pct) >= 10 AS qualifies FROM r GROUP BY source, epoch, run"""


def _estimate(spark: SparkSession, sf: str) -> DataFrame:
    found = limits.representatives(_found_runs(spark, sf))
    out = limits.estimates(found, limits.current_readings(fixtures.readings(spark, sf), EVALUATED), EVALUATED)
    return out.select("source", "window_key", "state", "tokens_per_pct", "candidates", "reason", "next_evaluation_at")


#: Of an epoch the one qualifying run of greatest movement; the newest five of a week; the one largest agreeing subset.
ESTIMATE_SQL = f"""WITH r AS ({RUNS_SQL}), q AS (SELECT *, max(movement) OVER (PARTITION BY source, epoch) AS far FROM r WHERE qualifies), p AS (SELECT source, epoch, any_value(tokens) AS tokens, any_value(movement) AS movement FROM q WHERE movement = far GROUP BY source, epoch HAVING count(*) = 1),
  c AS (SELECT *, tokens / movement AS ratio, tokens / (movement + 1) AS lower, tokens / nullif(movement - 1, 0) AS upper, row_number() OVER (PARTITION BY source ORDER BY epoch DESC) - 1 AS i FROM p WHERE epoch <= {EVALUATED} AND epoch >= {EVALUATED} - 7 * 86400),
  k AS MATERIALIZED (SELECT * FROM c WHERE i < 5), nn AS (SELECT source, count(*) AS many, max(lower) > min(upper) AS disjoint, min(epoch) AS oldest FROM k GROUP BY source),
  m AS (SELECT nn.source, b AS mask, bit_count(b::BIGINT)::BIGINT AS size FROM nn, range(1, 32) x(b) WHERE b < (1 << many) AND bit_count(b::BIGINT) >= greatest(3, ceil(0.75 * many))),
  ok AS (SELECT m.source, m.mask, m.size, median(k.ratio) AS value FROM m JOIN k ON k.source = m.source AND ((m.mask >> k.i) & 1) = 1 GROUP BY ALL HAVING max(ratio) / min(ratio) <= 1.25 AND max(lower) <= min(upper)),
  best AS (SELECT source, max(size) AS size FROM ok GROUP BY source), core AS (SELECT ok.source, count(*) AS cores, any_value(value) AS value FROM ok JOIN best USING (source, size) GROUP BY ok.source),
  cur AS (SELECT source, window_key, arg_max(resets_at, (account_id IS NOT NULL, observed_at, resets_at, used_pct)) AS resets_at FROM ({{readings}}) WHERE observed_at <= {EVALUATED} GROUP BY ALL)
  SELECT cur.source, window_key, CASE WHEN cores = 1 THEN 'ready' WHEN many >= 3 THEN 'unstable' ELSE 'gathering' END AS state, CASE WHEN cores = 1 THEN value END AS tokens_per_pct, coalesce(many, 0)::INT AS candidates,
    CASE WHEN coalesce(many, 0) < 3 THEN 'insufficient-recent-epochs' WHEN cores = 1 THEN NULL WHEN cores > 1 THEN 'competing-stable-cores' WHEN disjoint THEN 'quantization-ranges-disjoint' ELSE 'ratio-spread-exceeded' END AS reason, least(cur.resets_at, oldest + 7 * 86400 + 1)::BIGINT AS next_evaluation_at
  FROM cur LEFT JOIN nn USING (source) LEFT JOIN core USING (source)""".replace("{readings}", f"WITH {READINGS_SQL} SELECT * FROM readings")


def _walk_refusals(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.readings(spark, sf)
    walked = limits.walk(rows)
    return limits.rejections(walked, limits.with_usage(walked.filter("reason is null"), limit_usage(rows)))


#: The walk, reading by reading: `since` is the open stretch's epoch, with the percent and second that anchor it.
REFUSALS_SQL = f"""WITH RECURSIVE {_LIMIT_USAGE_SQL}, o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY observed_at, resets_at, source_order) AS rn, used_pct::BIGINT AS pct, resets_at, observed_at, account_id IS NOT NULL AS proven FROM readings),
  w AS (SELECT source, 0::BIGINT AS rn, NULL::BIGINT AS since, 0::BIGINT AS anchor, 0::BIGINT AS highest, 0::BIGINT AS t0, NULL::VARCHAR AS lacks, NULL::VARCHAR AS reason FROM (SELECT DISTINCT source FROM readings)
    UNION ALL SELECT o.source, o.rn,
      CASE WHEN o.proven THEN o.resets_at WHEN w.since IS NOT NULL AND (o.pct < w.highest OR o.pct >= 100) THEN NULL ELSE w.since END,
      CASE WHEN o.proven AND (w.since IS NULL OR w.since <> o.resets_at OR o.pct < w.highest OR o.pct <> w.anchor) THEN o.pct ELSE w.anchor END,
      CASE WHEN o.proven AND (w.since IS NULL OR w.since <> o.resets_at OR o.pct < w.highest OR o.pct <> w.anchor) THEN o.pct WHEN NOT o.proven AND w.since IS NOT NULL THEN greatest(w.highest, o.pct) ELSE w.highest END,
      CASE WHEN o.proven AND (w.since IS NULL OR w.since <> o.resets_at OR o.pct < w.highest OR o.pct <> w.anchor) THEN o.observed_at ELSE w.t0 END,
      CASE WHEN NOT o.proven THEN 'missing-account-identity' END,
      CASE WHEN w.since IS NULL THEN NULL WHEN NOT o.proven THEN CASE WHEN o.pct < w.highest THEN 'percentage-decrease' WHEN o.pct >= 100 THEN 'percentage-saturation' END WHEN w.since <> o.resets_at THEN 'reset-boundary' WHEN o.pct < w.highest THEN 'percentage-decrease' WHEN o.pct = w.anchor THEN NULL
        WHEN o.pct >= 100 THEN 'percentage-saturation' WHEN w.t0 = o.observed_at THEN 'ambiguous-reading-order' END
    FROM w JOIN o ON o.source = w.source AND o.rn = w.rn + 1),
  x AS (SELECT source, lacks AS reason FROM w WHERE lacks IS NOT NULL UNION ALL SELECT source, reason FROM w WHERE reason IS NOT NULL UNION ALL SELECT source, reason FROM ({INTERVALS_SQL}) WHERE reason IS NOT NULL)
  SELECT source, 'w1440' AS window_key, reason, count(*)::BIGINT AS n FROM x GROUP BY ALL"""


def _asof_content(spark: SparkSession, sf: str) -> DataFrame:
    """For each line item the tokens that its session logged in earlier seconds: a running sum that ends before the second."""
    before = W.Window.partitionBy("session_id").orderBy("timestamp").rangeBetween(W.Window.unboundedPreceding, -1)
    rows = fixtures.usage(spark, sf).filter("session_id is not null")
    out = rows.groupBy("session_id", "timestamp").agg(F.sum("output_tokens").alias("own"))
    return out.withColumn("context", F.coalesce(F.sum("own").over(before), F.lit(0)))


QUERIES = {
    "dedup_insert": (_insert, f"WITH {_RN} {insert_sql()}"),
    "dedup_replace": (_replace, f"WITH {_RN} SELECT {', '.join(_SHOWN)} FROM r QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY rn DESC) = 1"),
    "dedup_keep_max": (_keep_max, KEEP_MAX_SQL),
    "supersede": (_supersede, SUPERSEDE_SQL),
    "replace_file": (_replace_files, REPLACE_FILES_SQL),
    "reading_merge": (_merge_readings, MERGE_SQL),
    "ctx_additive": (_additive, f"WITH {USAGE_SQL} SELECT source, source_file, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, sum(input_tokens)::BIGINT AS est_tokens, sum(api_calls)::BIGINT AS calls FROM usage GROUP BY ALL"),
    "source_sessions": (_sessions, f"WITH {USAGE_SQL} SELECT source, session_id, arg_max(project, timestamp) FILTER (project IS NOT NULL) AS project, max(timestamp) AS updated_at FROM usage WHERE session_id IS NOT NULL GROUP BY ALL"),
    "unbooked_requests": (_unbooked, UNBOOKED_SQL),
    "unbooked_anti": (_unbooked_only, f"WITH {USAGE_SQL} SELECT lower(o_orderpriority) AS source, count(*)::BIGINT AS sessions FROM orders WHERE o_orderkey::VARCHAR NOT IN (SELECT session_id FROM usage WHERE timestamp >= 883612800 AND session_id IS NOT NULL) GROUP BY ALL"),
    "limits_displayed": (_displayed, DISPLAYED_SQL),
    "limit_intervals": (_intervals, INTERVALS_SQL),
    "limit_runs": (_runs, RUNS_SQL),
    "limit_estimate": (_estimate, ESTIMATE_SQL),
    "limit_rejections": (_walk_refusals, REFUSALS_SQL),
    "asof_content": (_asof_content, f"WITH {USAGE_SQL}, s AS (SELECT session_id, timestamp, sum(output_tokens)::BIGINT AS own FROM usage WHERE session_id IS NOT NULL GROUP BY ALL) SELECT *, coalesce(sum(own) OVER (PARTITION BY session_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS context FROM s"),
}
