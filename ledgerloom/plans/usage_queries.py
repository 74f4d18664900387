"""Queries over the derived ledger, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import formats
from ledgerloom.operators import context, trend, usage
from ledgerloom.operators.usage import Filters
from ledgerloom.plans import fixtures
from ledgerloom.plans.fixtures import HOURLY_SQL, RATES_SQL, USAGE_SQL

Query = Callable[[SparkSession, str], DataFrame]
#: The window of the windowed queries: 1997, UTC.
START, END = 852076800, 883612800
WINDOW = Filters(start=START, end=END)
DAY_SQL = "strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d')"


def _rates(spark: SparkSession) -> DataFrame:
    """All brands' resolved rates: a table of a few dozen rows."""
    brands = spark.range(1, 26).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("model"))
    return usage.resolve_rates(brands, fixtures.rates(spark), fixtures.overrides(spark))


def priced_sql(keys: str, where: str = "TRUE", source: str = "usage") -> str:
    """CTEs ending in p(keys, model, token sums, tokens, requests, reasoning, cost, flags)."""
    keys = f"{keys}, " if keys else ""
    return f"""{USAGE_SQL}, {RATES_SQL}, s AS (
      SELECT {keys}model, sum(input_tokens)::BIGINT AS ti, sum(output_tokens)::BIGINT AS tn, sum(cache_read_tokens)::BIGINT AS tr, sum(cache_write_5m_tokens)::BIGINT AS t5,
        sum(cache_write_1h_tokens)::BIGINT AS t1, sum(api_calls)::BIGINT AS requests, sum(reasoning_tokens)::BIGINT AS reasoning FROM {source} WHERE {where} GROUP BY ALL),
    p AS (SELECT s.*, ti + tn + tr + t5 + t1 AS tokens,
        CASE WHEN input IS NOT NULL THEN ti * input + tn * output + tr * cache_read + t5 * cache_write_5m + t1 * cache_write_1h ELSE 0 END AS cost,
        CASE WHEN input IS NOT NULL THEN ti + tn + tr + t5 + t1 ELSE 0 END AS priced, CASE WHEN s.model IS NULL THEN ti + tn + tr + t5 + t1 ELSE 0 END AS nameless,
        s.model IS NOT NULL AND input IS NULL AND ti + tn + tr + t5 + t1 > 0 AS unpriced,
        coalesce(input IS NOT NULL AND ((tr > 0 AND cache_read = 0) OR (t5 > 0 AND cache_write_5m = 0) OR (t1 > 0 AND cache_write_1h = 0)), FALSE) AS estimated
      FROM s LEFT JOIN rates USING (model))"""


def _summary_sql(where: str) -> str:
    return f"""WITH {priced_sql("", where)}, t AS (SELECT coalesce(sum(ti), 0)::BIGINT AS input_tokens, coalesce(sum(tn), 0)::BIGINT AS output_tokens, coalesce(sum(tr), 0)::BIGINT AS cache_read_tokens,
        coalesce(sum(t5 + t1), 0)::BIGINT AS cache_write_tokens, coalesce(sum(requests), 0)::BIGINT AS requests, coalesce(sum(cost), 0)::BIGINT AS c, coalesce(sum(priced), 0) AS priced, coalesce(sum(nameless), 0)::BIGINT AS unattributed_tokens,
        coalesce(string_agg(model, ',' ORDER BY model) FILTER (unpriced), '') AS unpriced_models, coalesce(string_agg(model, ',' ORDER BY model) FILTER (estimated), '') AS cache_estimated_models FROM p)
      SELECT input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens AS total_tokens, requests,
        CASE WHEN priced > 0 OR input_tokens + output_tokens + cache_read_tokens + cache_write_tokens = 0 THEN c END AS cost, unpriced_models <> '' AS has_unpriced, unattributed_tokens, unpriced_models, cache_estimated_models,
        CASE WHEN input_tokens + cache_read_tokens + cache_write_tokens > 0 THEN cache_read_tokens / (input_tokens + cache_read_tokens + cache_write_tokens) ELSE 0.0::DOUBLE END AS cache_hit_rate,
        (SELECT count(DISTINCT source || ':' || session_id) FROM usage WHERE {where})::BIGINT AS convs FROM t"""


def _summary(filters: Filters) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = usage.summary(fixtures.usage(spark, sf), _rates(spark), filters)
        names = lambda c: F.array_join(c, ",").alias(c)
        return out.select(*[names(c) if c in ("unpriced_models", "cache_estimated_models") else F.col(c) for c in out.columns])

    return run


def _where(filters: Filters) -> str:
    return " AND ".join(["TRUE"] + ([f"timestamp >= {filters.start}"] if filters.start is not None else []) + ([f"timestamp < {filters.end}"] if filters.end is not None else []) + ([f"source IN {filters.sources + ('',)}"] if filters.sources else []))


def _series_day(spark: SparkSession, sf: str) -> DataFrame:
    return usage.series(fixtures.usage(spark, sf), _rates(spark), WINDOW).drop("by_model", *usage.TOKENS)


SERIES_DAY_SQL = f"""WITH {priced_sql(DAY_SQL + " AS bucket, source", _where(WINDOW))}, c AS (SELECT {DAY_SQL} AS bucket, source, count(DISTINCT session_id)::BIGINT AS convs FROM usage WHERE {_where(WINDOW)} GROUP BY ALL)
  SELECT bucket, source, sum(tokens)::BIGINT AS tokens, sum(cost)::BIGINT AS cost, bool_or(unpriced) AS has_unpriced, bool_or(estimated) AS cache_estimated, sum(nameless)::BIGINT AS unattributed_tokens, sum(reasoning)::BIGINT AS reasoning, any_value(convs) AS convs
  FROM p JOIN c USING (bucket, source) GROUP BY bucket, source"""


def _series_by_model(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.series(fixtures.usage(spark, sf), _rates(spark), WINDOW)
    return out.select("bucket", "source", F.explode("by_model").alias("model", "tokens"))


def _series_hour(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.hourly_usage(spark, sf)
    return rows.groupBy(usage.bucket(F.col("timestamp"), "America/New_York", True).alias("bucket"), "source").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count_distinct("session_id").alias("convs"))


def _breakdown(by: str) -> Query:
    return lambda spark, sf: usage.breakdown(fixtures.usage(spark, sf), _rates(spark), by)


def _breakdown_sql(by: str) -> str:
    key = {"model": "model", "project": "coalesce(project, 'unknown')", "tool": "source"}[by]
    of = "source" if by == "model" else "NULL::VARCHAR"
    named = f"(SELECT {key} AS key, {of} AS of, * FROM usage)"
    return f"""WITH {priced_sql("key, of", source=named)}, c AS (SELECT key, of, count(DISTINCT session_id)::BIGINT AS convs FROM {named} GROUP BY ALL),
      b AS (SELECT key, of, sum(ti)::BIGINT AS input_tokens, sum(tn)::BIGINT AS output_tokens, sum(tr)::BIGINT AS cache_read_tokens, sum(t5 + t1)::BIGINT AS cache_write_tokens, sum(tokens)::BIGINT AS total_tokens, sum(requests)::BIGINT AS requests,
        CASE WHEN sum(priced) > 0 THEN sum(cost)::BIGINT END AS cost, sum(reasoning)::BIGINT AS reasoning_tokens, bool_or(estimated) AS cache_estimated, bool_or(unpriced) AS has_unpriced, sum(nameless)::BIGINT AS unattributed_tokens FROM p GROUP BY key, of)
      SELECT b.key, b.of AS source, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, total_tokens, requests, cost, reasoning_tokens, cache_estimated, has_unpriced, unattributed_tokens, convs
      FROM b JOIN c ON b.key IS NOT DISTINCT FROM c.key AND b.of IS NOT DISTINCT FROM c.of"""


def _cost_by_source(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.breakdown(fixtures.usage(spark, sf), _rates(spark), "model")
    basis = formats.cost_basis(F.col("cost"), F.col("has_unpriced"), F.col("unattributed_tokens"))
    return out.select("source", F.coalesce("key", F.lit("Unattributed usage")).alias("model"), "cost", "total_tokens", basis.alias("basis"))


def _window_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Summary and the three breakdowns of a window in one table, from one pass of grouping sets."""
    rows = WINDOW.apply(fixtures.usage(spark, sf)).withColumn("project", F.coalesce("project", F.lit("unknown")))
    sets = rows.groupingSets([[], ["source", "model"], ["project"], ["source"]], "source", "model", "project").agg(F.grouping_id().cast("int").alias("part"), F.sum(usage.total_tokens()).alias("tokens"), F.sum("api_calls").alias("requests"))
    return sets.select("part", "source", "model", "project", "tokens", "requests")


WINDOW_BUNDLE_SQL = f"""WITH {USAGE_SQL}, u AS (SELECT * REPLACE (coalesce(project, 'unknown') AS project) FROM usage WHERE {_where(WINDOW)})
  SELECT grouping(source, model, project)::INT AS part, source, model, project, sum(input_tokens + output_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens)::BIGINT AS tokens, sum(api_calls)::BIGINT AS requests
  FROM u GROUP BY GROUPING SETS ((), (source, model), (project), (source))"""

_TOTAL = "input_tokens + output_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens"
POINTS_SQL = f"{USAGE_SQL}, pts AS (SELECT {DAY_SQL} AS bucket, source, model, sum({_TOTAL})::BIGINT AS tokens FROM usage GROUP BY ALL)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return trend.points(fixtures.totals(spark, sf))


def _ctx_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return context.buckets(fixtures.usage(spark, sf), WINDOW)


CTX_BUCKETS_SQL = f"""WITH {USAGE_SQL}, f AS (SELECT source, session_id, arg_min(dedup_key, (timestamp, dedup_key)) AS dedup_key, min(timestamp) AS timestamp FROM usage
    WHERE cache_write_5m_tokens + cache_write_1h_tokens > 0 AND session_id IS NOT NULL GROUP BY ALL),
  j AS (SELECT u.*, f.dedup_key IS NOT NULL AS first, cache_write_5m_tokens + cache_write_1h_tokens AS cw FROM usage u LEFT JOIN f ON u.source = f.source AND u.session_id = f.session_id AND u.timestamp = f.timestamp AND u.dedup_key = f.dedup_key WHERE {_where(WINDOW).replace("timestamp", "u.timestamp")})
  SELECT source, (sum(cache_read_tokens) + sum(CASE WHEN NOT first AND cw > 0 THEN cw ELSE 0 END))::BIGINT AS history, sum(input_tokens)::BIGINT AS new_input, sum(CASE WHEN first THEN cw END)::BIGINT AS system,
    greatest(sum(output_tokens) - coalesce(sum(reasoning_tokens), 0), 0)::BIGINT AS response, sum(reasoning_tokens)::BIGINT AS reasoning FROM j GROUP BY source"""


def _tool_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tool weights from the documents table: sources as tools, languages as sources."""
    n = F.regexp_extract("source", "[0-9]+$", 0).cast("int")
    name = F.when(n == 0, "Read").when(n == 1, "Bash").when(n == 2, "Grep").when(n == 3, "WebFetch").when(n < 12, F.concat(F.lit("mcp__s"), (n % 3).cast("string"), F.lit("__t"), n.cast("string"))).otherwise(F.col("source"))
    rows = fixtures.table(spark, sf, "documents").select(F.col("lang").alias("source"), name.alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("string").alias("day"), F.expr("n_chars div 4").alias("est_tokens"))
    return rows.withColumn("calls", F.lit(1).cast("long"))


TOOLS_SQL = """tools AS (SELECT lang AS source, CASE WHEN n = 0 THEN 'Read' WHEN n = 1 THEN 'Bash' WHEN n = 2 THEN 'Grep' WHEN n = 3 THEN 'WebFetch' WHEN n < 12 THEN 'mcp__s' || (n % 3)::VARCHAR || '__t' || n::VARCHAR ELSE source END AS name,
    strftime('2024-01-01'::DATE + (doc_id % 60)::INT, '%Y-%m-%d') AS day, n_chars // 4 AS est_tokens, 1::BIGINT AS calls FROM (SELECT *, regexp_extract(source, '[0-9]+$')::INT AS n FROM documents))"""
TOOL_DAYS = Filters(start=1704844800, end=1707523200)  # 2024-01-10 up to 2024-02-09


def _ctx_tools(spark: SparkSession, sf: str) -> DataFrame:
    return context.tool_weights(_tool_rows(spark, sf), ["source", "name"], TOOL_DAYS)


CTX_TOOLS_SQL = f"WITH {TOOLS_SQL} SELECT source, name, sum(est_tokens)::BIGINT AS est_tokens, sum(calls)::BIGINT AS calls FROM tools WHERE day >= '2024-01-10' AND day <= '2024-02-09' AND day < '2024-02-10' GROUP BY ALL"


def alloc_sql(rows: str, group: str, key: str, weight: str, total: str, out: str) -> str:
    over = f"PARTITION BY {group}"
    return f"""(SELECT * EXCLUDE (sw, base, rem, lft, rk), (base + CASE WHEN rk <= lft THEN 1 ELSE 0 END)::BIGINT AS {out} FROM (SELECT *, row_number() OVER ({over} ORDER BY rem DESC, {key}) AS rk, CASE WHEN sw > 0 AND {total} > 0 THEN {total} - sum(base) OVER ({over}) ELSE 0 END AS lft FROM (
      SELECT *, CASE WHEN sw > 0 AND {total} > 0 THEN ({total} * greatest({weight}, 0)) // sw ELSE 0 END AS base, CASE WHEN sw > 0 AND {total} > 0 THEN ({total} * greatest({weight}, 0)) % sw ELSE 0 END AS rem
      FROM (SELECT *, sum(greatest({weight}, 0)) OVER ({over}) AS sw FROM {rows}))))"""


def _tool_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = context.tool_weights(_tool_rows(spark, sf), ["source", "name"])
    totals = rows.groupBy("source").agg((F.sum("est_tokens") * 3 + 17).alias("toolcalls"))
    return context.tool_tree(rows.join(totals, "source"))


_CATEGORY_SQL = "CASE WHEN regexp_matches(name, '^(Read|Write|Edit|Glob)$') THEN 'File Ops' WHEN name = 'Grep' THEN 'Search' WHEN name = 'Bash' THEN 'Execution' WHEN regexp_matches(name, '^Web(Fetch|Search)$') THEN 'Web' WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'MCP: ' || split_part(name, '__', 2) WHEN name = 'Skill' THEN 'Skill' ELSE 'Other' END"
TOOL_TREE_SQL = f"""WITH {TOOLS_SQL}, w AS (SELECT source, name, sum(est_tokens)::BIGINT AS est_tokens, sum(calls)::BIGINT AS calls, {_CATEGORY_SQL} AS category FROM tools GROUP BY ALL),
  c AS (SELECT source, category, sum(est_tokens)::BIGINT AS w, any_value(t) AS t FROM w JOIN (SELECT source, (sum(est_tokens) * 3 + 17)::BIGINT AS t FROM w GROUP BY source) USING (source) GROUP BY ALL),
  ca AS {alloc_sql("c", "source", "category", "w", "t", "category_tokens")}, l AS (SELECT w.*, category_tokens FROM w JOIN ca USING (source, category))
  SELECT source, category, category_tokens, name, tokens, calls FROM {alloc_sql("l", "source, category", "name", "est_tokens", "category_tokens", "tokens")}"""


def _mcp_bars(spark: SparkSession, sf: str) -> DataFrame:
    rows = context.tool_weights(_tool_rows(spark, sf), ["source", "name"]).withColumn("server", context.mcp_server(F.col("name"))).filter("server <> ''")
    sums = rows.groupBy("source", "server").agg(F.sum("est_tokens").alias("est_tokens"), F.sum("calls").alias("calls")).withColumn("total", F.lit(10_007).cast("long"))
    return context.allocate(sums, ["source"], "server", "est_tokens", "total", "tokens").select("source", "server", "calls", "tokens")


MCP_SQL = f"""WITH {TOOLS_SQL}, m AS (SELECT source, split_part(name, '__', 2) AS server, sum(est_tokens)::BIGINT AS est_tokens, sum(calls)::BIGINT AS calls, 10007::BIGINT AS total FROM tools WHERE name LIKE 'mcp\\_\\_%' ESCAPE '\\' GROUP BY ALL)
  SELECT source, server, calls, tokens FROM {alloc_sql("m", "source", "server", "est_tokens", "total", "tokens")}"""


def _resources(spark: SparkSession, sf: str) -> DataFrame:
    return context.resources(_tool_rows(spark, sf).withColumn("kind", F.when(F.col("name").startswith("mcp__"), "mcp").otherwise("tool")), TOOL_DAYS)


def _heat_days(spark: SparkSession, sf: str) -> DataFrame:
    return trend.heat_days(_points(spark, sf)).select("day", "tokens", "unattributed", F.size("by_source").alias("sources"), F.size("by_model").alias("models"))


HEAT_SQL = f"""WITH {POINTS_SQL} SELECT bucket AS day, sum(tokens)::BIGINT AS tokens, coalesce(sum(tokens) FILTER (model IS NULL), 0)::BIGINT AS unattributed, count(DISTINCT source)::INT AS sources, count(DISTINCT model)::INT AS models FROM pts GROUP BY ALL"""
_DAYS_SQL = f"{POINTS_SQL}, d AS (SELECT bucket AS day, sum(tokens)::BIGINT AS tokens FROM pts GROUP BY ALL)"


def _day_sums(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).groupBy(F.col("bucket").alias("day")).agg(F.sum("tokens").alias("tokens"))


LEVELS_SQL = f"WITH {_DAYS_SQL} SELECT day, tokens, CASE WHEN tokens > 0 THEN least(4, greatest(1, (4 * count(*) OVER (ORDER BY tokens) + count(*) OVER () - 1) // count(*) OVER ()))::INT ELSE 0 END AS level FROM d WHERE tokens > 0"
STREAK_SQL = f"""WITH {_DAYS_SQL}, i AS (SELECT *, day::DATE - row_number() OVER (ORDER BY day)::INT AS island FROM d WHERE tokens > 0), r AS (SELECT island, count(*) AS n FROM i GROUP BY ALL)
  SELECT (SELECT sum(tokens) FROM d)::BIGINT AS tokens, (SELECT count(*) FROM i)::BIGINT AS active_days, (SELECT max(n) FROM r)::BIGINT AS longest_streak, (SELECT day FROM d ORDER BY tokens DESC, day LIMIT 1) AS best_day"""


def _trend_sql(unit: str) -> str:
    key = {"week": "strftime(bucket::DATE - dayofweek(bucket::DATE)::INT, '%Y-%m-%d')", "month": "bucket[:7]", "day": "bucket"}[unit]
    step = {"week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY"}[unit]
    ends = {"week": "(min(bucket)::DATE - dayofweek(min(bucket)::DATE)::INT), (max(bucket)::DATE - dayofweek(max(bucket)::DATE)::INT)", "month": "date_trunc('month', min(bucket)::DATE), date_trunc('month', max(bucket)::DATE)", "day": "min(bucket)::DATE, max(bucket)::DATE"}[unit]
    form = "%Y-%m" if unit == "month" else "%Y-%m-%d"
    return f"""WITH {POINTS_SQL}, k AS (SELECT strftime(unnest(generate_series(a, b, {step})), '{form}') AS bucket FROM (SELECT {ends} FROM pts) e(a, b)), s AS (SELECT {key} AS bucket, source, sum(tokens)::BIGINT AS tokens FROM pts GROUP BY ALL)
      SELECT k.bucket, o.source, coalesce(s.tokens, 0)::BIGINT AS tokens FROM k CROSS JOIN (SELECT DISTINCT source FROM pts) o LEFT JOIN s ON s.bucket = k.bucket AND s.source = o.source"""


def _trend(unit: str) -> Query:
    return lambda spark, sf: trend.trend(_points(spark, sf), unit)


SPLIT_SQL = f"""WITH {POINTS_SQL}, m AS (SELECT model, sum(tokens)::BIGINT AS tokens FROM pts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model IS NULL ORDER BY tokens DESC, model) AS rn FROM m WHERE tokens > 0)
  SELECT CASE WHEN model IS NULL THEN 7 WHEN rn <= 5 THEN rn ELSE 6 END::INT AS place, CASE WHEN model IS NULL THEN 'unattributed' WHEN rn <= 5 THEN model ELSE 'more' END AS model, sum(tokens)::BIGINT AS tokens FROM r GROUP BY ALL"""
PROFILE_SQL = f"""WITH {POINTS_SQL} SELECT model, sum(tokens)::BIGINT AS tokens, min(bucket) AS first_day, count(DISTINCT bucket)::BIGINT AS active_days, sum(tokens)::BIGINT / (SELECT sum(tokens)::BIGINT FROM pts) AS share FROM pts WHERE model IS NOT NULL GROUP BY model"""


def _project_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.usage(spark, sf).groupBy(F.coalesce("project", F.lit("/EUROPE")).alias("key")).agg(F.sum(usage.total_tokens()).alias("tokens"))
    return trend.fold_projects(rows)


PROJECT_SQL = f"""WITH {USAGE_SQL}, p AS (SELECT coalesce(project, '/EUROPE') AS key, sum({_TOTAL})::BIGINT AS tokens FROM usage GROUP BY ALL)
  SELECT coalesce(q.key, p.key) AS key, sum(p.tokens)::BIGINT AS tokens, count(*)::BIGINT AS members FROM p LEFT JOIN p q ON q.key = regexp_extract(p.key, '^(.*)/[^/]*$', 1) GROUP BY 1"""


def _pace(spark: SparkSession, sf: str) -> DataFrame:
    return trend.pace(fixtures.usage(spark, sf), START, 30 * 86400)


PACE_SQL = f"""WITH {USAGE_SQL}, n AS (SELECT source, coalesce(sum({_TOTAL}) FILTER (timestamp >= {START}), 0)::BIGINT AS tokens, coalesce(sum({_TOTAL}) FILTER (timestamp < {START}), 0)::BIGINT AS before FROM usage WHERE timestamp >= {START - 30 * 86400} AND timestamp < {START + 30 * 86400} GROUP BY source)
  SELECT source, tokens, before, CASE WHEN before > 0 THEN floor((tokens - before) * 100 / before + 0.5)::BIGINT END AS percent FROM n"""


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    return trend.bucket_ranks(trend.trend(_points(spark, sf), "month", False).groupBy("bucket").agg(F.sum("tokens").alias("tokens")))


RANKS_SQL = f"""WITH {POINTS_SQL}, m AS (SELECT bucket[:7] AS bucket, sum(tokens)::BIGINT AS tokens FROM pts GROUP BY ALL)
  SELECT bucket, tokens, rank() OVER (ORDER BY tokens DESC)::INT AS rank, CASE WHEN avg(tokens) OVER () > 0 THEN floor((tokens - avg(tokens) OVER ()) * 100 / avg(tokens) OVER () + 0.5)::BIGINT END AS percent FROM m"""


def _multiples(spark: SparkSession, sf: str) -> DataFrame:
    return trend.small_multiples(_points(spark, sf)).withColumn("series", F.array_join(F.transform("series", lambda x: x.cast("string")), ","))


MULTIPLES_SQL = f"""WITH t AS ({_trend_sql("month")}) SELECT source, sum(tokens)::BIGINT AS tokens, string_agg(tokens::VARCHAR, ',' ORDER BY bucket) AS series, sum(tokens)::BIGINT / (SELECT sum(tokens)::BIGINT FROM t) AS share FROM t GROUP BY source"""


def _owners(spark: SparkSession, sf: str) -> DataFrame:
    return trend.owners(_points(spark, sf)).withColumn("sources", F.array_join("sources", ","))


OWNERS_SQL = f"WITH {POINTS_SQL} SELECT model, arg_max(source, (bucket, source)) AS source, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM pts WHERE model IS NOT NULL GROUP BY model"


def _pricing(spark: SparkSession, sf: str) -> DataFrame:
    return usage.displayed_models(fixtures.usage(spark, sf), fixtures.rates(spark), fixtures.overrides(spark))


PRICING_SQL = f"""WITH {USAGE_SQL}, {RATES_SQL}, n AS (SELECT model, source, count(*) AS n FROM usage WHERE model IS NOT NULL GROUP BY ALL), m AS (SELECT model, arg_min(source, (-n, source)) AS source FROM n GROUP BY model)
  SELECT model, source, nullif(input, 0)::BIGINT AS input, nullif(output, 0)::BIGINT AS output, nullif(cache_read, 0)::BIGINT AS cache_read, nullif(cache_write_5m, 0)::BIGINT AS cache_write_5m, nullif(cache_write_1h, 0)::BIGINT AS cache_write_1h, origin,
    CASE WHEN origin = 'override' THEN 'override' WHEN origin IS NULL THEN 'unpriced' WHEN cache_read = 0 OR cache_write_5m = 0 THEN 'est' ELSE 'ok' END AS state FROM m LEFT JOIN rates USING (model)"""


def _history(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    rate = lambda k: F.when(n >= 2, (n * k).cast("long")).otherwise(F.lit(0).cast("long"))
    return spark.range(0, 6).select(F.lit("Brand#7").alias("model"), F.concat((1995 + n).cast("string"), F.lit("-07-01")).alias("day"), (n >= 2).alias("priced"), *[rate(k).alias(r) for k, r in zip((100, 500, 10, 125, 200), usage.RATES, strict=True)])


def _asof_price(spark: SparkSession, sf: str) -> DataFrame:
    days = fixtures.usage(spark, sf).filter("model is not null").select("model", usage.bucket(F.col("timestamp")).alias("day")).distinct()
    return usage.price_at_day(days, _history(spark)).select("model", "day", "input", "output")


ASOF_SQL = f"""WITH {USAGE_SQL}, h AS (SELECT 'Brand#7' AS model, (1995 + n)::VARCHAR || '-07-01' AS day, n >= 2 AS priced, CASE WHEN n >= 2 THEN n * 100 ELSE 0 END AS input, CASE WHEN n >= 2 THEN n * 500 ELSE 0 END AS output FROM range(0, 6) r(n)),
  d AS (SELECT DISTINCT model, {DAY_SQL} AS day FROM usage WHERE model IS NOT NULL),
  a AS (SELECT d.model, d.day, h.priced, h.input, h.output FROM d ASOF LEFT JOIN h ON d.model = h.model AND d.day >= h.day)
  SELECT model, day, CASE WHEN priced THEN input ELSE (SELECT arg_min(h.input, h.day) FROM h WHERE h.priced AND h.model = a.model AND h.day > a.day) END::BIGINT AS input, CASE WHEN priced THEN output ELSE (SELECT arg_min(h.output, h.day) FROM h WHERE h.priced AND h.model = a.model AND h.day > a.day) END::BIGINT AS output FROM a"""


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    parts = fixtures.table(spark, sf, "part")
    raw = F.concat(F.lit("Vendor/"), F.regexp_replace("p_type", " ", "-"), F.when(F.col("p_partkey") % 2 == 0, F.lit("-20240229")).otherwise("-2024"))
    return parts.select(usage.normalize_model(raw).alias("model")).groupBy("model").agg(F.count("*").alias("n"))


NORMALIZED_SQL = "SELECT regexp_replace(split_part(lower('Vendor/' || replace(p_type, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN '-20240229' ELSE '-2024' END), '/', 2), '-[0-9]{8}$', '') AS model, count(*)::BIGINT AS n FROM part GROUP BY 1"


def _compact(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 6).cast("double"))).cast("long")
    return fixtures.table(spark, sf, "orders").select("o_orderkey", n.alias("n"), formats.compact(n).alias("text"))


def _compact_sql() -> str:
    cents = lambda u: f"((n * 100 + {u // 2}) // {u})"
    shown = lambda u, m: f"({cents(u)} // 100)::VARCHAR || '.' || lpad(({cents(u)} % 100)::VARCHAR, 2, '0') || '{m}'"
    return f"SELECT o_orderkey, n, CASE WHEN n < 1000 THEN n::VARCHAR WHEN {cents(1000)} < 100000 THEN {shown(1000, 'K')} WHEN {cents(10**6)} < 100000 THEN {shown(10**6, 'M')} ELSE {shown(10**9, 'B')} END AS text FROM (SELECT o_orderkey, floor(o_totalprice * pow(10.0, (o_orderkey % 6)::DOUBLE))::BIGINT AS n FROM orders)"


QUERIES: dict[str, tuple[Query, str]] = {
    "summary": (_summary(Filters()), _summary_sql("TRUE")),
    "summary_window": (_summary(WINDOW), _summary_sql(_where(WINDOW))),
    "summary_empty": (_summary(Filters(start=10, end=20)), _summary_sql("timestamp >= 10 AND timestamp < 20")),
    "window": (_window_bundle, WINDOW_BUNDLE_SQL),
    "series_day": (_series_day, SERIES_DAY_SQL),
    "series_by_model": (_series_by_model, f"WITH {USAGE_SQL} SELECT {DAY_SQL} AS bucket, source, model, sum({_TOTAL})::BIGINT AS tokens FROM usage WHERE model IS NOT NULL AND {_where(WINDOW)} GROUP BY ALL HAVING sum({_TOTAL}) > 0"),
    "series_hour": (_series_hour, f"WITH {HOURLY_SQL} SELECT strftime(to_timestamp(timestamp) AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:00') AS bucket, source, sum(input_tokens + output_tokens)::BIGINT AS tokens, count(DISTINCT session_id)::BIGINT AS convs FROM hourly GROUP BY ALL"),
    **{f"breakdown_{by}": (_breakdown(by), _breakdown_sql(by)) for by in ("model", "project", "tool")},
    "cost_by_source": (_cost_by_source, f"WITH b AS ({_breakdown_sql('model')}) SELECT source, coalesce(key, 'Unattributed usage') AS model, cost, total_tokens, CASE WHEN cost IS NULL THEN 'unavailable' WHEN has_unpriced OR unattributed_tokens > 0 THEN 'partial' ELSE 'exact' END AS basis FROM b"),
    "ctx_buckets": (_ctx_buckets, CTX_BUCKETS_SQL),
    "ctx_tools": (_ctx_tools, CTX_TOOLS_SQL),
    "ctx_resources": (_resources, f"WITH {TOOLS_SQL} SELECT DISTINCT source, CASE WHEN name LIKE 'mcp%' THEN 'mcp' ELSE 'tool' END AS kind, name FROM tools WHERE day >= '2024-01-10' AND day <= '2024-02-09'"),
    "tool_tree": (_tool_tree, TOOL_TREE_SQL),
    "mcp_bars": (_mcp_bars, MCP_SQL),
    "heatmap_days": (_heat_days, HEAT_SQL),
    "heatmap_levels": (lambda spark, sf: trend.heat_levels(_day_sums(spark, sf)), LEVELS_SQL),
    "heat_streak": (lambda spark, sf: trend.streaks(_day_sums(spark, sf)), STREAK_SQL),
    "peak_day": (lambda spark, sf: trend.peak(_day_sums(spark, sf).withColumnRenamed("day", "bucket")), f"WITH {_DAYS_SQL} SELECT day AS bucket, tokens FROM d ORDER BY tokens DESC, day LIMIT 1"),
    **{f"trend_{unit}": (_trend(unit), _trend_sql(unit)) for unit in ("day", "week", "month")},
    "split_topn": (lambda spark, sf: trend.split_rows(_points(spark, sf), 5), SPLIT_SQL),
    "profile": (lambda spark, sf: trend.profile(_points(spark, sf)), PROFILE_SQL),
    "project_fold": (_project_fold, PROJECT_SQL),
    "panel_pace": (_pace, PACE_SQL),
    "bucket_rank": (_ranks, RANKS_SQL),
    "small_multiples": (_multiples, MULTIPLES_SQL),
    "model_owners": (_owners, OWNERS_SQL),
    "model_pricing": (_pricing, PRICING_SQL),
    "price_asof_day": (_asof_price, ASOF_SQL),
    "normalize_model": (_normalized, NORMALIZED_SQL),
    "compact_tokens": (_compact, _compact_sql()),
}
