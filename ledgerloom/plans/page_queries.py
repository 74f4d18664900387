"""Queries of the pages: price catalog, pricing table, shell commands, splits, tables, panels, reports, dates and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, formats, shell
from ledgerloom.operators import context, merge, pages, prices, trend, usage
from ledgerloom.operators.usage import RATES, Filters
from ledgerloom.plans import fixtures
from ledgerloom.plans.fixtures import HOURLY_SQL, RATES_SQL, USAGE_SQL
from ledgerloom.plans.usage_queries import DAY_SQL, POINTS_SQL, SERIES_DAY_SQL, START, WINDOW, _breakdown_sql, _points, _rates, _summary_sql, _where, alloc_sql, priced_sql

def _fixed_sql(x: str, d: int) -> str:
    """As formats.fixed."""
    return f"CASE WHEN ({x}) * 1024 = floor(({x}) * 1024) AND ({x}) * 1e{d} - floor(({x}) * 1e{d}) = 0.5 THEN printf('%.{d}f', (floor(({x}) * 1e{d}) + 1) / 1e{d}) ELSE printf('%.{d}f', {x}) END"


_quote = lambda s: "'" + s.replace("'", "''") + "'"

# A price catalog from the parts: keys of four spellings, providers of which some are publishers, rates in whole nano-dollars.
_PROVIDERS = ("anthropic", "openai", "gemini", "vertex_ai-language-models", "reseller", "zai", "host")
_SPELT = (
    ("k % 4 = 0", "concat(lower(p_brand), '-', p_size)"),
    ("k % 4 = 1", "concat('v', p_size % 3, '/', lower(p_brand), '-', p_size)"),
    ("k % 4 = 2", "concat(lower(p_brand), '-', p_size, '-20240101')"),
    ("TRUE", "concat('far/', lower(p_brand), '-', p_size)"),
)
_SPELLING = "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in _SPELT) + " END"
_PROVIDER = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PROVIDERS)) + " END"
_PARTS = f"SELECT p_partkey AS k, {_SPELLING} AS model, {_PROVIDER} AS provider, CASE WHEN k % 11 <> 0 THEN k % 900 + 1 END AS i, CASE WHEN k % 13 <> 0 THEN k % 700 + 2 END AS o, CASE WHEN k % 3 = 0 THEN k % 50 END AS r, CASE WHEN k % 5 < 2 THEN k % 60 + 1 END AS w FROM (SELECT *, p_partkey AS k FROM part)"


def _catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    fixtures.table(spark, sf, "part").createOrReplaceTempView("part_of_catalog")
    parts = spark.sql(_PARTS.replace("FROM part)", "FROM part_of_catalog)"))
    big = lambda c: F.col(c).cast("long")
    one = parts.groupBy("model").agg(F.min_by(F.struct("provider", "i", "o", "r", "w", "k"), "k").alias("x")).select("model", "x.*")
    listed = one.filter("k % 17 <> 0").select("model", "provider", big("i").alias("input"), big("o").alias("output"), big("r").alias("cache_read"), big("w").alias("cache_write_5m"), F.when(F.col("k") % 2 == 0, big("w") * 2).alias("cache_write_1h"))
    text = lambda c: F.when(F.col("k") % 6 == 0, "-1").when(F.col("k") % 6 == 1, "0").otherwise(F.col(c).cast("string"))
    payload = one.filter("k % 3 = 0").select(F.col("model").alias("id"), F.struct(text("i").alias("prompt"), text("o").alias("completion"), F.col("r").cast("string").alias("input_cache_read"), F.col("w").cast("string").alias("input_cache_write"), F.lit(None).cast("string").alias("input_cache_write_1h")).alias("pricing"), F.col("k").alias("seq"))
    host = lambda tag, who: F.struct(F.concat(tag, F.lit("/fp8")).alias("tag"), who.alias("provider_name"), F.col("pricing"))
    listings = payload.filter("id like 'v%' and seq % 9 = 0").select("id", F.array(host(F.lit("host"), F.lit("Host")), host(F.substring_index("id", "/", 1), F.when(F.col("seq") % 2 == 0, "Maker"))).alias("endpoints"), "seq")
    return listed, prices.routed_rows(payload), prices.publisher_rows(listings)


def _published(spark: SparkSession, sf: str) -> DataFrame:
    listed, routed, publishers = _catalog(spark, sf)
    out = prices.published_rates(listed, routed, publishers)
    return out.select("model", "catalog", *[F.col(r).cast("double").alias(r) for r in RATES])


_NORMAL = lambda c: f"regexp_replace(split_part(lower({c}), '/', -1), '-[0-9]{{8}}$', '')"
_COLUMNS = ", ".join(RATES)
CATALOG_SQL = f"""one AS (SELECT model, arg_min(struct_pack(provider := provider, i := i, o := o, r := r, w := w, k := k), k) AS x FROM ({_PARTS}) GROUP BY model),
  listed AS (SELECT model, x.provider AS provider, x.i::DOUBLE AS input, x.o::DOUBLE AS output, x.r::DOUBLE AS cache_read, x.w::DOUBLE AS cache_write_5m, CASE WHEN x.k % 2 = 0 THEN x.w * 2 END::DOUBLE AS cache_write_1h,
    coalesce(list_position([{", ".join(map(_quote, prices.PUBLISHERS))}], x.provider) - 1, {prices.NO_PUBLISHER}) AS rank FROM one WHERE x.k % 17 <> 0 AND (x.i IS NOT NULL OR x.o IS NOT NULL)),
  payload AS (SELECT model AS id, x.k AS seq, CASE WHEN x.k % 6 IN (0, 1) THEN NULL ELSE nullif(x.i, 0) END::DOUBLE AS input, CASE WHEN x.k % 6 IN (0, 1) THEN NULL ELSE nullif(x.o, 0) END::DOUBLE AS output, nullif(x.r, 0)::DOUBLE AS cache_read, nullif(x.w, 0)::DOUBLE AS cache_write_5m, NULL::DOUBLE AS cache_write_1h FROM one WHERE x.k % 3 = 0),
  routed AS (SELECT id AS model, * EXCLUDE (id) FROM payload WHERE id LIKE '%/%' AND (input IS NOT NULL OR output IS NOT NULL)),
  publishers AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'Maker' ELSE split_part(model, '/', 1) END AS publisher FROM routed WHERE model LIKE 'v%' AND seq % 9 = 0)"""
PUBLISHED_SQL = f"""WITH {CATALOG_SQL},
  n AS (SELECT *, {_NORMAL("model")} AS name, coalesce(rank < min(rank) OVER (PARTITION BY {_NORMAL("model")} ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS wins FROM listed),
  merged AS (SELECT name AS model, min(rank) AS best, {", ".join(f"arg_min({r}, (CASE WHEN wins THEN rank ELSE 100 END, model)) FILTER ({r} IS NOT NULL) AS {r}" for r in RATES)} FROM n GROUP BY name),
  own AS (SELECT p.model, p.publisher, p.seq, {", ".join(f"coalesce(p.{r}, CASE WHEN e.model IS NOT NULL THEN e.{r} ELSE m.{r} END) AS {r}" for r in RATES)} FROM publishers p LEFT JOIN listed e ON e.model = p.model LEFT JOIN merged m ON m.model = {_NORMAL("p.model")}),
  turns AS (SELECT model, 1 AS turn, seq, publisher AS catalog, {_COLUMNS} FROM own UNION ALL SELECT {_NORMAL("model")}, 2, seq, publisher, {_COLUMNS} FROM own
    UNION ALL SELECT l.model, 3, 0, 'litellm', {", ".join("l." + r for r in RATES)} FROM listed l WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.model = l.model AND m.best < l.rank) UNION ALL SELECT model, 4, 0, 'litellm', {_COLUMNS} FROM merged
    UNION ALL SELECT model, 5, seq, 'openrouter', {_COLUMNS} FROM routed UNION ALL SELECT {_NORMAL("model")}, 6, seq, 'openrouter', {_COLUMNS} FROM routed)
  SELECT model, catalog, coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(cache_read, 0) AS cache_read, coalesce(cache_write_5m, 0) AS cache_write_5m, coalesce(cache_write_1h, cache_write_5m, 0) AS cache_write_1h
  FROM turns QUALIFY row_number() OVER (PARTITION BY model ORDER BY turn, seq) = 1"""


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """Models of the ledger, spelt as parts, and the ids that would price them."""
    _, routed, _ = _catalog(spark, sf)
    models = fixtures.table(spark, sf, "part").select(F.concat(F.lower("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("model"))
    return prices.lookup_targets(models, routed.select(F.col("model").alias("id")))


TARGETS_SQL = f"""WITH {CATALOG_SQL}, m AS (SELECT DISTINCT concat(lower(p_brand), '-', p_size) AS model FROM part), l AS (SELECT {_NORMAL("model")} AS name, max(model) AS id FROM routed GROUP BY 1)
  SELECT m.model, coalesce(e.model, l.id) AS id FROM m LEFT JOIN routed e ON e.model = m.model LEFT JOIN l ON l.name = {_NORMAL("m.model")} WHERE coalesce(e.model, l.id) IS NOT NULL"""


def _due(spark: SparkSession, sf: str) -> DataFrame:
    ids = _targets(spark, sf).select("id").distinct()
    cached = ids.filter(F.length("id") % 2 == 0).select("id", (F.ascii(F.substring("id", -1, 1)) * 1000).cast("long").alias("fetched_at"))
    return prices.reads_due(ids, cached, 54_000, 2_000, 50)


DUE_SQL = f"""WITH t AS (SELECT DISTINCT id FROM ({TARGETS_SQL})), c AS (SELECT id, CASE WHEN length(id) % 2 = 0 THEN ascii(right(id, 1)) * 1000 END::BIGINT AS fetched_at FROM t)
  SELECT * FROM c WHERE fetched_at IS NULL OR 54000 - fetched_at >= 2000 ORDER BY fetched_at NULLS FIRST, id LIMIT 50"""


def _needing(spark: SparkSession, sf: str) -> DataFrame:
    ledger = fixtures.usage(spark, sf)
    return prices.needing_lookup(ledger, _rates(spark), spark.sql("SELECT 'Brand#15' AS model"))


def _pricing_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = usage.displayed_models(fixtures.usage(spark, sf), fixtures.rates(spark), fixtures.overrides(spark))
    over = F.coalesce(F.col("origin") == "override", F.lit(False))
    return prices.shown(rows.drop("state").withColumnRenamed("cache_write_5m", "cache_write").drop("cache_write_1h").withColumn("overridden", over))


_SHOWN_SQL = f"""{USAGE_SQL}, {RATES_SQL}, n AS (SELECT model, source, count(*) AS n FROM usage WHERE model IS NOT NULL GROUP BY ALL), m AS (SELECT model, arg_min(source, (-n, source)) AS source FROM n GROUP BY model),
  d AS (SELECT model, source, nullif(input, 0)::BIGINT AS input, nullif(output, 0)::BIGINT AS output, nullif(cache_read, 0)::BIGINT AS cache_read, nullif(cache_write_5m, 0)::BIGINT AS cache_write, origin, coalesce(origin = 'override', FALSE) AS overridden FROM m LEFT JOIN rates USING (model)),
  shown AS (SELECT *, CASE WHEN overridden THEN 'override' WHEN origin IS NULL THEN 'unpriced' WHEN input IS NOT NULL AND output IS NOT NULL AND (cache_read IS NULL OR cache_write IS NULL) THEN 'est' ELSE 'ok' END AS state,
    CASE WHEN coalesce(input, output, cache_read, cache_write) IS NOT NULL THEN coalesce(input, 0) + coalesce(output, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0) END::BIGINT AS overall,
    NOT overridden AND coalesce(origin = 'openrouter', FALSE) AS routed, CASE origin WHEN 'litellm' THEN 'LiteLLM' WHEN 'openrouter' THEN 'OpenRouter' ELSE origin END AS label FROM d)"""
_NATURAL_SQL = "'brand#' || lpad(split_part(model, '#', 2), 10, '0')"
_ORDERS = (("overall", True), ("cache_read", False), ("model", False), ("source", False))


def _pricing_table(spark: SparkSession, sf: str) -> DataFrame:
    out, rows = None, _pricing_rows(spark, sf)
    for column, down in _ORDERS:
        part = prices.ordered(rows, column, down).select(F.lit(column).alias("sorted_by"), "place", "model", "state", "overall", "routed", "label")
        out = part if out is None else out.unionByName(part)
    return out


def _pricing_table_sql() -> str:
    orders = {"overall": f"overall DESC NULLS LAST, {_NATURAL_SQL} DESC", "cache_read": f"cache_read ASC NULLS LAST, {_NATURAL_SQL} DESC", "model": _NATURAL_SQL, "source": f"CASE state WHEN 'unpriced' THEN 2 WHEN 'override' THEN 1 ELSE 0 END, CASE WHEN state IN ('unpriced', 'override') THEN '' ELSE lower(label) END, {_NATURAL_SQL} DESC"}
    return f"WITH {_SHOWN_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS sorted_by, row_number() OVER (ORDER BY {orders[c]})::INT AS place, model, state, overall, routed, label FROM shown" for c, _ in _ORDERS)


def _pricing_search(spark: SparkSession, sf: str) -> DataFrame:
    return prices.search(_pricing_rows(spark, sf), " BRAND#1 ", "ok").select("model", "source", "state", "overall")


# Command lines from the parts' names and types, without quotes, so that SQL can cut them at blanks.
_LINES = (
    "npm run build", "yarn build:app", "pnpm run lib:build", "npm test", "npm run unittest", "yarn run typecheck", "pnpm add left-pad", "npm publish", "npm run dev-server", "npm run lint", "cd app; node --check x.js", "node -e 1", "node --input-type=module -e 1",
    "node tools/report.js", "node serve.js", "git status", "cd x && git push origin", "git -C . log", "FOO=1 git add .", "git commit -m x", "curl -s host", "x | wget y", "ps aux", "kill 3", "tmux ls", "open .", "rm -r x", "mkdir y", "ls;", "pwd", "echo a | sort", "make all", "env rtk git fetch", "xcrun /usr/bin/clang -c a.c", "bash -lc ls", "python3 /opt/x.py",
)
_LINE_SQL = f"[{', '.join(map(_quote, _LINES))}][doc_id % {len(_LINES)} + 1]"


def _exec_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One command for each document, weighed by its length; languages stand for sources."""
    docs = fixtures.table(spark, sf, "documents")
    line = F.get(F.array(*[F.lit(x) for x in _LINES]), (F.col("doc_id") % len(_LINES)).cast("int"))
    cut = docs.select(F.col("lang").alias("source"), line.alias("line"), F.expr("n_chars div 4").alias("est")).withColumn("cut", shell.cut(F.col("line")))
    return cut.select("source", shell.kind(F.col("line"), F.col("cut.words")).alias("kind"), shell.executable(F.col("cut.run")).alias("exe"), shell.signature(F.col("cut.run")).alias("cmd"), F.col("est").alias("est_tokens"), F.lit(1).cast("long").alias("calls"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with quotes of both kinds, escapes within and without, empty words and quotes that stay open."""
    docs = fixtures.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("l"), F.col("source").alias("s"))
    text = F.format_string('run  "a \\"%s\\" b"\tx=\'c %s\' \'\' k\\ \'"\'"\'"', "l", "s")
    line = F.concat(text, F.when(F.col("doc_id") % 3 == 0, " 'to the end ").otherwise(" end"))
    inner = F.format_string("env bash -lc '%s -x \"%s y\"'", "s", "l")
    return docs.select("doc_id", F.array_join(shell.words(line), "|").alias("words"), F.array_join(shell.run(shell.words(inner)), "|").alias("run"))


WORDS_SQL = (
    "SELECT doc_id, 'run|a \"' || lang || '\" b|x=c ' || source || '|k\\|\"''' || CASE WHEN doc_id % 3 = 0 THEN '|to the end ' ELSE '|end' END AS words, source || '|-x|' || lang || ' y' AS run FROM documents"
)


def _exec_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _exec_rows(spark, sf).groupBy("source", "kind", "exe", "cmd").agg(F.sum("est_tokens").alias("est_tokens"), F.sum("calls").alias("calls"))


def _exec_sql() -> str:
    cut = "regexp_replace"
    kinds = " ".join(f"WHEN regexp_matches(marked, {_quote(p)}) THEN '{k}'" for k, p in shell.KINDS)
    runs = f"CASE WHEN line LIKE 'bash -lc %' THEN substr(line, 10) ELSE {cut}({cut}(line, '^(env|rtk|command|xcrun) ', ''), '^(env|rtk|command|xcrun) ', '') END"
    return f"""ex AS (SELECT lang AS source, {_LINE_SQL} AS line, n_chars // 4 AS est FROM documents),
  ew AS (SELECT source, line, est, string_split({runs}, ' ') AS run, ',' || array_to_string(list_transform(string_split(line, ' '), lambda w: replace({cut}(w, '[;&|]+$', ''), ',', ' ')), ',') || ',' AS marked FROM ex),
  ek AS (SELECT source, CASE {kinds} WHEN regexp_matches(line, '[;&|]') THEN 'compound' ELSE 'unknown' END AS kind, split_part(list_filter(run, lambda w: NOT regexp_matches(w, '^[A-Z_][A-Z0-9_]*='))[1], '/', -1) AS exe,
    trim(split_part(run[1], '/', -1) || ' ' || coalesce(list_filter(run[2:], lambda w: NOT starts_with(w, '-') AND NOT regexp_matches(w, '^[A-Z_][A-Z0-9_]*='))[1], '')) AS cmd, est FROM ew),
  ec AS (SELECT source, kind, exe, cmd, sum(est)::BIGINT AS est_tokens, count(*)::BIGINT AS calls FROM ek GROUP BY ALL)"""


def _bash_totals(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg((F.sum("est_tokens") * 2 + 7).alias("bash"))


def _facets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _exec_weights(spark, sf)
    return pages.exec_facets(rows, _bash_totals(spark, rows))


def _facets_sql() -> str:
    each = " UNION ALL ".join(f"SELECT source, '{f}' AS facet, {f} AS key, sum(est_tokens)::BIGINT AS w, sum(calls)::BIGINT AS calls FROM ec GROUP BY ALL" for f in ("kind", "exe", "cmd"))
    return f"WITH {_exec_sql()}, f AS ({each}), j AS (SELECT f.*, bash FROM f JOIN (SELECT source, (sum(est_tokens) * 2 + 7)::BIGINT AS bash FROM ec GROUP BY source) USING (source)) SELECT source, facet, key, tokens, calls FROM {alloc_sql('j', 'source, facet', 'key', 'w', 'bash', 'tokens')}"


def _signatures(spark: SparkSession, sf: str) -> DataFrame:
    rows = _exec_weights(spark, sf)
    return pages.exec_signatures(rows, _bash_totals(spark, rows))


def _signatures_sql() -> str:
    return f"WITH {_exec_sql()}, s AS (SELECT source, cmd, min(exe) AS exe, sum(est_tokens)::BIGINT AS w, sum(calls)::BIGINT AS calls FROM ec GROUP BY ALL), j AS (SELECT s.*, bash FROM s JOIN (SELECT source, (sum(est_tokens) * 2 + 7)::BIGINT AS bash FROM ec GROUP BY source) USING (source)) SELECT source, exe, cmd, tokens, calls FROM {alloc_sql('j', 'source', 'cmd', 'w', 'bash', 'tokens')}"


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return pages.model_split(_points(spark, sf)).withColumn("sources", F.array_join("sources", ","))


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return usage.series(fixtures.usage(spark, sf), _rates(spark), WINDOW)


SERIES_SQL = f"""{priced_sql(DAY_SQL + " AS bucket, source", _where(WINDOW))}, cv AS (SELECT {DAY_SQL} AS bucket, source, count(DISTINCT session_id)::BIGINT AS convs FROM usage WHERE {_where(WINDOW)} GROUP BY ALL),
  sr AS (SELECT bucket, source, sum(ti)::BIGINT AS input_tokens, sum(tn)::BIGINT AS output_tokens, sum(tr)::BIGINT AS cache_read_tokens, sum(t5 + t1)::BIGINT AS cache_write_tokens, sum(tokens)::BIGINT AS tokens, sum(cost)::BIGINT AS cost, bool_or(unpriced) AS has_unpriced,
    bool_or(estimated) AS cache_estimated, sum(nameless)::BIGINT AS unattributed_tokens, sum(reasoning)::BIGINT AS reasoning, any_value(convs) AS convs FROM p JOIN cv USING (bucket, source) GROUP BY bucket, source)"""


def _series_ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = _series(spark, sf).select("bucket", "source", "tokens", "cost")
    from pyspark.sql import window as W

    return rows.withColumn("place", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy("bucket", "source")))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return pages.table_order(pages.daily_rows(_series(spark, sf)), "reasoning")


DAILY_SQL = f"""WITH {SERIES_SQL}, d AS (SELECT bucket AS label, sum(tokens)::BIGINT AS total, sum(input_tokens)::BIGINT AS input, sum(output_tokens)::BIGINT AS output, sum(cache_read_tokens)::BIGINT AS cached, sum(reasoning)::BIGINT AS reasoning, sum(convs)::BIGINT AS convs FROM sr GROUP BY ALL)
  SELECT *, row_number() OVER (ORDER BY coalesce(reasoning, -1) DESC, label)::INT AS place FROM d"""


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return pages.model_bars(usage.breakdown(fixtures.usage(spark, sf), _rates(spark), "model"))


BARS_SQL = f"""WITH b AS ({_breakdown_sql("model")}) SELECT key, source, total_tokens, cost, cache_estimated, total_tokens / sum(total_tokens) OVER (PARTITION BY source)::BIGINT AS share,
  {", ".join(f"{c} / greatest(1, total_tokens) AS {c}_part" for c in pages.CATEGORIES)} FROM b"""


def _skill_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.table(spark, sf, "documents")
    return docs.groupBy(F.col("lang").alias("source"), F.concat(F.lit("skill-"), (F.col("doc_id") % 23).cast("string")).alias("name")).agg(F.sum(F.expr("n_chars div 4")).alias("est_tokens"), F.count("*").alias("uses"))


SKILLS_SQL = "sk AS (SELECT lang AS source, 'skill-' || (doc_id % 23)::VARCHAR AS name, sum(n_chars // 4)::BIGINT AS est_tokens, count(*)::BIGINT AS uses FROM documents GROUP BY ALL)"


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.table(spark, sf, "documents")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("skill", "mcp_server", "agent", "memory_file", "other")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = docs.filter("doc_id % 5 <> 2 or lang <> 'en'").select(F.col("lang").alias("source"), kind.alias("kind"), F.col("source").alias("name")).distinct()
    return pages.kinds_of(rows)


KINDS_SQL = """WITH r AS (SELECT DISTINCT lang AS source, ['skill', 'mcp_server', 'agent', 'memory_file', 'other'][doc_id % 5 + 1] AS kind, source AS name FROM documents WHERE doc_id % 5 <> 2 OR lang <> 'en'), c AS (SELECT source, kind, count(*) AS n FROM r WHERE kind <> 'other' GROUP BY ALL)
  SELECT source, string_agg(n::VARCHAR || ' ' || replace(kind, '_', ' ') || CASE WHEN n = 1 THEN '' ELSE 's' END, ' · ' ORDER BY list_position(['skill', 'mcp_server', 'agent', 'memory_file'], kind)) AS meta FROM c GROUP BY source"""


def _with_context(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger with context columns: parts of what was billed, in whole shares."""
    rows = fixtures.usage(spark, sf).drop("seq")
    rows = rows.withColumn("billed", F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens"))
    known = F.col("reasoning_tokens").isNotNull()
    parts = {"system": F.expr("billed div 5"), "reasoning": F.expr("billed div 7"), "toolcalls": F.expr("billed div 3"), "agents": F.lit(None).cast("long"), "mcp": F.when(F.col("api_calls") == 1, F.expr("billed div 9")), "skills": F.lit(0).cast("long")}
    for name, part in parts.items():
        rows = rows.withColumn(f"ctx_{name}", F.when(known, part))
    return rows.withColumn("ctx_messages", F.when(known, F.col("billed") - F.expr("billed div 5") - F.expr("billed div 7")))


CONTEXT_SQL = f"""{USAGE_SQL}, cx AS (SELECT *, input_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens AS billed, reasoning_tokens IS NOT NULL AS known FROM usage WHERE {_where(WINDOW)}),
  st AS (SELECT source, sum(billed)::BIGINT AS billed, sum(cache_read_tokens)::BIGINT AS reused, sum(CASE WHEN known THEN billed - billed // 5 - billed // 7 END)::BIGINT AS messages, sum(CASE WHEN known THEN billed // 5 END)::BIGINT AS system, sum(CASE WHEN known THEN billed // 7 END)::BIGINT AS reasoning,
    sum(CASE WHEN known THEN billed // 3 END)::BIGINT AS toolcalls, NULL::BIGINT AS agents, sum(CASE WHEN known AND api_calls = 1 THEN billed // 9 END)::BIGINT AS mcp, sum(CASE WHEN known THEN 0 END)::BIGINT AS skills FROM cx GROUP BY source)"""


def _card(spark: SparkSession, sf: str) -> DataFrame:
    """The context card of every source: totals beside the bucket view."""
    rows = _with_context(spark, sf)
    totals = pages.source_totals(rows, WINDOW).select("source", "billed", "reused", F.col("messages").alias("ctx_messages"), "toolcalls")
    return totals.join(pages.bucket_view(context.buckets(rows, WINDOW)).select("source", "history", "new_input", "response", "messages", "total"), "source")


def _card_sql() -> str:
    from ledgerloom.plans.usage_queries import CTX_BUCKETS_SQL

    return f"WITH {CONTEXT_SQL}, b AS ({CTX_BUCKETS_SQL}) SELECT source, billed, reused, st.messages AS ctx_messages, toolcalls, history, new_input, response, history + new_input + response AS messages, history + new_input + response + coalesce(b.system, 0) + coalesce(b.reasoning, 0) AS total FROM st JOIN b USING (source)"


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.cost_groups(usage.breakdown(fixtures.usage(spark, sf), _rates(spark), "model"))
    shown = formats.money(F.col("group_cost") / 1e9)
    return rows.withColumn("label", pages.source_cost_label(F.col("group_cost"), F.col("unpriced"), F.col("unattributed"), shown))


_MONEY_SQL = lambda c, d=2: f"format('{{:,.{d}f}}', round(({c})::VARCHAR::DECIMAL(38, 12), {d}))"
GROUPS_SQL = f"""WITH b AS ({_breakdown_sql("model")}), g AS (SELECT *, sum(cost) FILTER (key IS NOT NULL) OVER (PARTITION BY source)::BIGINT AS group_cost, count(*) FILTER (key IS NOT NULL AND cost IS NULL) OVER (PARTITION BY source)::BIGINT AS unpriced,
    coalesce(sum(unattributed_tokens) FILTER (key IS NULL) OVER (PARTITION BY source), 0)::BIGINT AS unattributed, coalesce(key, 'Unattributed usage') AS model FROM b),
  r AS (SELECT dense_rank() OVER (ORDER BY group_cost DESC NULLS LAST, source)::INT AS place, source, group_cost, unpriced, unattributed, row_number() OVER (PARTITION BY source ORDER BY cost DESC NULLS LAST, model)::INT AS spot, model, cost, cache_estimated FROM g)
  SELECT *, CASE WHEN unpriced > 0 OR unattributed > 0 THEN '≥ ' ELSE '' END || '$' || {_MONEY_SQL("group_cost / 1e9")} || CASE WHEN unpriced > 0 THEN ' · ' || unpriced::VARCHAR || ' unpriced' ELSE '' END || CASE WHEN unattributed > 0 THEN ' · Unattributed usage' ELSE '' END AS label FROM r"""


def _times(spark: SparkSession, sf: str) -> DataFrame:
    return pages.report_times(_series(spark, sf))


TIMES_SQL = f"""WITH {SERIES_SQL}, t AS (SELECT bucket AS key, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, sum(tokens)::BIGINT AS total_tokens,
    sum(convs)::BIGINT AS sessions, sum(cost)::BIGINT AS c, bool_or(has_unpriced) AS has_unpriced, bool_or(cache_estimated) AS cache_estimated, sum(unattributed_tokens)::BIGINT AS unattributed_tokens FROM sr GROUP BY ALL)
  SELECT * EXCLUDE (c), CASE WHEN NOT (has_unpriced AND c = 0) THEN c END AS cost FROM t"""


def _bucket_csv(spark: SparkSession, sf: str) -> DataFrame:
    return pages.bucket_csv(trend.trend_points(_points(spark, sf), "month"))


BUCKET_CSV_SQL = f"""WITH {POINTS_SQL}, s AS (SELECT bucket[:7] AS bucket, model, sum(tokens)::BIGINT AS tokens, max(source) AS source FROM pts WHERE model IS NOT NULL GROUP BY ALL), w AS (SELECT *, tokens / sum(tokens) OVER (PARTITION BY bucket)::BIGINT AS part FROM s WHERE tokens > 0)
  SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY tokens DESC, model)::INT AS line, model || ',' || source || ',' || tokens::VARCHAR || ',' || {_fixed_sql("part", 4)} AS text FROM w"""


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return pages.report_lines(fixtures.usage(spark, sf), _rates(spark), WINDOW)


def _report_sql() -> str:
    cells = lambda sessions, source: f"""key || {"',' || source || " if source else ""} ',' || input_tokens || ',' || output_tokens || ',' || cache_read_tokens || ',' || cache_write_tokens || ',' || total_tokens || ',' || {"convs || ',' ||" if sessions else ""}
      {_fixed_sql("CASE WHEN input_tokens + cache_read_tokens + cache_write_tokens > 0 THEN cache_read_tokens / (input_tokens + cache_read_tokens + cache_write_tokens) ELSE 0.0::DOUBLE END", 4)} || ',' || coalesce({_fixed_sql("cost / 1e9", 6)}, '') || ',' ||
      CASE WHEN cost IS NULL THEN 'unavailable' WHEN has_unpriced OR unattributed_tokens > 0 THEN 'partial' ELSE 'exact' END || ',' || unattributed_tokens || ',' || cache_estimated"""  # noqa: E731
    head = lambda first, sessions, source: f"{first}{',source' if source else ''},input_tokens,output_tokens,cache_read_tokens,cache_write_tokens,total_tokens{',sessions' if sessions else ''},cache_hit_rate,cost_usd,cost_basis,unattributed_tokens,cache_estimated"
    parts = [("day", f"({TIMES_SQL})", "key", False, False)]
    for by, first in (("tool", "source"), ("model", "model"), ("project", "project")):
        inner = _breakdown_sql(by).replace("FROM usage)", f"FROM usage WHERE {_where(WINDOW)})")
        parts.append((first, f"(SELECT * REPLACE (coalesce(key, 'Unattributed usage') AS key) FROM ({inner}))", "total_tokens DESC, key, source", True, by == "model"))
    return " UNION ALL ".join(f"SELECT {n} AS block, 0 AS line, '{head(first, sessions, source)}' AS text UNION ALL SELECT {n}, row_number() OVER (ORDER BY {order})::INT, {cells(sessions, source)} FROM {rows}" for n, (first, rows, order, sessions, source) in enumerate(parts, 1))


_HOUR_NOW = 1704326400  # 2024-01-04, midnight UTC: the evening before in New York


def _chart(spark: SparkSession, sf: str) -> DataFrame:
    """The hours of a local day with their cost, a thousand for each input token."""
    rows = fixtures.hourly_usage(spark, sf)
    series = rows.groupBy(usage.bucket(F.col("timestamp"), "America/New_York", True).alias("bucket")).agg((F.sum("input_tokens") * 1000).alias("cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    windows = spark.range(1).select(dates.panel_windows("today", F.lit(_HOUR_NOW), "America/New_York").alias("w"))
    keys = windows.select(F.explode(dates.bucket_keys(F.col("w.start"), F.col("w.end"), F.lit(_HOUR_NOW).cast("long"), True, "America/New_York")).alias("bucket"))
    return pages.panel_chart(series, keys)


CHART_SQL = f"""WITH {HOURLY_SQL}, s AS (SELECT strftime(to_timestamp(timestamp) AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:00') AS bucket, (sum(input_tokens) * 1000)::BIGINT AS cost, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM hourly GROUP BY 1),
  k AS (SELECT '2024-01-03 ' || lpad(h::VARCHAR, 2, '0') || ':00' AS bucket, h AS position FROM range(0, 20) r(h)), j AS (SELECT k.bucket, position, coalesce(cost, 0) AS cost, coalesce(tokens, 0) AS tokens FROM k LEFT JOIN s USING (bucket))
  SELECT bucket, position::INT AS position, cost, tokens, cost / max(cost) OVER () AS height, row_number() OVER (ORDER BY cost DESC, bucket) = 1 AS is_peak, CASE WHEN position IN (0, 9, 19) THEN bucket[12:16] END AS tick FROM j"""


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    ledger, rates = fixtures.usage(spark, sf), _rates(spark)
    now, before = Filters(start=START, end=START + 30 * 86400), Filters(start=START - 30 * 86400, end=START)
    return pages.panel_rows(usage.summary(ledger, rates, now), usage.summary(ledger, rates, before), usage.breakdown(ledger, rates, "model", now))


def _panel_sql() -> str:
    now, before = f"timestamp >= {START} AND timestamp < {START + 30 * 86400}", f"timestamp >= {START - 30 * 86400} AND timestamp < {START}"
    rows = _breakdown_sql("model").replace("FROM usage)", f"FROM usage WHERE {now})")
    return f"""WITH b AS ({rows}), d AS (SELECT (a.cost / o.cost - 1) * 100 AS delta FROM ({_summary_sql(now)}) a, ({_summary_sql(before)}) o),
      r AS (SELECT *, row_number() OVER (ORDER BY cost DESC NULLS LAST, total_tokens DESC, key, source)::INT AS place, sum(cost) OVER ()::BIGINT AS priced, greatest(0, count(*) OVER () - 5)::BIGINT AS overflow FROM b WHERE total_tokens > 0)
      SELECT delta, place, key, source, total_tokens AS tokens, cost, coalesce(cost, 0) / priced AS share, overflow FROM r, d WHERE place <= 5"""


_CATALOG_ORDER = ["3-medium", "1-urgent", "5-low"]


def _ordered_sources(spark: SparkSession, sf: str) -> DataFrame:
    return pages.in_catalog_order(trend.in_window(_points(spark, sf), "1997-01-01", "1997-06-30"), _CATALOG_ORDER)


def _stacked(spark: SparkSession, sf: str) -> DataFrame:
    return pages.stacked(_points(spark, sf), _CATALOG_ORDER)


_AT_SQL = f"coalesce(nullif(list_position({_CATALOG_ORDER}, source), 0), 4)"
STACKED_SQL = f"""WITH {POINTS_SQL}, m AS (SELECT model, sum(tokens)::BIGINT AS tokens, arg_max(source, (bucket, source)) AS source FROM pts WHERE model IS NOT NULL GROUP BY model)
  SELECT model, source, tokens, row_number() OVER (ORDER BY tokens DESC, model)::INT AS rank, row_number() OVER (ORDER BY {_AT_SQL}, tokens DESC, model)::INT AS place FROM m"""


def _window_full(spark: SparkSession, sf: str) -> DataFrame:
    return pages.window_parts(fixtures.usage(spark, sf), _rates(spark), WINDOW)


def _window_full_sql() -> str:
    shown = "input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, total_tokens, requests, cost, has_unpriced, unattributed_tokens, convs, CASE WHEN input_tokens + cache_read_tokens + cache_write_tokens > 0 THEN cache_read_tokens / (input_tokens + cache_read_tokens + cache_write_tokens) ELSE 0.0 END AS cache_hit_rate"
    parts = [f"SELECT 'summary' AS part, NULL::VARCHAR AS key, NULL::VARCHAR AS source, {shown} FROM ({_summary_sql(_where(WINDOW))})"]
    for by in ("model", "project", "tool"):
        parts.append(f"SELECT '{by}', key, source, {shown} FROM ({_breakdown_sql(by).replace('FROM usage)', f'FROM usage WHERE {_where(WINDOW)})')})")
    return " UNION ALL ".join(parts)


_ALL_FILTERS = Filters(sources=("1-urgent", "2-high"), models=("Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15"), project="/AMERICA/NATION_1", start=START)


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _ALL_FILTERS.apply(fixtures.usage(spark, sf)).groupBy("source", "model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"))


def _order_days(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


_SLOTS = [("lastMonth", 0), None, ("rolling", 45), ("rolling", 1)]


def _presets(spark: SparkSession, sf: str) -> DataFrame:
    return _order_days(spark, sf).select(F.col("day").cast("string").alias("today"), F.explode(dates.presets(F.lit("1995-06-15").cast("date"), F.col("day"), _SLOTS)).alias("p")).select("today", "p.*")


PRESETS_SQL = """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), p AS (
    SELECT day, 'yesterday' AS key, day - 1 AS a, day - 1 AS b FROM d UNION ALL SELECT day, 'thisMonth', date_trunc('month', day)::DATE, day FROM d UNION ALL SELECT day, 'last90', day - 89, day FROM d UNION ALL SELECT day, 'thisYear', date_trunc('year', day)::DATE, day FROM d
    UNION ALL SELECT day, 'lastMonth', (date_trunc('month', day) - INTERVAL 1 MONTH)::DATE, date_trunc('month', day)::DATE - 1 FROM d UNION ALL SELECT day, 'rolling', day - 44, day FROM d)
  SELECT strftime(day, '%Y-%m-%d') AS today, key, strftime(greatest(a, '1995-06-15'::DATE), '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last FROM p WHERE b >= '1995-06-15'::DATE"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    tz = "America/New_York"
    day = F.col("day")
    each = [dates.range_window(n, day, tz=tz) for n in ("day", "week", "month", "total")] + [dates.range_window("custom", day, day, F.lit("1997-01-01").cast("date"), tz), dates.heat_window(day, tz)]
    named = F.array(*[F.struct(F.lit(n).alias("name"), w.alias("w")) for n, w in zip(("day", "week", "month", "total", "custom", "heat"), each, strict=True)])
    return _order_days(spark, sf).select(day.cast("string").alias("today"), F.explode(named).alias("x")).select("today", "x.name", "x.w.*")


def _windows_sql() -> str:
    at = lambda d: f"epoch(timezone('America/New_York', ({d})::TIMESTAMP))::BIGINT"
    text = lambda d: f"strftime({d}, '%Y-%m-%d')"
    rows = [("day", "day", "day", "day", None), ("week", "day - 6", "day", "day - 6", None), ("month", "day - 29", "day", "day - 29", None), ("total", None, None, None, None), ("custom", "least(day, '1997-01-01'::DATE)", "greatest(day, '1997-01-01'::DATE)", "least(day, '1997-01-01'::DATE)", "greatest(day, '1997-01-01'::DATE) + 1"), ("heat", "day - 364", "day", "day - 364", "day + 1")]
    return "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) " + " UNION ALL ".join(f"SELECT {text('day')} AS today, '{n}' AS name, {text(a) if a else 'NULL'} AS first, {text(b) if b else 'NULL'} AS last, {at(s) if s else 'NULL::BIGINT'} AS start, {at(e) if e else 'NULL::BIGINT'} AS \"end\" FROM d" for n, a, b, s, e in rows)


def _months(spark: SparkSession, sf: str) -> DataFrame:
    cells = dates.month_cells(F.col("month"))
    return _order_days(spark, sf).select(F.trunc("day", "month").alias("month")).distinct().select(F.date_format("month", "yyyy-MM").alias("month"), F.posexplode(cells).alias("cell", "day")).select("month", "cell", F.col("day").cast("string").alias("day"))


MONTHS_SQL = """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), g AS (SELECT m, unnest(range(0, 42)) AS cell FROM m), c AS (SELECT m, cell, m + (cell - (isodow(m) - 1))::INT AS day, ((isodow(m) - 1 + day(last_day(m)) + 6) // 7) * 7 AS n FROM g)
  SELECT strftime(m, '%Y-%m') AS month, cell::INT AS cell, CASE WHEN date_trunc('month', day) = m THEN strftime(day, '%Y-%m-%d') END AS day FROM c WHERE cell < n"""


def _bucket_bounds(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf).select("bucket").distinct()
    out = None
    for per in ("day", "week", "month"):
        keys = points.select(trend.coarser(F.col("bucket"), per).alias("key")).distinct()
        rows = keys.select(F.lit(per).alias("per"), "key", dates.bucket_bounds(F.col("key"), per, "America/New_York").alias("b")).select("per", "key", "b.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _bucket_bounds_sql() -> str:
    at = lambda d: f"epoch(timezone('America/New_York', ({d})::TIMESTAMP))::BIGINT"
    keys = {"day": ("bucket", "bucket::DATE", "1 DAY"), "week": ("strftime(bucket::DATE - dayofweek(bucket::DATE)::INT, '%Y-%m-%d')", "key::DATE", "7 DAY"), "month": ("bucket[:7]", "(key || '-01')::DATE", "1 MONTH")}
    return f"WITH {POINTS_SQL} " + " UNION ALL ".join(f"SELECT '{per}' AS per, key, {at(begin.replace('bucket', 'key'))} AS start, {at(begin.replace('bucket', 'key') + f' + INTERVAL {step}')} AS \"end\" FROM (SELECT DISTINCT {key} AS key FROM pts)" for per, (key, begin, step) in keys.items())


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    n, now = F.col("o_orderkey").cast("long"), F.lit(1 << 48)  # later than any key, as an instant up to 0 stands for no scan at all
    via = F.when(n % 2 == 0, "live").otherwise("logs")
    rows = fixtures.table(spark, sf, "orders").select("o_orderkey").distinct()
    return rows.select("o_orderkey", dates.duration(n * 7).alias("lasts"), dates.freshness(via, F.when(n % 5 != 0, now - n * 13), now).alias("fresh"), dates.since(F.when(n % 3 == 0, 0).otherwise(now - n), now).alias("scanned"))


SPANS_SQL = """WITH o AS (SELECT DISTINCT o_orderkey, o_orderkey * 7 AS m FROM orders) SELECT o_orderkey,
  CASE WHEN m >= 1440 THEN (m // 1440)::VARCHAR || 'd' || CASE WHEN m % 1440 >= 60 THEN ' ' || (m % 1440 // 60)::VARCHAR || 'h' ELSE '' END WHEN m >= 60 THEN (m // 60)::VARCHAR || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60)::VARCHAR || 'm' ELSE '' END ELSE m::VARCHAR || 'm' END AS lasts,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey * 13 < 30 THEN 'checkedNow' ELSE 'checkedAgo' END WHEN o_orderkey * 13 > 86400 THEN 'observedOld' ELSE 'observedAgo' END AS fresh,
  CASE WHEN o_orderkey % 3 = 0 THEN '—' WHEN o_orderkey < 60 THEN 'just now' WHEN o_orderkey < 3600 THEN (o_orderkey // 60)::VARCHAR || ' min ago' ELSE (o_orderkey // 3600)::VARCHAR || 'h ago' END AS scanned FROM o"""


def _moneys(spark: SparkSession, sf: str) -> DataFrame:
    usd = F.col("o_totalprice")
    rows = fixtures.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").distinct()
    whole = F.floor(usd)
    return rows.select("o_orderkey", formats.money(usd).alias("usd"), formats.money(usd, "JPY", 150.0).alias("jpy"), formats.money(usd, "SGD", 2.0).alias("sgd"), formats.money(usd, "AUD", 0.5, True).alias("aud"), formats.bar_title(whole.cast("long"), F.col("o_orderkey") % 2 == 0, F.when(F.col("o_orderkey") % 3 != 0, usd), F.col("o_orderkey") % 5 == 0, F.lit(0)).alias("title"), formats.rate_per_million(usd / 1e12).alias("rate"), formats.percent(usd / 1e6).alias("share"), formats.short_tokens(whole * 100).alias("tokens"), formats.adaptive_cost(F.when(F.col("o_orderkey") % 4 != 0, usd)).alias("cost"))


def _moneys_sql() -> str:
    cents = lambda u: f"((n * 100 + {u // 2}) // {u})"
    shown = lambda u, m: f"({cents(u)} // 100)::VARCHAR || '.' || lpad(({cents(u)} % 100)::VARCHAR, 2, '0') || '{m}'"
    compact = f"CASE WHEN n < 1000 THEN n::VARCHAR WHEN {cents(1000)} < 100000 THEN {shown(1000, 'K')} ELSE {shown(10**6, 'M')} END"
    money = lambda x, d=2: f"format('{{:,.{d}f}}', round(({x})::VARCHAR::DECIMAL(38, 12), {d}))"
    t, rate, share = "(n * 100)", "o_totalprice / 1e12 * 1000000", "o_totalprice / 1e6 * 100"
    return f"""SELECT o_orderkey, '$' || {money("o_totalprice")} AS usd, '¥' || {money("o_totalprice * 150.0::DOUBLE", 0)} AS jpy, 'SGD' || chr(160) || {money("o_totalprice * 2.0::DOUBLE")} AS sgd, 'AU$' || {money("o_totalprice * 0.5::DOUBLE")} AS aud,
      CASE WHEN o_orderkey % 2 = 0 THEN '≥ ' ELSE '' END || {compact} || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' · ' || CASE WHEN o_orderkey % 5 = 0 THEN '≥ ' ELSE '' END || '$' || {money("o_totalprice")} END AS title,
      '$' || CASE WHEN {rate} < 0.1 THEN {_fixed_sql(rate, 3)} ELSE {_fixed_sql(rate, 2)} END AS rate, CASE WHEN o_totalprice / 1e6 < 0.1 THEN {_fixed_sql(share, 1)} ELSE {_fixed_sql(share, 0)} END || '%' AS share,
      CASE WHEN {t} >= 0.9995e6 THEN CASE WHEN {t} >= 10000000 THEN {_fixed_sql(t + " / 1000000", 1)} ELSE {_fixed_sql(t + " / 1000000", 2)} END || 'M' WHEN {t} >= 999.5 THEN CASE WHEN {t} >= 100000 THEN {_fixed_sql(t + " / 1000", 0)} ELSE {_fixed_sql(t + " / 1000", 1)} END || 'K' ELSE {t}::VARCHAR END AS tokens,
      CASE WHEN o_orderkey % 4 = 0 THEN 'unpriced' ELSE '$' || {money("o_totalprice")} END AS cost
      FROM (SELECT DISTINCT o_orderkey, o_totalprice, floor(o_totalprice)::BIGINT AS n FROM orders)"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    part = fixtures.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    name = F.regexp_replace("p_name", " ", "%20")
    body = F.concat(F.lit(formats.SKILL_BODY), F.when(F.col("p_partkey") % 2 == 0, " /home/x/.claude/skills/").otherwise(" /p/plugins/cache/market/tool/1.0/skills/a/"), F.lower("p_type"), F.lit("/\nrest"))
    return part.select(
        "p_partkey", formats.uri_path(F.concat(F.lit("file:///a+b/"), name)).alias("path"), formats.model_scope(F.when(F.col("p_partkey") % 3 != 0, F.array("p_type", "p_brand", "p_type"))).alias("scope"), formats.skill_name(body).alias("skill"),
        formats.epoch_key([F.col(c) for c in ("p_brand", "p_type", "p_name")], F.col("p_partkey")).alias("epoch_key"),
        formats.legacy_key(F.lit("pi"), F.lit("message"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") * 1000), F.col("p_partkey"), F.lit(None).cast("string"), F.col("p_type"), [F.col("p_size"), *[F.lit(0)] * 4, F.when(F.col("p_size") > 9, F.col("p_size"))]).alias("legacy"),
    )


NAMES_SQL = f"""SELECT p_partkey, '/a+b/' || p_name AS path, CASE WHEN p_partkey % 3 = 0 THEN 'all' ELSE to_json(list_sort(list_distinct([p_type, p_brand])))::VARCHAR END AS scope, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE 'tool:' || lower(p_type) END AS skill,
  sha256(p_brand::BLOB || '\\x00'::BLOB || p_type::BLOB || '\\x00'::BLOB || p_name::BLOB || '\\x00'::BLOB || from_hex(printf('%016x', p_partkey)))[:16] AS epoch_key,
  'pi:legacy:message:' || sha256('[' || (p_partkey * 1000)::VARCHAR || ',null,"' || p_type || '",' || p_size || ',0,0,0,0,' || CASE WHEN p_size > 9 THEN p_size::VARCHAR ELSE 'null' END || ']') AS legacy FROM part"""


def _slice(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    return trend.trend_slice(points, points, "1997-01-01", "1997-03-31")


SLICE_SQL = f"""WITH {POINTS_SQL}, q AS (SELECT * FROM pts WHERE bucket BETWEEN '1997-01-01' AND '1997-03-31'), wk AS (SELECT *, bucket::DATE - dayofweek(bucket::DATE)::INT AS w FROM q), k AS (SELECT unnest(generate_series(min(w), max(w), INTERVAL 7 DAY)) AS w FROM wk),
  s AS (SELECT w, source, sum(tokens)::BIGINT AS tokens FROM wk GROUP BY ALL) SELECT strftime(k.w, '%Y-%m-%d') AS bucket, o.source, coalesce(s.tokens, 0)::BIGINT AS tokens FROM k CROSS JOIN (SELECT DISTINCT source FROM q) o LEFT JOIN s ON s.w = k.w AND s.source = o.source"""


def _some_files(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "supplier").select(F.concat(F.lit("O/"), F.col("s_suppkey").cast("string")).alias("path"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return merge.files_with_records(_some_files(spark, sf), fixtures.usage(spark, sf).filter(F.col("timestamp") >= 999_000_000))


def _cleared(spark: SparkSession, sf: str) -> DataFrame:
    ledger = fixtures.usage(spark, sf)
    weights = ledger.select("source_file", "session_id", F.col("input_tokens").alias("est_tokens"))
    left = merge.cleared_sessions(weights, ledger, _some_files(spark, sf).filter("path like '%7'"))
    return left.groupBy("source_file").agg(F.count("*").alias("n"), F.sum("est_tokens").alias("est_tokens"))


def _exports(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "orders").select(F.lower("o_orderpriority").alias("source"), F.col("o_orderkey").alias("fetched_at"), (F.col("o_orderkey") % 5).alias("usage_resets_available"))
    return merge.with_exports(rows.select("source").distinct().unionByName(spark.sql("SELECT 'none' AS source")), rows)


QUERIES = {
    "trend_slice": (_slice, SLICE_SQL),
    "file_records": (_files, f"WITH {USAGE_SQL} SELECT 'O/' || s_suppkey AS path FROM supplier WHERE 'O/' || s_suppkey IN (SELECT source_file FROM usage WHERE timestamp >= 999000000)"),
    "cleared_sessions": (_cleared, f"WITH {USAGE_SQL} SELECT source_file, count(*)::BIGINT AS n, sum(input_tokens)::BIGINT AS est_tokens FROM usage WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM usage WHERE session_id IS NOT NULL AND source_file IN (SELECT 'O/' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 7)) GROUP BY source_file"),
    "limit_exports_on_cards": (_exports, "SELECT lower(o_orderpriority) AS source, arg_max(o_orderkey % 5, o_orderkey)::BIGINT AS usage_resets_available, max(o_orderkey)::BIGINT AS fetched_at FROM orders GROUP BY 1 UNION ALL SELECT 'none', NULL, NULL"),
    "price_catalog": (_published, PUBLISHED_SQL),
    "price_targets": (_targets, TARGETS_SQL),
    "price_reads_due": (_due, DUE_SQL),
    "price_needing_lookup": (_needing, f"WITH {USAGE_SQL}, {RATES_SQL} SELECT DISTINCT model FROM usage WHERE model IS NOT NULL AND model NOT IN (SELECT model FROM rates) AND model <> 'Brand#15'"),
    "pricing_table": (_pricing_table, _pricing_table_sql()),
    "pricing_search": (_pricing_search, f"WITH {_SHOWN_SQL} SELECT model, source, state, overall FROM shown WHERE state = 'ok' AND (contains(lower(model), 'brand#1') OR contains(lower(source), 'brand#1'))"),
    "pricing_chips": (lambda spark, sf: prices.chips(_pricing_rows(spark, sf)), f"WITH {_SHOWN_SQL} SELECT count(*)::BIGINT AS \"all\", count(*) FILTER (state = 'unpriced')::BIGINT AS unpriced, count(*) FILTER (state = 'override')::BIGINT AS override, count(*) FILTER (state = 'est')::BIGINT AS est FROM shown"),
    "shell_words": (_words, WORDS_SQL),
    "ctx_exec": (_exec_weights, f"WITH {_exec_sql()} SELECT * FROM ec"),
    "exec_facets": (_facets, _facets_sql()),
    "exec_signatures": (_signatures, _signatures_sql()),
    "model_split": (_split, f"WITH {POINTS_SQL} SELECT model, sum(tokens)::BIGINT AS tokens, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM pts GROUP BY model"),
    "category_totals": (lambda spark, sf: pages.category_totals(_series(spark, sf)), f"WITH {SERIES_SQL} SELECT source, sum(input_tokens)::BIGINT AS input, sum(output_tokens)::BIGINT AS output, sum(cache_read_tokens)::BIGINT AS cache_read, sum(cache_write_tokens)::BIGINT AS cache_write, sum(tokens)::BIGINT AS tokens FROM sr GROUP BY source"),
    "series_ordered": (_series_ordered, f"WITH s AS ({SERIES_DAY_SQL}) SELECT bucket, source, tokens, cost, row_number() OVER (ORDER BY bucket, source)::INT AS place FROM s"),
    "daily_table": (_daily, DAILY_SQL),
    "model_bars": (_bars, BARS_SQL),
    "ctx_skills": (_skill_rows, f"WITH {SKILLS_SQL} SELECT * FROM sk"),
    "skill_bars": (lambda spark, sf: pages.skill_bars(_skill_rows(spark, sf)), f"WITH {SKILLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY est_tokens DESC, name) AS rn FROM sk) SELECT source, least(rn, 11)::INT AS place, CASE WHEN rn > 10 THEN '' ELSE name END AS name, sum(est_tokens)::BIGINT AS tokens, sum(uses)::BIGINT AS uses, count(*) FILTER (rn > 10)::BIGINT AS rest FROM r GROUP BY ALL"),
    "ctx_meta": (_kinds, KINDS_SQL),
    "ctx_source_totals": (lambda spark, sf: pages.source_totals(_with_context(spark, sf), WINDOW), f"WITH {CONTEXT_SQL} SELECT * FROM st"),
    "context_card": (_card, _card_sql()),
    "cost_groups": (_groups, GROUPS_SQL),
    "report_times": (_times, TIMES_SQL),
    "report_csv": (_report, _report_sql()),
    "bucket_csv": (_bucket_csv, BUCKET_CSV_SQL),
    "panel_chart": (_chart, CHART_SQL),
    "panel_rows": (_panel, _panel_sql()),
    "sources_in_order": (_ordered_sources, f"WITH {POINTS_SQL} SELECT source, sum(tokens)::BIGINT AS tokens, row_number() OVER (ORDER BY {_AT_SQL}, source)::INT AS place FROM pts WHERE bucket BETWEEN '1997-01-01' AND '1997-06-30' GROUP BY source"),
    "stacked_models": (_stacked, STACKED_SQL),
    "window_full": (_window_full, _window_full_sql()),
    "filtered": (_filtered, f"WITH {USAGE_SQL} SELECT source, model, count(*)::BIGINT AS n, sum(input_tokens)::BIGINT AS tokens FROM usage WHERE source IN ('1-urgent', '2-high') AND model IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15') AND project = '/AMERICA/NATION_1' AND timestamp >= {START} GROUP BY ALL"),
    "date_presets": (_presets, PRESETS_SQL),
    "date_windows": (_windows, _windows_sql()),
    "month_cells": (_months, MONTHS_SQL),
    "bucket_bounds": (_bucket_bounds, _bucket_bounds_sql()),
    "date_spans": (_spans, SPANS_SQL),
    "format_money": (_moneys, _moneys_sql()),
    "format_names": (_names, NAMES_SQL),
}
