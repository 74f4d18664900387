"""Queries of stores that are written and read back, of what is found in folders, and of prices as they were frozen."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.operators import limits, merge, prices, usage
from ledgerloom.plans import fixtures, ledger_queries
from ledgerloom.plans.fixtures import USAGE_SQL
from ledgerloom.plans.source_queries import _BOOKED, EVENTS_SQL, _events
from ledgerloom.plans.usage_queries import DAY_SQL
from ledgerloom.session import shared_folder
from ledgerloom.sources import artifacts, discovery, documents, records
from ledgerloom.streaming import ledger


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- a log of updates for each conversation; a cancelled turn bills nothing, one kind is not known, one file in 13 is wrong
def _updates(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.octet_length("text").alias("n"), "text")
    file = F.concat(F.lit("/g/"), F.col("conv_id").cast("string"), F.lit("/updates.jsonl"))
    kind = F.when(F.col("role") == "user", "user_message_chunk").when(F.col("turn") % 3 == 0, "agent_thought_chunk").when(F.col("turn") % 3 == 1, "tool_call").otherwise("agent_message_chunk")
    body = F.when(kind == "tool_call", F.struct(F.col("text").alias("rawInput"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit(None).cast("string").alias("rawInput"), F.col("text")))
    content = F.when(kind == "tool_call", F.to_json(F.struct(body["rawInput"].alias("rawInput")))).otherwise(F.to_json(F.struct(F.struct(F.col("text")).alias("content"))))
    head = lambda kind: F.concat(F.lit('{"timestamp":'), (F.lit(1735689600) + F.col("conv_id") * 60 + F.col("turn")).cast("string"), F.lit(',"method":"session/update","params":{"sessionId":"s'), F.col("conv_id").cast("string"), F.lit('","update":{"sessionUpdate":"'), kind, F.lit('"'))
    chunk = F.concat(head(kind), F.lit(","), F.substr(content, F.lit(2)), F.lit("}}"))
    other = F.concat(head(F.lit("new_telemetry")), F.lit(',"content":{"text":"zzzzzzzz"}}}}'))
    used = F.concat(F.lit(',"usage":{"inputTokens":'), (F.col("n") + 40).cast("string"), F.lit(',"outputTokens":'), (F.col("turn") + 5).cast("string"), F.lit(',"cachedReadTokens":'), F.when(F.col("conv_id") % 13 == 5, F.col("n") + 41).otherwise(7).cast("string"), F.lit(',"cacheCreationTokens":3,"reasoningTokens":2,"modelCalls":'), (F.col("turn") % 2 + 1).cast("string"), F.lit("}"))
    end = F.concat(head(F.lit("turn_completed")), F.lit(',"prompt_id":"p'), F.col("turn").cast("string"), F.lit('"'), F.when(F.col("turn") % 4 != 2, used).otherwise(""), F.lit("}}}"))
    lines = [rows.select(file.alias("file"), (F.col("turn") * 10 + k).alias("place"), line.alias("line")) for k, line in ((0, chunk), (1, other))]
    return lines[0].unionByName(lines[1]).unionByName(rows.filter("role = 'assistant' or turn % 5 = 0").select(file.alias("file"), (F.col("turn") * 10 + 5).alias("place"), end.alias("line")))


def _grok(spark: SparkSession, sf: str) -> DataFrame:
    return records.turn_rows(_updates(spark, sf)).select("dedup_key", "timestamp", "api_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "reasoning_tokens", "ctx_messages", "ctx_reasoning")


GROK_SQL = """WITH c AS (SELECT conv_id, turn, strlen(text) AS n, CASE WHEN role <> 'user' AND turn % 3 = 0 THEN 0 ELSE strlen(text) // 4 END AS m, CASE WHEN role <> 'user' AND turn % 3 = 0 THEN strlen(text) // 4 ELSE 0 END AS r, (role = 'assistant' OR turn % 5 = 0) AS ends FROM conversations),
  g AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM c),
  w AS (SELECT *, sum(m) OVER (PARTITION BY conv_id, t) AS wm, sum(r) OVER (PARTITION BY conv_id, t) AS wr, n + 40 AS billed FROM g)
  SELECT 'grok:s' || conv_id || ':p' || turn AS dedup_key, (1735689600 + conv_id * 60 + turn)::BIGINT AS timestamp, (turn % 2 + 1)::BIGINT AS api_calls, (billed - 10)::BIGINT AS input_tokens, (turn + 5)::BIGINT AS output_tokens, 7::BIGINT AS cache_read_tokens, 3::BIGINT AS cache_write_5m_tokens, 2::BIGINT AS reasoning_tokens,
    CASE WHEN wm + wr > 0 THEN billed - billed * wr // (wm + wr) END::BIGINT AS ctx_messages, CASE WHEN wm + wr > 0 THEN nullif(billed * wr // (wm + wr), 0) END::BIGINT AS ctx_reasoning
  FROM w WHERE ends AND turn % 4 <> 2 AND conv_id NOT IN (SELECT conv_id FROM c WHERE conv_id % 13 = 5 AND ends AND turn % 4 <> 2)"""


# --- a ledger that takes the usage in three batches, a part of it twice, and then corrections and replacements
def _filled(spark: SparkSession, sf: str) -> str:
    table, id_ = _fresh(spark, "ledger"), F.col("dedup_key").cast("long")
    rows = fixtures.hourly_usage(spark, sf)
    told = lambda some, n, gone=None: some.select("*", F.lit(n).cast("long").alias("seq"), F.lit(gone).cast("string").alias("supersedes") if gone is None else F.col(gone).alias("supersedes"))
    for n in range(3):
        ledger.put(told(rows.filter((id_ % 3 == n) | (id_ % 3 == n - 1) & (id_ % 5 == 0)), n), n, table)
    more = rows.filter(id_ % 7 == 0).withColumn("output_tokens", F.col("output_tokens") + 1).withColumn("timestamp", F.col("timestamp") + 86_400)
    gone = rows.filter((id_ % 11 == 0) & (id_ % 7 != 0)).withColumn("old", F.col("dedup_key")).withColumn("dedup_key", F.concat("old", F.lit("#it0")))
    ledger.put(told(more, 3).unionByName(told(gone, 3, "old").drop("old")), 3, table)
    return table


def _ledger_daily(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.daily(spark, _filled(spark, sf)).select("day", "source", "model", "records", "input_tokens", "output_tokens")


def _ledger_signals(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.signals(spark, _filled(spark, sf)).select(F.col("batch").alias("revision"), "source", "inserted", "updated", "removed")


LEDGER_DAILY_SQL = f"""WITH {fixtures.HOURLY_SQL}, x AS (SELECT source, model, input_tokens, CASE WHEN dedup_key::BIGINT % 7 = 0 THEN output_tokens + 1 ELSE output_tokens END AS output_tokens, CASE WHEN dedup_key::BIGINT % 7 = 0 THEN timestamp + 86400 ELSE timestamp END AS timestamp FROM hourly)
  SELECT {DAY_SQL} AS day, source, model, count(*) AS records, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM x GROUP BY ALL"""
LEDGER_SIGNALS_SQL = f"""WITH {fixtures.HOURLY_SQL}, b AS (SELECT source, dedup_key::BIGINT AS n, n % 7 = 0 AS more, n % 11 = 0 AND n % 7 <> 0 AS gone FROM hourly),
  s AS (SELECT n % 3 AS revision, source, count(*) AS inserted, 0 AS updated, 0 AS removed FROM b GROUP BY ALL UNION ALL SELECT 3, source, count_if(gone), count_if(more), count_if(gone) FROM b WHERE more OR gone GROUP BY ALL)
  SELECT revision::BIGINT AS revision, source, inserted::BIGINT AS inserted, updated::BIGINT AS updated, removed::BIGINT AS removed FROM s"""


# --- files of a home folder, one for each document
_SHAPES = ("tasks/{0}/ui_messages.json", "deep/tasks/{0}/claude_messages.json", "tasks/{0}/other.json", "sessions/x/{0}.json", "opencode-{0}.db", "storage/session/g/{0}.json", "storage/message/s{0}/m.json", "{0}.jsonl", "sub/{0}.jsonl", "logs/Qoder-{0}.log")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    below = F.lit(None).cast("string")
    for i, shape in enumerate(_SHAPES):
        before, after = shape.split("{0}")
        below = F.when(F.col("doc_id") % len(_SHAPES) == i, F.concat(F.lit(before), n, F.lit(after))).otherwise(below)
    return fixtures.table(spark, sf, "documents").select(F.lit("/h").alias("root"), F.concat(F.lit("/h/"), below).alias("path"), below.alias("below"), F.col("n_chars").alias("size"))


def _discovered(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for tool in ("cline", "opencode", "goose", "qoder"):
        found = discovery.artifacts_of(_files(spark, sf), tool).groupBy(F.lit(tool).alias("tool"), "kind").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("size"), F.max(discovery.task_id(F.col("path"))).alias("last_task"))
        out = found if out is None else out.unionByName(found)
    return out


DISCOVERED_SQL = """WITH d AS (SELECT doc_id::VARCHAR AS i, doc_id % 10 AS k, n_chars FROM documents), x AS (
    SELECT 'cline' AS tool, CASE WHEN k < 2 THEN 'task' ELSE 'session' END AS kind, CASE WHEN k < 2 THEN i ELSE 'x' END AS task, n_chars FROM d WHERE k IN (0, 1, 3)
    UNION ALL SELECT 'opencode', CASE k WHEN 4 THEN 'database' WHEN 5 THEN 'legacy_session' ELSE 'legacy_message' END, CASE k WHEN 4 THEN 'h' WHEN 5 THEN 'g' ELSE 's' || i END, n_chars FROM d WHERE k IN (4, 5, 6)
    UNION ALL SELECT 'goose', 'legacy', 'h', n_chars FROM d WHERE k = 7
    UNION ALL SELECT 'qoder', CASE WHEN k < 9 THEN 'transcript' ELSE 'log' END, CASE k WHEN 7 THEN 'h' WHEN 8 THEN 'sub' ELSE 'logs' END, n_chars FROM d WHERE k IN (7, 8, 9))
  SELECT tool, kind, count(*) AS files, sum(n_chars)::BIGINT AS size, max(task) AS last_task FROM x GROUP BY ALL"""


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    files = fixtures.table(spark, sf, "orders").select(F.concat(F.lit("/q/"), F.lpad((F.col("o_orderkey") % 89).cast("string"), 2, "0"), F.lit("/task-"), (F.col("o_custkey") % 40).cast("string"), F.lit(".session.execution.jsonl")).alias("path"))
    return discovery.first_paths(files)


TRANSCRIPTS_SQL = "SELECT 'task-' || (o_custkey % 40) || '.session.execution' AS key, min('/q/' || lpad((o_orderkey % 89)::VARCHAR, 2, '0') || '/task-' || (o_custkey % 40) || '.session.execution.jsonl') AS path FROM orders GROUP BY 1"


# --- logs in which applications tell their models' names: one line in five behind the marker, one in seven of those torn
def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    app = F.when(F.col("u") % 2 == 0, "/a/QoderCN").otherwise(F.concat(F.lit("/b"), (F.col("u") % 4).cast("string"), F.lit("/Qoder")))
    file = F.concat(app, F.lit("/logs/w"), (F.col("u") % 9).cast("string"), F.lit("/qoder.log"))
    named = F.concat(F.lit('{"chat":[{"name":"kmodel","displayName":"Kimi-'), F.col("n").cast("string"), F.lit('"},{"name":"","displayName":"No"}],"more":[{"name":"x'), (F.col("u") % 3).cast("string"), F.lit('","displayName":"X-'), F.col("n").cast("string"), F.lit('"}'), F.when(F.col("n") % 7 != 0, "]}").otherwise(""))
    line = F.when(F.col("n") % 5 == 0, F.concat(F.lit("12:00 info Model classes refreshed: "), named)).otherwise(F.concat(F.lit("12:00 info "), named))
    lines = e.select(file.alias("file"), F.col("n").alias("place"), line.alias("line"), (F.col("u") % 9).alias("modified"))
    return discovery.model_aliases(lines)


ALIASES_SQL = f"""WITH {EVENTS_SQL}, l AS (SELECT CASE WHEN u % 2 = 0 THEN '/a/QoderCN' ELSE '/b' || (u % 4) || '/Qoder' END AS app, u % 9 AS w, n, u FROM e WHERE n % 5 = 0 AND n % 7 <> 0),
  f AS (SELECT app, w, max(n) AS n, arg_max(u, n) AS u FROM l GROUP BY ALL), a AS (SELECT app, arg_max(n, w) AS n, arg_max(u, w) AS u FROM f GROUP BY app),
  m AS (SELECT app, app LIKE '%CN' AS chinese, 'kmodel' AS alias, 'kimi-' || n AS model FROM a UNION ALL SELECT app, app LIKE '%CN', 'x' || (u % 3), 'x-' || n FROM a)
  SELECT chinese, alias, arg_max(model, app) AS model FROM m GROUP BY ALL"""


# --- old sessions beside a newer store that was read, and beside one that was skipped
def _guarded(spark: SparkSession, sf: str) -> DataFrame:
    table = _fresh(spark, "sessions")
    orders = fixtures.table(spark, sf, "orders")
    sessions = lambda ok: orders.filter(ok).select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id")).distinct()
    legacy, modern = sessions("o_orderkey % 2 = 0"), sessions("o_custkey % 3 = 0")
    discovery.remember_sessions(spark, table, "goose", modern)
    discovery.remember_sessions(spark, table, "goose", sessions("o_custkey % 6 = 1"))
    discovery.remember_sessions(spark, table, "opencode", sessions("o_custkey % 6 = 2"))
    known = discovery.remembered_sessions(spark, table, "goose")
    cases = {"read": discovery.guarded(legacy, modern, None), "skipped": discovery.guarded(legacy, None, known), "lost": discovery.guarded(legacy, None, None)}
    out = None
    for name, rows in cases.items():
        one = rows.select(F.lit(name).alias("case_name"), "session_id")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("case_name").agg(F.count("*").alias("sessions"), F.min("session_id").alias("first"), F.max("session_id").alias("last"))


GUARDED_SQL = """WITH l AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 2 = 0), x AS (SELECT 'read' AS case_name, 's' || c AS s FROM l WHERE c % 3 <> 0 UNION ALL SELECT 'skipped', 's' || c FROM l WHERE c % 3 <> 0 AND c % 6 <> 1)
  SELECT case_name, count(*) AS sessions, min(s) AS first, max(s) AS last FROM x GROUP BY 1"""


# --- conversations and limits that are exported as files and read back
def _packed(n: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
    def varint(v: int) -> bytes:
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    number = lambda field, v: varint(field << 3) + varint(v)
    text = lambda field, v: varint(field << 3 | 2) + varint(len(v)) + v

    def one(n: int, k: int, t: int) -> bytes:
        used = number(2, k) + number(3, 2 * k) + number(4, k % 3) + number(5, k % 7) + number(9, k % 2) + (text(11, f"r{n}".encode()) if n % 4 else b"")
        chat = text(4, used) + number(3, 5) + text(9, text(4, number(1, t))) + (text(19, b"gemini-default") if n % 2 else text(19, f"own-{n % 5}".encode()))
        return text(1, chat) + (text(3, varint(28 << 3 | 2) + varint(6) + b"picker") if n % 3 == 0 else b"")

    return pd.Series([one(int(a), int(b), int(c)) for a, b, c in zip(n, k, t, strict=True)])


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    blobs = e.select(F.concat(F.lit("c"), (F.col("u") % 50).cast("string")).alias("session"), F.col("n").alias("idx"), pandas_udf(_packed, "binary")("n", "k", "t").alias("data"), F.lit("/w").alias("project"))
    folder = _fresh(spark, "exports")
    documents.write_documents(artifacts.conversation_exports(blobs), folder)
    return artifacts.exported_rows(documents.read_documents(spark, folder)).select(*_BOOKED)


EXPORTED_SQL = f"""WITH {EVENTS_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY u % 50 ORDER BY n) - 1 AS place FROM e WHERE k > 0)
  SELECT 'antigravity:c' || (u % 50) || ':' || CASE WHEN n % 4 <> 0 THEN 'r' || n ELSE place::VARCHAR END AS dedup_key, t AS timestamp, CASE WHEN n % 2 = 0 THEN 'own-' || (n % 5) WHEN t < 1742860800 THEN 'gemini-2.0-flash' WHEN t < 1779148800 THEN 'gemini-2.5-flash' ELSE 'gemini-3.5-flash' END AS model, '/w' AS project,
    1::BIGINT AS api_calls, k AS input_tokens, 2 * k AS output_tokens, k % 7 AS cache_read_tokens, k % 3 AS cache_write_5m_tokens, 'c' || (u % 50) AS session_id, k % 2 AS reasoning_tokens FROM g"""


def _limits_exported(spark: SparkSession, sf: str) -> DataFrame:
    folder = _fresh(spark, "limits")
    documents.write_documents(artifacts.limit_documents(fixtures.readings(spark, sf)), folder, replace=True)
    return records.limit_exports(spark, folder).select("source", "window_key", "window_minutes", "used_pct", "resets_at", "observed_at", "via", "plan", "account_id", "metering_regime", "limit_id", "model_scope")


def _limits_exported_sql() -> str:
    return f"""WITH {fixtures.READINGS_SQL}, n AS (SELECT source AS s, max(observed_at) AS seen FROM readings GROUP BY 1), a AS (SELECT n.s, max(account_id) AS account FROM readings JOIN n ON source = n.s AND observed_at = n.seen GROUP BY 1)
      SELECT source, window_key, window_minutes, used_pct, resets_at, observed_at, 'export' AS via, 'plan' AS plan, account AS account_id, 'regime' AS metering_regime, source || ':limit' AS limit_id, 'all' AS model_scope FROM readings JOIN n ON source = n.s AND observed_at = n.seen JOIN a ON source = a.s"""


# --- prices as each month found them, of every brand
def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """A price of a brand in a month in which its parts were shipped; one month in three has none."""
    rows = fixtures.usage(spark, sf).filter("model is not null").select("model", F.concat(F.substring(usage.bucket(F.col("timestamp")), 1, 7), F.lit("-01")).alias("day"), "input_tokens")
    month = F.substring("day", 6, 2).cast("int")
    each = rows.groupBy("model", "day").agg(F.count("*").alias("n")).withColumn("priced", (month + F.expr("cast(substring(model, 7) as int)")) % 3 != 0)
    return each.select("model", "day", "priced", *[F.when(F.col("priced"), F.col("n") * k).otherwise(0).alias(r) for k, r in zip((10, 50, 1, 12, 20), usage.RATES, strict=True)])


def _frozen(spark: SparkSession, sf: str) -> DataFrame:
    return prices.frozen(_observed(spark, sf)).select("model", "day", "priced", "input", "output")


_OBSERVED_SQL = f"""o AS (SELECT model, day, n, (month + brand) % 3 <> 0 AS priced FROM (SELECT model, substr({DAY_SQL}, 1, 7) || '-01' AS day, count(*) AS n, substr({DAY_SQL}, 6, 2)::INT AS month, substr(model, 7)::INT AS brand FROM usage WHERE model IS NOT NULL GROUP BY ALL))"""
FROZEN_SQL = f"""WITH {USAGE_SQL}, {_OBSERVED_SQL}, f AS (SELECT o.model, o.day, (SELECT arg_min(p.n, p.day) FROM o p WHERE p.model = o.model AND p.day >= o.day AND p.priced) AS n FROM o)
  SELECT model, day, n IS NOT NULL AS priced, coalesce(n * 10, 0)::BIGINT AS input, coalesce(n * 50, 0)::BIGINT AS output FROM f"""


def _priced_days(spark: SparkSession, sf: str) -> DataFrame:
    days = fixtures.usage(spark, sf).filter("model is not null").select("model", usage.bucket(F.col("timestamp")).alias("day")).distinct()
    return usage.price_at_day(days, prices.frozen(_observed(spark, sf))).select("model", "day", "input", "output")


PRICED_DAYS_SQL = f"""WITH {USAGE_SQL}, {_OBSERVED_SQL}, d AS (SELECT DISTINCT model, {DAY_SQL} AS day FROM usage WHERE model IS NOT NULL),
  f AS (SELECT d.model, d.day, (SELECT arg_min(p.n, p.day) FROM o p WHERE p.model = d.model AND p.day >= substr(d.day, 1, 7) || '-01' AND p.priced) AS n FROM d)
  SELECT model, day, (n * 10)::BIGINT AS input, (n * 50)::BIGINT AS output FROM f"""


def _alias_price(spark: SparkSession, sf: str) -> DataFrame:
    """Brand 5 stands for automatic reviews, which have no price of their own; brand 7's is that of their stand-in."""
    rates = fixtures.rates(spark).withColumn("model", F.when(F.col("model") == "Brand#7", usage.AUTO_REVIEW_AS).otherwise(F.col("model")))
    model = F.when(F.col("model") == "Brand#5", usage.AUTO_REVIEW).otherwise(F.col("model"))
    used = fixtures.usage(spark, sf).withColumn("model", model)
    found = usage.resolve_rates(used.select("model"), rates, fixtures.overrides(spark))
    return used.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens")).join(found, "model", "left").select("model", "input_tokens", "input", "output", "origin")


ALIAS_PRICE_SQL = f"""WITH {USAGE_SQL}, {fixtures.RATES_SQL}, m AS (SELECT CASE WHEN model = 'Brand#5' THEN 'codex-auto-review' ELSE model END AS model, CASE WHEN model = 'Brand#5' THEN 'Brand#7' WHEN model <> 'Brand#7' THEN model END AS priced_as, sum(input_tokens)::BIGINT AS input_tokens FROM usage GROUP BY ALL)
  SELECT m.model, m.input_tokens, input::BIGINT AS input, output::BIGINT AS output, origin FROM m LEFT JOIN rates ON rates.model = priced_as"""

# --- rates of a catalog whose fields are numbers, strings, missing or null
def _catalog_rates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 5 == 0, F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))).when(k % 5 == 1, "null").when(k % 5 == 2, F.col("p_size").cast("string")).when(k % 5 == 3, F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    entry = F.parse_json(F.when(value.isNull(), '{"other":1}').otherwise(F.concat(F.lit('{"rate":'), value, F.lit("}"))))
    return fixtures.table(spark, sf, "part").select("p_partkey", prices.number_field(entry, "rate").alias("rate"))


CATALOG_RATES_SQL = "SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN p_size::DOUBLE WHEN 3 THEN p_size + 0.5::DOUBLE END AS rate FROM part"


# --- sessions that a tool knows of but has no transcript of any more
def _pruned(spark: SparkSession, sf: str) -> DataFrame:
    known = fixtures.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("session_id"), F.concat(F.lit("/w/"), F.col("o_custkey").cast("string")).alias("cwd"), F.col("o_orderpriority").alias("title"), F.lit(1).alias("created_at"), F.lit(2).alias("updated_at"), F.when(F.col("o_orderkey") % 7 == 0, 5).alias("deleted_at")
    )
    transcripts = fixtures.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("session_id"))
    return records.pruned_sessions(known, transcripts).groupBy("title").agg(F.count("*").alias("sessions"), F.max("cwd").alias("last"))


PRUNED_SQL = "SELECT o_orderpriority AS title, count(*) AS sessions, max('/w/' || o_custkey) AS last FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1"


# --- message records of sessions whose older rows were sums of whole sessions
def _superseded(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    sums = e.groupBy("session").agg(F.sum("k").alias("input_tokens")).select(F.concat(F.lit("opencode:session:"), "session", F.lit(":sum")).alias("dedup_key"), F.col("session").alias("session_id"), "input_tokens", F.lit(0).cast("long").alias("seq"))
    new = e.filter("u % 3 = 0").select(F.concat(F.lit("opencode:session:"), "session", F.lit(":message:"), "id").alias("dedup_key"), F.col("session").alias("session_id"), F.col("k").alias("input_tokens"), F.lit(1).cast("long").alias("seq"))
    return merge.supersede(sums, new, prefixes=artifacts.superseded_prefixes(new)).select("dedup_key", "session_id", "input_tokens")


SUPERSEDED_SQL = f"""WITH {EVENTS_SQL} SELECT 'opencode:session:' || u || ':sum' AS dedup_key, u::VARCHAR AS session_id, sum(k)::BIGINT AS input_tokens FROM e WHERE u % 3 <> 0 GROUP BY u
  UNION ALL SELECT 'opencode:session:' || u || ':message:' || n, u::VARCHAR, k FROM e WHERE u % 3 = 0"""


# --- when time alone changes the next answer
def _next_due(spark: SparkSession, sf: str) -> DataFrame:
    return limits.next_due(ledger_queries._estimate(spark, sf), ledger_queries.EVALUATED)


NEXT_DUE_SQL = f"SELECT min(next_evaluation_at) FILTER (next_evaluation_at > {ledger_queries.EVALUATED}) AS due FROM ({ledger_queries.ESTIMATE_SQL})"

QUERIES = {
    "ctx_fold_grok": (_grok, GROK_SQL),
    "ledger_daily": (_ledger_daily, LEDGER_DAILY_SQL),
    "ledger_signals": (_ledger_signals, LEDGER_SIGNALS_SQL),
    "discover_artifacts": (_discovered, DISCOVERED_SQL),
    "transcript_index": (_transcripts, TRANSCRIPTS_SQL),
    "model_aliases": (_aliases, ALIASES_SQL),
    "overlap_guard": (_guarded, GUARDED_SQL),
    "export_conversations": (_exported, EXPORTED_SQL),
    "export_limits": (_limits_exported, _limits_exported_sql()),
    "price_frozen": (_frozen, FROZEN_SQL),
    "price_frozen_days": (_priced_days, PRICED_DAYS_SQL),
    "price_alias": (_alias_price, ALIAS_PRICE_SQL),
    "price_fields": (_catalog_rates, CATALOG_RATES_SQL),
    "pruned_sessions": (_pruned, PRUNED_SQL),
    "superseded_sums": (_superseded, SUPERSEDED_SQL),
    "limit_next_due": (_next_due, NEXT_DUE_SQL),
}
