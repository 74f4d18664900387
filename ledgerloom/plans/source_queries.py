"""Queries of the log parsers and context folds: the tables are written as logs line by line, parsed, and compared with what
the SQL says of the tables themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import formats
from ledgerloom.operators import folds, limits
from ledgerloom.plans import fixtures, ledger_queries
from ledgerloom.sources import artifacts, scan, vendors

_BOOKED = ["dedup_key", "timestamp", "model", "project", "api_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "session_id", "reasoning_tokens"]


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _text(value: str) -> Column:
    return F.lit(value)


# --- transcripts: one file a conversation, one line a turn, and a compaction behind every seventh (conversation + turn)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "conversations").filter("role <> 'system'")
    return rows.select(F.concat(F.lit("/t/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), "conv_id", "turn", "role", "text", F.col("conv_id").cast("string").alias("sid"))


def _tool() -> Column:
    return F.when(F.col("conv_id") % 3 == 0, "mcp__s__t").when(F.col("conv_id") % 3 == 1, "Skill").otherwise("Read")


def _transcript(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    ident = lambda n: F.concat(F.lit("t"), n.cast("string"))
    plain = _json(type=_text("user"), sessionId=F.col("sid"), message=F.struct(F.col("text").alias("content")))
    said, result = _json(type=_text("text"), text=F.col("text")), _json(type=_text("tool_result"), tool_use_id=ident(F.col("turn") - 1), content=F.col("text"))
    thought, call = _json(type=_text("thinking"), thinking=F.col("text")), F.concat(F.lit('{"type":"tool_use","id":"'), ident(F.col("turn")), F.lit('","name":"'), _tool(), F.lit('","input":{"skill":"k'), F.col("turn").cast("string"), F.lit('"}}'))
    listed = lambda kind, *parts: F.concat(F.lit(f'{{"type":"{kind}","sessionId":"'), F.col("sid"), F.lit('","message":{"content":['), F.concat_ws(",", *parts), F.lit("]}}"))
    line = F.when(F.col("role") == "assistant", listed("assistant", thought, said, call)).when(F.col("turn") % 2 == 0, plain).otherwise(listed("user", said, result))
    lines = turns.select("file", (F.col("turn") * 10).alias("place"), line.alias("line"))
    cuts = turns.filter("(conv_id + turn) % 7 = 0").select("file", (F.col("turn") * 10 + 5).alias("place"), F.concat(F.lit('{"type":"system","subtype":"compact_boundary","sessionId":"'), F.col("sid"), F.lit('"}')).alias("line"))
    return lines.unionByName(cuts)


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).filter("role = 'assistant'")
    return rows.select("file", F.col("sid").alias("session"), (F.col("turn") * 10).alias("place"), F.concat("sid", F.lit(":"), F.col("turn").cast("string")).alias("dedup_key"), (F.lit(5000) + F.col("conv_id") * 37 + F.col("turn") * 100).cast("long").alias("billed"), F.lit(0).alias("i"), (F.col("conv_id") % 11 == 0).alias("sidechain"))


def _claude_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = folds.call_contexts(_transcript(spark, sf), _calls(spark, sf))
    return out.select("dedup_key", "billed", "ctx_messages", "ctx_system", "ctx_reasoning", "ctx_toolcalls", "ctx_agents", "ctx_mcp", "ctx_skills")


_TRANSCRIPT_SQL = """c AS (SELECT conv_id, turn, role, octet_length(encode(text)) // 4 AS e, length('{"skill":"k' || turn || '"}') // 4 AS u, conv_id % 3 AS k FROM conversations WHERE role <> 'system'),
  l AS (SELECT a.conv_id, a.turn, a.role, a.k, a.e, a.u, b.role = 'assistant' AS answered, a.role = 'user' AND a.turn % 2 = 1 AS lists FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
  s AS (SELECT *, CASE WHEN role = 'assistant' THEN e + u WHEN lists THEN 2 * e ELSE e END AS msg, CASE WHEN role = 'assistant' THEN u WHEN lists THEN e ELSE 0 END AS tool, CASE WHEN role = 'assistant' THEN e ELSE 0 END AS reas, (role = 'user')::INT AS turns,
    CASE WHEN role = 'assistant' AND k = 0 THEN u WHEN lists AND coalesce(answered, FALSE) AND k = 0 THEN e ELSE 0 END AS mcp, CASE WHEN role = 'assistant' AND k = 1 THEN u WHEN lists AND coalesce(answered, FALSE) AND k = 1 THEN e ELSE 0 END AS skill FROM l),
  m AS (SELECT *, sum(turns) OVER (PARTITION BY conv_id ORDER BY turn) AS t, coalesce(sum(((conv_id + turn) % 7 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM s),
  b AS (SELECT *, coalesce(sum(msg) OVER w, 0) AS bm, coalesce(sum(tool) OVER w, 0) AS bt, coalesce(sum(mcp) OVER w, 0) AS bc, coalesce(sum(skill) OVER w, 0) AS bs, coalesce(sum(reas) OVER (PARTITION BY conv_id, ep, t ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS br, 5000 + conv_id * 37 + turn * 100 AS billed
    FROM m WINDOW w AS (PARTITION BY conv_id, ep ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  y AS (SELECT *, first_value(greatest(0, billed - bm - br)) OVER (PARTITION BY conv_id ORDER BY turn) AS sys FROM b WHERE role = 'assistant'),
  z AS (SELECT *, bm + br + sys AS total, billed * sys // nullif(bm + br + sys, 0) AS xs, billed * br // nullif(bm + br + sys, 0) AS xr FROM y)"""
CLAUDE_SQL = f"""WITH {_TRANSCRIPT_SQL} SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS dedup_key, billed::BIGINT AS billed, (billed - xs - xr)::BIGINT AS ctx_messages, xs::BIGINT AS ctx_system, nullif(xr, 0)::BIGINT AS ctx_reasoning, least(billed * bt // total, billed - xs - xr)::BIGINT AS ctx_toolcalls,
  CASE WHEN conv_id % 11 = 0 THEN billed END::BIGINT AS ctx_agents, least(billed * bc // total, billed - xs - xr)::BIGINT AS ctx_mcp, least(billed * bs // total, billed - xs - xr)::BIGINT AS ctx_skills FROM z"""


def _claude_tools(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.tool_rows(_transcript(spark, sf))
    return rows.groupBy("name").agg(F.sum("est_tokens").alias("est_tokens"), F.sum("calls").alias("calls"))


CLAUDE_TOOLS_SQL = f"""WITH {_TRANSCRIPT_SQL}, n AS (SELECT CASE k WHEN 0 THEN 'mcp__s__t' WHEN 1 THEN 'Skill' ELSE 'Read' END AS name, u AS w, 1 AS calls FROM s WHERE role = 'assistant'
    UNION ALL SELECT CASE WHEN NOT coalesce(answered, FALSE) THEN 'unknown' WHEN k = 0 THEN 'mcp__s__t' WHEN k = 1 THEN 'Skill' ELSE 'Read' END, e, 0 FROM s WHERE lists) SELECT name, sum(w)::BIGINT AS est_tokens, sum(calls)::BIGINT AS calls FROM n GROUP BY name"""


def _resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The same fold in two reads of each file: what the first read ended with goes into the second."""
    lines, calls = _transcript(spark, sf), _calls(spark, sf)
    early, late = lines.filter("place < 40"), lines.filter("place >= 40")
    state = folds.final_state(early, calls.filter("place < 40"))
    out = folds.call_contexts(early, calls.filter("place < 40")).unionByName(folds.call_contexts(late, calls.filter("place >= 40"), prior=state, resumed=True))
    return out.select("dedup_key", "ctx_messages", "ctx_toolcalls")


RESUMED_SQL = f"WITH x AS ({CLAUDE_SQL}) SELECT dedup_key, ctx_messages, ctx_toolcalls FROM x"


def _codex_fold(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    n = F.col("turn") % 4
    payload = F.when((F.col("role") == "user") | (n == 1), F.concat(F.lit('{"type":"message","role":"'), F.col("role"), F.lit('","k":'), F.col("conv_id").cast("string"), F.lit("}"))).when(n == 3, F.concat(F.lit('{"type":"function_call","call_id":"'), F.col("sid"), F.lit('","name":"x"}'))).otherwise(F.concat(F.lit('{"type":"reasoning","k":'), F.repeat(F.lit("1"), F.col("turn").cast("int") + 5), F.lit("}")))
    lines = turns.select("file", (F.col("turn") * 10).alias("place"), F.concat(F.lit('{"type":"response_item","payload":'), payload, F.lit("}")).alias("line"))
    records = turns.select("file", (F.col("turn") * 10 + 5).alias("place"), (F.lit(900) + F.col("conv_id")).cast("long").alias("billed"))
    return folds.rollout_contexts(lines, records).select("file", "place", "ctx_messages", "ctx_system", "ctx_reasoning", "ctx_toolcalls")


CODEX_SQL = """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' OR turn % 4 = 1 THEN length('{"type":"message","role":"' || role || '","k":' || conv_id || '}') WHEN turn % 4 = 3 THEN length('{"type":"function_call","call_id":"' || conv_id || '","name":"x"}') ELSE length('{"type":"reasoning","k":}') + turn + 5 END // 4 AS e,
    CASE WHEN role = 'user' OR turn % 4 = 1 THEN 'm' WHEN turn % 4 = 3 THEN 't' ELSE 'r' END AS kind FROM conversations WHERE role <> 'system'),
  t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c), b AS (SELECT *, sum(CASE WHEN kind <> 'r' THEN e ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS bm, sum(CASE WHEN kind = 't' THEN e ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS bt, sum(CASE WHEN kind = 'r' THEN e ELSE 0 END) OVER (PARTITION BY conv_id, n ORDER BY turn) AS br, 900 + conv_id AS billed FROM t)
  SELECT '/t/' || conv_id || '.jsonl' AS file, (turn * 10 + 5)::BIGINT AS place, CASE WHEN bm + br > 0 THEN billed - billed * br // (bm + br) END::BIGINT AS ctx_messages, NULL::BIGINT AS ctx_system, CASE WHEN bm + br > 0 THEN nullif(billed * br // (bm + br), 0) END::BIGINT AS ctx_reasoning, CASE WHEN bm + br > 0 THEN least(billed * bt // (bm + br), billed - billed * br // (bm + br)) END::BIGINT AS ctx_toolcalls FROM b"""


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Entry trees: each third turn hangs on the turn before its own predecessor; assistants name a model in one of four turns."""
    turns = _turns(spark, sf)
    ident = lambda n: F.concat(F.lit("e"), n.cast("string"))
    parent = F.when(F.col("turn") > 1, F.concat(F.lit('"'), ident(F.col("turn") - F.when(F.col("turn") % 3 == 2, 2).otherwise(1)), F.lit('"'))).otherwise("null")
    used = F.concat(F.lit('{"input":'), (F.col("conv_id") + 100).cast("string"), F.lit(',"output":'), (F.col("turn") + 9).cast("string"), F.lit(',"cacheRead":7,"cacheWrite":5,"cacheWrite1h":2,"reasoning":99}'))
    model = F.when(F.col("turn") % 4 == 1, F.concat(F.lit('"model":"m'), F.col("turn").cast("string"), F.lit('",'))).otherwise("")
    body = F.when(F.col("role") == "user", F.concat(F.lit('{"role":"user","content":'), F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))), F.lit("}"))).otherwise(
        F.concat(F.lit('{"role":"assistant",'), model, F.lit('"content":['), _json(type=_text("thinking"), thinking=F.col("text")), F.lit(","), _json(type=_text("text"), text=F.col("text")), F.lit('],"usage":'), used, F.lit("}"))
    )
    line = F.concat(F.lit('{"type":"message","id":"'), ident(F.col("turn")), F.lit('","parentId":'), parent, F.lit(',"timestamp":"2025-01-0'), (F.col("turn") % 9 + 1).cast("string"), F.lit('T00:00:00Z","message":'), body, F.lit("}"))
    heads = turns.groupBy("file", "sid").agg(F.lit(-1).cast("long").alias("place")).select("file", "place", F.concat(F.lit('{"type":"session","id":"'), "sid", F.lit('","cwd":"/w"}')).alias("line"))
    out = artifacts.tree_rows(turns.select("file", "turn", line.alias("line")).withColumnRenamed("turn", "place").unionByName(heads))
    return out.select("source_file", "dedup_key", "session_id", "model", "project", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "reasoning_tokens", "ctx_messages", "ctx_reasoning")


TREE_SQL = """WITH RECURSIVE c AS (SELECT conv_id, turn, role, octet_length(encode(text)) // 4 AS e, turn - CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END AS up, turn > 1 AS hangs FROM conversations WHERE role <> 'system'),
  f AS (SELECT conv_id, turn, role, 0::BIGINT AS bm, 0::BIGINT AS br, CASE WHEN role = 'user' THEN e ELSE e END::BIGINT AS am, CASE WHEN role = 'user' THEN 0 ELSE e END::BIGINT AS ar, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'm' || turn END AS model FROM c a WHERE NOT hangs OR NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = a.conv_id AND p.turn = a.up)
    UNION ALL SELECT c.conv_id, c.turn, c.role, f.am, f.ar, f.am + c.e, CASE WHEN c.role = 'user' THEN 0 ELSE f.ar + c.e END, CASE WHEN c.role = 'assistant' AND c.turn % 4 = 1 THEN 'm' || c.turn ELSE f.model END FROM c JOIN f ON f.conv_id = c.conv_id AND c.hangs AND c.up = f.turn)
  SELECT '/t/' || conv_id || '.jsonl' AS source_file, 'pi:assistant:e' || turn || ':2025-01-0' || (turn % 9 + 1) || 'T00:00:00Z' AS dedup_key, conv_id::VARCHAR AS session_id, model, '/w' AS project, (conv_id + 100)::BIGINT AS input_tokens, (turn + 9)::BIGINT AS output_tokens, 7::BIGINT AS cache_read_tokens, 3::BIGINT AS cache_write_5m_tokens, 2::BIGINT AS cache_write_1h_tokens,
    least(99, turn + 9)::BIGINT AS reasoning_tokens, CASE WHEN bm + br > 0 THEN conv_id + 112 - (conv_id + 112) * br // (bm + br) END::BIGINT AS ctx_messages, CASE WHEN bm + br > 0 THEN nullif((conv_id + 112) * br // (bm + br), 0) END::BIGINT AS ctx_reasoning FROM f WHERE role = 'assistant'"""


# --- the events table as other logs


def _events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return fixtures.table(spark, sf, "events").select(F.col("event_id").alias("n"), F.col("user_id").alias("u"), F.col("event_type").alias("kind"), k.alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session"))


EVENTS_SQL = "e AS (SELECT event_id AS n, user_id AS u, event_type AS kind, json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) // 1000000 AS t FROM events)"
_ROUTED_NAMES = ("antigravity-gemini-3-pro-high", "antigravity-claude-sonnet-4-5-thinking-low", "antigravity-new-one", "gpt", "")


def _opencode(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    name = F.get(F.array(*[F.lit(x) for x in _ROUTED_NAMES]), (F.col("n") % 5).cast("int"))
    bad = F.when(F.col("n") % 13 == 0, "-1").when(F.col("n") % 17 == 0, "7.0").otherwise((F.col("k") % 5).cast("string"))
    data = F.concat(F.lit('{"role":"'), F.when(F.col("n") % 7 == 0, "user").otherwise("assistant"), F.lit('","modelID":"'), name, F.lit('","tokens":{"input":'), F.col("k").cast("string"), F.lit(',"output":'), (F.col("k") % 9).cast("string"), F.lit(',"reasoning":6,"cache":{"read":'), (F.col("k") % 4).cast("string"), F.lit(',"write":'), bad, F.lit("}}}"))
    messages = e.select(F.lit("/o.db").alias("file"), "id", "session", (F.when(F.col("n") % 19 != 0, F.col("t") * 1000)).alias("time_created"), data.alias("data")).withColumnRenamed("session", "session_id")
    sessions = e.groupBy(F.col("session").alias("id")).agg(F.concat(F.lit("/home/"), F.first("session")).alias("directory"), (F.min("t") * 1000).alias("time_created"), (F.max("t") * 1000).alias("time_updated"))
    return artifacts.message_rows(messages, sessions).select(*_BOOKED)


OPENCODE_SQL = f"""WITH {EVENTS_SQL}, s AS (SELECT u, max(t) AS last FROM e GROUP BY u), m AS (SELECT e.*, last, k AS i, k % 9 AS o, k % 4 AS r, CASE WHEN n % 17 = 0 THEN 7 ELSE k % 5 END AS w FROM e JOIN s USING (u) WHERE n % 7 <> 0 AND n % 13 <> 0)
  SELECT 'opencode:session:' || u || ':message:' || n AS dedup_key, CASE WHEN n % 19 <> 0 THEN t ELSE last END AS timestamp, ['gemini-3-pro-preview', 'claude-sonnet-4-5', 'antigravity-new-one', 'gpt', NULL][n % 5 + 1] AS model, '/home/' || u AS project, 1::BIGINT AS api_calls, i AS input_tokens, o AS output_tokens, r AS cache_read_tokens, w AS cache_write_5m_tokens, u::VARCHAR AS session_id, least(6, o) AS reasoning_tokens FROM m WHERE i + o + r + w > 0"""


def _qoder(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    info = F.when(F.col("u") % 3 != 0, F.concat(F.lit('{"model_key":"'), F.when(F.col("u") % 3 == 1, "kmodel").otherwise(F.concat(F.lit("x"), (F.col("n") % 2).cast("string"))), F.lit('"}')))
    token = F.when(F.col("n") % 11 != 0, F.concat(F.lit('{"prompt_tokens":'), (F.col("k") + 50).cast("string"), F.lit(',"completion_tokens":'), F.col("k").cast("string"), F.lit(',"cached_tokens":'), (F.col("k") % 60).cast("string"), F.lit("}")))
    messages = e.select(F.when(F.col("n") % 2 == 0, "/QoderCN/a.db").otherwise("/Qoder/a.db").alias("file"), F.lpad("id", 9, "0").alias("id"), F.col("session").alias("session_id"), token.alias("token_info"), info.alias("model_info"), (F.col("t") * 1000).alias("gmt_create"))
    sessions = e.filter("u % 3 = 0").select(F.col("session").alias("session_id"), (F.col("u") + 2).cast("string").alias("parent_session_id")).distinct()
    return artifacts.chat_rows(messages, sessions).select(*_BOOKED)


QODER_SQL = f"""WITH {EVENTS_SQL}, f AS (SELECT u, arg_min('x' || (n % 2), n) AS first FROM e WHERE u % 3 = 2 GROUP BY u), m AS (SELECT e.*, CASE e.u % 3 WHEN 1 THEN CASE WHEN n % 2 = 0 THEN 'kimi-k2.6' ELSE 'kimi-k2.7-code' END WHEN 2 THEN 'x' || (n % 2) ELSE f.first END AS model FROM e LEFT JOIN f ON f.u = e.u + 2 WHERE n % 11 <> 0)
  SELECT 'qoder:' || lpad(n::VARCHAR, 9, '0') AS dedup_key, t AS timestamp, model, NULL::VARCHAR AS project, 1::BIGINT AS api_calls, greatest(0, k + 50 - k % 60) AS input_tokens, k AS output_tokens, k % 60 AS cache_read_tokens, 0::BIGINT AS cache_write_5m_tokens, u::VARCHAR AS session_id, NULL::BIGINT AS reasoning_tokens FROM m"""


def _iso(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _unbooked(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    line = F.concat(F.lit('{"type":"assistant","timestamp":"'), _iso(F.col("t")), F.lit('","message":{"id":"'), F.col("id"), F.lit('","usage":{"input_tokens":'), F.when(F.col("n") % 3 == 0, "0").otherwise("5"), F.lit("}}}"))
    lines = e.select(F.concat(F.lit("/q/"), "session").alias("file"), line.alias("line"))
    booked = e.filter("n % 5 = 0").select(F.concat(F.lit("qoder:"), "id").alias("dedup_key"))
    return artifacts.unbooked_calls(lines, booked)


UNBOOKED_SQL = f"WITH {EVENTS_SQL} SELECT '/q/' || u AS path, 'qoder' AS source, count(*)::BIGINT AS requests, min(t) AS first_at, max(t) AS last_at FROM e WHERE n % 3 = 0 AND n % 5 <> 0 GROUP BY u"


def _cline(spark: SparkSession, sf: str) -> DataFrame:
    """One task a user; every request is in the editor's file, started and finished, and each third in the older file too."""
    e = _events(spark, sf)
    said = lambda say, plus: F.concat(F.lit(f'{{"say":"{say}","ts":'), (F.col("t") * 1000).cast("string"), F.lit(',"requestId":"'), "id", F.lit('","text":'), F.to_json(F.array(F.concat(F.lit('{"tokensIn":'), (F.col("k") + plus).cast("string"), F.lit(',"tokensOut":3,"cacheReads":"2"}')))).substr(2, 200), F.lit("}"))
    clean = lambda c: F.regexp_replace(c, r"\]\}$", "}")
    rows = e.select("n", "session", clean(said("api_req_started", 1)).alias("a"), clean(said("api_req_finished", 2)).alias("b"))
    listed = lambda cols, some: some.groupBy("session").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", *cols))), ","), F.lit("]")).alias("text"))
    new = listed(["a", "b"], rows).select(F.concat(F.lit("/c/tasks/"), "session", F.lit("/ui_messages.json")).alias("file"), "text", F.concat(F.lit("<model>big</model> <cwd>/w/"), "session", F.lit("</cwd>")).alias("history"))
    old = listed(["b"], rows.filter("n % 3 = 0")).select(F.concat(F.lit("/c/tasks/"), "session", F.lit("/claude_messages.json")).alias("file"), "text", F.lit("<model>x</model><model>y</model>").alias("history"))
    return artifacts.task_rows(new.unionByName(old)).select(*_BOOKED)


CLINE_SQL = f"""WITH {EVENTS_SQL} SELECT 'cline:session:' || u || ':request:' || n AS dedup_key, t AS timestamp, 'big' AS model, '/w/' || u AS project, 1::BIGINT AS api_calls, k + 1 AS input_tokens, 3::BIGINT AS output_tokens, 2::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_write_5m_tokens, u::VARCHAR AS session_id, NULL::BIGINT AS reasoning_tokens FROM e"""


def _packed(texts: pd.Series) -> pd.Series:
    import zstandard

    return texts.map(lambda x: zstandard.ZstdCompressor().compress(x.encode()))


def _zed(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    body = F.concat(F.lit('{"version":"1","model":{"provider":"'), F.when(F.col("n") % 4 == 0, "other").otherwise("zed.dev"), F.lit('","model":"m'), (F.col("n") % 3).cast("string"), F.lit('"},"request_token_usage":{"a":{},"b":{}},"cumulative_token_usage":{"input_tokens":'), F.col("k").cast("string"), F.lit(',"output_tokens":1,"cache_read_input_tokens":'), (F.col("k") % 3).cast("string"), F.lit("}}"))
    rows = e.select(F.concat(F.lit("/z"), (F.col("n") % 2).cast("string")).alias("file"), F.col("session").alias("id"), _iso(F.col("t")).alias("updated_at"), F.lit("ZSTD").alias("data_type"), F.pandas_udf(_packed, "binary")(body).alias("data"), F.concat(F.lit("rel\n /p/"), "session").alias("folder_paths"))
    return artifacts.thread_rows(rows).select("dedup_key", "timestamp", "project", "api_calls", (F.col("input_tokens") + F.col("cache_read_tokens")).alias("tokens"))


ZED_SQL = f"""WITH {EVENTS_SQL} SELECT DISTINCT 'zed:thread:' || u AS dedup_key, t AS timestamp, '/p/' || u AS project, 2::BIGINT AS api_calls, (k + k % 3)::BIGINT AS tokens FROM e WHERE n % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY u ORDER BY t DESC, k + k % 3 DESC) = 1"""


def _antigravity(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    alias = F.when(F.col("n") % 4 == 0, "gemini-default").when(F.col("n") % 4 == 1, "Claude-Opus-4-5-Thinking").when(F.col("n") % 4 == 2, "").otherwise("odd")
    one = F.struct(F.when(F.col("n") % 5 != 0, F.concat(F.lit("r"), "id")).alias("response_id"), (F.col("t") + F.when(F.col("n") % 8 == 0, 60_000_000).otherwise(0)).alias("ts"), F.when(F.col("n") % 4 == 2, 1036).cast("long").alias("model_enum"), alias.alias("model_alias"), F.col("k").alias("input"), F.lit(2).cast("long").alias("output"), F.lit(0).cast("long").alias("cache_read"), F.lit(0).cast("long").alias("cache_write"), F.lit(1).cast("long").alias("thinking"))
    files = e.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("n", one.alias("g")))).alias("gs"))
    text = F.to_json(F.struct(F.lit(1).alias("schema"), F.col("session").alias("conversation_id"), F.lit("/x").alias("project"), F.transform("gs", lambda x: x["g"]).alias("generations")))
    return artifacts.exported_rows(files.select(F.concat(F.lit("/a/"), "session").alias("file"), text.alias("text"))).select("dedup_key", "timestamp", "model", "project", "input_tokens", "output_tokens", "reasoning_tokens")


ANTIGRAVITY_SQL = f"""WITH {EVENTS_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n) - 1 AS i, t + CASE WHEN n % 8 = 0 THEN 60000000 ELSE 0 END AS stamp FROM e)
  SELECT 'antigravity:' || u || ':' || CASE WHEN n % 5 <> 0 THEN 'r' || n ELSE i::VARCHAR END AS dedup_key, stamp AS timestamp, CASE n % 4 WHEN 0 THEN CASE WHEN stamp < 1742860800 THEN 'gemini-2.0-flash' WHEN stamp < 1779148800 THEN 'gemini-2.5-flash' ELSE 'gemini-3.5-flash' END WHEN 1 THEN 'claude-opus-4-5' WHEN 2 THEN 'gemini-3.1-pro-preview' ELSE 'odd' END AS model, '/x' AS project, k AS input_tokens, 2::BIGINT AS output_tokens, 1::BIGINT AS reasoning_tokens FROM g"""


def _codex_limits(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    slot = lambda m, at: F.concat(F.lit('{"used_percent":'), F.col("k").cast("string"), F.lit(f',"window_minutes":{m},"resets_at":'), at, F.lit("}"))
    later = (F.col("t") + 600).cast("string")
    line = F.concat(F.lit('{"timestamp":"'), _iso(F.col("t")), F.lit('","type":"event_msg","payload":{"type":"token_count","info":null,"rate_limits":{"limit_id":"'), F.when(F.col("n") % 6 == 0, "premium").otherwise("codex"), F.lit('","plan_type":"p","primary":'), slot(299, later), F.lit(',"secondary":'), F.when(F.col("n") % 2 == 0, "null").otherwise(slot(10080, F.concat(F.lit('"'), _iso(F.col("t") + 900), F.lit('"')))), F.lit("}}}"))
    rows = e.select(F.concat(F.lit("/r/"), "session").alias("file"), F.col("n").alias("place"), F.col("n").alias("offset"), line.alias("line"))
    # Files of odd users are forks that replay what lies before event 5000 (or all, where their own turn never comes).
    files = e.filter("u % 2 = 1").select(F.concat(F.lit("/r/"), "session").alias("file")).distinct()
    forks = files.select("file", F.lit(-2).cast("long").alias("place"), F.lit(0).cast("long").alias("offset"), F.lit('{"type":"session_meta","payload":{"forked_from_id":"x"}}').alias("line"))
    own = files.select("file", F.lit(500).cast("long").alias("place"), F.lit(0).cast("long").alias("offset"), F.lit('{"type":"turn_context","payload":{}}').alias("line"))
    out = artifacts.rollout_limits(rows.unionByName(forks).unionByName(own))
    return out.select("window_key", "window_minutes", "used_pct", "resets_at", "observed_at", "plan", "limit_id", "source_order")


CODEX_LIMITS_SQL = f"""WITH {EVENTS_SQL}, r AS (SELECT * FROM e WHERE n % 6 <> 0 AND (u % 2 = 0 OR n >= 500))
  SELECT 'w300' AS window_key, 299::BIGINT AS window_minutes, k::DOUBLE AS used_pct, t + 600 AS resets_at, t AS observed_at, 'p' AS plan, 'codex:w300' AS limit_id, n AS source_order FROM r UNION ALL SELECT 'w10080', 10080, k, t + 900, t, 'p', 'codex:w10080', n FROM r WHERE n % 2 = 1"""


def _grok_limits(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    used = F.when(F.col("k") > 0, F.concat(F.lit('"creditUsagePercent":'), F.col("k").cast("string"), F.lit(","))).otherwise("")
    kind = F.when(F.col("n") % 3 == 0, "WEEKLY").when(F.col("n") % 3 == 1, "MONTHLY").otherwise("YEARLY")
    start = F.when(F.col("n") % 2 == 0, F.concat(F.lit('"start":"'), _iso(F.col("t") - 86_400), F.lit('",'))).otherwise("")
    line = F.concat(F.lit('{"ts":"'), _iso(F.col("t")), F.lit('","msg":"'), F.when(F.col("n") % 5 == 0, "other").otherwise("billing: fetched credits config"), F.lit('","ctx":{"subscriptionTier":"x","config":{'), used, F.lit('"currentPeriod":{"type":"USAGE_PERIOD_TYPE_'), kind, F.lit('",'), start, F.lit('"end":"'), _iso(F.col("t") + 86_400), F.lit('"}}}}'))
    return artifacts.credit_limits(e.select(line.alias("line"))).select("source", "window_key", "window_minutes", "used_pct", "resets_at", "observed_at", "plan")


GROK_LIMITS_SQL = f"WITH {EVENTS_SQL} SELECT 'grok' AS source, CASE n % 3 WHEN 0 THEN 'w10080' ELSE 'w43200' END AS window_key, CASE WHEN n % 2 = 0 THEN 2880 WHEN n % 3 = 0 THEN 10080 ELSE 43200 END::BIGINT AS window_minutes, k::DOUBLE AS used_pct, t + 86400 AS resets_at, t AS observed_at, 'x' AS plan FROM e WHERE n % 3 <> 2 AND n % 5 <> 0"

_LOST_SQL = "lost AS (SELECT * FROM (VALUES ('click', 2, 1704500000), ('view', 1, NULL), ('error', 0, 1704600000), ('signup', 1, 1700000000)) v(source, count, max_mtime))"


def _lost(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('click', 2L, 1704500000L), ('view', 1L, CAST(NULL AS BIGINT)), ('error', 0L, 1704600000L), ('signup', 1L, 1700000000L) AS v(source, count, max_mtime)")


def _floors(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.readings(spark, sf).withColumn("covered_from", F.col("observed_at") - F.lit(100))
    exports = rows.groupBy("source").agg(F.max("observed_at").alias("fetched_at")).crossJoin(F.broadcast(spark.sql("SELECT * FROM VALUES ('acct'), ('new'), (CAST(NULL AS STRING)) AS v(account_id)")))  # a row a source and three accounts
    return artifacts.coverage_floor(exports, rows, _lost(spark))


def _moved(spark: SparkSession, sf: str) -> DataFrame:
    rows = artifacts.record_unreadable(fixtures.readings(spark, sf), _lost(spark))
    return rows.groupBy("source").agg(F.min("covered_from").alias("covered_from"), F.count("*").alias("n"))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the suppliers' files are to be read, and which the manifest forgets."""
    rows = fixtures.table(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.col("s_suppkey").alias("size"), (F.col("s_suppkey") % 7).alias("mtime"))
    known = rows.select("path", "size", F.when(F.col("size") % 3 == 0, -1).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("size") % 4 == 0, 1).otherwise(2).alias("parser_version"))
    due = artifacts.unchanged_files(rows.filter("size % 5 <> 0"), known, 2).select("path", F.lit("due").alias("what"))
    return due.unionByName(artifacts.pruned_manifest(known, rows.filter("size % 5 <> 0")).select("path", F.lit("known").alias("what")))


def _owners(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.usage(spark, sf).select(F.when(F.col("session_id").isNotNull(), F.col("dedup_key")).alias("ident"), F.col("source_file").alias("file"), "output_tokens")
    return folds.owned(rows).groupBy("file").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"))


def _owners_sql() -> str:
    from ledgerloom.plans.fixtures import USAGE_SQL

    return f"WITH {USAGE_SQL}, r AS (SELECT CASE WHEN session_id IS NOT NULL THEN dedup_key END AS ident, source_file AS file, output_tokens FROM usage), f AS (SELECT *, min(file) OVER (PARTITION BY ident) AS owner FROM r) SELECT file, count(*)::BIGINT AS n, sum(output_tokens)::BIGINT AS tokens FROM f WHERE ident IS NULL OR owner = file GROUP BY file"


def _floors_sql() -> str:
    from ledgerloom.plans.fixtures import READINGS_SQL

    return f"""WITH {READINGS_SQL}, {_LOST_SQL}, x AS (SELECT source, max(observed_at) AS fetched_at, a.account_id FROM readings, (VALUES ('acct'), ('new'), (NULL)) a(account_id) GROUP BY ALL), o AS (SELECT source, account_id, min(observed_at) AS first, max(observed_at - 100) AS claim FROM readings WHERE account_id IS NOT NULL GROUP BY ALL)
      SELECT x.source, x.fetched_at, x.account_id, CASE WHEN x.account_id IS NULL OR (l.count > 0 AND l.max_mtime IS NULL) THEN NULL ELSE greatest(coalesce(o.first, x.fetched_at), o.claim, CASE WHEN l.count > 0 THEN l.max_mtime + 1 END) END::BIGINT AS covered_from FROM x LEFT JOIN o USING (source, account_id) LEFT JOIN lost l ON l.source = x.source"""


def _moved_sql() -> str:
    from ledgerloom.plans.fixtures import READINGS_SQL

    return f"WITH {READINGS_SQL}, {_LOST_SQL}, c AS (SELECT source, min(observed_at) AS covered, count(*) AS n FROM readings GROUP BY source) SELECT c.source, greatest(covered, CASE WHEN l.count > 0 THEN l.max_mtime + 1 END)::BIGINT AS covered_from, n::BIGINT AS n FROM c LEFT JOIN lost l USING (source)"


MANIFEST_SQL = """WITH r AS (SELECT s_name AS path, s_suppkey AS size FROM supplier) SELECT path, 'due' AS what FROM r WHERE size % 5 <> 0 AND (size % 3 = 0 OR size % 4 = 0) UNION ALL SELECT path, 'known' FROM r WHERE size % 5 <> 0"""

# --- vendors' answers and limit cards


def _payloads(spark: SparkSession, sf: str, text: Column) -> DataFrame:
    return _events(spark, sf).select(F.col("t").alias("fetched_at"), text.alias("payload"))


def _claude_windows(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("n"), F.col("k").cast("string")
    later = lambda more: F.concat(F.lit('"'), _iso(F.col("t") + more), F.lit('"'))
    listed = F.concat(F.lit('{"limits":[{"kind":"session","percent":'), k, F.lit(',"resets_at":'), later(60), F.lit('},{"kind":"weekly_scoped","percent":'), k, F.lit(',"resets_at":'), (F.col("t") + 90).cast("string"), F.lit(',"scope":{"model":{"display_name":"Opus 4"}}},{"kind":"odd","percent":1,"resets_at":null}]}'))
    named = F.concat(F.lit('{"limits":[],"a":{"seven_day":{"utilization":'), k, F.lit(',"resets_at":'), later(70), F.lit('},"seven_day_x":{"utilization":2,"resets_at":'), later(80), F.lit('},"none":{"utilization":3,"resets_at":null}}}'))
    return vendors.claude_windows(_payloads(spark, sf, F.when(n % 2 == 0, listed).otherwise(named)))


CLAUDE_WINDOWS_SQL = f"""WITH {EVENTS_SQL} SELECT t AS fetched_at, 'five_hour' AS window_key, 300::BIGINT AS window_minutes, k::DOUBLE AS used_pct, t + 60 AS resets_at, 'session' AS limit_id, 'all' AS model_scope FROM e WHERE n % 2 = 0 UNION ALL SELECT t, 'seven_day_opus_4', 10080, k, t + 90, NULL, NULL FROM e WHERE n % 2 = 0
  UNION ALL SELECT t, 'seven_day', 10080, k, t + 70, 'weekly_all', 'all' FROM e WHERE n % 2 = 1 UNION ALL SELECT t, 'seven_day_x', 10080, 2, t + 80, NULL, NULL FROM e WHERE n % 2 = 1"""


def _codex_windows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    text = F.concat(F.lit('{"rate_limit":{"primary":{"used_percent":'), k, F.lit(',"limit_window_seconds":18000,"reset_after_seconds":30},"secondary":{"utilization":4,"window_minutes":10079,"resets_at":'), (F.col("t") + 5).cast("string"), F.lit('},"third":{"used_percent":1}},"list":[{"used_percent":9,"window_minutes":5,"reset_at":1}]}'))
    return vendors.codex_windows(_payloads(spark, sf, text))


CODEX_WINDOWS_SQL = f"WITH {EVENTS_SQL} SELECT t AS fetched_at, 'w300' AS window_key, 300::BIGINT AS window_minutes, k::DOUBLE AS used_pct, t + 30 AS resets_at, 'codex:w300' AS limit_id, 'all' AS model_scope FROM e UNION ALL SELECT t, 'w10080', 10079, 4, t + 5, 'codex:w10080', 'all' FROM e"


def _other_windows(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("n"), F.col("k").cast("string")
    quota = F.concat(F.lit('{"quota_snapshots":{"premium_interactions":{"unlimited":'), F.when(n % 3 == 0, "true").otherwise("false"), F.lit(',"entitlement":80,"remaining":'), k, F.lit('}},"quota_reset_date_utc":"'), _iso(F.col("t") + 7), F.lit('"}'))
    group = F.concat(F.lit('{"groups":[{"buckets":[{"bucketId":"gemini-5h","remainingFraction":0.5,"resetTime":"'), _iso(F.col("t")), F.lit('"},{"bucket_id":"3p-weekly","disabled":'), F.when(n % 2 == 0, "true").otherwise("false"), F.lit(',"remaining_fraction":0.25,"reset_time":"'), _iso(F.col("t") + 1), F.lit('"},{"bucketId":"new","remainingFraction":1,"resetTime":"'), _iso(F.col("t")), F.lit('"},{"bucketId":"gemini-weekly","remainingAmount":3}]}]}'))
    return vendors.copilot_windows(_payloads(spark, sf, quota)).unionByName(vendors.antigravity_windows(_payloads(spark, sf, group)))


OTHER_WINDOWS_SQL = f"""WITH {EVENTS_SQL} SELECT t AS fetched_at, 'premium_requests' AS window_key, NULL::BIGINT AS window_minutes, (80.0::DOUBLE - k) * 100 / 80 AS used_pct, t + 7 AS resets_at, NULL::VARCHAR AS limit_id, NULL::VARCHAR AS model_scope FROM e WHERE n % 3 <> 0 AND k <= 80
  UNION ALL SELECT t, 'gemini:w300', 300, 50, t, NULL, NULL FROM e UNION ALL SELECT t, '3p:w10080', 10080, 75, t + 1, NULL, NULL FROM e WHERE n % 2 = 1"""


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.readings(spark, sf)
    catalog = spark.sql("SELECT * FROM VALUES (0, 'click', 'live'), (1, 'view', 'logs'), (2, 'error', 'live'), (3, 'none', 'logs'), (4, 'gone', 'live'), (5, 'signup', CAST(NULL AS STRING)), (6, 'purchase', 'live') AS v(place, key, limits)")
    failures = spark.sql("SELECT * FROM VALUES ('error', 'signed-out'), ('purchase', 'timeout') AS v(source, failure)")
    return limits.cards(catalog, limits.displayed_windows(rows), limits.plan_of(rows), failures)


def _cards_sql() -> str:
    from ledgerloom.plans.fixtures import READINGS_SQL

    return f"""WITH {READINGS_SQL}, o AS (SELECT source, max(observed_at) AS observed_at FROM (SELECT *, max(resets_at) OVER (PARTITION BY source) AS newest FROM readings) WHERE resets_at >= newest - 600 GROUP BY source), c AS (SELECT * FROM (VALUES (0, 'click', 'live'), (1, 'view', 'live'), (2, 'error', 'signed-out'), (3, 'none', 'nothing-recorded'), (4, 'gone', 'signed-out'), (6, 'purchase', 'error')) v(place, source, state))
      SELECT place, source, state, CASE WHEN state = 'live' THEN 'plan' END AS plan, observed_at, CASE WHEN state = 'live' THEN 1 ELSE 0 END::BIGINT AS windows FROM c LEFT JOIN o USING (source)"""


def _limits_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.readings(spark, sf)
    out = limits.page(rows, ledger_queries.limit_usage(rows), ledger_queries.EVALUATED)
    return out.select("source", "window_key", "used", "left", "tone", "tick", "state", "tokens_per_pct", "plan")


def _limits_page_sql() -> str:
    from ledgerloom.plans.fixtures import READINGS_SQL

    at = ledger_queries.EVALUATED
    return f"""WITH est AS ({ledger_queries.ESTIMATE_SQL}), d AS (WITH {READINGS_SQL}, n AS (SELECT *, max(resets_at) OVER (PARTITION BY source) AS newest FROM readings WHERE observed_at <= {at}) SELECT source, window_key, floor(max(used_pct) + 0.5)::BIGINT AS used, max(resets_at) AS resets_at FROM n WHERE resets_at >= newest - 600 GROUP BY ALL)
      SELECT source, window_key, used, 100 - used AS left, CASE WHEN 100 - used > 50 THEN 'ok' WHEN 100 - used > 20 THEN 'low' ELSE 'dry' END AS tone, (resets_at - {at}) / 86400.0::DOUBLE AS tick, state, tokens_per_pct, 'plan' AS plan FROM d JOIN est USING (source, window_key)"""


_PLANS = ("default_claude_max_5x", "plus", "pro-plus", "claude", "", "team  annual")
_KEYS = ("five_hour", "w300", "seven_day", "w10080", "seven_day_opus_4", "w43200", "w77", "gemini:w300", "premium_requests")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    plan, key = F.get(F.array(*[F.lit(p) for p in _PLANS]), (n % 6).cast("int")), F.get(F.array(*[F.lit(k) for k in _KEYS]), (n % 9).cast("int"))
    rows = fixtures.table(spark, sf, "nation").select("n_nationkey", formats.plan_label(plan).alias("plan"), formats.window_label(key, F.when(n % 2 == 0, "grok").otherwise("codex")).alias("w"))
    return rows.select("n_nationkey", "plan", "w.pool", "w.label")


LABELS_SQL = """SELECT n_nationkey, ['Max 5x', 'Plus', 'Pro Plus', 'claude', NULL, 'Team Annual'][n_nationkey % 6 + 1] AS plan, CASE WHEN n_nationkey % 9 = 7 THEN 'gemini' END AS pool,
  CASE n_nationkey % 9 WHEN 0 THEN 'session' WHEN 1 THEN 'session' WHEN 2 THEN 'weekly' WHEN 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'weekly credits' ELSE 'weekly' END WHEN 4 THEN 'Opus 4' WHEN 5 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'monthly credits' ELSE '43200 min' END WHEN 6 THEN '77 min' WHEN 7 THEN 'session' ELSE 'Premium requests' END AS label FROM nation"""

def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The tools of the catalog with their records, where each user's events stand for one tool's."""
    used = _events(spark, sf).groupBy((F.col("u") % len(scan.CATALOG)).cast("int").alias("place")).agg(F.count("*").alias("records"), F.sum("k").alias("tokens"))
    return scan.catalog(spark).join(used, "place", "left")


def _catalog_sql() -> str:
    rows = ", ".join(f"({i}, '{s.key}', '{s.label}', {repr(s.limits) if s.limits else 'NULL'})" for i, s in enumerate(scan.CATALOG))
    return f"WITH {EVENTS_SQL}, r AS (SELECT u % {len(scan.CATALOG)} AS place, count(*) AS records, sum(k)::BIGINT AS tokens FROM e GROUP BY 1) SELECT v.place::INT AS place, key, label, limits, records, tokens FROM (VALUES {rows}) v(place, key, label, limits) LEFT JOIN r ON r.place = v.place"


QUERIES = {
    "ctx_fold_claude": (_claude_fold, CLAUDE_SQL),
    "ctx_fold_tools": (_claude_tools, CLAUDE_TOOLS_SQL),
    "ctx_fold_resumed": (_resumed, RESUMED_SQL),
    "ctx_fold_codex": (_codex_fold, CODEX_SQL),
    "ctx_fold_tree": (_tree, TREE_SQL),
    "opencode_messages": (_opencode, OPENCODE_SQL),
    "qoder_chat": (_qoder, QODER_SQL),
    "qoder_unbooked": (_unbooked, UNBOOKED_SQL),
    "cline_tasks": (_cline, CLINE_SQL),
    "zed_threads": (_zed, ZED_SQL),
    "antigravity_exports": (_antigravity, ANTIGRAVITY_SQL),
    "codex_limits": (_codex_limits, CODEX_LIMITS_SQL),
    "grok_limits": (_grok_limits, GROK_LIMITS_SQL),
    "coverage_floor": (_floors, _floors_sql()),
    "unreadable_coverage": (_moved, _moved_sql()),
    "file_manifest": (_manifest, MANIFEST_SQL),
    "tool_ownership": (_owners, _owners_sql()),
    "claude_windows": (_claude_windows, CLAUDE_WINDOWS_SQL),
    "codex_windows": (_codex_windows, CODEX_WINDOWS_SQL),
    "other_windows": (_other_windows, OTHER_WINDOWS_SQL),
    "limit_cards": (_cards, _cards_sql()),
    "limits_page": (_limits_page, _limits_page_sql()),
    "limit_labels": (_labels, LABELS_SQL),
    "source_catalog": (_catalog, _catalog_sql()),
}
