"""One home folder with the logs of every tool, older stores beside newer ones, and exports."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import prices, usage
from ledgerloom.sources import artifacts, discovery, documents, readers, scan, sqlite


def put(path, *rows) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def store(path, *statements) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as db:
        for s in statements:
            db.execute(*s) if isinstance(s, tuple) else db.execute(s)
    return str(path)


def wire(field: int, value: int | bytes) -> bytes:
    def varint(v: int) -> bytes:
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    return varint(field << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(field << 3) + varint(value)


GOOSE = (
    "CREATE TABLE sessions (id TEXT, working_dir TEXT, created_at TEXT, updated_at TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, accumulated_input_tokens INT, accumulated_output_tokens INT, accumulated_cache_read_tokens INT, accumulated_cache_write_tokens INT)",
    "INSERT INTO sessions VALUES ('new', '/w', '2025-01-01 00:00:00', NULL, 50, 5, 0, 0, NULL, NULL, NULL, NULL)",
)


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    time = "2025-01-01T00:00:00Z"
    used = {"input_tokens": 10, "output_tokens": 2, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 1}
    claude = lambda n, out, **more: {"type": "assistant", "sessionId": "s", "timestamp": time, "requestId": "q", "message": {"id": f"m{n}", "model": "x", "usage": {**used, "output_tokens": out}}} | more
    put(home / ".claude/projects/p/s.jsonl", claude(1, 2, cwd="/first"), claude(1, 9), claude(2, 1))
    total = {"type": "event_msg", "timestamp": time, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 100, "output_tokens": 10}}, "rate_limits": {"limit_id": "codex", "plan_type": "plus", "primary": {"used_percent": 12.0, "window_minutes": 300, "resets_at": 1735700000}}}}
    put(home / ".codex/sessions/r.jsonl", {"type": "turn_context", "payload": {"model": "m"}}, total)
    chat = {"sessionId": "g1", "messages": [{"id": "1", "timestamp": time, "model": "gm", "tokens": {"input": 9, "output": 1, "cached": 4, "thoughts": 2}}]}
    put(home / ".gemini/tmp/nice/chats/one.json", chat)
    put(home / ".gemini/tmp/hash123456/chats/two.jsonl", {"sessionId": "g2"}, {"id": "2", "timestamp": time, "tokens": {"input": 5, "output": 1}})
    put(home / ".gemini/projects.json", {"projects": {"/real": "nice"}})
    grok = {"timestamp": 1735689600, "method": "session/update", "params": {"sessionId": "k", "update": {"sessionUpdate": "turn_completed", "prompt_id": "p", "usage": {"inputTokens": 70, "outputTokens": 7, "modelCalls": 1}}}}
    put(home / ".grok/sessions/%2Fw/k/updates.jsonl", grok)
    put(home / ".grok/sessions/%2Fw/k/summary.json", {"current_model_id": "grok-x", "info": {"cwd": "/cwd"}})
    chat_model = wire(4, wire(2, 50) + wire(3, 40) + wire(5, 7) + wire(11, b"rid")) + wire(19, b"own-model")
    antigravity = home / ".gemini/antigravity/conversations"
    store(antigravity / "c1.db", "CREATE TABLE gen_metadata (idx INTEGER, data BLOB)", "CREATE TABLE trajectory_metadata_blob (id TEXT, data BLOB)", ("INSERT INTO gen_metadata VALUES (0, ?), (1, ?)", (wire(1, chat_model), wire(1, chat_model))), ("INSERT INTO trajectory_metadata_blob VALUES ('main', ?)", (wire(2, wire(1, 1735689600)) + wire(1, wire(1, b"file:///Users/dev/my%20app")),)))
    put(antigravity / "c1.json", {"schema": 1, "conversation_id": "c1", "generations": [{"response_id": "rid", "ts": 5, "input": 1, "output": 1}, {"response_id": "only", "ts": 1735689600, "input": 8, "output": 1, "cache_read": 0, "cache_write": 2, "thinking": 0}]})
    goose = home / ".local/share/goose/sessions"
    store(goose / "sessions.db", "CREATE TABLE schema_version (version INT)", "INSERT INTO schema_version VALUES (15)", *GOOSE)
    put(goose / "new.jsonl", {"id": "new", "input_tokens": 999})
    put(goose / "20250102_030405.jsonl", {"id": "old", "input_tokens": 3, "working_dir": "/o"})
    opencode = home / ".local/share/opencode"
    message = lambda out: json.dumps({"role": "assistant", "modelID": "antigravity-claude-opus-4-5-thinking-max", "tokens": {"input": 4, "output": out, "reasoning": 0, "cache": {"read": 0, "write": 0}}})
    tables = ("CREATE TABLE message (id TEXT, session_id TEXT, time_created INT, data TEXT)", "CREATE TABLE session (id TEXT, directory TEXT, time_created INT, time_updated INT)")
    store(opencode / "opencode.db", *tables, ("INSERT INTO message VALUES ('a', 's1', 1735689600000, ?)", (message(1),)), "INSERT INTO session VALUES ('s1', '/d', 1, 2)")
    store(opencode / "opencode-beta.db", *tables, ("INSERT INTO message VALUES ('a', 's1', 1735689600000, ?), ('b', 's2', 1735689600000, ?)", (message(1), message(2))))
    put(opencode / "storage/session/g/s1.json", {"id": "s1", "directory": "/no"})
    put(opencode / "storage/session/g/s9.json", {"id": "s9", "directory": "/nine"})
    for s in ("s1", "s9"):
        put(opencode / f"storage/message/{s}/z.json", json.loads(message(5)) | {"sessionID": s, "time": {"created": 1735689600000}})
    task = home / ".config/Code/User/globalStorage/saoudrizwan.claude-dev/tasks/77"
    put(task / "ui_messages.json", json.dumps([{"say": "api_req_started", "ts": 1735689600000, "text": json.dumps({"tokensIn": 6, "tokensOut": 2})}]))
    put(task / "api_conversation_history.json", json.dumps("# Current Working Directory (/task) <model>cl-model</model>"))
    put(home / ".cline/data/sessions/x/s5.json", {"sessionId": "s5", "version": 1, "messages": [{"say": "api_req_finished", "ts": 1735689600000, "text": json.dumps({"tokensIn": 1, "tokensOut": 1})}]})
    chat_tables = ("CREATE TABLE chat_message (id TEXT, session_id TEXT, token_info TEXT, model_info TEXT, gmt_create INT)", "CREATE TABLE chat_session (session_id TEXT, parent_session_id TEXT)")
    add = ("INSERT INTO chat_message VALUES (?, 's', ?, ?, 1735689600000)", ("q1", json.dumps({"prompt_tokens": 5, "completion_tokens": 1, "cached_tokens": 0}), json.dumps({"model_key": "kmodel"})))
    store(home / ".config/QoderCN/SharedClientCache/cache/db/local.db", *chat_tables, add)
    store(home / ".config/Qoder/SharedClientCache/cache/db/local.db", *chat_tables, (add[0], ("q2", *add[1][1:])))
    put(home / ".config/Qoder/logs/d/qoder.log", "x Model classes refreshed: " + json.dumps({"chat": [{"name": "kmodel", "displayName": "Kimi-New"}]}), "Model classes refreshed: {torn")
    put(home / ".grok/logs/unified.jsonl", {"ts": time, "msg": "billing: fetched credits config", "ctx": {"subscriptionTier": "t", "config": {"creditUsagePercent": 30.0, "billingPeriodEnd": "2025-01-08T00:00:00Z", "currentPeriod": {"type": "USAGE_PERIOD_TYPE_WEEKLY", "start": "2025-01-01T00:00:00Z", "end": "2025-01-08T00:00:00Z"}}}})
    return home


def test_every_store_of_a_home_folder(spark, home):
    rows, status = scan.run(spark, str(home), {})
    said = {r.source: (r.records, r.error) for r in status.collect()}
    there = {"claude": 2, "codex": 1, "gemini": 2, "grok": 1, "antigravity": 2, "goose": 2, "opencode": 3, "cline": 2, "qoder": 2}
    assert {k: v for k, v in said.items() if k in there} == {k: (n, None) for k, n in there.items()}
    assert all(v[0] == 0 and v[1] for k, v in said.items() if k not in there)
    got = {r.dedup_key: r for r in rows.collect()}
    assert len(got) == sum(there.values())
    assert (got["claude:m1:q"].output_tokens, got["claude:m1:q"].project) == (9, "/first")  # what was known first stays
    assert {r.project for r in got.values() if r.source == "gemini"} == {"/real", "hash1234"}
    (grok,) = [r for r in got.values() if r.source == "grok"]
    assert (grok.model, grok.project, grok.input_tokens) == ("grok-x", "/cwd", 70)
    assert (got["antigravity:c1:rid"].input_tokens, got["antigravity:c1:rid"].project, got["antigravity:c1:rid"].timestamp) == (50, "/Users/dev/my app", 1735689600)
    assert got["antigravity:c1:only"].cache_write_5m_tokens == 2
    assert {r.session_id: r.input_tokens for r in got.values() if r.source == "goose"} == {"new": 50, "old": 3}
    assert {(r.session_id, r.output_tokens, r.model) for r in got.values() if r.source == "opencode"} == {("s1", 1, "claude-opus-4-5"), ("s2", 2, "claude-opus-4-5"), ("s9", 5, "claude-opus-4-5")}
    assert {(r.session_id, r.model, r.project) for r in got.values() if r.source == "cline"} == {("77", "cl-model", "/task"), ("s5", None, None)}
    assert {r.dedup_key: r.model for r in got.values() if r.source == "qoder"} == {"qoder:q1": "kimi-k2.6", "qoder:q2": "kimi-new"}
    limits = {r.source: (r.window_key, r.used_pct) for r in scan.readings(spark, str(home), {}).collect()}
    assert limits == {"codex": ("w300", 12.0), "grok": ("w10080", 30.0)}


def test_goose_schemas(spark, tmp_path):
    def version(n: int) -> str:
        return store(tmp_path / f"{n}.db", "CREATE TABLE schema_version (version INT)", f"INSERT INTO schema_version VALUES ({n})", *GOOSE)

    assert sqlite.goose_store(spark, version(1)).count() == 1
    assert sqlite.goose_store(spark, store(tmp_path / "none.db", *GOOSE)).count() == 1
    for bad in (0, 16):
        with pytest.raises(ValueError, match="schema version"):
            sqlite.goose_store(spark, version(bad))
    with pytest.raises(ValueError, match="no sessions"):
        sqlite.goose_store(spark, store(tmp_path / "empty.db", "CREATE TABLE x (y INT)"))


def test_the_guard_stays_when_the_newer_store_was_skipped(spark, tmp_path):
    table, old = str(tmp_path / "t"), spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    assert discovery.remembered_sessions(spark, table, "goose").count() == 0
    for some in ("a", "b"):
        discovery.remember_sessions(spark, table, "goose", spark.createDataFrame([(some,), (some,)], "session_id string"))
    known = discovery.remembered_sessions(spark, table, "goose")
    left = lambda *how: sorted(r.session_id for r in discovery.guarded(old, *how).collect())
    assert left(None, known) == ["c"] and left(None, None) == [] and left(spark.createDataFrame([("c",)], "session_id string"), None) == ["a", "b"]


def test_documents_are_whole_or_not_there(spark, tmp_path):
    folder = str(tmp_path / "out")
    some = spark.range(40).select(F.concat(F.lit("d"), "id", F.lit(".json")).alias("name"), F.concat(F.lit('{"é":'), "id", F.lit("}")).alias("text")).repartition(5)
    documents.write_documents(some, folder)
    assert {r.text for r in documents.read_documents(spark, folder).collect()} == {f'{{"é":{i}}}' for i in range(40)}
    documents.write_documents(some.filter("name = 'd1.json'").withColumn("text", F.lit("new")), folder)
    assert documents.read_documents(spark, folder).count() == 40 and (tmp_path / "out/d1.json").read_text() == "new"
    for bad in (some.withColumn("name", F.lit("same.json")), some.withColumn("name", F.lit("../x"))):
        with pytest.raises(Exception, match="one name|no name"):
            documents.write_documents(bad, folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".staged")) == [] and documents.read_documents(spark, folder).count() == 40
    documents.write_documents(some.limit(2), folder, replace=True)
    assert documents.read_documents(spark, folder).count() == 2


def test_a_price_is_frozen_once_a_day_and_fills_gaps(spark, tmp_path):
    schema = "model string, day string, priced boolean, " + ", ".join(f"{r} long" for r in usage.RATES)
    days = [("m", "2025-01-0%d" % d, p) for d, p in ((1, None), (2, None), (3, 30), (4, 40), (5, None), (6, 60), (7, None))]
    observed = spark.createDataFrame([(m, d, p is not None, *[p or 0] * 5) for m, d, p in days], schema)
    table = str(tmp_path / "history")
    for m, d, p in days:
        current = spark.createDataFrame([(m, *[p] * 5)] if p else [], "model string, " + ", ".join(f"{r} long" for r in usage.RATES))
        prices.freeze_price(spark, table, current, d, m)
        if d.endswith("6"):
            prices.freeze_price(spark, table, current, d, m)  # once more on the same day
    columns = ["model", "day", "priced", *usage.RATES]
    stored = spark.read.schema(schema).parquet(table)
    assert sorted(map(tuple, stored.select(columns).collect())) == sorted(map(tuple, prices.frozen(observed).select(columns).collect()))
    assert {r.day[-1]: r.input for r in stored.collect()} == {"1": 30, "2": 30, "3": 30, "4": 40, "5": 60, "6": 60, "7": 0}


def test_routed_names(spark):
    names = {"antigravity-claude-opus-4-5-thinking-max": "claude-opus-4-5", "antigravity-claude-sonnet-4-5-thinking": "claude-sonnet-4-5", "antigravity-gemini-3-pro-max": "gemini-3-pro-preview", "antigravity-claude-opus-4-5-thinking-x-y": "claude-opus-4-5", "antigravity-odd-low": "antigravity-odd-low", "plain-max": "plain-max"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", artifacts.routed_model(F.col("n")).alias("m")).collect()
    assert {r.n: r.m for r in rows} == names and set(readers.READERS) == {s.key for s in scan.CATALOG}
