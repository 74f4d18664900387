"""Log readers, merges and streaming on small files."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import formats
from ledgerloom.operators import merge, report, usage
from ledgerloom.sources import lines, records, sqlite
from ledgerloom.streaming import ledger


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def call(i, output, request="q", **more):
    used = {"input_tokens": 10, "output_tokens": output, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 7}
    return {"type": "assistant", "sessionId": "s", "requestId": request, "timestamp": "2025-01-01T00:00:10.5Z", "cwd": "/x/.claude/worktrees/y", "message": {"id": i, "model": "m", "usage": used | more}}


def test_call_records(spark, tmp_path):
    put(tmp_path / "a/one.jsonl", [call("1", 3), "{broken", call("2", 4, None), {"type": "user"}, call("3", 0, input_tokens=0, cache_read_input_tokens=0, cache_creation_input_tokens=0)])
    put(tmp_path / "b/two.jsonl", [call("1", 9), call("4", 1, cache_creation={"ephemeral_5m_input_tokens": 2, "ephemeral_1h_input_tokens": 3}), call("5", 1, iterations=[{"input_tokens": 1, "output_tokens": 1, "model": "n"}, {"input_tokens": 2, "output_tokens": 2}])])
    rows = records.call_records(spark, str(tmp_path))
    got = sorted((r.dedup_key, r.output_tokens, r.cache_write_5m_tokens, r.cache_write_1h_tokens, r.model) for r in rows.collect())
    assert got == [("claude:1:q", 3, 7, 0, "m"), ("claude:1:q", 9, 7, 0, "m"), ("claude:2", 4, 7, 0, "m"), ("claude:4:q", 1, 2, 3, "m"), ("claude:5:q#it0", 1, 0, 0, "n"), ("claude:5:q#it1", 2, 0, 0, "m")]
    one = rows.filter("dedup_key = 'claude:2'").first()
    assert (one.timestamp, one.project, one.session_id) == (1735689610, "/x", "s")
    kept = {r.dedup_key: r.output_tokens for r in ledger.latest(rows).collect()}
    assert kept["claude:1:q"] == 9 and len(kept) == 5
    bad = lines.skipped(lines.json_lines(spark, str(tmp_path)), records.CALLS).agg(F.sum("lines_skipped")).first()[0]
    assert bad == 1


def total(**n):
    return {"timestamp": "2025-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": n}}}


def test_rollout_records(spark, tmp_path):
    turn = {"type": "turn_context", "payload": {"model": "m"}}
    home = {"type": "session_meta", "payload": {"cwd": "/w"}}
    put(tmp_path / "r.jsonl", [home, turn, total(input_tokens=100, cached_input_tokens=40, output_tokens=10), total(input_tokens=100, cached_input_tokens=40, output_tokens=10), total(input_tokens=110, cached_input_tokens=90, output_tokens=10), total(input_tokens=200, cached_input_tokens=90, output_tokens=30, reasoning_output_tokens=5)])
    put(tmp_path / "f.jsonl", [{"type": "session_meta", "payload": {"forked_from_id": "r", "cwd": "/w"}}, total(input_tokens=100, output_tokens=10), turn, total(input_tokens=150, output_tokens=15)])
    rows = records.rollout_records(spark, str(tmp_path))
    got = sorted((r.session_id, r.input_tokens, r.cache_read_tokens, r.output_tokens, r.reasoning_tokens, r.model, r.project) for r in rows.collect())
    assert got == [("f", 50, 0, 5, None, "m", "/w"), ("r", 50, 50, 20, 5, "m", "/w"), ("r", 60, 40, 10, None, "m", "/w")]


def test_other_logs(spark, tmp_path):
    put(tmp_path / "chat/session.json", [{"sessionId": "s", "messages": [{"id": "1", "timestamp": "2025-01-01T00:00:00Z", "model": "g", "tokens": {"input": 1000, "output": 200, "cached": 300, "thoughts": 50}}, {"id": "1", "tokens": {"input": 1}}, {"id": "2"}]}])
    chat = records.chat_records(spark, str(tmp_path / "chat")).collect()
    assert [(r.input_tokens, r.output_tokens, r.cache_read_tokens, r.reasoning_tokens) for r in chat] == [(700, 250, 300, 50)]
    done = lambda **u: {"timestamp": 1735689600000, "params": {"sessionId": "s", "update": {"sessionUpdate": "turn_completed", "prompt_id": "p", "usage": u}}}
    put(tmp_path / "g1/updates.jsonl", [done(inputTokens=64000, cachedReadTokens=48000, cacheCreationTokens=2000, outputTokens=10, modelCalls=7)])
    put(tmp_path / "g2/updates.jsonl", [done(inputTokens=1, cachedReadTokens=2)])
    turns = records.turn_records(spark, [str(tmp_path / "g1"), str(tmp_path / "g2")]).collect()
    assert [(r.input_tokens, r.cache_read_tokens, r.cache_write_5m_tokens, r.api_calls, r.timestamp) for r in turns] == [(14000, 48000, 2000, 7, 1735689600)]
    put(tmp_path / "w/parent/subagents/a.jsonl", [{"type": "message", "id": "1", "sessionId": "own", "timestamp": 1735689600000, "providerData": {"model": "m", "usage": {"requests": 0, "inputTokens": 100, "outputTokens": 5}, "rawUsage": {"prompt_cache_hit_tokens": 0, "cache_read_input_tokens": 60, "cache_creation_input_tokens": 3, "prompt_cache_write_tokens": 4}}}, {"type": "note", "id": "2"}])
    work = records.line_records(spark, str(tmp_path / "w")).collect()
    assert [(r.dedup_key, r.session_id, r.input_tokens, r.cache_read_tokens, r.cache_write_5m_tokens, r.api_calls) for r in work] == [("workbuddy:1", "parent", 36, 60, 4, 1)]
    put(tmp_path / "lim/x.json", [{"schema": 4, "source": "s", "fetched_at": 5, "plan": "p", "windows": [{"key": "w", "window_minutes": 300, "used_pct": 1.5, "resets_at": 9, "evidence": {"limit_id": "l", "model_scope": "all"}}, {"key": "v"}]}])
    put(tmp_path / "lim/y.json", [{"schema": 5, "source": "s", "windows": []}])
    assert [(r.window_key, r.used_pct, r.limit_id) for r in records.limit_exports(spark, str(tmp_path / "lim")).collect()] == [("w", 1.5, "l")]


def test_sqlite_sources(spark, tmp_path):
    def db(name, *statements):
        with sqlite3.connect(tmp_path / name) as c:
            for s in statements:
                c.execute(s)
        return str(tmp_path / name)

    hermes = db("h.db", "CREATE TABLE sessions (id, model, started_at, input_tokens, output_tokens, reasoning_tokens, cache_read_tokens, cache_write_tokens, api_call_count, cwd)", "INSERT INTO sessions VALUES ('a', 'm', 1735689600.5, 1, 2, 3, 4, 5, 30, '/p')")
    assert [(r.dedup_key, r.output_tokens, r.api_calls, r.cache_write_5m_tokens, r.project) for r in sqlite.hermes_records(spark, hermes).collect()] == [("hermes:a", 5, 30, 5, "/p")]
    goose = db(
        "g.db", "CREATE TABLE sessions (id, working_dir, created_at, updated_at, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, accumulated_input_tokens, accumulated_output_tokens, accumulated_cache_read_tokens, accumulated_cache_write_tokens)",
        "CREATE TABLE usage_ledger (id, session_id, created_timestamp, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens)",
        "INSERT INTO sessions VALUES ('a', '/p', '2025-01-01 00:00:00', NULL, 1, 1, 0, 0, 0, 0, 0, 0), ('b', '/q', '2025-01-01 00:00:00', NULL, 1, 1, 0, 0, 100, 9, 10, 0)",
        "INSERT INTO usage_ledger VALUES (1, 'a', 1735689600, 'm', 50, 5, 20, 1)",
    )
    assert sorted((r.dedup_key, r.input_tokens, r.project) for r in sqlite.goose_records(spark, goose).collect()) == [("goose:session:b", 90, "/q"), ("goose:usage:a:1", 29, "/p")]
    copilot = db("c.db", "CREATE TABLE assistant_usage_events (id, session_id, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, token_details_json, created_at)", """INSERT INTO assistant_usage_events VALUES (1, 's', 'm', 100, 5, 60, 10, 2, '[{"tokenType":"input","tokenCount":20},{"tokenType":"cache_read","tokenCount":70},{"tokenType":"cache_write","tokenCount":10}]', '2025-01-01T00:00:00Z'), (2, 's', 'm', 50, 5, 60, 10, 2, NULL, '2025-01-01T00:00:00Z')""")
    assert sorted((r.input_tokens, r.cache_read_tokens, r.cache_write_5m_tokens) for r in sqlite.copilot_records(spark, copilot).collect()) == [(0, 50, 0), (20, 70, 10)]
    with pytest.raises(Exception, match="no such|no column"):
        sqlite.hermes_records(spark, copilot).collect()


def test_stream_equals_batch(spark, tmp_path, small):
    rows = spark.read.parquet(f"{small}/lineitem.parquet").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("dedup_key"), F.lit("s").alias("source"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp"), F.floor("l_extendedprice").alias("output_tokens"), F.struct("l_partkey", "l_suppkey", "l_quantity").alias("seq"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    ledger.ingest(stream, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    ledger.ingest(stream, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()  # nothing new
    got = {r.dedup_key: r.output_tokens for r in ledger.stored(spark, str(tmp_path / "table")).collect()}
    assert got == {r.dedup_key: r.output_tokens for r in rows.groupBy("dedup_key").agg(F.max("output_tokens").alias("output_tokens")).collect()}
    assert ledger.compact(spark, str(tmp_path / "table"), str(tmp_path / "days")).count() == len(got)


def test_insert_keeps_tokens_and_fills_the_rest(spark):
    rows = spark.createDataFrame([("k", 1, None, None, 1), ("k", 9, "s", None, 2), ("k", 7, None, 4, 3)], "dedup_key string, output_tokens long, session_id string, reasoning_tokens long, seq int")
    assert tuple(merge.insert(rows).first()) == ("k", 1, "s", 4)


def test_readouts(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    for n, text in ((0, "0"), (999, "999"), (1000, "1.00K"), (1234567, "1.23M"), (999_995, "1.00M"), (5 * 10**9, "5.00B")):
        assert value(formats.compact(F.lit(n).cast("long"))) == text
    assert [value(formats.epoch(F.lit(x).cast("long"))) for x in (1735689600, 1735689600999, 1735689600999999)] == [1735689600] * 3
    assert value(formats.iso_epoch(F.lit("2025-01-01T00:00:00.9Z"))) == 1735689600 and value(formats.iso_epoch(F.lit("soon"))) is None
    assert [value(formats.window_key(F.lit(m))) for m in (300, 314, 316, 10080, 77)] == ["w300", "w300", "w316", "w10080", "w77"]
    assert value(formats.basename(F.lit("/a/b//"))) == "b" and value(formats.absolute_project(F.lit("rel/x"))) is None
    assert value(usage.bucket(F.lit(1710054000), "America/New_York", True)) == "2024-03-10 03:00"


def test_report_folder(spark, tmp_path, small):
    from ledgerloom.plans import fixtures, usage_queries

    paths = report.write_report(fixtures.usage(spark, small), usage_queries._rates(spark), str(tmp_path))
    models = spark.read.option("header", True).csv(paths["models"])
    assert {"key", "cost", "cost_basis"} <= set(models.columns) and models.filter("key = 'Unattributed usage' and cost is null").count() >= 1
    assert spark.read.option("header", True).csv(paths["summary"]).count() == 1


def test_offsets_count_carriage_returns_and_leave_torn_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"a":1}\r\n{"a":22}\n{"a":333}\r\n{"torn"')
    got = sorted((r.offset, r.line.strip()) for r in lines.with_offsets(lines.json_lines(spark, str(tmp_path))).collect())
    assert got == [(0, '{"a":1}'), (9, '{"a":22}'), (18, '{"a":333}')]


def test_stream_keeps_what_earlier_rows_knew(spark, tmp_path):
    schema = "dedup_key string, source string, timestamp long, model string, project string, output_tokens long, input_tokens long, session_id string, reasoning_tokens long, seq long"
    batches = [[("k", "s", 1, "m", "/p", 5, 1, "x", None, 1), ("l", "s", 1, "m", None, 5, 1, None, None, 2)], [("k", "s", 9, "n", None, 8, 2, None, 3, 3)], [("k", "s", 9, "o", "/late", 7, 9, "y", 4, 4), ("l", "s", 1, "m", "/q", 5, 1, "z", 1, 5)]]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ledger.ingest(stream, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    got = {r.dedup_key: r.asDict() for r in ledger.stored(spark, str(tmp_path / "table")).collect()}
    assert (got["k"]["output_tokens"], got["k"]["input_tokens"], got["k"]["model"], got["k"]["project"], got["k"]["session_id"], got["k"]["reasoning_tokens"]) == (8, 2, "n", "/p", "x", 3)
    assert (got["l"]["project"], got["l"]["session_id"], got["l"]["reasoning_tokens"]) == ("/q", "z", 1) and len(got) == 2
    with pytest.raises(ValueError):
        ledger.ingest(stream.drop("seq"), str(tmp_path / "t2"), str(tmp_path / "c2"))


def test_call_ledger_divides_contexts_and_replaces_plain_keys(spark, tmp_path):
    said = {"type": "user", "sessionId": "s", "message": {"content": "x" * 400}}
    first = call("1", 3) | {"isSidechain": True}
    again = call("5", 1)
    several = call("5", 1, iterations=[{"input_tokens": 1, "output_tokens": 1, "model": "n"}, {"input_tokens": 2, "output_tokens": 2}])
    put(tmp_path / "p/one.jsonl", [said, first, again, several])
    got = {r.dedup_key: r for r in records.call_ledger(spark, str(tmp_path)).collect()}
    assert set(got) == {"claude:1:q", "claude:5:q#it0", "claude:5:q#it1"}
    assert (got["claude:1:q"].ctx_messages, got["claude:1:q"].ctx_system, got["claude:1:q"].ctx_agents) == (22, 0, 22)
    assert got["claude:5:q#it1"].ctx_agents is None and got["claude:5:q#it1"].ctx_messages == 2


def test_rollout_ledger_knows_no_system_prompt(spark, tmp_path):
    item = {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "y" * 100}}
    put(tmp_path / "r.jsonl", [{"type": "turn_context", "payload": {"model": "m"}}, item, total(input_tokens=100, cached_input_tokens=40, output_tokens=10)])
    row = records.rollout_ledger(spark, str(tmp_path)).first()
    assert (row.ctx_messages, row.ctx_system, row.ctx_reasoning, row.ctx_toolcalls, row.ctx_mcp) == (100, None, None, 0, None)


def test_other_artifacts(spark, tmp_path):
    from ledgerloom.sources import artifacts

    wire = lambda field, value: bytes([field << 3 | 2, len(value)]) + value if isinstance(value, bytes) else bytes([field << 3]) + bytes([value])
    used = wire(2, 50) + wire(3, 40) + wire(5, 7) + wire(9, 11) + wire(11, b"rid")
    chat = bytes([4 << 3 | 2, len(used)]) + used + b"\x9a\x01" + bytes([14]) + b"gemini-default"
    blob = wire(1, chat)
    rows = spark.createDataFrame([("/f", "s", 0, blob, 1742860799, "/p"), ("/f", "s", 1, b"\xff", 5, None)], "file string, session string, idx int, data binary, created long, project string")
    got = [(r.dedup_key, r.input_tokens, r.output_tokens, r.cache_read_tokens, r.reasoning_tokens, r.model) for r in artifacts.generation_rows(rows).collect()]
    assert got == [("antigravity:s:rid", 50, 40, 7, 11, "gemini-2.0-flash")]
    old = spark.createDataFrame([("/x/20250102_030405.jsonl", 0, '{"id":"a","input_tokens":9,"output_tokens":1,"accumulated_input_tokens":90,"accumulated_output_tokens":10,"working_dir":"/w"}', 7), ("/x/b.jsonl", 0, '{"id":"b","input_tokens":3}', 7), ("/x/c.jsonl", 0, '{"id":"c","input_tokens":3,"updated_at":"2025-01-01 00:00:00"}', 7)], "file string, place int, line string, mtime long")
    modern = spark.createDataFrame([("b",)], "session_id string")
    got = sorted((r.session_id, r.input_tokens, r.output_tokens, r.timestamp, r.project) for r in records.legacy_headers(old, modern).collect())
    assert got == [("a", 90, 10, 1735787045, "/w"), ("c", 3, 0, 1735689600, None)]
    chats = records.chat_lines(spark.createDataFrame([("/h/hash1234567/chats/f.jsonl", 0, '{"sessionId":"s"}'), ("/h/hash1234567/chats/f.jsonl", 1, '{"id":"1","timestamp":"2025-01-01T00:00:00Z","tokens":{"input":5,"output":1}}')], "file string, place int, line string"))
    assert json.loads(chats.first().value)["messages"][0]["id"] == "1"
    folders = records.chat_projects(spark.createDataFrame([("/h/hash1234567/chats/f.jsonl",), ("/h/nice/chats/f.jsonl",)], "source_file string"), spark.createDataFrame([("/real/nice", "nice")], "real string, friendly string"))
    assert sorted(r.project for r in folders.collect()) == ["/real/nice", "hash1234"]
    turns = records.turn_projects(spark.createDataFrame([("/g/%2Fw%2Fx/s1/updates.jsonl", None), ("/g/y/s2/updates.jsonl", "m")], "source_file string, model string"), spark.createDataFrame([("/g/y/s2/summary.json", '{"current_model_id":"z","info":{"cwd":"/cwd"}}')], "file string, text string"))
    assert sorted((r.project, r.model or "") for r in turns.collect()) == [("/cwd", "m"), ("/w/x", "")]


def test_a_scan_reads_what_is_there_and_says_what_is_not(spark, tmp_path):
    from ledgerloom.sources import scan

    put(tmp_path / ".claude/projects/a/one.jsonl", [call("1", 3), call("1", 9)])
    put(tmp_path / "other/r.jsonl", [{"type": "turn_context", "payload": {"model": "m"}}, total(input_tokens=10, output_tokens=1)])

    def broken(spark, paths):
        raise ValueError("no such column")

    readers = {k: scan.READERS[k] for k in ("claude", "codex", "workbuddy")} | {"kilo": broken}
    rows, status = scan.run(spark, str(tmp_path), {"CODEX_HOME": "relative"}, {"codex": str(tmp_path / "other")}, readers)
    said = {r.source: (r.records, r.error) for r in status.collect()}
    assert said["claude"] == (1, None) and said["codex"] == (1, None) and said["kilo"] == (0, "no such column") and said["workbuddy"][0] == 0 and said["workbuddy"][1]
    assert len(said) == len(scan.CATALOG) and sorted((r.source, r.output_tokens) for r in rows.collect()) == [("claude", 9), ("codex", 1)]
    assert scan.changes(status).first().asDict() == {"records": 2, "failed": 2}
    one = scan.CATALOG[1]
    assert scan.roots(one, "/h", {}) == ["/h/.codex/sessions"] and scan.roots(one, "/h", {"CODEX_HOME": "~/x"}) == ["/h/x/sessions"]
    assert scan.roots(one, "/h", {"CODEX_HOME": "/y"}, "/z/./w") == ["/z/w"] and scan.roots(one, "/h", {"CODEX_HOME": " "}) == ["/h/.codex/sessions"]
