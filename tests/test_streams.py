"""Growing logs, state across batches, timers and retractions, each also after a restart."""

from __future__ import annotations

import glob
import json
import os
import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerloom.operators import limits
from ledgerloom.sources import growing, records
from ledgerloom.streaming import clock, ledger, sessions


def drain(frame, path, checkpoint) -> None:
    """All there is goes to a table; as many batches as it takes."""
    query = frame.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def read_lines(spark, tmp_path) -> list[tuple]:
    rows = spark.read.parquet(str(tmp_path / "out")).select("file", "generation", "place", "line").collect()
    return sorted((os.path.basename(r.file), r.generation, r.place, r.line) for r in rows)


def test_appends_torn_lines_and_aliases_give_each_line_once(spark, tmp_path):
    logs = tmp_path / "logs"
    (logs / "a").mkdir(parents=True)
    one, two = logs / "a" / "one.jsonl", logs / "two.jsonl"
    one.write_bytes(b'{"n":1}\n{"n":2}\r\n\n{"torn"')
    two.write_text("x\ny\n")
    os.symlink(one, logs / "b.jsonl")
    os.link(two, logs / "z.jsonl")
    os.symlink(logs, logs / "a" / "up")

    def turn(version="1"):
        drain(growing.growing_lines(spark, str(logs), str(tmp_path / "state"), version=version), tmp_path / "out", tmp_path / "ck")
        return read_lines(spark, tmp_path)

    first = [("one.jsonl", 0, 0, '{"n":1}'), ("one.jsonl", 0, 8, '{"n":2}\r'), ("two.jsonl", 0, 0, "x"), ("two.jsonl", 0, 2, "y")]
    assert turn() == first
    with one.open("ab") as f:
        f.write(b':3}\n{"n":4}\n')
    with two.open("a") as f:
        f.write("half")
    second = sorted([*first, ("one.jsonl", 0, 18, '{"torn":3}'), ("one.jsonl", 0, 29, '{"n":4}')])
    assert turn() == second and turn() == second
    with two.open("a") as f:
        f.write(" done\n")
    third = sorted([*second, ("two.jsonl", 0, 4, "half done")])
    assert turn() == third
    two.write_text("new\n")  # shorter: begun anew
    fourth = sorted([*third, ("two.jsonl", 1, 0, "new")])
    assert turn() == fourth
    again = [(f, g + 1, p, x) for f, g, p, x in fourth if f == "one.jsonl"] + [("two.jsonl", 2, 0, "new")]
    assert turn("2") == sorted([*fourth, *again])  # another parser reads all again


def test_long_logs_are_cut_at_lines(spark, tmp_path, monkeypatch):
    lines = [json.dumps({"n": i, "x": "é" * (i % 50)}, ensure_ascii=False) for i in range(500)] + ["y" * 5000]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "long.jsonl").write_text("\n".join(lines) + "\n")
    stream = growing.growing_lines(spark, str(tmp_path / "logs"), str(tmp_path / "state"), max_bytes=2000)
    for _ in range(40):
        drain(stream, tmp_path / "out", tmp_path / "ck")
        got = read_lines(spark, tmp_path)
        if len(got) == len(lines):
            break
    assert [r[3] for r in sorted(got, key=lambda r: r[2])] == lines


@pytest.mark.parametrize("piece", [1, 3, 7, 64, 10_000])
def test_pieces_hold_each_line_once(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(growing, "PIECE", piece)
    monkeypatch.setattr(growing, "BLOCK", 4)
    text = "a\n\nbb\n" + "c" * 90 + "\ndd\nlast\ntorn"
    (tmp_path / "x.jsonl").write_text(text)
    reader = growing.GrowingReader({"path": str(tmp_path), "state": str(tmp_path / "s")})
    got = [line for p in reader.partitions({"n": 0}, reader.latestOffset()) for b in reader.read(p) for line in b.column(5).to_pylist()]
    assert got == [x for x in text.split("\n")[:-1] if x]


def test_snapshots_stand_for_plans(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "SNAPSHOT", 2)
    options = {"path": str(tmp_path), "state": str(tmp_path / "s")}
    log, seen = tmp_path / "x.jsonl", []
    at = {"n": 0}
    for i in range(7):
        with log.open("a") as f:
            f.write(f"{i}\n")
        reader = growing.GrowingReader(options)  # a new driver each time
        end = reader.latestOffset()
        seen += [line for p in reader.partitions(at, end) for b in reader.read(p) for line in b.column(5).to_pylist()]
        reader.commit(end)
        at = end
    assert seen == [str(i) for i in range(7)] and len([f for f in os.listdir(tmp_path / "s") if f.startswith("plan")]) == 1


def message_log(n: int, several: bool = True) -> list[str]:
    """A transcript with everything that a composition depends on."""
    out = []
    for i in range(n):
        session = {"sessionId": f"s{i % 2}"} if i % 5 else {}
        usage = {"input_tokens": 900 + 7 * i, "output_tokens": i + 1, "cache_read_input_tokens": 13 * i, "cache_creation_input_tokens": 5}
        if several and i % 6 == 4:
            usage["iterations"] = [{**usage, "model": "a"}, {**usage, "input_tokens": 40, "model": "b"}]
        content = [{"type": "thinking", "thinking": "hm " * i}, {"type": "text", "text": "said " * i}, {"type": "tool_use", "id": f"t{i}", "name": ["mcp__s__t", "Skill", "Read"][i % 3], "input": {"skill": "k" * i}}]
        time = f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"
        line = {"type": "assistant", "timestamp": time, "requestId": "r", "isSidechain": i % 7 == 0, "message": {"id": f"m{i - i % 2 if i % 3 else i}", "model": "x", "content": content, "usage": usage}}
        out.append({"type": "user", "timestamp": time, "message": {"content": f"ask {i}" if i % 2 else [{"type": "text", "text": "Base directory for this skill: /x/skills/k" if i % 4 else "t"}]}} | session)
        out += [line | session, {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{i}", "content": "r" * 40 * i}]}} | session]
        if i % 9 == 8:
            out.append({"type": "system", "subtype": "compact_boundary"} | session)
        if i % 11 == 3:
            out.append({"type": "assistant", "timestamp": time, "requestId": "r", "message": {"id": f"m{i}", "model": "x", "content": [], "usage": usage | {"output_tokens": 1}}} | session)
    return [json.dumps(x) for x in out] + ["no json"]


def fed(spark, tmp_path, lines, stream_of, cuts, name="one"):
    """The log is appended to piece by piece; every piece is a run of its own, after a restart."""
    log = tmp_path / "logs" / f"{name}.jsonl"
    log.parent.mkdir(exist_ok=True)
    text, at = "".join(x + "\n" for x in lines), 0
    for cut in [*cuts, len(text)]:
        with log.open("a") as f:
            f.write(text[at:cut])
        at = cut
        stream = stream_of(growing.growing_lines(spark, str(log.parent), str(tmp_path / "state")))
        drain(stream, tmp_path / "out", tmp_path / "ck")
    return spark.read.parquet(str(tmp_path / "out"))


SEEN = ["dedup_key", "model", "session_id", "input_tokens", "output_tokens", "cache_read_tokens", "timestamp", "project", "reasoning_tokens", *sessions.CONTEXT]


def told(frame) -> list[str]:
    return sorted(repr(tuple(r)) for r in frame.select(SEEN).collect())


def test_call_contexts_survive_appends_and_restarts(spark, tmp_path):
    lines = message_log(24)
    got = fed(spark, tmp_path, lines, sessions.call_stream, [900, 2500, 2501, 9000])
    plain = {r.supersedes for r in got.select("supersedes").collect()}
    whole = records.call_ledger(spark, str(tmp_path / "logs"))
    assert told(got.filter(~F.col("dedup_key").isin([p for p in plain if p]))) == told(whole) and len(plain) > 2
    assert got.filter("ctx_messages is not null").count() > 10


def test_lost_state_taints(spark, tmp_path):
    lines = message_log(8, several=False)
    fed(spark, tmp_path, lines, sessions.call_stream, [])
    with (tmp_path / "logs" / "one.jsonl").open("a") as f:
        f.write("\n".join(message_log(12, several=False)[24:36]) + "\n")
    stream = sessions.call_stream(growing.growing_lines(spark, str(tmp_path / "logs"), str(tmp_path / "state")))
    reader = growing.GrowingReader({"path": str(tmp_path / "logs"), "state": str(tmp_path / "state")})
    assert reader.latestOffset() == {"n": 2}
    (tmp_path / "state" / "plan-000000000001.json").write_text(json.dumps({"version": "1", "files": []}))  # what was read is gone
    drain(stream, tmp_path / "out2", tmp_path / "ck2")
    rows = spark.read.parquet(str(tmp_path / "out2")).collect()
    assert len(rows) >= 2 and all(r.ctx_messages is None for r in rows)


def rollout_log() -> list[str]:
    out, total = [{"type": "session_meta", "payload": {"cwd": "/p", "forked_from_id": None}}], [0] * 5
    for i in range(30):
        time = f"2024-01-01T00:00:{i:02d}Z"
        if i % 4 == 0:
            out.append({"type": "turn_context", "payload": {"model": ["m1", "unknown", "m2"][i % 3]}})
            out.append({"type": "response_item", "payload": {"type": "message", "role": "user", "content": "x" * 50 * i}})
        out.append({"type": "response_item", "payload": {"type": ["reasoning", "function_call", "message"][i % 3], "role": "assistant", "content": "y" * 30 * i}})
        total = [t + d for t, d in zip(total, (100 + i, 10, 40, 3, i % 2))]
        shown = [t + (9000 if n == 2 and i % 7 == 3 else 0) for n, t in enumerate(total)]
        names = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens")
        out.append({"timestamp": time, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": dict(list(zip(names, shown))[: 3 + i % 3])}}})
    return [json.dumps(x) for x in out]


def test_running_totals_survive_appends_and_restarts(spark, tmp_path):
    got = fed(spark, tmp_path, rollout_log(), sessions.total_stream, [300, 301, 3000, 6000])
    assert told(got) == told(records.rollout_ledger(spark, str(tmp_path / "logs"))) and got.count() > 15


# --- the ledger
LEDGER = "dedup_key string, source string, timestamp long, model string, project string, output_tokens long, input_tokens long, cache_read_tokens long, cache_write_5m_tokens long, cache_write_1h_tokens long, session_id string, reasoning_tokens long, seq long, supersedes string"


def batches(n: int, size: int) -> list[list[tuple]]:
    """Records that come again with more output, on other days, late, and that replace each other."""
    rng, out = random.Random(n), []
    for b in range(n):
        rows = []
        for i in range(size):
            key = f"k{rng.randrange(size * n // 2)}"
            gone = f"k{rng.randrange(size * n // 2)}" if rng.random() < 0.05 else None
            rows.append((key, rng.choice("ab"), 86_400 * rng.randrange(1, 9), rng.choice(["m", "n", None]), None, rng.randrange(50), rng.randrange(9), 1, 2, 3, rng.choice(["s", None]), rng.choice([None, 4]), b * size + i, gone))
        out.append(rows)
    return out


def plain_ledger(all_batches) -> set[str]:
    """Keys that stand in the end: a key that a batch replaces goes, with what the batch has of it."""
    there: set[str] = set()
    for rows in all_batches:
        there |= {r[0] for r in rows}
        there -= {r[-1] for r in rows if r[-1]}
    return there


def sums(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def check_series(spark, table):
    from ledgerloom.operators import usage

    has = [c for c in ledger.COUNTED if c not in ("records", "api_calls")]
    batch = ledger.stored(spark, table).groupBy(usage.bucket(F.col("timestamp")).alias("day"), "source", "model").agg(F.count("*").alias("records"), *[F.sum(c).alias(c) for c in has])
    batch = batch.withColumn("reasoning_tokens", F.coalesce("reasoning_tokens", F.lit(0)))
    kept = ledger.daily(spark, table)
    assert sums(kept.select("day", "source", "model", "records", *has)) == sums(batch) and kept.count() > 0


def test_the_series_follows_every_correction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SPLIT", 40)
    monkeypatch.setattr(ledger, "SNAPSHOT", 3)
    monkeypatch.setattr(ledger, "KEEP", 1)
    some, table = batches(7, 60), str(tmp_path / "table")
    for n, rows in enumerate(some):
        frame = spark.createDataFrame(rows, LEDGER)
        if n == 4:  # a failure before the log was written, and the batch again
            frame.limit(9).write.parquet(f"{table}/rows/batch=4")
            frame.limit(0).write.parquet(f"{table}/changes/batch=4")
        ledger.put(frame, n, table)
        if n in (2, 6):
            check_series(spark, table)
    ledger.put(spark.createDataFrame(some[-1], LEDGER), 6, table)  # the last batch once more
    check_series(spark, table)
    got = {r.dedup_key for r in ledger.stored(spark, table).select("dedup_key").collect()}
    assert got == plain_ledger(some) and ledger.stored(spark, table).count() == len(got)
    said = ledger.signals(spark, table)
    total = said.agg(F.sum("inserted") - F.sum("removed")).first()[0]
    assert total == len(got) and ledger.committed(spark, table) == 6
    assert {r.batch for r in ledger.signals(spark, table, 5).collect()} == {6}
    days = {r.day: r.revision for r in ledger.daily(spark, table).groupBy("day").agg(F.max("revision").alias("revision")).collect()}
    assert set(days.values()) <= set(range(7)) and max(days.values()) == 6


def test_a_small_batch_touches_few_parts_and_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SPLIT", 20)
    monkeypatch.setattr(ledger, "KEEP", 1)
    table = str(tmp_path / "table")
    ledger.put(spark.createDataFrame(batches(1, 800)[0], LEDGER).drop("supersedes"), 0, table)
    parts = ledger._live(spark, table)
    assert len(parts) >= 16 and max(p.rows for p in parts) <= 40
    for n in (1, 2, 3):
        ledger.put(spark.createDataFrame(batches(n + 1, 10)[n][:10], LEDGER).drop("supersedes"), n, table)
        assert sum(p.batch == n for p in ledger._live(spark, table)) <= 20
    named = {f"{table}/rows/batch={p.batch}/bits={p.bits}/value={p.value}" for p in ledger._live(spark, table)}
    first = [p for p in glob.glob(f"{table}/rows/batch=0/bits=*/value=*")]
    assert sum(p not in named for p in first) < len(first) - sum(p in named for p in first) + 1
    check_series(spark, table)


def test_cadence():
    assert [ledger.cadence(s) for s in (0, 1, 10, 77, 99_999)] == [14_400, 10, 10, 77, 14_400]


def test_late_records_change_the_answers_of_their_source_only(spark, tmp_path):
    table, hour = str(tmp_path / "table"), 3600
    reading = "source string, window_key string, window_minutes long, used_pct double, resets_at long, observed_at long, account_id string, plan string, metering_regime string, limit_id string, model_scope string, covered_from long, external_activity string, source_order long"
    seen = [(s, "w300", 300, float(6 * i + e), (e + 1) * 5 * hour, e * 5 * hour + i * 600, "acct", "pro", "r", "l", "all", 0, None, None) for s in "ab" for e in range(6) for i in range(1, 8)]
    readings = spark.createDataFrame(seen, reading)
    used = [(f"{s}{e}.{i}", s, e * 5 * hour + i * 600 + 60, "m", None, 100, 500, 0, 0, 0, "x", None, i, None) for s in "ab" for e in range(6) for i in range(8)]
    at = 5 * 5 * hour + 2 * hour
    ledger.put(spark.createDataFrame(used, LEDGER), 0, table)
    first = {r.source: r.tokens_per_pct for r in ledger.answers(spark, table, readings, at).collect()}
    assert first == {"a": 100.0, "b": 100.0}
    late = [(f"late{e}", "a", e * 5 * hour + 700, "m", None, 0, 6 * 600 * 6, 0, 0, 0, "x", None, 99, None) for e in range(6)]
    ledger.put(spark.createDataFrame(late, LEDGER), 1, table)
    again = {r.source: (r.tokens_per_pct, r.revision) for r in ledger.answers(spark, table, readings, at, since=0).collect()}
    whole = {r.source: r.tokens_per_pct for r in ledger.answers(spark, table, readings, at).collect()}
    assert set(again) == {"a"} and again["a"][1] == 1 and again["a"][0] == whole["a"] > 150 and whole["b"] == 100.0


def test_growing_logs_fill_the_ledger(spark, tmp_path):
    lines, table = message_log(24), str(tmp_path / "table")
    log = tmp_path / "logs" / "one.jsonl"
    log.parent.mkdir()
    text, at = "".join(x + "\n" for x in lines), 0
    for cut in (1500, 6000, len(text)):
        with log.open("a") as f:
            f.write(text[at:cut])
        at = cut
        ledger.ingest(sessions.call_stream(growing.growing_lines(spark, str(log.parent), str(tmp_path / "state"))), table, str(tmp_path / "ck")).awaitTermination()
    columns = ["dedup_key", "output_tokens", "input_tokens", "model", "session_id", "ctx_messages", "ctx_toolcalls"]
    whole = ledger.merged(records.call_ledger(spark, str(log.parent)))
    assert sums(ledger.stored(spark, table).select(columns)) == sums(whole.select(columns))
    check_series(spark, table)


# --- the clock
def told_by_clock(spark, path) -> list:
    try:
        return sorted(spark.read.schema(clock.ANSWERS).parquet(str(path)).collect(), key=lambda r: (r.window_key, r.evaluated_at, r.by_timer))
    except AnalysisException:
        return []


def run_until(spark, tmp_path, enough, seconds=60, fresh="1"):
    stream = clock.clock(spark.readStream.schema(clock.EVIDENCE).parquet(str(tmp_path / "evidence")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + seconds
        while time.time() < end and not enough(told_by_clock(spark, tmp_path / "out")):
            if query.exception():
                raise query.exception()
            time.sleep(0.5)
    finally:
        query.stop()
    return told_by_clock(spark, tmp_path / "out")


def test_answers_change_when_their_time_comes(spark, tmp_path):
    now = int(time.time())
    series = {"source": "s", "account_id": "a", "plan": "p", "metering_regime": "r", "limit_id": "l", "model_scope": "all", "revision": 0}
    blank = {f.split()[0]: None for f in clock.EVIDENCE.split(", ")}
    reading = lambda key, resets_at, **x: blank | series | {"kind": "reading", "window_key": key, "resets_at": resets_at, "covered_from": 0, "used_pct": 10.0, "observed_at": now} | x
    epoch = lambda key, at, tokens, **x: blank | series | {"kind": "epoch", "window_key": key, "epoch": at, "window_minutes": 300, "tokens": tokens, "movement": 20.0, "ratio": tokens / 20} | x
    span = limits.horizon(300)
    rows = [reading("resets", now + 25), *[epoch("resets", now - 10_000 * i, 2000.0 + i) for i in (1, 2, 3)]]
    rows += [reading("ages", now + 90_000), *[epoch("ages", now - 10_000 * i, 2000.0) for i in (1, 2)], epoch("ages", now + 24 - span, 2000.0)]  # one of three is soon too old
    rows += [reading("ages", now + 5, plan=None, observed_at=now + 9)]  # newer, but proves nothing
    spark.createDataFrame(rows, clock.EVIDENCE).write.mode("append").parquet(str(tmp_path / "evidence"))
    first = run_until(spark, tmp_path, lambda got: len(got) >= 2)  # then the stream is stopped, and begins again
    assert [(r.window_key, r.state, r.by_timer) for r in first[:2]] == [("ages", "ready", False), ("resets", "ready", False)]
    assert {r.window_key: r.next_evaluation_at for r in first} == {"resets": now + 25, "ages": now + 25} and {r.tokens_per_pct for r in first} == {100.0, 100.1}
    got = run_until(spark, tmp_path, lambda got: len(got) >= 4)
    by = {r.window_key: r for r in got if r.by_timer}
    assert (by["resets"].state, by["resets"].reason, by["resets"].next_evaluation_at) == ("blocked", "no-current-reading", None)
    assert (by["ages"].state, by["ages"].candidates) == ("stale", 2) and all(r.evaluated_at >= now + 25 for r in by.values())
    spark.createDataFrame([epoch("ages", now - 30_000, 6000.0, revision=1), epoch("ages", now - 20_000, 1.0, revision=-1)], clock.EVIDENCE).write.mode("append").parquet(str(tmp_path / "evidence"))
    last = run_until(spark, tmp_path, lambda got: len(got) >= 5)[-1]
    assert len(told_by_clock(spark, tmp_path / "out")) == 5
    new = max((r for r in told_by_clock(spark, tmp_path / "out") if r.window_key == "ages"), key=lambda r: r.evaluated_at)
    assert (new.state, new.candidates, new.by_timer) == ("unstable", 3, False) and last is not None


def test_timers_fire_in_a_stream_that_ended_between_batches(spark, tmp_path):
    now = int(time.time())
    blank = {f.split()[0]: None for f in clock.EVIDENCE.split(", ")}
    row = blank | {"kind": "reading", "source": "s", "account_id": "a", "plan": "p", "metering_regime": "r", "limit_id": "l", "model_scope": "all", "window_key": "w", "revision": 0, "resets_at": now + 30, "covered_from": 0, "used_pct": 10.0, "observed_at": now}
    spark.createDataFrame([row], clock.EVIDENCE).write.parquet(str(tmp_path / "evidence"))
    stream = clock.clock(spark.readStream.schema(clock.EVIDENCE).parquet(str(tmp_path / "evidence")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 hour").start()
    while not query.exception() and (not told_by_clock(spark, tmp_path / "out") or query.status["isTriggerActive"]):
        time.sleep(0.2)
    query.stop()  # no batch is begun and not ended
    assert [(r.next_evaluation_at, r.by_timer) for r in told_by_clock(spark, tmp_path / "out")] == [(now + 30, False)]
    got = run_until(spark, tmp_path, lambda got: len(got) >= 2)
    assert [(r.state, r.reason, r.by_timer) for r in got[1:]] == [("blocked", "no-current-reading", True)] and got[1].evaluated_at >= now + 30
