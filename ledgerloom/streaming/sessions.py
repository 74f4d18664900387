"""What logs that grow have said before, kept from batch to batch: context compositions of calls, and running totals.

The lines of `sources.growing` are parsed in the JVM, a row a line with what it adds and what it books; a stateful processor keyed by
file holds, in the state store, what the file's next line is judged by. So the records that a line books carry the composition
before it whether the file was read at once or in a hundred appends, also after a restart. A file that is begun anew (another
generation) begins with nothing. Where a file is read on but its state is lost, nothing is guessed: its sessions are tainted, their
parts stay null, and the first total of a log of running totals books nothing.

A batch brings at most the source's `max_bytes` of a file, in any order: the processor sorts these few rows by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions.formats import absolute_project, estimate, iso_epoch, skill_name
from ledgerloom.operators.folds import PARTS, attributed, block_body, block_id, session_of, size_of, with_blocks
from ledgerloom.sources import records
from ledgerloom.sources.lines import parsed, stem

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTEXT = ("ctx_messages", "ctx_system", "ctx_reasoning", "ctx_toolcalls", "ctx_agents", "ctx_mcp", "ctx_skills")
_SUMS = ", ".join(f"{p} long" for p in PARTS)
_RECORD = ", ".join(f"{c} {'long' if c.endswith('_tokens') or c in ('timestamp', 'api_calls') else 'string'}" for c in records.COLUMNS)
_OUT = f"identity string, generation int, place long, i int, {_RECORD}, billed long, sidechain boolean, {_SUMS}, sys long, tainted boolean"

_named = lambda schema: Row(*[f.split()[0] for f in schema.split(", ")])


def use_rocksdb(spark: SparkSession) -> None:
    """The store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def call_lines(lines: DataFrame, source: str = "claude") -> DataFrame:
    """A row for each line that books calls, adds content or compacts."""
    rows = records.with_calls(with_blocks(lines), source)
    block = lambda b: F.struct(b["type"].alias("kind"), block_id(b).alias("id"), b["name"].alias("name"), size_of(block_body(b)).alias("size"), (F.coalesce(b["type"] == "text", F.lit(False)) & skill_name(block_body(b)).isNotNull()).alias("loads"))
    cut = (F.col("l.type") == "system") & (F.col("l.subtype") == "compact_boundary")
    out = rows.select(
        "identity", "file", "generation", "since", "place", session_of(F.col("l")).alias("session"), (F.col("l.type") == "user").alias("user"), F.coalesce(cut, F.lit(False)).alias("cut"),
        F.coalesce("l.isSidechain", F.lit(False)).alias("sidechain"), "calls", F.transform("b", block).alias("blocks"),
    )
    return out.filter("cut or size(blocks) > 0 or size(calls) > 0")


class _Carried:
    """A map of the state store whose entries are read when they are asked for and written once, at the end of a batch."""

    def __init__(self, store):
        self.store, self.known, self.changed = store, {}, set()

    def get(self, key: str) -> tuple | None:
        if key not in self.known:
            self.known[key] = tuple(self.store.getValue((key,))) if self.store.containsKey((key,)) else None
        return self.known[key]

    def put(self, key: str, value: tuple) -> None:
        self.known[key] = value
        self.changed.add(key)

    def keep(self) -> None:
        for key in self.changed:
            self.store.updateValue((key,), self.known[key])


class CallContexts(StatefulProcessor):
    """Records of message logs with the composition before them. State of a file: its generation, the composition of each session,
    the name of each tool call, what each record's key was first divided by, and the keys that calls have replaced."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "generation int")
        self.sessions = handle.getMapState("sessions", "session string", f"{_SUMS}, sys long, tainted boolean")
        self.tools = handle.getMapState("tools", "id string", "name string")
        self.firsts = handle.getMapState("firsts", "dedup_key string", f"{_SUMS}, sys long, tainted boolean")
        self.replaced = handle.getMapState("replaced", "dedup_key string", "yes boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stores = (self.sessions, self.tools, self.firsts, self.replaced)
        known, taint = self.file.get()[0] if self.file.exists() else None, False
        maps = [_Carried(m) for m in stores]
        for r in sorted(rows, key=lambda r: (r.generation, r.place)):
            if r.generation != known:
                taint = known is None and r.since > 0  # read on, and nothing is known of what was before
                for m in stores:
                    m.clear()
                known, maps = r.generation, [_Carried(m) for m in stores]
            yield from self._line(r, taint, *maps)
        for m in maps:
            m.keep()
        self.file.update((known,))

    def _line(self, r: Row, taint: bool, sessions: _Carried, tools: _Carried, firsts: _Carried, replaced: _Carried) -> Iterator[Row]:
        *sums, sys, tainted = sessions.get(r.session) or (0, 0, 0, 0, 0, None, taint)
        now, blocks = dict(zip(PARTS, sums, strict=True)), r.blocks or []
        for c in r.calls or []:
            billed = c["input_tokens"] + c["cache_read_tokens"] + c["cache_write_5m_tokens"] + c["cache_write_1h_tokens"]
            if sys is None:
                sys = max(0, billed - now["msg"] - now["reas"])
            key = c["dedup_key"]
            plain = key.split("#it")[0]
            if plain != key:
                replaced.put(plain, (True,))
            elif replaced.get(plain):
                continue
            if firsts.get(key) is None:
                firsts.put(key, (*now.values(), sys, tainted))
            yield _named(_OUT)(r.identity, r.generation, r.place, c["i"], *[c[n] for n in records.COLUMNS], billed, r.sidechain, *firsts.get(key))
        if r.cut:
            now = dict.fromkeys(PARTS, 0)
        if r.user and any(b["kind"] in ("string", "text") for b in blocks):
            now["reas"] = 0
        for b in blocks:
            kind, size, ident = b["kind"], b["size"], b["id"]
            tool, name = kind == ("tool_result" if r.user else "tool_use"), b["name"] or ""
            if tool and r.user:
                called = tools.get(ident) if ident is not None else None
                name = (called[0] if called else None) or "unknown"
            now["msg"] += size if tool or kind in ("string", "text") else 0
            now["tool"] += size if tool else 0
            now["mcp"] += size if tool and name.startswith("mcp__") else 0
            now["skill"] += size if tool and name == "Skill" or r.user and b["loads"] else 0
            now["reas"] += size if not r.user and kind == "thinking" else 0
            if tool and not r.user and ident is not None and tools.get(ident) is None:
                tools.put(ident, (b["name"],))
        sessions.put(r.session, (*now.values(), sys, tainted))


def call_stream(lines: DataFrame, source: str = "claude") -> DataFrame:
    """A stream of `growing_lines` -> a stream of ledger rows with ctx_ columns, seq and supersedes: the key that a record of
    several calls replaces."""
    use_rocksdb(lines.sparkSession)
    kept = call_lines(lines, source).groupBy("identity").transformWithState(CallContexts(), _OUT, "Append", "None")
    side = F.col("source_file").contains("/subagents/") | F.col("sidechain")
    return _with_context(attributed(kept, sidechain=side))


def _with_context(rows: DataFrame) -> DataFrame:
    several = F.col("dedup_key").rlike("#it[0-9]+$")
    return rows.select(*records.COLUMNS, *CONTEXT, F.struct("generation", F.col("source_file").alias("file"), "place", "i").alias("seq"), F.when(several, F.regexp_replace("dedup_key", "#it[0-9]+$", "")).alias("supersedes"))


# --- logs of running totals
_TOTALS = ", ".join(f"{c} long" for c in records.COUNTED)
_STEPS = f"identity string, generation int, file string, place long, i int, at long, model string, cwd string, x_input long, x_output long, x_cached long, x_written long, x_reasoning long, billed long, {_SUMS}, sys long, tainted boolean"


def total_lines(lines: DataFrame) -> DataFrame:
    """A row for each line of a log of running totals that says a total, a turn's model, what the log is, or adds content."""
    rows = parsed(lines, records.ROLLOUT).withColumn("item", F.from_json("line", "type string, payload string"))
    p = F.from_json("item.payload", "type string, role string")
    t, is_item = "j.payload.info.total_token_usage", F.coalesce(F.col("j.type") == "response_item", F.lit(False))
    kind = F.when(F.col("j.type").isin("session_meta", "turn_context"), F.col("j.type")).when(F.col(t).isNotNull(), "total").when(is_item, "item")
    size, tool, said = estimate(F.octet_length("item.payload")), p["type"].isin("function_call", "function_call_output"), p["type"] == "message"
    amount = lambda ok: F.when(is_item & ok, size).otherwise(0).cast("long")
    fork = F.col("j.payload.forked_from_id").isNotNull() | F.col("j.payload.parent_thread_id").isNotNull() | F.coalesce(F.col("j.payload.thread_source") == "subagent", F.lit(False))
    return rows.select(
        "identity", "file", "generation", "since", "place", kind.alias("type"), iso_epoch(F.col("j.timestamp")).alias("timestamp"), F.col("j.payload.model").alias("model"), F.col("j.payload.cwd").alias("cwd"), fork.alias("fork"),
        *[F.col(f"{t}.{c}").alias(n) for c, n in (("input_tokens", "input"), ("output_tokens", "output"), ("cached_input_tokens", "cached"), ("cache_write_input_tokens", "written"), ("reasoning_output_tokens", "reasoning"))],
        amount(said | tool).alias("msg"), amount(tool).alias("tool"), amount(p["type"] == "reasoning").alias("reas"), F.coalesce(is_item & said & (p["role"] == "user"), F.lit(False)).alias("turn"),
    ).filter("type is not null")


class TotalSteps(StatefulProcessor):
    """Steps between running totals, with the composition before them. State of a file: its generation, the last totals, the model
    and folder in force, whether what it replays is over, and the composition."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", f"generation int, known boolean, {_TOTALS}, model string, cwd string, replay boolean, started boolean, msg long, tool long, reas long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else None
        generation, known, totals, parts = None, True, None, (0, 0, 0)
        if held is not None:
            generation, known = held[:2]
            totals, parts = records.Totals(dict(zip(records.COUNTED, held[2:7], strict=True)), *held[7:11]), held[11:]
        for r in sorted(rows, key=lambda r: (r.generation, r.place)):
            if r.generation != generation:
                known, totals, parts = generation is not None or r.since == 0, records.Totals(), (0, 0, 0)
                generation = r.generation
            step = totals.step(r.asDict()) if r.type != "item" else None
            if step is not None and known:
                at, model, cwd, *sums = step
                billed = sums[0] + sums[2] + sums[3]
                msg, tool, reas = parts
                yield _named(_STEPS)(r.identity, r.generation, r.file, r.place, 0, at, model, cwd, *sums, billed, msg, tool, 0, 0, reas, 0, billed <= 0)
            known = known or r.type == "total"
            if r.type == "item":
                parts = (parts[0] + r.msg, parts[1] + r.tool, (0 if r.turn else parts[2]) + r.reas)
        last = totals
        self.state.update((generation, known, *(last.last[c] for c in records.COUNTED), last.model, last.cwd, last.replay, last.started, *parts))


def total_stream(lines: DataFrame, source: str = "codex") -> DataFrame:
    """A stream of `growing_lines` -> a stream of ledger rows with ctx_ columns and seq, as `records.rollout_ledger` makes them."""
    use_rocksdb(lines.sparkSession)
    steps = total_lines(lines).groupBy("identity").transformWithState(TotalSteps(), _STEPS, "Append", "None")
    rows = attributed(steps, observed=())
    name = stem(F.col("file"))
    made: list[Column] = records.ledger_columns(
        source, dedup_key=F.concat(F.lit(f"{source}:"), name, F.lit(":"), F.col("place").cast("string")), timestamp="at", model="model", project=absolute_project(F.col("cwd")), input_tokens="x_input", output_tokens="x_output", cache_read_tokens="x_cached", cache_write_5m_tokens="x_written",
        source_file="file", session_id=name, reasoning_tokens="x_reasoning",
    )
    kept = rows.filter("x_input + x_output + x_cached + x_written > 0 and at is not null")
    return kept.select(*made, *CONTEXT, F.struct("generation", "file", "place", "i").alias("seq"), F.lit(None).cast("string").alias("supersedes"))
