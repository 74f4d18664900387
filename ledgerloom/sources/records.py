"""Usage records from the logs of tools, one function for each kind of log. All return the ledger's columns.

Buckets never overlap: what the cache served or stored is taken out of the input, and records without any token are no
records. A model that a log does not name stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.functions.formats import absolute_project, epoch, estimate, iso_epoch, nonnegative
from ledgerloom.operators import folds
from ledgerloom.operators.usage import TOKENS, total_tokens
from ledgerloom.sources.lines import json_lines, parsed, plain_path, stem, with_offsets, zero

COLUMNS = ["dedup_key", "source", "timestamp", "model", "project", "api_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "source_file", "session_id", "reasoning_tokens"]

def ledger_columns(source: str, **columns: Column | str | None) -> list[Column]:
    """The ledger's columns from expressions; counters that are not given are 0, other columns null, calls 1."""
    def made(name: str) -> Column:
        if name == "source":
            return F.lit(source)
        given = columns.get(name)
        value = F.col(given) if isinstance(given, str) else given
        if name.endswith("_tokens") and name != "reasoning_tokens":
            return F.greatest(zero(value), F.lit(0).cast("long")) if value is not None else F.lit(0).cast("long")
        if name == "api_calls":
            return value.cast("long") if value is not None else F.lit(1).cast("long")
        kind = "long" if name in ("timestamp", "reasoning_tokens") else "string"
        return (value if value is not None else F.lit(None)).cast(kind)

    return [made(c).alias(c) for c in COLUMNS] + [columns[c].alias(c) for c in ("seq",) if c in columns]


def ledger_rows(rows: DataFrame, source: str, **columns: Column | str | None) -> DataFrame:
    """Rows with the ledger's columns, without those that are no records."""
    return rows.select(*ledger_columns(source, **columns)).filter((total_tokens() > 0) & F.col("dedup_key").isNotNull() & F.col("timestamp").isNotNull())


_COUNTERS = "input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint, cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>"
CALLS = f"type string, sessionId string, requestId string, timestamp string, cwd string, message struct<id: string, model: string, usage: struct<{_COUNTERS}, iterations: array<struct<model: string, {_COUNTERS}>>>>"


def _usages() -> tuple[Column, Column]:
    """(the calls that a parsed line of CALLS tells of, whether it names several)."""
    several = F.coalesce(F.size("j.message.usage.iterations") > 1, F.lit(False))
    whole = F.struct(F.col("j.message.model").alias("model"), *[F.col(f"j.message.usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation")])
    return F.when(several, F.col("j.message.usage.iterations")).otherwise(F.array(whole)), several


def _call_columns(source: str, several: Column, i: Column, u: Column) -> dict[str, Column]:
    key = F.concat_ws(":", F.lit(source), F.col("j.message.id"), F.col("j.requestId"))
    return {
        "dedup_key": F.when(several, F.concat(key, F.lit("#it"), i.cast("string"))).otherwise(key),
        "timestamp": iso_epoch(F.col("j.timestamp")), "model": F.nullif(F.coalesce(u["model"], "j.message.model"), F.lit("<synthetic>")), "project": absolute_project(F.col("j.cwd")),
        "input_tokens": u["input_tokens"], "output_tokens": u["output_tokens"], "cache_read_tokens": u["cache_read_input_tokens"],
        "cache_write_5m_tokens": F.when(u["cache_creation"].isNull(), u["cache_creation_input_tokens"]).otherwise(u["cache_creation"]["ephemeral_5m_input_tokens"]),
        "cache_write_1h_tokens": u["cache_creation"]["ephemeral_1h_input_tokens"], "source_file": F.col("file"), "session_id": F.col("j.sessionId"),
    }


_IS_CALL = "j.type = 'assistant' and j.message.id is not null and j.message.usage is not null"


def call_records(spark: SparkSession, paths: str | list[str], source: str = "claude") -> DataFrame:
    """Message logs: one record for each API call, also where one message took several. With seq, for keep-max merging:
    a message that is logged while it grows appears again with more output."""
    return call_rows(json_lines(spark, paths), source)


def call_rows(lines: DataFrame, source: str = "claude") -> DataFrame:
    """`call_records` of lines(file, place, line)."""
    usages, several = _usages()
    calls = parsed(lines, CALLS).filter(_IS_CALL).select("file", "place", "j", F.posexplode(usages).alias("i", "u"), several.alias("several"))
    return ledger_rows(calls, source, **_call_columns(source, F.col("several"), F.col("i"), F.col("u")), seq=F.struct("file", "place"))


def with_calls(lines: DataFrame, source: str = "claude") -> DataFrame:
    """lines(file, place, line, ..) with j, the line, and calls, an array of the records it books: i and the ledger's columns."""
    usages, several = _usages()
    rows = parsed(lines, CALLS)
    each = F.transform(usages, lambda u, i: F.struct(i.alias("i"), *ledger_columns(source, **_call_columns(source, several, i, u))))
    told = F.filter(each, lambda r: (sum((r[c] for c in TOKENS[1:]), r[TOKENS[0]]) > 0) & r["dedup_key"].isNotNull() & r["timestamp"].isNotNull())
    return rows.withColumn("calls", F.when(F.expr(_IS_CALL), told))


ROLLOUT = "timestamp string, type string, payload struct<cwd: string, forked_from_id: string, parent_thread_id: string, thread_source: string, model: string, type: string, info: struct<total_token_usage: struct<input_tokens: bigint, cached_input_tokens: bigint, cache_write_input_tokens: bigint, output_tokens: bigint, reasoning_output_tokens: bigint>>>"
COUNTED = ("input", "output", "cached", "written", "reasoning")
_STEPS = "file string, offset long, timestamp long, model string, cwd string, input long, output long, cached long, written long, reasoning long"


class Totals:
    """What a log of running totals said last."""

    def __init__(self, last: dict | None = None, model: str | None = None, cwd: str | None = None, replay: bool = False, started: bool = False):
        self.last, self.model, self.cwd, self.replay, self.started = last or dict.fromkeys(COUNTED, 0), model, cwd, replay, started

    def step(self, r: dict) -> tuple | None:
        """(timestamp, model, cwd, input, output, cached, written, reasoning) if the line books something."""
        if r["type"] == "session_meta":
            self.cwd, self.replay = r["cwd"] or self.cwd, self.replay or bool(r["fork"]) and not self.started
            return None
        if r["type"] == "turn_context":
            if r["model"] is not None:
                self.model = r["model"] if r["model"].strip() and r["model"].lower() != "unknown" else None
            self.replay, self.started = False, True
            return None
        last = self.last
        # A total that is not named stays at what it was.
        now = {c: last[c] if r[c] is None and c in ("written", "reasoning") else int(r[c] or 0) for c in COUNTED}
        step = {c: max(0, now[c] - last[c]) for c in COUNTED}
        if step["cached"] + step["written"] > step["input"]:
            return None
        booked = step["input"] or step["output"]
        self.last = {**now, "reasoning": now["reasoning"] if booked else last["reasoning"]}
        if not booked or self.replay:
            return None
        return (r["timestamp"], self.model, self.cwd, step["input"] - step["cached"] - step["written"], step["output"], step["cached"], step["written"], None if r["reasoning"] is None else step["reasoning"])


def rollout_records(spark: SparkSession, paths: str | list[str], source: str = "codex") -> DataFrame:
    """Logs of running totals: a record is the step between two totals. Totals that go down count as no step, a step whose
    cache is larger than its input is left out and keeps the older totals, and what a forked or subagent's log replays is not
    counted until its own first turn. Reasoning that no total names is not known. Files stream through in order; a task holds one file's last totals only."""
    rows = parsed(with_offsets(json_lines(spark, paths)), ROLLOUT).filter("j.type in ('session_meta', 'turn_context') or j.payload.info.total_token_usage is not null")
    t = "j.payload.info.total_token_usage"
    flat = rows.select(
        "file", "offset", F.col("j.type").alias("type"), iso_epoch(F.col("j.timestamp")).alias("timestamp"), F.col("j.payload.model").alias("model"), F.col("j.payload.cwd").alias("cwd"), (F.col("j.payload.forked_from_id").isNotNull() | F.col("j.payload.parent_thread_id").isNotNull() | (F.col("j.payload.thread_source") == "subagent")).alias("fork"),
        *[F.col(f"{t}.{c}").alias(n) for c, n in (("input_tokens", "input"), ("output_tokens", "output"), ("cached_input_tokens", "cached"), ("cache_write_input_tokens", "written"), ("reasoning_output_tokens", "reasoning"))],
    )
    names = [x.split()[0] for x in _STEPS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, totals = None, Totals()
        for frame in frames:
            out = []
            for r in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if r["file"] != file:
                    file, totals = r["file"], Totals()
                if (step := totals.step(r)) is not None:
                    out.append((file, r["offset"], *step))
            if out:
                made = pd.DataFrame(out, columns=names)
                yield made.astype({"reasoning": "Int64"})

    steps = flat.repartition("file").sortWithinPartitions("file", "offset").mapInPandas(run, _STEPS)
    return ledger_rows(
        steps, source, dedup_key=F.concat(F.lit(f"{source}:"), stem(F.col("file")), F.lit(":"), F.col("offset").cast("string")), timestamp="timestamp", model="model", project=absolute_project(F.col("cwd")),
        input_tokens="input", output_tokens="output", cache_read_tokens="cached", cache_write_5m_tokens="written", source_file="file", session_id=stem(F.col("file")), reasoning_tokens="reasoning",
    )


CHAT = "sessionId string, messages array<struct<id: string, timestamp: string, model: string, tokens: struct<input: bigint, output: bigint, cached: bigint, thoughts: bigint>>>"


def chat_records(spark: SparkSession, paths: str | list[str], source: str = "gemini") -> DataFrame:
    """`chat_rows` of the chat files below paths."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    return chat_rows(files.select(plain_path(F.col("_metadata.file_path")).alias("file"), "value"), source)


def chat_rows(files: DataFrame, source: str = "gemini") -> DataFrame:
    """files(file, value), a JSON object each: the input holds what was cached, the output lacks the thoughts. The first of
    equal message ids counts."""
    rows = files.select("file", F.from_json("value", CHAT).alias("j")).filter("j.messages is not null").select("file", F.col("j.sessionId").alias("session"), F.posexplode("j.messages").alias("n", "m"))
    made = ledger_rows(
        rows.filter("m.id is not null and m.tokens is not null"), source, dedup_key=F.concat_ws(":", F.lit(source), "session", "m.id"), timestamp=iso_epoch(F.col("m.timestamp")), model=F.col("m.model"),
        input_tokens=zero(F.col("m.tokens.input")) - zero(F.col("m.tokens.cached")), output_tokens=zero(F.col("m.tokens.output")) + zero(F.col("m.tokens.thoughts")), cache_read_tokens=F.col("m.tokens.cached"),
        source_file=F.col("file"), session_id=F.col("session"), reasoning_tokens=F.col("m.tokens.thoughts"), seq=F.struct("file", "n"),
    )
    first = W.Window.partitionBy("dedup_key").orderBy("seq")
    return made.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "seq")


#: The updates whose lines are understood.
UPDATES = ("agent_message_chunk", "agent_thought_chunk", "auto_compact_completed", "auto_compact_started", "compaction_checkpoint", "current_mode_update", "hook_execution", "image_compressed", "image_dropped", "plan", "retry_state", "session_recap", "subagent_finished", "subagent_spawned", "task_backgrounded", "task_completed", "tool_call", "tool_call_update", "turn_completed", "user_message_chunk")


def turn_records(spark: SparkSession, paths: str | list[str], source: str = "grok") -> DataFrame:
    """`turn_rows` of the update logs below paths."""
    return turn_rows(json_lines(spark, paths, "updates.jsonl"), source)


def turn_rows(lines: DataFrame, source: str = "grok") -> DataFrame:
    """lines(file, place, line) of update logs: a record for each completed turn, with ctx_ columns: what was billed is divided by what
    the chunks since the turn before weigh, thoughts against all else. Updates of other kinds or methods are left out. A file with a line
    that is no JSON, an update without a time, or a turn whose usage contradicts itself is left out whole."""
    v, u = F.col("v"), "$.params.update"
    text = lambda p: F.get_json_object("line", p)
    kind_of = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    count = lambda p: F.when(kind_of(p) == "BIGINT", F.try_variant_get(v, p, "bigint"))
    rows = lines.filter(F.trim("line") != "").select("file", "place", "line", F.try_parse_json("line").alias("v"))
    known = F.coalesce(text("$.method").isin("session/update", "_x.ai/session/update"), F.lit(True)) & (F.coalesce(text("$.params.sessionId"), F.lit("")) != "") & text(f"{u}.sessionUpdate").isin(*UPDATES)
    size = lambda p: F.coalesce(estimate(F.octet_length(text(p))), F.lit(0))
    counters = {"input": "inputTokens", "calls": "modelCalls", "output": "outputTokens", "cached": "cachedReadTokens", "written": "cacheCreationTokens", "reasoning": "reasoningTokens"}
    rows = rows.select(
        "file", "place", v.isNull().alias("broken"), F.coalesce(known, F.lit(False)).alias("known"), text(f"{u}.sessionUpdate").alias("kind"), count("$.timestamp").alias("t"), text("$.params.sessionId").alias("session"), F.nullif(text(f"{u}.prompt_id"), F.lit("")).alias("prompt"),
        text(f"{u}.usage").isNotNull().alias("billed"), *[text(f"{u}.usage.{c}").isNotNull().alias(f"has_{n}") for n, c in counters.items()], *[count(f"{u}.usage.{c}").alias(n) for n, c in counters.items()],
        size(f"{u}.content.text").alias("text_size"), (size(f"{u}.rawInput") + size(f"{u}.rawOutput") + size(f"{u}.content")).alias("tool_size"),
    )
    ends = F.col("kind") == "turn_completed"
    odd = F.lit(False)
    for n in counters:
        odd = odd | (F.col(f"has_{n}") & (F.coalesce(F.col(n), F.lit(-1)) < 0))
    odd = odd | ~F.col("has_input") | ~F.col("has_calls") | (zero(F.col("cached")) + zero(F.col("written")) > zero(F.col("input"))) | (zero(F.col("reasoning")) > zero(F.col("output"))) | (zero(F.col("calls")) < 1)
    empty = (zero(F.col("input")) == 0) & (zero(F.col("output")) == 0)
    wrong = F.col("broken") | F.col("known") & ((zero(F.col("t")) <= 0) | ends & F.col("billed") & (odd | ~empty & F.col("prompt").isNull()))
    bad = rows.groupBy("file").agg(F.bool_or(F.coalesce(wrong, F.lit(False))).alias("bad")).filter("bad").select("file")
    message = F.when(F.col("kind").isin("user_message_chunk", "agent_message_chunk"), F.col("text_size")).when(F.col("kind").isin("tool_call", "tool_call_update"), F.col("tool_size")).otherwise(0)
    thought = F.when(F.col("kind") == "agent_thought_chunk", F.col("text_size")).otherwise(0)
    before = W.Window.partitionBy("file").orderBy("place").rowsBetween(W.Window.unboundedPreceding, -1)
    turns = rows.filter("known").join(bad, "file", "left_anti").withColumn("turn", F.coalesce(F.count_if(ends).over(before), F.lit(0))).withColumn("msg", message).withColumn("reas", thought)
    sums = turns.groupBy("file", "turn").agg(F.sum("msg").alias("w_msg"), F.sum("reas").alias("w_reas"), F.max_by(F.struct("t", "session", "prompt", "billed", *counters), F.when(ends, F.col("place"))).alias("e")).filter("e.billed")
    rows = sums.select("file", F.col("w_msg").alias("msg"), F.col("w_reas").alias("reas"), "e.*")
    none = F.lit(0).cast("long")
    shown = folds.attributed(rows.withColumn("billed", F.col("input")).select("*", *[none.alias(c) for c in ("tool", "mcp", "skill", "sys")], (F.col("input") <= 0).alias("tainted")), observed=())
    made = ledger_columns(
        source, dedup_key=F.concat_ws(":", F.lit(source), "session", "prompt"), timestamp=epoch(F.col("t")), api_calls=F.col("calls"), input_tokens=F.col("input") - zero(F.col("cached")) - zero(F.col("written")), output_tokens=F.col("output"), cache_read_tokens=F.col("cached"), cache_write_5m_tokens=F.col("written"),
        source_file=F.col("file"), session_id=F.col("session"), reasoning_tokens=F.col("reasoning"),
    )
    parts = ["ctx_messages", "ctx_system", "ctx_reasoning", F.lit(None).cast("long").alias("ctx_toolcalls"), "ctx_agents", "ctx_mcp", "ctx_skills"]
    return shown.select(*made, *parts).filter((total_tokens() > 0) & F.col("timestamp").isNotNull())


LINES = "type string, id string, sessionId string, timestamp bigint, cwd string, providerData struct<requestModelId: string, model: string, usage: struct<requests: bigint, inputTokens: bigint, outputTokens: bigint>, rawUsage: struct<prompt_cache_hit_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint, prompt_cache_write_tokens: bigint, completion_thinking_tokens: bigint>>"


def line_records(spark: SparkSession, paths: str | list[str], source: str = "workbuddy") -> DataFrame:
    """Line logs: a record for each call, message or summary with usage. Logs in a folder subagents belong to the session
    whose folder that lies in."""
    rows = parsed(json_lines(spark, paths), LINES).filter("j.type in ('function_call', 'message', 'summary') and j.providerData.usage is not null")
    raw, used = "j.providerData.rawUsage", "j.providerData.usage"
    cached = F.coalesce(F.nullif(F.col(f"{raw}.prompt_cache_hit_tokens"), F.lit(0)), F.nullif(F.col(f"{raw}.cache_read_input_tokens"), F.lit(0)), F.lit(0))
    written = F.greatest(zero(F.col(f"{raw}.cache_creation_input_tokens")), zero(F.col(f"{raw}.prompt_cache_write_tokens")))
    parent = F.nullif(F.regexp_extract("file", "([^/]+)/subagents/", 1), F.lit(""))
    return ledger_rows(
        rows, source, dedup_key=F.concat(F.lit(f"{source}:"), F.col("j.id")), timestamp=epoch(F.col("j.timestamp")), model=F.coalesce("j.providerData.requestModelId", "j.providerData.model"), project=absolute_project(F.col("j.cwd")),
        api_calls=F.greatest(zero(F.col(f"{used}.requests")), F.lit(1)), input_tokens=zero(F.col(f"{used}.inputTokens")) - cached - written, output_tokens=F.col(f"{used}.outputTokens"), cache_read_tokens=cached, cache_write_5m_tokens=written,
        source_file=F.col("file"), session_id=F.coalesce(parent, F.col("j.sessionId")), reasoning_tokens=F.col(f"{raw}.completion_thinking_tokens"), seq=F.struct("file", "place"),
    )


def call_ledger(spark: SparkSession, paths: str | list[str], source: str = "claude") -> DataFrame:
    """`call_records` with ctx_ columns: how each call's context divides, from what its file logged before. A message that is
    logged by calls replaces what its earlier lines booked under its plain key."""
    lines = json_lines(spark, paths)
    rows = call_records(spark, paths, source)
    own = rows.select("dedup_key", F.col("seq.file").alias("file"), F.col("seq.place").alias("place"), (F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).alias("billed"))
    i = F.coalesce(F.regexp_extract("dedup_key", "#it([0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("i")
    about = parsed(lines, "sessionId string, isSidechain boolean").select("file", "place", F.coalesce("j.sessionId", stem(F.col("file"))).alias("session"), F.col("j.isSidechain").alias("sidechain"))
    shares = folds.call_contexts(lines.select("file", "place", "line"), own.select("*", i).join(about, ["file", "place"]))
    parts = [f"ctx_{c}" for c in ("messages", "system", "reasoning", "toolcalls", "agents", "mcp", "skills")]
    with_parts = rows.join(shares.select("dedup_key", F.struct("file", "place").alias("seq"), *parts), ["dedup_key", "seq"])
    plain = with_parts.filter(F.col("dedup_key").contains("#it")).select(F.regexp_replace("dedup_key", "#it[0-9]+$", "").alias("dedup_key"), F.col("seq.file").alias("source_file")).distinct()
    return with_parts.join(plain, ["dedup_key", "source_file"], "left_anti")


def rollout_ledger(spark: SparkSession, paths: str | list[str], source: str = "codex") -> DataFrame:
    """`rollout_records` with ctx_ columns."""
    rows = rollout_records(spark, paths, source)
    at = F.element_at(F.split("dedup_key", ":"), -1).cast("long").alias("place")
    own = rows.select(F.col("source_file").alias("file"), at, (F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_5m_tokens")).alias("billed"))
    lines = with_offsets(json_lines(spark, paths)).select("file", F.col("offset").alias("place"), "line")
    shares = folds.rollout_contexts(lines, own).select(F.col("file").alias("source_file"), F.col("place").alias("p"), *[f"ctx_{c}" for c in ("messages", "system", "reasoning", "toolcalls", "agents", "mcp", "skills")])
    return rows.join(shares, (rows.source_file == shares.source_file) & (F.element_at(F.split("dedup_key", ":"), -1).cast("long") == F.col("p"))).drop(shares.source_file, shares.p)


def chat_lines(lines: DataFrame) -> DataFrame:
    """lines(file, place, line) of chats that are logged line by line -> files(file, value) as `chat_records` reads them."""
    rows = lines.select("file", "place", F.get_json_object("line", "$.sessionId").alias("session"), F.when(F.get_json_object("line", "$.tokens").isNotNull(), F.col("line")).alias("m"))
    each = rows.groupBy("file").agg(F.max("session").alias("session"), F.array_sort(F.collect_list(F.struct("place", "m"))).alias("ms"))
    return each.select("file", F.concat(F.lit('{"sessionId":"'), F.coalesce("session", stem(F.col("file"))), F.lit('","messages":['), F.array_join(F.transform(F.filter("ms", lambda x: x["m"].isNotNull()), lambda x: x["m"]), ","), F.lit("]}")).alias("value"))


def chat_projects(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Chat records with a project: rows(source_file, ..) lie in a folder named by a hash or a friendly name, projects(real,
    friendly) says which path that stands for; else the first eight characters of the folder."""
    folder = F.element_at(F.split("source_file", "/"), -3)
    known = projects.groupBy(F.col("friendly").alias("p_name")).agg(F.min("real").alias("p_real"))
    return rows.withColumn("folder", folder).join(known, F.col("folder") == F.col("p_name"), "left").withColumn("project", F.coalesce("p_real", F.substring("folder", 1, 8))).drop("folder", "p_name", "p_real")


def turn_projects(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Turn records with the project and model of their session's summary.json(file, text), else the folder's decoded name."""
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    about = summaries.select(F.regexp_replace("file", "/[^/]*$", "").alias("s_folder"), F.get_json_object("text", "$.info.cwd").alias("s_cwd"), F.get_json_object("text", "$.current_model_id").alias("s_model")).dropDuplicates(["s_folder"])
    named = F.try_url_decode(F.element_at(F.split("source_file", "/"), -3))
    joined = rows.withColumn("folder", folder).join(about, F.col("folder") == F.col("s_folder"), "left")
    return joined.withColumn("project", F.coalesce(absolute_project(F.col("s_cwd")), absolute_project(named))).withColumn("model", F.coalesce("model", "s_model")).drop("folder", "s_folder", "s_cwd", "s_model")


def legacy_headers(lines: DataFrame, modern: DataFrame, source: str = "goose") -> DataFrame:
    """lines(file, place, line, mtime) of old session files: the first line's counters, the accumulated ones where any is set;
    sessions that modern(session_id) holds are left out. The model is not known."""
    first = lines.groupBy("file").agg(F.min_by("line", "place").alias("line"), F.max("mtime").alias("mtime"))
    field = lambda *names: F.coalesce(*[nonnegative(F.get_json_object("line", f"$.{n}")) for n in names])
    some = F.coalesce(F.greatest(*[field(f"accumulated_{c}_tokens") for c in ("input", "output", "total")]), F.lit(0)) > 0
    pick = lambda c: F.when(some, field(f"accumulated_{c}_tokens")).otherwise(field(f"{c}_tokens", f"usage.{c}_tokens"))
    text = lambda n: F.get_json_object("line", f"$.{n}")
    named = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract("file", r"([0-9]{8}_[0-9]{6})[^/]*$", 1), F.lit("yyyyMMdd_HHmmss")))
    at = F.coalesce(iso_epoch(F.replace(text("updated_at"), F.lit(" "), F.lit("T"))), iso_epoch(F.replace(text("created_at"), F.lit(" "), F.lit("T"))), named, F.col("mtime"))
    rows = first.withColumn("session", F.coalesce(text("id"), stem(F.col("file")))).join(modern.select(F.col("session_id").alias("session")).distinct(), "session", "left_anti")
    read, written = zero(pick("cache_read")), zero(pick("cache_write"))
    return ledger_rows(rows, source, dedup_key=F.concat(F.lit(f"{source}:session:"), F.col("session")), timestamp=at, project=absolute_project(text("working_dir")), input_tokens=zero(pick("input")) - read - written, output_tokens=pick("output"), cache_read_tokens=read, cache_write_5m_tokens=written, source_file="file", session_id="session")


def pruned_sessions(known: DataFrame, transcripts: DataFrame) -> DataFrame:
    """known(session_id, cwd, title, created_at, updated_at, deleted_at): sessions without a transcript, as metadata."""
    return known.filter("deleted_at is null").drop("deleted_at").join(transcripts.select("session_id").distinct(), "session_id", "left_anti")


EXPORT = "schema int, source string, fetched_at bigint, plan string, metering_regime string, account_id string, windows array<struct<key: string, window_minutes: bigint, used_pct: double, resets_at: bigint, evidence: struct<limit_id: string, model_scope: string>>>"


def limit_exports(spark: SparkSession, paths: str | list[str], source: str | None = None) -> DataFrame:
    """Limit readings from exports of the known schema versions (1 to 4). source: exports of any other are refused."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    rows = files.select(F.from_json("value", EXPORT).alias("j")).filter("j.schema between 1 and 4").filter(F.lit(True) if source is None else F.col("j.source") == source).select("j", F.explode("j.windows").alias("w"))
    return rows.filter("w.resets_at is not null and w.used_pct is not null").select(
        F.col("j.source").alias("source"), F.col("w.key").alias("window_key"), F.col("w.window_minutes").alias("window_minutes"), F.col("w.used_pct").alias("used_pct"), F.col("w.resets_at").alias("resets_at"), F.col("j.fetched_at").alias("observed_at"), F.lit("export").alias("via"),
        F.col("j.plan").alias("plan"), F.col("j.account_id").alias("account_id"), F.col("j.metering_regime").alias("metering_regime"), F.col("w.evidence.limit_id").alias("limit_id"), F.col("w.evidence.model_scope").alias("model_scope"),
        F.lit(None).cast("long").alias("source_order"), F.lit(None).cast("long").alias("covered_from"), F.lit(None).cast("string").alias("external_activity"),
    )
