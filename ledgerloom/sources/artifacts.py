"""More kinds of logs: message tables, chat rows, task files, entry trees, threads, generations and limits in logs.

Each parser takes a DataFrame of what the artifact holds and returns ledger rows or limit readings, so that it is the same
for files, tables and tests; the readers beside them only fetch rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.functions import pandas_udf

from ledgerloom.functions.formats import absolute_project, epoch, iso_epoch, nonnegative, window_key
from ledgerloom.operators import folds
from ledgerloom.operators.usage import total_tokens
from ledgerloom.sources.lines import json_lines, stem, zero
from ledgerloom.sources.records import ledger_rows
from ledgerloom.sources.sqlite import sqlite_rows

#: Names that a routing plugin writes, and the models they stand for.
ROUTED = {"gemini-3-pro": "gemini-3-pro-preview", "gemini-3-pro-preview": "gemini-3-pro-preview", "gemini-3-flash": "gemini-3-flash-preview", "gemini-3-flash-preview": "gemini-3-flash-preview", "claude-sonnet-4-5": "claude-sonnet-4-5", "claude-opus-4-5": "claude-opus-4-5"}
#: Names of models in generations, and the models they stand for.
GENERATED = {
    "gemini-3-flash-a": "gemini-3.5-flash", "gemini-3-flash-b": "gemini-3.5-flash", "gemini-3-flash-c": "gemini-3.5-flash", "gemini-3-flash": "gemini-3.5-flash", "gemini-3-flash-agent": "gemini-3.5-flash",
    "gemini-3-pro-high": "gemini-3-pro-preview", "gemini-3-pro-low": "gemini-3-pro-preview", "gemini-3.1-pro-high": "gemini-3.1-pro-preview", "gemini-3.1-pro-low": "gemini-3.1-pro-preview",
    "claude-opus-4-5-thinking": "claude-opus-4-5", "claude-opus-4-6-thinking": "claude-opus-4-6",
}
#: The default model of an era, until the second given (None: since then).
DEFAULTS = ((1742860800, "gemini-2.0-flash"), (1779148800, "gemini-2.5-flash"), (None, "gemini-3.5-flash"))
#: Numbers of models in exports, and the names that stand for the same.
NUMBERED = {1008: "gemini-3-pro-high", 1012: "claude-opus-4-5-thinking", 1018: "gemini-3-flash", 1047: "gemini-3-flash-c", 1026: "claude-opus-4-6-thinking", 1035: "claude-sonnet-4-6", 1036: "gemini-3.1-pro-low", 1037: "gemini-3.1-pro-high", 1084: "gemini-default"}
#: Aliases of chat models: in both editions, and where the editions differ (Chinese, other).
CHAT_ALIASES = {"qmodel_38max": "qwen3.8-max", "qmodel_preview": "qwen3.8-max-preview", "qmodel_latest": "qwen3.7-max", "qmodel": "qwen3.7-plus", "q36fmodel": "qwen3.6-flash", "dmodel": "deepseek-v4-pro", "dfmodel": "deepseek-v4-flash", "gm51model": "glm-5.2", "kmodel_latest": "kimi-k3", "cmodel": "cantus"}
EDITION_ALIASES = {"kmodel": ("kimi-k2.6", "kimi-k2.7-code"), "mmodel": ("minimax-m2.7", "minimax-m3")}


def _mapped(name: Column, names: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), other)


def routed_model(name: Column) -> Column:
    """The model behind a routing plugin's name: its prefix and its variant go; a name that is not known stays as it is."""
    base = F.regexp_replace(F.regexp_replace(name, "^antigravity-", ""), "(-thinking(-.*)?|-(minimal|low|medium|high|max))$", "")
    return F.when(name.startswith("antigravity-"), _mapped(base, ROUTED, name)).otherwise(name)


def generated_model(name: Column, at: Column) -> Column:
    era = F.lit(DEFAULTS[-1][1])
    for until, model in reversed(DEFAULTS[:-1]):
        era = F.when(at < until, model).otherwise(era)
    return F.when(F.lower(name) == "gemini-default", era).otherwise(_mapped(F.lower(name), GENERATED, name))


def numbered_model(number: Column, at: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NUMBERED.items() for x in pair])
    return generated_model(F.try_element_at(table, number.cast("int")), at)


def chat_model(name: Column, chinese: Column, discovered: Column | None = None) -> Column:
    """The model behind an alias; discovered: a map of aliases that the edition's own logs name, which goes first."""
    out = _mapped(name, CHAT_ALIASES, name)
    for alias, (there, here) in EDITION_ALIASES.items():
        out = F.when(name == alias, F.when(chinese, there).otherwise(here)).otherwise(out)
    return out if discovered is None else F.coalesce(F.try_element_at(discovered, name), out)


_MESSAGE = "id string, role string, modelID string, tokens struct<input: string, output: string, reasoning: string, cache_read: string, cache_write: string, cache: struct<read: string, write: string>>"


def message_rows(messages: DataFrame, sessions: DataFrame, source: str = "opencode") -> DataFrame:
    """messages(file, id, session_id, time_created, data) and sessions(id, directory, time_created, time_updated), times in
    milliseconds: a record for each assistant message; counters that are no whole numbers make it none."""
    rows = messages.withColumn("d", F.from_json("data", _MESSAGE)).filter("d.role = 'assistant' and d.tokens is not null")
    about = sessions.select(F.col("id").alias("s_id"), "directory", F.coalesce("time_updated", "time_created").alias("s_time")).dropDuplicates(["s_id"])
    rows = rows.join(about, F.col("session_id") == F.col("s_id"), "left")
    given = {"input": F.col("d.tokens.input"), "output": F.col("d.tokens.output"), "read": F.coalesce("d.tokens.cache.read", "d.tokens.cache_read"), "write": F.coalesce("d.tokens.cache.write", "d.tokens.cache_write"), "reasoning": F.col("d.tokens.reasoning")}
    for name, value in given.items():
        rows = rows.withColumn(name, nonnegative(value)).withColumn(f"bad_{name}", value.isNotNull() & nonnegative(value).isNull())
    rows = rows.filter(~(F.col("bad_input") | F.col("bad_output") | F.col("bad_read") | F.col("bad_write") | F.col("bad_reasoning")))
    at = F.when(F.col("time_created") > 0, F.col("time_created")).otherwise(F.col("s_time"))
    return ledger_rows(
        rows, source, dedup_key=F.concat(F.lit(f"{source}:session:"), F.col("session_id"), F.lit(":message:"), F.coalesce(F.nullif("id", F.lit("")), F.col("d.id"))), timestamp=epoch(at), model=routed_model(F.nullif(F.col("d.modelID"), F.lit(""))), project=absolute_project(F.col("directory")),
        input_tokens="input", output_tokens="output", cache_read_tokens="read", cache_write_5m_tokens="write", source_file="file", session_id="session_id", reasoning_tokens=F.least(F.col("reasoning"), zero(F.col("output"))),
    )


def superseded_prefixes(records: DataFrame, source: str = "opencode") -> DataFrame:
    """(prefix): aggregates of the sessions that records replace, for `merge.supersede`."""
    return records.select(F.concat(F.lit(f"{source}:session:"), F.col("session_id"), F.lit(":")).alias("prefix")).distinct()


def opencode_records(spark: SparkSession, path: str) -> DataFrame:
    messages = sqlite_rows(spark, path, "SELECT id, session_id, time_created, data FROM message", "file string, id string, session_id string, time_created bigint, data string")
    return message_rows(messages, sqlite_rows(spark, path, "SELECT id, directory, time_created, time_updated FROM session", "id string, directory string, time_created bigint, time_updated bigint"))


def opencode_legacy(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(file, text) of the older store -> (messages, sessions) for `message_rows`; a message without an id is called by its
    path below its session's folder."""
    j = files.select("file", "text", F.try_parse_json("text").alias("v")).filter("v is not null")
    text = lambda p: F.try_variant_get("v", p, "string")
    number = lambda p: F.try_variant_get("v", p, "bigint")
    sessions = j.filter(F.col("file").contains("/session/")).select(text("$.id").alias("id"), text("$.directory").alias("directory"), number("$.time.created").alias("time_created"), number("$.time.updated").alias("time_updated"))
    named = F.coalesce(F.nullif(text("$.id"), F.lit("")), F.regexp_extract("file", r"/message/[^/]+/(.+)\.[^.]*$", 1))
    messages = j.filter(F.col("file").contains("/message/")).select("file", named.alias("id"), F.coalesce(text("$.sessionID"), F.regexp_extract("file", "/message/([^/]+)/", 1)).alias("session_id"), number("$.time.created").alias("time_created"), F.col("text").alias("data"))
    return messages, sessions


def chat_rows(messages: DataFrame, sessions: DataFrame, source: str = "qoder", discovered: Column | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """messages(file, id, session_id, token_info, model_info, gmt_create ms) and sessions(session_id, parent_session_id): the
    input holds what was cached; a session whose messages name no model takes its parent's first. aliases(chinese, alias,
    model): what the editions' own logs say, see `discovery.model_aliases`; it goes before what is known."""
    rows = messages.filter("token_info is not null and token_info <> '' and gmt_create > 0").withColumn("t", F.from_json("token_info", "prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint")).filter("t is not null")
    named = F.nullif(F.get_json_object("model_info", "$.model_key"), F.lit(""))
    rows = rows.withColumn("named", named).withColumn("session", F.nullif(F.trim("session_id"), F.lit("")))
    first = messages.withColumn("named", named).filter("named is not null").groupBy(F.col("session_id").alias("p_id")).agg(F.min_by("named", "id").alias("p_named"))
    parents = sessions.filter("parent_session_id <> ''").select(F.col("session_id").alias("c_id"), "parent_session_id").dropDuplicates(["c_id"]).join(first, F.col("parent_session_id") == F.col("p_id")).select("c_id", "p_named")
    rows = rows.join(parents, F.col("session") == F.col("c_id"), "left")
    cached = zero(F.col("t.cached_tokens"))
    chinese, named = F.lower("file").rlike("/(qodercn|[.]qoder-cn)/"), F.coalesce("named", "p_named")
    model = chat_model(named, chinese, discovered)
    if aliases is not None:
        told = aliases.select(F.col("chinese").alias("a_chinese"), F.col("alias").alias("a_alias"), F.col("model").alias("a_model"))
        rows = rows.join(told, (chinese == F.col("a_chinese")) & (named == F.col("a_alias")), "left")
        model = F.coalesce("a_model", model)
    return ledger_rows(
        rows, source, dedup_key=F.concat(F.lit(f"{source}:"), F.col("id")), timestamp=epoch(F.col("gmt_create")), model=model, input_tokens=zero(F.col("t.prompt_tokens")) - cached,
        output_tokens=F.col("t.completion_tokens"), cache_read_tokens=cached, source_file="file", session_id="session",
    )


def qoder_records(spark: SparkSession, path: str, aliases: DataFrame | None = None) -> DataFrame:
    messages = sqlite_rows(spark, path, "SELECT id, session_id, token_info, model_info, gmt_create FROM chat_message", "file string, id string, session_id string, token_info string, model_info string, gmt_create bigint")
    return chat_rows(messages, sqlite_rows(spark, path, "SELECT session_id, parent_session_id FROM chat_session", "session_id string, parent_session_id string"), aliases=aliases)


def unbooked_calls(lines: DataFrame, booked: DataFrame, source: str = "qoder") -> DataFrame:
    """lines(file, line) of call logs: requests without any token, as (path, source, requests, first_at, last_at), less those
    whose key booked(dedup_key) has."""
    j = lines.select("file", F.from_json("line", "type string, timestamp string, message struct<id: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>").alias("j")).filter("j.type = 'assistant' and j.message.id is not null and j.message.usage is not null")
    used = sum((zero(F.col(f"j.message.usage.{c}")) for c in ("output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")), zero(F.col("j.message.usage.input_tokens")))
    empty = j.filter(used == 0).select("file", F.concat(F.lit(f"{source}:"), F.col("j.message.id")).alias("dedup_key"), iso_epoch(F.col("j.timestamp")).alias("at")).groupBy("file", "dedup_key").agg(F.min("at").alias("at"))
    left = empty.join(booked.select("dedup_key"), "dedup_key", "left_anti")
    return left.groupBy(F.col("file").alias("path")).agg(F.lit(source).alias("source"), F.count("*").alias("requests"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


_TASK = "array<struct<say: string, ts: string, timestamp: string, text: string, id: string, requestId: string, request_id: string, model: string, cwd: string>>"
_TASK_TEXT = "tokensIn string, tokensOut string, cacheReads string, cacheWrites string, id string, requestId string, request_id string, model string"
#: How far files are believed when they hold the same request.
FILE_RANKS = {"claude_messages.json": 0, "ui_messages.json": 2}


def task_rows(files: DataFrame, source: str = "cline") -> DataFrame:
    """files(file, text, history): arrays of messages of editor tasks, or objects of command-line sessions that hold one.
    Requests are told by their own id, else their time, else their number; the started request counts, the finished one
    where it has none. The same request in several files is taken from the most trusted, and what it lacks from the others."""
    session = F.coalesce(*[F.get_json_object("text", f"$.{k}") for k in ("sessionId", "session_id", "id", "session.id")], F.nullif(F.regexp_extract("file", r".*/tasks/([^/]+)/", 1), F.lit("")), F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1))
    version = F.coalesce(F.get_json_object("text", "$.version").try_cast("int"), F.lit(1))
    messages = F.from_json(F.when(F.ltrim("text").startswith("["), F.col("text")).otherwise(F.get_json_object("text", "$.messages")), _TASK)
    tags = lambda *names: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce("history", F.lit("")), F.lit(f"<{n}>\\s*([^<]+?)\\s*</{n}>")) for n in names])))
    alone = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    place = F.array_distinct(F.concat(tags("cwd", "current_working_directory"), F.regexp_extract_all(F.coalesce("history", F.lit("")), F.lit(r"# Current Working Directory \(([^)]+)\)"))))
    rows = files.withColumn("session", session).filter(version <= 1).select("file", "session", alone(tags("model")).alias("h_model"), alone(F.filter(place, lambda p: absolute_project(p).isNotNull())).alias("h_project"), F.posexplode(messages).alias("n", "m"))
    rows = rows.filter("m.say in ('api_req_started', 'api_req_finished')").withColumn("t", F.from_json("m.text", _TASK_TEXT)).filter("t is not null")
    given = {"input": "tokensIn", "output": "tokensOut", "read": "cacheReads", "write": "cacheWrites"}
    for name, field in given.items():
        rows = rows.withColumn(name, F.coalesce(nonnegative(F.col(f"t.{field}")), F.lit(0)))
    stamp = F.coalesce("m.ts", "m.timestamp")
    at = F.coalesce(iso_epoch(stamp), epoch(stamp.try_cast("bigint")))
    ident = F.coalesce(*[F.nullif(F.col(f"{o}.{k}"), F.lit("")) for o in ("m", "t") for k in ("requestId", "request_id", "id")], F.concat(F.lit("ts:"), at.cast("string")))
    rows = rows.filter("input + output + read + write > 0").withColumn("at", at).filter("at is not null").withColumn("ident", ident).withColumn("started", F.col("m.say") == "api_req_started")
    rows = rows.withColumn("index", F.row_number().over(W.Window.partitionBy("file", "started").orderBy("n")) - 1)
    one = rows.groupBy("file", "session", "index").agg(F.min_by(F.struct("ident", "at", "input", "output", "read", "write", F.coalesce("m.model", "t.model", "h_model").alias("model"), F.coalesce("m.cwd", "h_project").alias("project")), F.when(F.col("started"), 0).otherwise(1)).alias("r")).select("file", "session", "index", "r.*")
    key = F.concat(F.lit(f"{source}:session:"), F.col("session"), F.lit(":request:"), F.coalesce("ident", F.concat(F.lit("index:"), F.col("index").cast("string"))))
    name = F.substring_index("file", "/", -1)
    rank = F.lit(3)
    for known, value in FILE_RANKS.items():
        rank = F.when(name == known, value).otherwise(rank)
    order = F.struct((-rank).alias("rank"), F.col("file").alias("file"))
    made = one.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct("file", "session", "at", "input", "output", "read", "write"), order).alias("w"), *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("model", "project")]).select("key", "w.*", "model", "project")
    return ledger_rows(made, source, dedup_key="key", timestamp="at", model="model", project=absolute_project(F.col("project")), input_tokens="input", output_tokens="output", cache_read_tokens="read", cache_write_5m_tokens="write", source_file="file", session_id="session")


_USED = "struct<input: bigint, output: bigint, cacheRead: bigint, cacheWrite: bigint, cacheWrite1h: bigint, reasoning: bigint>"
_ENTRY = f"type string, id string, parentId string, timestamp string, cwd string, modelId string, model string, fromHook boolean, firstKeptEntryId string, summary string, usage {_USED}, message struct<role: string, model: string, responseModel: string, toolName: string, timestamp: bigint, content: string, usage: {_USED}>"
_ENTRY_BLOCK = "array<struct<type: string, text: string, thinking: string, arguments: string, name: string>>"


def tree_entries(lines: DataFrame) -> DataFrame:
    """lines(file, place, line) -> the entries of tree logs with what each adds to a context, its usage and its session."""
    j = lines.select("file", "place", F.from_json("line", _ENTRY).alias("j"), F.try_parse_json("line").alias("v")).filter("j.type is not null")
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    head = j.filter("j.type = 'session'").groupBy("file").agg(F.max_by(F.struct(F.col("j.id").alias("session"), F.col("j.cwd").alias("cwd")), "place").alias("h")).select(F.col("file").alias("h_file"), "h.*")
    text = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant")) == "STRING", F.lit(False))
    parts = F.coalesce(F.from_json("j.message.content", _ENTRY_BLOCK), F.array().cast(_ENTRY_BLOCK))
    sized = lambda kind, field: F.aggregate(F.filter(parts, lambda b: b["type"] == kind), F.lit(0).cast("long"), lambda s, b: s + folds.size_of(b[field]))
    said = F.when(text, folds.size_of(F.col("j.message.content"))).otherwise(sized("text", "text"))
    role, kind = F.col("j.message.role"), F.col("j.type")
    is_ = lambda name: (kind == "message") & (role == name)
    shown = F.when(kind == "compaction", "compaction").when(kind == "model_change", "model").when(is_("user"), "user").when(is_("assistant"), "assistant").when(is_("toolResult"), "tool").otherwise("other")
    calls = sized("toolCall", "arguments")
    rows = j.filter("j.type <> 'session'").select(
        "file", "place", empty(F.col("j.id")).alias("id"), empty(F.col("j.parentId")).alias("parent"), shown.alias("kind"), empty(F.col("j.timestamp")).alias("at"),
        F.when(is_("assistant"), F.coalesce(empty(F.col("j.message.responseModel")), empty(F.col("j.message.model")))).when(kind == "model_change", F.coalesce(empty(F.col("j.modelId")), empty(F.col("j.model")))).alias("model"),
        F.when(kind == "compaction", folds.size_of(F.col("j.summary"))).when(is_("user") | is_("toolResult"), said).when(is_("assistant"), sized("text", "text") + calls).otherwise(0).alias("msg"),
        F.when(is_("assistant"), calls).when(is_("toolResult"), said).otherwise(0).alias("tool"), F.when(is_("assistant"), sized("thinking", "thinking")).otherwise(0).alias("reas"),
        empty(F.col("j.firstKeptEntryId")).alias("kept"), F.coalesce("j.fromHook", F.lit(False)).alias("hooked"), F.when(kind == "compaction", F.col("j.usage")).otherwise(F.col("j.message.usage")).alias("used"), F.col("j.message.timestamp").alias("ms"),
    )
    return rows.join(head, F.col("file") == F.col("h_file"), "left").drop("h_file")


def tree_rows(lines: DataFrame, source: str = "pi") -> DataFrame:
    """Records of tree logs with ctx_ columns: assistants' calls, compactions and tools that did work of their own. With seq,
    for keep-max merging of copies."""
    entries = tree_entries(lines).withColumn("n", F.struct("file", "place"))
    folded = folds.tree_contexts(entries.select("file", "place", F.coalesce("id", F.concat(F.lit("#"), F.xxhash64("n").cast("string"))).alias("id"), "parent", "kind", "at", "model", "msg", "tool", "reas", "kept", "hooked"))
    folded = folded.select(F.col("file").alias("f"), F.col("id").alias("i"), F.col("model").alias("active"), F.col("msg").alias("b_msg"), F.col("tool").alias("b_tool"), F.col("reas").alias("b_reas"))
    rows = entries.filter("used is not null and kind in ('assistant', 'compaction', 'tool')").join(folded, (F.col("file") == F.col("f")) & (F.coalesce("id", F.concat(F.lit("#"), F.xxhash64("n").cast("string"))) == F.col("i")))
    plus = lambda c: F.greatest(zero(F.col(f"used.{c}")), F.lit(0).cast("long"))
    hour = F.least(plus("cacheWrite1h"), plus("cacheWrite"))
    at = F.coalesce(F.expr("ms div 1000"), iso_epoch(F.col("at")))
    what = F.when(F.col("kind") == "assistant", "assistant").when(F.col("kind") == "compaction", "compaction").otherwise("toolResult")
    from ledgerloom.functions.formats import legacy_key

    reasoning = F.least(F.greatest(F.col("used.reasoning"), F.lit(0)), plus("output"))
    model = F.when(F.col("kind") != "tool", F.col("active"))
    key = F.when(F.col("id").isNotNull() & F.col("at").isNotNull(), F.concat_ws(":", F.lit(source), what, "id", "at")).otherwise(legacy_key(F.lit(source), what, F.col("ms"), at, F.col("at"), model, [plus("input"), plus("output"), plus("cacheRead"), plus("cacheWrite") - hour, hour, reasoning]))
    made = rows.select("file", "place", key.alias("key"), at.alias("t"), model.alias("model"), absolute_project(F.col("cwd")).alias("project"), F.nullif("session", F.lit("")).alias("session"), plus("input").alias("input"), plus("output").alias("output"), plus("cacheRead").alias("read"), (plus("cacheWrite") - hour).alias("five"), hour.alias("hour"), reasoning.alias("reasoning"), "kind", "b_msg", "b_tool", "b_reas")
    none = F.lit(0).cast("long")
    shown = folds.attributed(made.select("key", F.col("file").alias("c_file"), F.col("place").alias("c_place"), (F.col("input") + F.col("read") + F.col("five") + F.col("hour")).alias("billed"), F.col("b_msg").alias("msg"), F.col("b_tool").alias("tool"), F.col("b_reas").alias("reas"), none.alias("mcp"), none.alias("skill"), none.alias("sys"), (F.col("kind") == "tool").alias("tainted")), observed=())
    booked = ledger_rows(made, source, dedup_key="key", timestamp="t", model="model", project="project", input_tokens="input", output_tokens="output", cache_read_tokens="read", cache_write_5m_tokens="five", cache_write_1h_tokens="hour", source_file="file", session_id="session", reasoning_tokens="reasoning", seq=F.struct("file", "place"))
    parts = shown.select(F.col("key").alias("dedup_key"), F.struct(F.col("c_file").alias("file"), F.col("c_place").alias("place")).alias("seq"), "ctx_messages", "ctx_system", "ctx_reasoning", "ctx_toolcalls", "ctx_agents", "ctx_mcp", "ctx_skills")
    return booked.join(parts, ["dedup_key", "seq"])


def pi_records(spark: SparkSession, paths: str | list[str], source: str = "pi") -> DataFrame:
    return tree_rows(json_lines(spark, paths).withColumnRenamed("value", "line"), source)


_THREAD = "version string, cumulative_token_usage struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>, request_token_usage map<string, string>, model struct<provider: string, model: string>"


def _unpacked(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import zstandard

    def text(value: bytes | None) -> str | None:
        try:
            return None if value is None else zstandard.ZstdDecompressor().decompressobj().decompress(bytes(value)).decode()
        except (zstandard.ZstdError, UnicodeDecodeError):
            return None

    for some in data:
        yield some.map(text)


def thread_rows(threads: DataFrame, source: str = "zed") -> DataFrame:
    """threads(file, id, updated_at, data_type, data, folder_paths): packed threads of the host's own provider; of a thread in
    several files the newest counts, then the larger."""
    rows = threads.filter("lower(trim(data_type)) = 'zstd'").withColumn("t", F.from_json(pandas_udf("string")(_unpacked)("data"), _THREAD)).filter("t.model.provider = 'zed.dev' and t.cumulative_token_usage is not null")
    at = F.coalesce(epoch(F.trim("updated_at").try_cast("bigint")), iso_epoch(F.trim("updated_at")))
    project = F.get(F.filter(F.transform(F.split(F.coalesce("folder_paths", F.lit("")), "\n"), lambda p: F.trim(p)), lambda p: absolute_project(p).isNotNull()), F.lit(0))
    used = "t.cumulative_token_usage"
    made = ledger_rows(
        rows, source, dedup_key=F.concat(F.lit(f"{source}:thread:"), F.col("id")), timestamp=at, model=F.col("t.model.model"), project=project, api_calls=F.greatest(F.coalesce(F.size("t.request_token_usage"), F.lit(0)), F.lit(1)), input_tokens=F.col(f"{used}.input_tokens"), output_tokens=F.col(f"{used}.output_tokens"),
        cache_read_tokens=F.col(f"{used}.cache_read_input_tokens"), cache_write_5m_tokens=F.col(f"{used}.cache_creation_input_tokens"), source_file="file", session_id="id",
    )
    rest = [c for c in made.columns if c != "dedup_key"]
    return made.groupBy("dedup_key").agg(F.max_by(F.struct(*rest), F.struct(F.col("timestamp"), total_tokens().alias("n"))).alias("r")).select("dedup_key", "r.*")


def zed_records(spark: SparkSession, path: str) -> DataFrame:
    return thread_rows(sqlite_rows(spark, path, "SELECT id, updated_at, data_type, data, folder_paths FROM threads", "file string, id string, updated_at string, data_type string, data binary, folder_paths string"))


def wire_fields(data: bytes) -> dict[int, int | bytes]:
    """The first value of each field of a protobuf message: whole numbers or bytes. What can't be read ends the message."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value & (1 << 64) - 1

    try:
        while at < len(data):
            key = number()
            field, wire = key >> 3, key & 7
            if wire == 0:
                out.setdefault(field, number())
            elif wire == 2:
                size = number()
                if at + size > len(data):
                    break
                out.setdefault(field, data[at : at + size])
                at += size
            elif wire in (1, 5):
                at += 8 if wire == 1 else 4
            else:
                break
    except IndexError:
        pass
    return out


_GENERATION = "input long, output long, read long, reasoning long, at long, model string, response string, write long, number long, planner string"


def _generation(data: bytes | None) -> tuple:
    inner = lambda m, f: wire_fields(m[f]) if isinstance(m.get(f), bytes) else {}
    count = lambda m, f: min(m[f], (1 << 63) - 1) if isinstance(m.get(f), int) else None
    text = lambda m, f: m[f].decode("utf-8", "ignore").strip() or None if isinstance(m.get(f), bytes) else None
    entry = wire_fields(bytes(data or b""))
    chat = inner(entry, 1)
    used = inner(chat, 4)
    reasoning, response = count(used, 9) or 0, count(used, 10) or 0
    whole = count(used, 3)
    return count(used, 2) or 0, reasoning + response if whole is None else whole, count(used, 5) or 0, reasoning, count(inner(inner(chat, 9), 4), 1), text(chat, 19), text(used, 11), count(used, 4) or 0, count(chat, 3), text(inner(entry, 3), 28)


def _generations(data: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _GENERATION.split(", ")]
    for some in data:
        yield pd.DataFrame([_generation(x) for x in some], columns=names).astype({c: "Int64" for c in [*names[:5], "write", "number"]})


def generation_rows(blobs: DataFrame, source: str = "antigravity") -> DataFrame:
    """blobs(file, session, idx, data, created, project): one packed message for each generation; its total output is taken,
    else its parts; a time that is missing is the conversation's."""
    rows = blobs.withColumn("g", pandas_udf(_GENERATION)(_generations)("data"))
    at = F.coalesce(F.when(F.col("g.at") > 0, F.col("g.at")), "created")
    return ledger_rows(
        rows, source, dedup_key=F.concat_ws(":", F.lit(source), "session", F.coalesce("g.response", F.col("idx").cast("string"))), timestamp=at, model=generated_model(F.coalesce("g.model", F.lit("unknown")), at), project="project",
        input_tokens=F.col("g.input"), output_tokens=F.col("g.output"), cache_read_tokens=F.col("g.read"), source_file="file", session_id="session", reasoning_tokens=F.col("g.reasoning"), seq=F.struct("file", F.col("idx").cast("long").alias("n")),
    )


def _about(data: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    from urllib.parse import unquote

    for some in data:
        rows = []
        for blob in some:
            told = wire_fields(bytes(blob or b""))
            inner = lambda f: wire_fields(told[f]) if isinstance(told.get(f), bytes) else {}  # noqa: B023, E731
            created, folder = inner(2).get(1), inner(1).get(1)
            uri = folder.decode("utf-8", "ignore") if isinstance(folder, bytes) else ""
            rows.append((created if isinstance(created, int) and created > 0 else None, unquote(uri.removeprefix("file://")) if uri.startswith("file://") else None))
        yield pd.DataFrame(rows, columns=["created", "project"]).astype({"created": "Int64"})


def conversation_blobs(generations: DataFrame, files: DataFrame) -> DataFrame:
    """generations(file, idx, data, about) of conversations' stores and files(path, modified) -> blobs for `generation_rows`: counted
    within their conversation, with its folder and the time when it began, else that of its file."""
    about = generations.select("file", "about").dropDuplicates(["file"]).select("file", pandas_udf("created long, project string")(_about)("about").alias("a"))
    times = files.select(F.col("path").alias("file"), F.unix_timestamp("modified").alias("at"))
    place = F.row_number().over(W.Window.partitionBy("file").orderBy("idx")) - 1
    rows = generations.select("file", "data", place.alias("idx")).join(about, "file").join(times, "file", "left")
    return rows.select("file", stem(F.col("file")).alias("session"), "idx", "data", F.coalesce("a.created", "at").alias("created"), F.col("a.project").alias("project"))


def conversation_exports(blobs: DataFrame) -> DataFrame:
    """blobs(session, idx, data, project) -> documents(name, text), one for each conversation, as `exported_rows` reads them: its
    generations that did any work, and the first name of a model that it was planned with."""
    rows = blobs.select("session", "idx", "project", pandas_udf(_GENERATION)(_generations)("data").alias("g"))
    work = (F.col("g.input") != 0) | (F.col("g.output") != 0) | (F.col("g.read") != 0) | (F.col("g.write") != 0)
    one = F.struct(
        F.col("g.response").alias("response_id"), F.coalesce("g.at", F.lit(0)).alias("ts"), F.col("g.number").alias("model_enum"), F.col("g.model").alias("model_alias"), F.col("g.input").alias("input"), F.col("g.output").alias("output"), F.col("g.read").alias("cache_read"), F.col("g.write").alias("cache_write"), F.col("g.reasoning").alias("thinking"),
    )
    each = rows.groupBy("session").agg(F.min_by(F.col("g.planner"), F.when(F.col("g.planner").isNotNull(), F.col("idx"))).alias("model"), F.max("project").alias("project"), F.sort_array(F.collect_list(F.when(work, F.struct("idx", one.alias("g"))))).alias("gs"))
    document = F.struct(F.lit(1).alias("schema"), F.col("session").alias("conversation_id"), "model", "project", F.transform("gs", lambda x: x["g"]).alias("generations"))
    return each.select(F.concat("session", F.lit(".json")).alias("name"), F.to_json(document).alias("text"))


def limit_documents(readings: DataFrame) -> DataFrame:
    """Readings -> documents(name, text), one for each source, of its newest readings, as `records.limit_exports` reads them."""
    newest = readings.groupBy("source").agg(F.max("observed_at").alias("at")).select(F.col("source").alias("n_source"), "at")
    rows = readings.join(newest, (F.col("source") == F.col("n_source")) & (F.col("observed_at") == F.col("at")))
    window = F.struct(F.col("window_key").alias("key"), "window_minutes", "used_pct", "resets_at", F.struct("limit_id", "model_scope").alias("evidence"))
    each = rows.groupBy("source").agg(F.max("at").alias("fetched_at"), *[F.max(c).alias(c) for c in ("plan", "metering_regime", "account_id")], F.sort_array(F.collect_list(window)).alias("windows"))
    return each.select(F.concat("source", F.lit(".json")).alias("name"), F.to_json(F.struct(F.lit(4).alias("schema"), "source", "fetched_at", "plan", "metering_regime", "account_id", "windows")).alias("text"))


_EXPORTED = "schema int, conversation_id string, model string, project string, generations array<struct<response_id: string, ts: bigint, model_enum: bigint, model_alias: string, input: bigint, output: bigint, cache_read: bigint, cache_write: bigint, thinking: bigint>>"


def exported_rows(files: DataFrame, source: str = "antigravity") -> DataFrame:
    """files(file, text): exports of conversations that can't be read otherwise."""
    rows = files.select("file", F.from_json("text", _EXPORTED).alias("j")).filter("j.schema is not null").select("file", "j", F.posexplode("j.generations").alias("n", "g"))
    at = F.col("g.ts")
    model = F.coalesce(generated_model(F.nullif(F.col("g.model_alias"), F.lit("")), at), numbered_model(F.col("g.model_enum"), at), F.nullif(F.col("j.model"), F.lit("")), F.lit("unknown"))
    return ledger_rows(
        rows, source, dedup_key=F.concat_ws(":", F.lit(source), F.col("j.conversation_id"), F.coalesce(F.nullif(F.col("g.response_id"), F.lit("")), F.col("n").cast("string"))), timestamp=at, model=model, project=F.col("j.project"), input_tokens=F.col("g.input"), output_tokens=F.col("g.output"),
        cache_read_tokens=F.col("g.cache_read"), cache_write_5m_tokens=F.col("g.cache_write"), source_file="file", session_id=F.col("j.conversation_id"), reasoning_tokens=F.col("g.thinking"), seq=F.struct("file", F.col("n").cast("long").alias("n")),
    )


def _reading(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    kinds = {"window_minutes": "long", "used_pct": "double", "resets_at": "long", "observed_at": "long", "source_order": "long", "covered_from": "long"}
    names = ["window_key", "window_minutes", "used_pct", "resets_at", "observed_at", "via", "plan", "account_id", "metering_regime", "limit_id", "model_scope", "source_order", "covered_from", "external_activity"]
    made = [columns.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names]
    return rows.select(F.lit(source).alias("source"), *made).filter("used_pct is not null and resets_at is not null and observed_at is not null")


_SLOT = "struct<used_percent: double, window_minutes: bigint, resets_at: string>"


def rollout_limits(lines: DataFrame) -> DataFrame:
    """lines(file, place, offset, line) of running-total logs: readings of the codex entitlement in both slots, but not in what
    a fork replays before its own first turn."""
    j = lines.select("file", "place", "offset", F.from_json("line", f"timestamp string, type string, payload struct<forked_from_id: string, parent_thread_id: string, thread_source: string, type: string, rate_limits: struct<limit_id: string, plan_type: string, primary: {_SLOT}, secondary: {_SLOT}>>").alias("j"))
    forked = (F.col("j.type") == "session_meta") & (F.col("j.payload.forked_from_id").isNotNull() | F.col("j.payload.parent_thread_id").isNotNull() | (F.col("j.payload.thread_source") == "subagent"))
    own = j.groupBy("file").agg(F.min(F.when(F.coalesce(forked, F.lit(False)), F.col("place"))).alias("fork"), F.min(F.when(F.col("j.type") == "turn_context", F.col("place"))).alias("own"))
    rows = j.filter("j.type = 'event_msg' and j.payload.type = 'token_count' and j.payload.rate_limits.limit_id = 'codex'").join(own, "file")
    replayed = F.col("fork").isNotNull() & (F.col("own").isNull() | (F.col("place") < F.col("own"))) & (F.col("place") > F.col("fork"))
    limits = "j.payload.rate_limits"
    slots = rows.filter(~F.coalesce(replayed, F.lit(False))).select("j", "offset", F.explode(F.array(F.col(f"{limits}.primary"), F.col(f"{limits}.secondary"))).alias("s")).filter("s.window_minutes is not null")
    key = window_key(F.col("s.window_minutes"))
    return _reading(
        slots, "codex", window_key=key, window_minutes=F.col("s.window_minutes"), used_pct=F.col("s.used_percent"), resets_at=F.coalesce(F.col("s.resets_at").try_cast("bigint"), iso_epoch(F.col("s.resets_at"))), observed_at=iso_epoch(F.col("j.timestamp")), via=F.lit("logs"),
        plan=F.col(f"{limits}.plan_type"), metering_regime=F.lit("codex:rate_limits"), limit_id=F.concat(F.lit("codex:"), key), model_scope=F.lit("all"), source_order=F.col("offset"),
    )


#: Lengths in minutes of the periods that credits are counted over.
PERIODS = {"USAGE_PERIOD_TYPE_WEEKLY": 10080, "USAGE_PERIOD_TYPE_MONTHLY": 43200}


def credit_limits(lines: DataFrame, message: str = "billing: fetched credits config") -> DataFrame:
    """lines(line) of a unified log: credit windows of known periods; a missing percent is none used, and the window is as long
    as its own two ends say."""
    j = lines.filter(F.col("line").contains(message)).select(F.from_json("line", "ts string, msg string, ctx struct<subscriptionTier: string, config: struct<creditUsagePercent: double, billingPeriodEnd: string, currentPeriod: struct<type: string, start: string, end: string>>>").alias("j")).filter(F.col("j.msg") == message)
    period = "j.ctx.config.currentPeriod"
    usual = F.try_element_at(F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair]), F.col(f"{period}.type"))
    end = iso_epoch(F.coalesce(f"{period}.end", "j.ctx.config.billingPeriodEnd"))
    own = F.floor((end - iso_epoch(F.col(f"{period}.start"))) / 60).cast("long")
    return _reading(j.filter(usual.isNotNull()), "grok", window_key=window_key(usual), window_minutes=F.when(own > 0, own).otherwise(usual), used_pct=F.coalesce("j.ctx.config.creditUsagePercent", F.lit(0.0)), resets_at=end, observed_at=iso_epoch(F.col("j.ts")), via=F.lit("logs"), plan=F.col("j.ctx.subscriptionTier"))


def coverage_floor(exports: DataFrame, readings: DataFrame, unreadable: DataFrame) -> DataFrame:
    """exports(source, account_id, fetched_at) with covered_from: since when everything of the account is known - the first
    reading of it, but not before anything unreadable or an earlier claim; null where that can't be told."""
    seen = readings.filter("account_id is not null").groupBy(F.col("source").alias("r_source"), F.col("account_id").alias("r_account")).agg(F.min("observed_at").alias("first_observed"), F.max("covered_from").alias("claim"))
    lost = unreadable.filter("count > 0").select(F.col("source").alias("u_source"), F.col("max_mtime").alias("lost_at"), F.lit(True).alias("lost"))
    rows = exports.join(seen, (F.col("source") == F.col("r_source")) & (F.col("account_id") == F.col("r_account")), "left").join(F.broadcast(lost), F.col("source") == F.col("u_source"), "left")  # a row a source
    floor = F.greatest(F.coalesce("first_observed", "fetched_at"), "claim", F.col("lost_at") + 1)
    unknown = F.col("account_id").isNull() | (F.coalesce("lost", F.lit(False)) & F.col("lost_at").isNull())
    return rows.select(*exports.columns, F.when(~unknown, floor).alias("covered_from"))


def record_unreadable(readings: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Readings whose claim of coverage reaches back before something unreadable of their source: the claim moves behind it."""
    lost = unreadable.filter("count > 0 and max_mtime is not null").select(F.col("source").alias("u_source"), "max_mtime")
    rows = readings.join(F.broadcast(lost), F.col("source") == F.col("u_source"), "left")  # a row a source
    moved = F.when(F.col("covered_from").isNotNull(), F.greatest("covered_from", F.col("max_mtime") + 1))
    return rows.select(*[c for c in readings.columns if c != "covered_from"], moved.alias("covered_from"))


def unchanged_files(listing: DataFrame, manifest: DataFrame, parser_version: int) -> DataFrame:
    """listing(path, size, mtime) without files that manifest(path, size, mtime, parser_version) knows just so."""
    return listing.join(manifest.filter(F.col("parser_version") == parser_version).select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def pruned_manifest(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """The manifest without files that are gone; records of theirs stay in the ledger."""
    return manifest.join(listing.select("path").distinct(), "path", "left_semi")
