"""What the scan reads of each tool: all its stores below its places, older ones beside newer ones, and what stands next to them."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import merge
from ledgerloom.sources import artifacts, discovery, records, sqlite
from ledgerloom.sources.lines import json_lines, plain_path, with_offsets
from ledgerloom.sources.sqlite import sqlite_rows

Reader = Callable[[SparkSession, list[str]], DataFrame]


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    found = [p for p in paths if discovery.there(spark, p)]
    if not found:
        raise FileNotFoundError(f"nothing at {', '.join(paths)}")
    return found


def texts(spark: SparkSession, roots: list[str], glob: str = "*.json") -> DataFrame:
    """(root, file, below, text) of whole files; below: the path from its root on."""
    out = None
    for root in roots:
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True).select(F.regexp_replace(plain_path(F.col("_metadata.file_path")), "^file:/*", "/").alias("file"), F.col("value").alias("text"))
        rows = rows.select(F.lit(root).alias("root"), "file", F.substring("file", len(root.rstrip("/")) + 2, 1 << 20).alias("below"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out if len(roots) == 1 else out.dropDuplicates(["file"])


def cline(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Editor tasks, with what their conversation's history says of model and folder, and sessions of the command line."""
    files = texts(spark, present(spark, paths))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    history = files.filter(F.col("file").endswith("/api_conversation_history.json")).select(folder.alias("folder"), F.col("text").alias("history"))
    place = F.concat(F.element_at(F.split("root", "/"), -1), F.lit("/"), "below")  # a root may be the folder of tasks itself
    found = files.filter(discovery.kind_of(place, "cline").isNotNull() & ~F.col("file").endswith("/api_conversation_history.json"))
    return artifacts.task_rows(found.withColumn("folder", folder).join(history, "folder", "left").select("file", "text", "history"))


def antigravity(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Conversations' stores and exports of those that can't be read; a generation of both counts once, the store's."""
    roots = present(spark, paths)
    files = discovery.listing(spark, roots).filter(~F.col("below").contains("/"))
    out = None
    stores = [r.path for r in files.filter(F.col("below").endswith(".db")).select("path").collect()]  # a row a conversation's file
    if stores:
        named = sqlite_rows(spark, ",".join(stores), "SELECT name FROM sqlite_master WHERE type = 'table'", "file string, name string").collect()
        whole = [f for f in stores if {"gen_metadata", "trajectory_metadata_blob"} <= {r.name for r in named if r.file == f}]
        if whole:
            rows = sqlite_rows(spark, ",".join(whole), "SELECT idx, data, (SELECT data FROM trajectory_metadata_blob LIMIT 1) about FROM gen_metadata", "file string, idx bigint, data binary, about binary")
            out = merge.insert(artifacts.generation_rows(artifacts.conversation_blobs(rows, files)))
    exports = texts(spark, roots).filter(~F.col("below").contains("/"))
    more = merge.insert(artifacts.exported_rows(exports.select("file", "text")))
    return more if out is None else out.unionByName(more.join(out.select("dedup_key"), "dedup_key", "left_anti"))


def gemini(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Chats as one object or line by line, with the real paths of their projects."""
    roots = present(spark, paths)
    whole = texts(spark, roots).filter(F.col("below").contains("/chats/")).select("file", F.col("text").alias("value"))
    rows = records.chat_rows(whole.unionByName(records.chat_lines(json_lines(spark, roots).select("file", "place", "line"))))
    known = [p for p in {posixpath.join(posixpath.dirname(r), "projects.json") for r in roots} if discovery.there(spark, p)]
    projects = spark.createDataFrame([], "real string, friendly string")
    if known:
        pairs = spark.read.text(known, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.projects"), "map<string, string>")))
        projects = pairs.select(F.col("key").alias("real"), F.col("value").alias("friendly"))
    return records.chat_projects(rows, projects)


def grok(spark: SparkSession, paths: list[str]) -> DataFrame:
    roots = present(spark, paths)
    summaries = texts(spark, roots, "summary.json").select(F.when(F.col("file").startswith("/"), F.concat(F.lit("file:"), "file")).otherwise(F.col("file")).alias("file"), "text")
    return records.turn_projects(records.turn_records(spark, roots), summaries)


def goose(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The store of sessions, if its schema is known, and older files of those sessions that it lacks."""
    roots = present(spark, paths)
    stores = [p for p in (f"{r.rstrip('/')}/sessions.db" for r in roots) if discovery.there(spark, p)]
    out, modern = None, spark.createDataFrame([], "session_id string")
    for store in stores:
        rows = sqlite.goose_store(spark, store)
        out = rows if out is None else out.unionByName(rows)
        modern = modern.unionByName(sqlite_rows(spark, store, "SELECT id AS session_id FROM sessions", "session_id string"))
    old = discovery.listing(spark, roots).filter(discovery.kind_of(F.col("below"), "goose") == "legacy")
    files = [r.path for r in old.select("path").collect()]  # a row an old session's file
    if files:
        lines = json_lines(spark, files).select("file", "place", "line")
        times = old.select(F.col("path").alias("p"), F.unix_timestamp("modified").alias("mtime"))
        rows = records.legacy_headers(lines.join(times, F.regexp_replace("file", "^file:/*", "/") == F.col("p"), "left"), modern)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(f"no sessions at {', '.join(roots)}")
    return out


def opencode(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All stores of the data folder, and the older tree of files for sessions that they lack."""
    out = modern = None
    roots = [posixpath.dirname(p) if p.endswith(".db") else p for p in present(spark, paths)]
    files = discovery.listing(spark, roots)
    stores = [r.path for r in files.filter(discovery.kind_of(F.col("below"), "opencode") == "database").select("path").orderBy("path").collect()]  # a row a store
    if stores:
        out = artifacts.opencode_records(spark, ",".join(stores)).dropDuplicates(["dedup_key"])
        modern = sqlite_rows(spark, ",".join(stores), "SELECT id AS session_id FROM session", "session_id string")
    trees = [p for p in (f"{r.rstrip('/')}/storage" for r in roots) if discovery.there(spark, p)]
    if trees:
        messages, sessions = artifacts.opencode_legacy(texts(spark, trees).select("file", "text"))
        rows = artifacts.message_rows(messages, sessions).dropDuplicates(["dedup_key"])
        rows = rows if modern is None else discovery.guarded(rows, modern, None)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(f"no sessions at {', '.join(roots)}")
    return out


def qoder(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Chat stores of both editions, with the models' names that their own logs tell."""
    stores = present(spark, paths)
    apps = {a for a in (posixpath.dirname(s) for s in stores)}
    roots = {next((x for x in _parents(a) if posixpath.basename(x).lower() in ("qoder", "qodercn")), None) for a in apps} - {None}
    logs = discovery.listing(spark, [f"{r}/logs" for r in sorted(roots)])
    names = [r.path for r in logs.filter(discovery.kind_of(F.col("below"), "qoder") == "log").select("path").collect()]  # a row a rotating log
    aliases = discovery.model_aliases(discovery.logs_with_times(spark, names)) if names else None
    return artifacts.qoder_records(spark, ",".join(stores), aliases)


def _parents(path: str) -> list[str]:
    out = []
    while path not in ("", "/"):
        out.append(path)
        path = posixpath.dirname(path)
    return out


def _each(one: Callable[[SparkSession, str], DataFrame]) -> Reader:
    return lambda spark, paths: one(spark, ",".join(present(spark, paths)))


READERS: dict[str, Reader] = {
    "claude": records.call_ledger, "codex": records.rollout_ledger, "copilot": _each(sqlite.copilot_records), "gemini": gemini, "hermes": _each(sqlite.hermes_records), "grok": grok, "antigravity": antigravity, "goose": goose,
    "opencode": opencode, "kilo": _each(sqlite.kilo_records), "zed": _each(artifacts.zed_records), "cline": cline, "pi": artifacts.pi_records, "omp": lambda spark, paths: artifacts.pi_records(spark, paths, "omp"),
    "workbuddy": records.line_records, "codebuddy": lambda spark, paths: records.line_records(spark, paths, "codebuddy"), "qoder": qoder,
}


def limit_readings(spark: SparkSession, places: dict[str, list[str]], exports: list[str] = ()) -> DataFrame:
    """Limit readings of all logs that hold some and of exported documents. places: where the tools' logs lie, by tool."""
    out = records.limit_exports(spark, present(spark, list(exports))) if exports else None
    for source, read in (("codex", _rollout_limits), ("grok", _credit_limits)):
        found = [p for p in places.get(source, []) if discovery.there(spark, p)]
        if found:
            rows = read(spark, found)
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError("no limits anywhere")
    return out


def _rollout_limits(spark: SparkSession, paths: list[str]) -> DataFrame:
    return artifacts.rollout_limits(with_offsets(json_lines(spark, paths)))


def _credit_limits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Credits are told in a log beside the sessions."""
    logs = [p for p in (posixpath.join(posixpath.dirname(x.rstrip("/")), "logs/unified.jsonl") for x in paths) if discovery.there(spark, p)]
    return artifacts.credit_limits(json_lines(spark, logs).select("line")) if logs else artifacts.credit_limits(spark.createDataFrame([], "line string"))
