"""Queries over logs that lie as files and over streams of them: the tables are written as logs, a file a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import fixtures
from ledgerloom.plans.source_queries import CLAUDE_SQL, _calls, _transcript
from ledgerloom.plans.store_queries import _fresh
from ledgerloom.sources import documents
from ledgerloom.sources.growing import growing_lines
from ledgerloom.sources.lines import json_lines, stem, with_offsets
from ledgerloom.streaming import sessions

#: Bytes of a log that one batch reads: small, so that logs take several batches and their state has to be carried.
FEW = 6000
#: Batches, about, that the longest log takes if that makes more bytes: their number must not grow with it.
BATCHES = 8


def _as_files(lines: DataFrame, folder: str, tail: str = "") -> str:
    """lines(file, place, line) as files of a folder, each with its lines in order."""
    each = lines.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("ls"))
    text = F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n" + tail))
    documents.write_documents(each.select(F.element_at(F.split("file", "/"), -1).alias("name"), text.alias("text")), folder)
    return folder


def _offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with carriage returns and bytes beyond ASCII, and a torn one at the end of each file."""
    rows = fixtures.table(spark, sf, "conversations")
    line = F.concat(F.lit('{"é":'), F.col("turn").cast("string"), F.lit(',"r":"'), "role", F.lit('"}'), F.when(F.col("turn") % 2 == 0, "\r").otherwise(""))
    lines = rows.select(F.concat(F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("turn").alias("place"), line.alias("line"))
    found = with_offsets(json_lines(spark, _as_files(lines, _fresh(spark, "logs"), '{"torn"')))
    return found.select(stem(F.col("file")).alias("file"), "offset", F.get_json_object("line", "$.r").alias("role"))


OFFSETS_SQL = """WITH l AS (SELECT conv_id, turn, role, 15 + length(turn::VARCHAR) + length(role) + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n FROM conversations)
  SELECT 'c' || conv_id AS file, (coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", role FROM l"""


def _streamed(spark: SparkSession, logs: str, stream_of) -> DataFrame:
    """What a stream makes of logs, run after run, each with a state that the run before has left."""
    out, state, mark, before = _fresh(spark, "streamed"), _fresh(spark, "state"), _fresh(spark, "checkpoint"), -1
    longest = spark.read.format("binaryFile").load(logs).agg(F.max("length")).first()[0] or 0
    while True:
        stream = stream_of(growing_lines(spark, logs, state, max_bytes=max(FEW, longest // BATCHES)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out)
        count = rows.count()
        if count == before:
            return rows
        before = count


def _stream_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The transcripts of `ctx_fold_claude` with what was billed in their own lines."""
    lines, calls = _transcript(spark, sf), _calls(spark, sf)
    told = lines.join(calls.select("file", "place", "dedup_key", "billed", "sidechain"), ["file", "place"], "left")
    head = F.format_string('"timestamp":"2025-01-01T00:00:00Z","isSidechain":%s,"message":{"id":"%s","usage":{"input_tokens":%d},', F.col("sidechain").cast("string"), "dedup_key", "billed")
    line = F.when(F.col("billed").isNull(), F.col("line")).otherwise(F.replace("line", F.lit('"message":{'), head))
    logs = _as_files(told.select("file", "place", line.alias("line")), _fresh(spark, "logs"))
    rows = _streamed(spark, logs, sessions.call_stream)
    return rows.select(F.regexp_replace("dedup_key", "^claude:", "").alias("dedup_key"), F.col("input_tokens").alias("billed"), *sessions.CONTEXT)


QUERIES = {
    "log_offsets": (_offsets, OFFSETS_SQL),
    "stream_calls": (_stream_calls, CLAUDE_SQL),
}
