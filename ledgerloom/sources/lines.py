"""Logs of JSON lines: whole lines with their file and their order in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def plain_path(path: Column) -> Column:
    """A file's path as it is called: Spark gives it with percent signs."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def json_lines(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """(file, place, line) of every file below paths; place orders the lines of a file. Files are split as Spark splits
    text, so a long log is read by many tasks."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(paths)
    block = F.col("_metadata.file_block_start")
    return text.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.struct(block.alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"), F.col("value").alias("line"), F.col("_metadata.file_size").alias("file_size"))


def with_offsets(lines: DataFrame) -> DataFrame:
    """Adds offset, the byte at which the line starts in its file; a carriage return belongs to the line. A last line without
    an end, which a tool may still be writing, is left out."""
    before = W.Window.partitionBy("file").orderBy("place").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))
    return placed.filter(F.col("offset") + F.octet_length("line") < F.col("file_size"))


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Adds j, the line as a struct; lines that are no JSON objects are left out."""
    rows = lines.withColumn("j", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.filter("j is not null and j._bad is null")


def skipped(lines: DataFrame, schema: str) -> DataFrame:
    """(file, lines_skipped): how many lines of each file could not be read."""
    rows = lines.withColumn("j", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.groupBy("file").agg(F.count_if(F.col("j._bad").isNotNull() | F.col("j").isNull()).alias("lines_skipped"))


def stem(file: Column) -> Column:
    """The name of a file without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("long")
