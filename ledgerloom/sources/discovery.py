"""What lies below the places where tools keep their logs: files by kind, indexes in which the first path wins, the aliases of models
that a tool's own logs tell, and the guard that keeps an older store from counting twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.lines import plain_path, stem

#: The places of artifacts, by the path below the root where a search begins; the first that fits counts.
PLACES = (
    ("cline", "task", r"(^|/)tasks/(.*/)?(ui_messages|claude_messages)\.json$"),
    ("cline", "session", r"(^|/)sessions/.*\.json$"),
    ("opencode", "database", r"^(opencode\.db|opencode-.+\.db)$"),
    ("opencode", "legacy_session", r"(^|/)storage/session/.*\.json$"),
    ("opencode", "legacy_message", r"(^|/)storage/message/[^/]+/.*\.json$"),
    ("goose", "database", r"^sessions\.db$"),
    ("goose", "legacy", r"^[^/]+\.jsonl$"),
    ("qoder", "database", r"(^|/)local\.db$"),
    ("qoder", "transcript", r"\.jsonl$"),
    ("qoder", "log", r"(^|/)(?i:[^/]*qoder[^/]*)\.log$"),
    ("antigravity", "export", r"\.json$"),
    ("antigravity", "database", r"\.db$"),
)
#: Fixed value: what stands before the catalog of models in a log line.
MARKER = "Model classes refreshed:"
_GROUPS = "map<string, array<struct<name: string, displayName: string>>>"


def there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, path, below, size, modified): the files below the roots that exist, by Spark's own listing; nothing is read."""
    out = spark.createDataFrame([], "root string, path string, below string, size long, modified timestamp")
    for root in dict.fromkeys(roots):
        if there(spark, root):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            name = F.regexp_replace("path", "^file:/*", "/") if "://" not in root else F.col("path")
            below = F.when(name == root, F.element_at(F.split(name, "/"), -1)).otherwise(F.substring(name, len(root.rstrip("/")) + 2, 1 << 20))
            out = out.unionByName(files.select(F.lit(root).alias("root"), name.alias("path"), below.alias("below"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
    return out


def kind_of(below: Column, source: str) -> Column:
    """What a file at this place below a root is to a tool; null: nothing."""
    kind = F.lit(None).cast("string")
    for tool, name, place in reversed(PLACES):
        if tool == source:
            kind = F.when(below.rlike(place), name).otherwise(kind)
    return kind


def artifacts_of(files: DataFrame, source: str) -> DataFrame:
    """files(path, below, ..) of a tool with kind; files of no known place are left out, and a path that several roots hold counts
    once."""
    rest = [c for c in files.columns if c != "path"]
    return files.withColumn("kind", kind_of(F.col("below"), source)).filter("kind is not null").groupBy("path").agg(*[F.min_by(c, "below").alias(c) for c in (*rest, "kind")])


def task_id(path: Column) -> Column:
    """The folder behind the last one that is called tasks, else the one that the file lies in."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^.*/tasks/([^/]+)/", 1), F.lit("")), F.element_at(F.split(path, "/"), -2))


def first_paths(files: DataFrame, key: Column | None = None) -> DataFrame:
    """(key, path): for each name without its extension (or each key) the first of the paths."""
    return files.groupBy((stem(F.col("path")) if key is None else key).alias("key")).agg(F.min("path").alias("path"))


def app_root(path: Column) -> Column:
    """The folder of the application that a file belongs to."""
    return F.nullif(F.regexp_extract(path, r"(?i)^(.*/(?:qodercn|qoder))/", 1), F.lit(""))


def is_chinese(path: Column) -> Column:
    return F.lower(path).rlike("(^|/)(qodercn|[.]qoder-cn)(/|$)")


def model_aliases(lines: DataFrame) -> DataFrame:
    """lines(file, place, line, modified) of applications' logs -> (chinese, alias, model). A log tells what its last line behind
    the marker says that can be read; an application what the newest of its logs tells; an edition what its applications tell, the
    later one by name where they differ."""
    at = F.instr("line", MARKER)
    told = lines.filter(at > 0).select("file", "place", "modified", F.from_json(F.substr("line", at + len(MARKER)), _GROUPS).alias("groups"))
    models = F.filter(F.flatten(F.map_values("groups")), lambda m: (F.coalesce(m["name"], F.lit("")) != "") & (F.coalesce(m["displayName"], F.lit("")) != ""))
    logs = told.withColumn("models", models).filter("size(models) > 0").groupBy("file").agg(F.max_by("models", "place").alias("models"), F.max("modified").alias("modified"))
    apps = logs.withColumn("app", app_root(F.col("file"))).filter("app is not null").groupBy("app").agg(F.max_by("models", F.struct("modified", "file")).alias("models"))
    each = apps.select("app", is_chinese(F.concat("app", F.lit("/"))).alias("chinese"), F.posexplode("models").alias("n", "m"))
    name = F.translate("m.displayName", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return each.groupBy("chinese", F.col("m.name").alias("alias")).agg(F.max_by(name, F.struct("app", "n")).alias("model"))


def logs_with_times(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, place, line, modified) of text logs."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("modified"))


# --- older stores beside newer ones
SESSIONS = "source string, session_id string"


def remember_sessions(spark: SparkSession, table: str, source: str, sessions: DataFrame) -> None:
    """Add the sessions(session_id) of a newer store to those that are known; each run adds its new ones."""
    new = sessions.select("session_id").filter("session_id is not null").distinct()
    known = remembered_sessions(spark, table, source)
    if known is not None:
        new = new.join(known, "session_id", "left_anti")
    new.withColumn("source", F.lit(source)).write.mode("append").partitionBy("source").parquet(table)


def remembered_sessions(spark: SparkSession, table: str, source: str) -> DataFrame | None:
    """(session_id) of earlier runs; none at all where there was no run; None where the table can't be read."""
    if not there(spark, table):
        return spark.createDataFrame([], "session_id string")
    try:
        rows = spark.read.schema(SESSIONS).parquet(table)
        rows.limit(1).count()
    except AnalysisException:
        return None
    return rows.filter(F.col("source") == source).select("session_id").distinct()


def guarded(legacy: DataFrame, modern: DataFrame | None, remembered: DataFrame | None) -> DataFrame:
    """legacy(session_id, ..) without the sessions that a newer store holds. modern(session_id): what was read of it in this run; None:
    it was skipped, because it had not changed, or could not be read. Then the sessions of earlier runs (remembered) stand for
    it, and where they can't be read either, nothing of the older store counts."""
    if modern is None and remembered is None:
        return legacy.limit(0)
    ids = None
    for some in (modern, remembered):
        if some is not None:
            ids = some.select("session_id") if ids is None else ids.unionByName(some.select("session_id"))
    return legacy.join(ids.distinct(), "session_id", "left_anti")
