"""A ledger that grows: Structured Streaming over records, with every late record taken in and every answer corrected.

Records may come again with more output and may come days late, so no watermark drops them. Rows lie in parts by the low bits of
their key's hash; a part that has more than SPLIT rows is written as its two, four, .. halves, so parts keep their size however large
the ledger is, and a batch of ten records rewrites ten parts at most. Each micro-batch is merged in `foreachBatch` with the stored
rows of its own keys, by the columns' rules (see `merge.keep_max_output`); the parts it touches are written beside the old ones under
the batch's number.

Next to them stand what the batch changes in the daily sums (the new rows of its keys added, the old ones taken back: the maintained
series is the sum of all changes) and, for each source, a signal of what it inserted, changed and removed, and when. A log of the
parts is written last: what it doesn't name is not there. So a batch that is run again after a failure writes the same, and a
reader never sees half of one. The batch's number is the revision of what it changed. Versions that nobody points to are deleted
KEEP batches later; every SNAPSHOT batches the log and the changes are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import limits, merge, usage

#: Rows of a part, batches for which a version stays, and batches that a snapshot sums up.
SPLIT, KEEP, SNAPSHOT = 500_000, 3, 50
#: How columns merge: of the row with most output, first known, filled among rows with most output, latest accepted.
FIRST, HYBRID, LATEST = ("project", "session_id"), ("reasoning_tokens",), ("model",)
#: Columns that only say how a row is stored or what it replaces.
_ASIDE = ("h", "bits", "value", "supersedes")
_LOG = "bits int, value long, rows long, gone boolean, was long"
COUNTED = ("records", "api_calls", *usage.TOKENS, "reasoning_tokens")


def merged(rows: DataFrame) -> DataFrame:
    """One row for each key, by `merge.keep_max_output`; seq is that of the newest row of the key."""
    rest = [c for c in rows.columns if c not in ("dedup_key", "seq", "output_tokens", *_ASIDE, *FIRST, *HYBRID, *LATEST)]
    kept = [[c for c in some if c in rows.columns] for some in (FIRST, HYBRID, LATEST)]
    told = rows.withColumn("newest", F.max("seq").over(W.Window.partitionBy("dedup_key")))
    return merge.keep_max_output(told, [*rest, "newest"], *kept).withColumnRenamed("newest", "seq").select(*[c for c in rows.columns if c not in _ASIDE])


# --- the folders of a table
def _folders(spark: SparkSession, path: str, kind: str, upto: int | None = None) -> list[int]:
    """The numbers of the folders kind=number below a path, ascending."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    names = [f.getPath().getName() for f in store.listStatus(where)]
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
    return [n for n in found if (upto is None or n <= upto) and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}/_SUCCESS"))]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _since_snapshot(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame | None:
    """The newest snapshot and the batches after it, with `batch`; the batch column of a snapshot is its own."""
    snaps, batches = _folders(spark, path, "snapshot", upto), _folders(spark, path, "batch", upto)
    last = snaps[-1] if snaps else -1
    some = [spark.read.schema(f"{schema}, batch long").parquet(f"{path}/snapshot={last}")] if snaps else []
    later = [f"{path}/batch={n}" for n in batches if n > last]
    if later:
        some.append(spark.read.schema(f"{schema}, batch long").parquet(*later))
    return None if not some else some[0] if len(some) == 1 else some[0].unionByName(some[1])


def _live(spark: SparkSession, table: str, upto: int | None = None) -> list:
    """(bits, value, rows, batch) of the parts that hold the ledger; they cover all keys."""
    log = _since_snapshot(spark, f"{table}/log", _LOG, upto)
    if log is None:
        return []
    newest = log.groupBy("bits", "value").agg(F.max_by(F.struct("rows", "gone"), "batch").alias("x"), F.max("batch").alias("batch"))
    return newest.filter("not x.gone").select("bits", "value", "x.rows", "batch").collect()  # a row a part


def committed(spark: SparkSession, table: str) -> int | None:
    """The newest revision."""
    return max([*_folders(spark, f"{table}/log", "batch"), *_folders(spark, f"{table}/log", "snapshot")], default=None)


def _low(bits: str | int) -> Column:
    return F.expr(f"h & (shiftleft(1L, {bits}) - 1)")


def _paths(table: str, parts: list) -> list[str]:
    return [f"{table}/rows/batch={p.batch}/bits={p.bits}/value={p.value}" for p in parts if p.rows]


def cadence(seconds: int) -> int:
    """Seconds between batches: 10 to 14,400; 0 is the longest."""
    return min(max(seconds, 10), 14_400) if seconds else 14_400


def ingest(records: DataFrame, table: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Merge a stream of ledger rows with seq, their order of arrival, into the ledger at `table`; read it with `stored`. Rows may
    have supersedes, a key that goes. seconds: how often (10 to 14,400, which 0 stands for; none: all there is, once)."""
    if "seq" not in records.columns:
        raise ValueError("records need seq, their order of arrival")
    interval = {"availableNow": True} if seconds is None else {"processingTime": f"{cadence(seconds)} seconds"}
    return records.writeStream.foreachBatch(lambda batch, number: put(batch, number, table)).option("checkpointLocation", checkpoint).trigger(**interval).start()


def put(batch: DataFrame, number: int, table: str) -> None:
    """Merge one batch of rows into the ledger, as revision `number`."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        _put(spark, batch, number, table)
    finally:
        batch.unpersist()


def _put(spark: SparkSession, batch: DataFrame, number: int, table: str) -> None:
    known = _live(spark, table, number - 1)
    parts = {(p.bits, p.value): p for p in known} or {(0, 0): None}
    hashed = F.pmod(F.xxhash64("dedup_key"), F.lit(1 << 40))
    keys = batch.select("dedup_key", F.lit(True).alias("given"))
    if "supersedes" in batch.columns:
        keys = keys.unionByName(batch.filter("supersedes is not null").select(F.col("supersedes").alias("dedup_key"), F.lit(False).alias("given")))
    keys = keys.filter("dedup_key is not null").groupBy("dedup_key").agg(F.bool_and("given").alias("stays")).withColumn("h", hashed)
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), _low(b).alias("value")) for b in sorted({b for b, _ in parts})]))
    cover = F.broadcast(spark.createDataFrame(list(parts), "bits int, value long"))  # a row a part
    told = keys.select(at.alias("at")).select("at.*").join(cover, ["bits", "value"]).groupBy("bits", "value").count().collect()  # at most a row a part
    if not told:
        return
    touched = [parts[r.bits, r.value] for r in told if parts[r.bits, r.value] is not None]
    paths = _paths(table, touched)
    columns = [c for c in batch.columns if c not in _ASIDE]
    old = (spark.read.schema(batch.select(columns).schema).parquet(*paths) if paths else batch.select(columns).limit(0))
    rest, hit = old.join(keys, "dedup_key", "left_anti"), old.join(keys, "dedup_key", "left_semi")
    fresh = merged(hit.unionByName(batch.select(columns))).join(keys.filter("stays").select("dedup_key"), "dedup_key", "left_semi")
    split = {(r.bits, r.value): _halvings((parts[r.bits, r.value].rows if parts[r.bits, r.value] else 0) + r["count"]) for r in told}
    deeper = F.broadcast(spark.createDataFrame([(b, v, b + k) for (b, v), k in split.items()], "bits int, value long, to int"))
    done = rest.unionByName(fresh).withColumn("h", hashed).withColumn("at", F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), _low(b).alias("value")) for b in sorted({b for b, _ in split})])))
    done = done.select(*columns, "h", "at.*").join(deeper, ["bits", "value"]).select(*columns, F.col("to").alias("bits"), _low("to").alias("value"))
    done.repartition("bits", "value").write.mode("overwrite").partitionBy("bits", "value").parquet(f"{table}/rows/batch={number}")
    written = spark.read.schema(f"bits int, value long, {_ddl(batch.select(columns))}").parquet(f"{table}/rows/batch={number}")
    counts = {(r.bits, r.value): r["count"] for r in written.groupBy("bits", "value").count().collect()}  # a row a part
    _tell(hit, written.select(columns).join(keys, "dedup_key", "left_semi"), table, number)
    log = [(b + k, v + (j << b), counts.get((b + k, v + (j << b)), 0), False, parts[b, v].batch if parts[b, v] and k == 0 else None) for (b, v), k in split.items() for j in range(1 << k)]
    log += [(b, v, 0, True, parts[b, v].batch if parts[b, v] else None) for (b, v), k in split.items() if k]
    spark.createDataFrame(log, _LOG).withColumn("batch", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{table}/log/batch={number}")
    _tidy(spark, table, number)


def _halvings(rows: int) -> int:
    k = 0
    while rows > SPLIT << k:
        k += 1
    return k


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _grain(rows: DataFrame, sign: int) -> DataFrame:
    """Each row with its day and its counts, to be added or taken back."""
    has = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in rows.columns else F.lit(0).cast("long")
    other = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select("dedup_key", F.lit(sign).alias("sign"), usage.bucket(F.col("timestamp")).alias("day"), "timestamp", "source", other("model").alias("model"), F.lit(1).cast("long").alias("records"), *[has(c).alias(c) for c in COUNTED[1:]])


def _tell(before: DataFrame, after: DataFrame, table: str, number: int) -> None:
    """Write what a batch changes in the sums, and its signals."""
    both = _grain(before, -1).unionByName(_grain(after, 1))
    sums = both.groupBy("day", "source", "model").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTED]).withColumn("revision", F.lit(number).cast("long"))
    changed = " or ".join(f"{c} <> 0" for c in COUNTED)
    sums.filter(changed).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/changes/batch={number}")
    image = F.struct("day", "timestamp", "model", *COUNTED)
    keys = both.groupBy("source", "dedup_key").agg(F.max(F.when(F.col("sign") < 0, image)).alias("was"), F.max(F.when(F.col("sign") > 0, image)).alias("is"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    moved = keys.filter(~F.col("was").eqNullSafe(F.col("is")))
    said = moved.groupBy("source").agg(F.count_if(F.col("was").isNull()).alias("inserted"), F.count_if(F.col("was").isNotNull() & F.col("is").isNotNull()).alias("updated"), F.count_if(F.col("is").isNull()).alias("removed"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    said.withColumn("batch", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{table}/signals/batch={number}")


def _tidy(spark: SparkSession, table: str, number: int) -> None:
    """Delete versions that were replaced KEEP batches ago; sum up."""
    done = _folders(spark, f"{table}/log", "batch", number)
    if len(done) > KEEP:
        then = done[-1 - KEEP]
        for r in spark.read.schema(_LOG).parquet(f"{table}/log/batch={then}").filter("was is not null").collect():  # a row a part
            _delete(spark, f"{table}/rows/batch={r.was}/bits={r.bits}/value={r.value}")
    last = max(_folders(spark, f"{table}/log", "snapshot"), default=None)
    if sum(n > (-1 if last is None else last) for n in done) >= SNAPSHOT:
        rows = [(p.bits, p.value, p.rows, False, None, p.batch) for p in _live(spark, table, number)]
        _changes(spark, table, number).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/changes/snapshot={number}")
        spark.createDataFrame(rows, f"{_LOG}, batch long").coalesce(1).write.mode("overwrite").parquet(f"{table}/log/snapshot={number}")
        for n in done:
            if last is not None and n <= last:  # summed up twice since
                _delete(spark, f"{table}/log/batch={n}")
                _delete(spark, f"{table}/changes/batch={n}")


_CHANGES = "day string, source string, model string, " + ", ".join(f"{c} long" for c in COUNTED) + ", revision long"


def _changes(spark: SparkSession, table: str, upto: int | None) -> DataFrame:
    some = _since_snapshot(spark, f"{table}/changes", _CHANGES, upto) if upto is not None else None
    if some is None:
        return spark.createDataFrame([], _CHANGES)
    return some.groupBy("day", "source", "model").agg(*[F.sum(c).alias(c) for c in COUNTED], F.max("revision").alias("revision"))


def daily(spark: SparkSession, table: str) -> DataFrame:
    """The maintained series: (day, source, model, COUNTED, revision) of the whole ledger, without reading it."""
    return _changes(spark, table, committed(spark, table)).filter("records <> 0")


_SIGNALS = "source string, inserted long, updated long, removed long, first_at long, last_at long"


def signals(spark: SparkSession, table: str, since: int = -1) -> DataFrame:
    """(source, inserted, updated, removed, first_at, last_at, batch): what the batches after a revision changed."""
    last = committed(spark, table)
    paths = [f"{table}/signals/batch={n}" for n in (_folders(spark, f"{table}/signals", "batch", last) if last is not None else []) if n > since]
    schema = f"{_SIGNALS}, batch long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def usage_of(spark: SparkSession, table: str, sources: DataFrame) -> DataFrame:
    """(source, account_id, timestamp, model, tokens) of the ledger's records of sources(source)."""
    rows = stored(spark, table).join(sources, "source", "left_semi")
    account = F.col("account_id") if "account_id" in rows.columns else F.lit(None).cast("string")
    return rows.select("source", account.alias("account_id"), "timestamp", "model", usage.total_tokens().alias("tokens"))


def answers(spark: SparkSession, table: str, readings: DataFrame, at: int, since: int = -1) -> DataFrame:
    """What a percent of each limit is worth at an instant, derived anew for the limits of sources whose records changed after
    revision `since`, and with the newest revision. The answers of all other limits stand."""
    moved = signals(spark, table, since).select("source").distinct()
    some = readings.join(moved, "source", "left_semi")
    found = limits.representatives(limits.runs(limits.intervals(some, usage_of(spark, table, moved)).filter("reason is null")))
    return limits.estimates(found, limits.current_readings(some, at), at).withColumn("revision", F.lit(committed(spark, table)).cast("long"))


def latest(rows: DataFrame) -> DataFrame:
    """For each key the row with the most output, the later of equals, with its seq."""
    order = F.struct("output_tokens", "seq")
    rest = [c for c in rows.columns if c != "dedup_key"]
    return rows.groupBy("dedup_key").agg(F.max_by(F.struct(*rest), order).alias("one")).select("dedup_key", "one.*")


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The ledger: the parts' newest rows, merged when they were written."""
    return spark.read.parquet(*_paths(table, _live(spark, table)))


def compact(spark: SparkSession, table: str, to: str) -> DataFrame:
    """Write the merged ledger as one new table, partitioned by day."""
    stored(spark, table).withColumn("day", usage.bucket(F.col("timestamp"))).write.mode("overwrite").partitionBy("day").parquet(to)
    return spark.read.parquet(to)


def hourly_counts(records: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream (time, source, tokens) in tumbling hours; here a watermark is chosen, and later records are dropped."""
    return records.withWatermark("time", late).groupBy(F.window("time", "1 hour"), "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records")).select(F.date_format("window.start", "yyyy-MM-dd HH:00").alias("bucket"), "source", "tokens", "records")


def trailing(points: DataFrame, days: int) -> DataFrame:
    """points(day, source, tokens) -> with the sum of the last `days` days, the day included."""
    span = W.Window.partitionBy("source").orderBy(F.unix_date(F.to_date("day"))).rangeBetween(1 - days, 0)
    return points.withColumn("trailing", F.sum("tokens").over(span))
