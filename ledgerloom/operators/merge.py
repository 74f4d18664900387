"""How records enter a ledger: pure merges of (old and new) rows with a total order of arrival, `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

BACKFILLED = ("session_id", "reasoning_tokens", "ctx_messages", "ctx_system", "ctx_reasoning", "ctx_toolcalls", "ctx_agents", "ctx_mcp", "ctx_skills")


def _last_known(column: str) -> Column:
    return F.max_by(F.when(F.col(column).isNotNull(), F.col(column)), F.when(F.col(column).isNotNull(), F.col("seq")))


def insert(rows: DataFrame) -> DataFrame:
    """The first row of a key stays; only session, reasoning and context columns take later known values."""
    later = [c for c in rows.columns if c in BACKFILLED]
    first = [c for c in rows.columns if c not in later and c not in ("dedup_key", "seq")]
    return rows.groupBy("dedup_key").agg(F.min_by(F.struct(*first), "seq").alias("one"), *[_last_known(c).alias(c) for c in later]).select("dedup_key", "one.*", *later)


def replace(rows: DataFrame) -> DataFrame:
    """The last row of a key stays whole."""
    rest = [c for c in rows.columns if c not in ("dedup_key", "seq")]
    return rows.groupBy("dedup_key").agg(F.max_by(F.struct(*rest), "seq").alias("one")).select("dedup_key", "one.*")


def keep_max_output(rows: DataFrame, winner: list[str], first: list[str], hybrid: list[str], latest: list[str]) -> DataFrame:
    """The row with the most output stays. A row is accepted if its output is no less than all before it. winner: of the
    first row with the most output; first: first known among accepted rows; hybrid: first known among rows with the
    most output; latest: of the last row with the most output, known or not."""
    before = W.Window.partitionBy("dedup_key").orderBy("seq").rowsBetween(W.Window.unboundedPreceding, -1)
    seen = rows.withColumn("high", F.max("output_tokens").over(before)).withColumn("most", F.max("output_tokens").over(W.Window.partitionBy("dedup_key")))
    seen = seen.filter("high is null or output_tokens >= high").withColumn("top", F.col("output_tokens") == F.col("most"))
    when = lambda ok, c: F.when(ok, c)
    known = lambda c, ok: F.min_by(when(ok & F.col(c).isNotNull(), F.col(c)), when(ok & F.col(c).isNotNull(), F.col("seq")))
    top = F.col("top")
    out = seen.groupBy("dedup_key").agg(
        F.min_by(when(top, F.struct("output_tokens", *winner)), when(top, F.col("seq"))).alias("won"),
        *[known(c, F.lit(True)).alias(c) for c in first],
        *[known(c, top).alias(c) for c in hybrid],
        F.max_by(when(top, F.struct(*latest)), when(top, F.col("seq"))).alias("last"),
    )
    return out.select("dedup_key", "won.*", *first, *hybrid, "last.*")


def supersede(old: DataFrame, new: DataFrame, keys: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """Old rows whose dedup_key is in keys(key), or begins with one of prefixes(prefix), go; then new rows are inserted.
    prefixes end in a colon, so that a key is matched by cutting it at its colons, not by comparing it with each."""
    if keys is not None:
        old = old.join(keys.select(F.col("key").alias("dedup_key")).distinct(), "dedup_key", "left_anti")
    if prefixes is not None:
        parts = F.split("dedup_key", ":")
        heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), ":"), F.lit(":")))
        doomed = old.filter(F.size(parts) > 1).select("dedup_key", F.explode(heads).alias("prefix")).join(prefixes.distinct(), "prefix", "left_semi").select("dedup_key").distinct()
        old = old.join(doomed, "dedup_key", "left_anti")
    return insert(old.unionByName(new))


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the files that new rows come from go; then the new rows are inserted."""
    return insert(old.join(new.select("source_file").distinct(), "source_file", "left_anti").unionByName(new))


def merge_readings(rows: DataFrame) -> DataFrame:
    """Limit readings by their key: known identities fill in, a contradicting row is dropped whole, and plan, coverage
    and external activity take the newest known value. Rows of a key are few (one reading, re-read)."""
    key = ["source", "window_key", "resets_at", "observed_at", "used_pct"]
    identity = ["account_id", "metering_regime", "limit_id", "model_scope"]
    upto = W.Window.partitionBy(*key).orderBy("seq").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    # A row contradicts if a known identity differs from the first known one.
    agrees = F.lit(True)
    for c in identity:
        agrees = agrees & (F.col(c).isNull() | (F.col(c) == F.first(c, ignorenulls=True).over(upto)))
    kept = rows.withColumn("agrees", agrees).filter("agrees")
    first_known = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    newest = [c for c in ("plan", "covered_from", "external_activity") if c in rows.columns]
    other = [c for c in rows.columns if c not in (*key, *identity, *newest, "seq")]
    return kept.groupBy(*key).agg(*[F.min_by(c, "seq").alias(c) for c in other], *[first_known(c) for c in identity], *[_last_known(c).alias(c) for c in newest])


def add_up(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Additive upserts of context tables: equal keys add."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def latest_known(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Session metadata: each column's last known value."""
    return rows.groupBy(*keys).agg(*[_last_known(c).alias(c) for c in rows.columns if c not in (*keys, "seq")])


def unbooked(rows: DataFrame) -> DataFrame:
    """rows(path, source, requests, first_at, last_at, seq): the last row of a path counts, zero removes it."""
    last = rows.groupBy("path").agg(F.max_by(F.struct("source", "requests", "first_at", "last_at"), "seq").alias("r")).select("path", "r.*").filter("requests > 0")
    return last.groupBy("source").agg(F.sum("requests").alias("requests"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def files_with_records(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files(path) that some record of the ledger comes from."""
    return files.join(ledger.select(F.col("source_file").alias("path")).distinct(), "path", "left_semi")


def cleared_sessions(weights: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Stored weights(source_file, session_id, ..) without those of sessions that have records in files(path), which are read anew."""
    again = ledger.join(files.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_semi").filter("session_id is not null")
    return weights.join(again.select("session_id").distinct(), "session_id", "left_anti")


def with_exports(cards: DataFrame, exports: DataFrame) -> DataFrame:
    """Limit cards(source, ..) with what exports(source, fetched_at, usage_resets_available) say last of how many resets are left."""
    newest = exports.groupBy("source").agg(F.max_by("usage_resets_available", "fetched_at").alias("usage_resets_available"), F.max("fetched_at").alias("fetched_at"))
    return cards.join(newest, "source", "left")
