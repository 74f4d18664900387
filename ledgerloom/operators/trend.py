"""What the pages of a usage ledger derive from its daily points: calendars, levels, streaks, re-bucketed trends, top
models with a rest, folded projects and the pace against the window before.

Points are (bucket, source, model, tokens) sums, one row for each day, source and model: a few thousand a year, whatever
the size of the ledger. Windows without a partition key run over days or models of one ledger only, never over records.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.operators.usage import Filters, bucket, total_tokens
from ledgerloom.session import cut

MORE, UNATTRIBUTED = "more", "unattributed"


def points(ledger: DataFrame, filters: Filters = Filters(), hourly: bool = False, tz: str = "UTC") -> DataFrame:
    """(bucket, source, model, tokens): the grain that every derivation starts from. A ledger may bring its total as `tokens`."""
    total = F.col("tokens") if "tokens" in ledger.columns else total_tokens()
    rows = filters.apply(ledger).groupBy(bucket(F.col("timestamp"), tz, hourly).alias("bucket"), "source", "model")
    return rows.agg(F.sum(total).alias("tokens"))


def in_window(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Points of the days from first to last, both included; hour keys count to their day."""
    return rows.filter(F.substring("bucket", 1, 10).between(first, last))


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def heat_days(rows: DataFrame) -> DataFrame:
    """(day, tokens, unattributed, by_source, by_model) of the active days."""
    day = F.substring("bucket", 1, 10).alias("day")
    sources = rows.groupBy(day, "source").agg(F.sum("tokens").alias("tokens")).groupBy("day").agg(F.sum("tokens").alias("tokens"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "tokens")))).alias("by_source"))
    models = rows.groupBy(day, "model").agg(F.sum("tokens").alias("tokens")).groupBy("day").agg(
        F.coalesce(F.sum(F.when(F.col("model").isNull(), F.col("tokens"))), F.lit(0)).alias("unattributed"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("model").isNotNull(), F.struct("model", "tokens"))))).alias("by_model"),
    )
    return sources.join(models, "day")


def calendar(first: Column, last: Column, unit: str = "day") -> Column:
    """All keys from first to last, for filling with zeros. unit: hour, day, week (from Sunday) or month."""
    if unit == "hour":
        return F.transform(F.sequence(F.to_timestamp(first), F.to_timestamp(last), F.expr("interval 1 hour")), lambda t: F.date_format(t, "yyyy-MM-dd HH:00"))
    a, b = F.to_date(first), F.to_date(last)
    if unit == "month":
        return F.transform(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    if unit == "week":
        return F.transform(F.sequence(_sunday(a), _sunday(b), F.expr("interval 7 days")), lambda d: d.cast("string"))
    return F.transform(F.sequence(a, b), lambda d: d.cast("string"))


def _sunday(day: Column) -> Column:
    return F.date_sub(day, F.dayofweek(day) - 1)


def coarser(key: Column, unit: str) -> Column:
    """The week's first Sunday, the month, or the day of a day or hour key."""
    day = F.substring(key, 1, 10)
    return {"hour": key, "day": day, "week": _sunday(F.to_date(day)).cast("string"), "month": F.substring(key, 1, 7)}[unit]


def granularity(days: Column) -> Column:
    """Hours for a day, days to a month, weeks to four months, else months."""
    return F.when(days <= 1, "hour").when(days <= 31, "day").when(days <= 120, "week").otherwise("month")


def trend(rows: DataFrame, unit: str, fill: bool = True) -> DataFrame:
    """(bucket, source, tokens) by hour, day, week or month; with fill, every key between the ends has every source."""
    if fill:  # asked three times, and the ledger is read once: a few rows a day
        rows = cut(rows.groupBy("bucket", "source").agg(F.sum("tokens").alias("tokens")))
    sums = rows.groupBy(coarser(F.col("bucket"), unit).alias("bucket"), "source").agg(F.sum("tokens").alias("tokens"))
    if not fill:
        return sums
    ends = rows.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    keys = ends.filter("a is not null").select(F.explode(calendar(F.col("a"), F.col("b"), unit)).alias("bucket"))
    grid = keys.join(F.broadcast(sums.select("source").distinct()), F.lit(True))  # sources number at most a few dozen
    return grid.join(sums, ["bucket", "source"], "left").select("bucket", "source", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def trend_points(rows: DataFrame, unit: str) -> DataFrame:
    """Points in coarser buckets."""
    return rows.groupBy(coarser(F.col("bucket"), unit).alias("bucket"), "source", "model").agg(F.sum("tokens").alias("tokens"))


def trend_slice(rows: DataFrame, hours: DataFrame, first: str, last: str, override: str | None = None) -> DataFrame:
    """(bucket, source, tokens) of the days from first to last in the unit that fits them, or in the one that is asked for;
    hours come from their own points."""
    days = (date.fromisoformat(last) - date.fromisoformat(first)).days + 1
    unit = override or ("hour" if days <= 1 else "day" if days <= 31 else "week" if days <= 120 else "month")
    return trend(in_window(hours if unit == "hour" else rows, first, last), unit)


def heat_levels(days: DataFrame) -> DataFrame:
    """days(day, tokens) -> with level 1 to 4 by the rank's quartile among active days; 0 without tokens."""
    active = W.Window.partitionBy(F.col("tokens") > 0)
    upto = active.orderBy("tokens").rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    n, less = F.count("*").over(active), F.count("*").over(upto)
    level = F.least(F.lit(4), F.greatest(F.lit(1), F.floor((4 * less + n - 1) / n))).cast("int")
    return days.withColumn("level", F.when(F.col("tokens") > 0, level).otherwise(0))


def streaks(days: DataFrame) -> DataFrame:
    """days(day, tokens) -> one row: total, active_days, longest_streak, best_day (the earliest of equals)."""
    active = days.filter("tokens > 0").withColumn("island", F.date_sub(F.to_date("day"), F.row_number().over(W.Window.orderBy("day"))))
    runs = active.groupBy("island").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max(F.struct("tokens", (-F.unix_date(F.to_date("day"))).alias("back"))).alias("best"))
    best = F.max("best")
    return runs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("active_days"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_streak"), F.date_from_unix_date((-best["back"]).cast("int")).cast("string").alias("best_day"))


def split_rows(rows: DataFrame, top: int) -> DataFrame:
    """(place, model, tokens): the `top` largest models, the rest as one row, unattributed usage last."""
    sums = rows.groupBy("model").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    ranked = sums.withColumn("rn", F.row_number().over(W.Window.partitionBy(F.col("model").isNull()).orderBy(F.desc("tokens"), "model")))
    named = ranked.select(
        F.when(F.col("model").isNull(), top + 2).when(F.col("rn") <= top, F.col("rn")).otherwise(top + 1).alias("place"),
        F.when(F.col("model").isNull(), UNATTRIBUTED).when(F.col("rn") <= top, F.col("model")).otherwise(MORE).alias("model"), "tokens",
    )
    return named.groupBy("place", "model").agg(F.sum("tokens").alias("tokens"))


def profile(rows: DataFrame) -> DataFrame:
    """(model, tokens, share of everything including unattributed usage, first_day, active_days) of each model."""
    sums = rows.groupBy("model").agg(F.sum("tokens").alias("tokens"), F.min(F.substring("bucket", 1, 10)).alias("first_day"), F.count_distinct(F.substring("bucket", 1, 10)).alias("active_days"))
    whole = F.sum("tokens").over(W.Window.partitionBy(F.lit(0)))
    return sums.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)).filter("model is not null")


def fold_projects(projects: DataFrame) -> DataFrame:
    """projects(key, tokens) -> tokens by key, where a key whose direct parent directory is a key too counts as the parent.
    Only one step up: a folded parent is not folded again for its children."""
    parents = projects.select(F.col("key").alias("parent")).distinct()
    up = projects.withColumn("up", F.regexp_extract("key", "^(.*)/[^/]*$", 1))
    return up.join(parents, F.col("up") == F.col("parent"), "left").groupBy(F.coalesce("parent", "key").alias("key")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("members"))


def bucket_ranks(sums: DataFrame) -> DataFrame:
    """sums(bucket, tokens) -> with rank (ties share one) and the whole percent above or below the mean."""
    whole = W.Window.partitionBy(F.lit(0))
    mean = F.avg("tokens").over(whole)
    return sums.withColumn("rank", F.rank().over(whole.orderBy(F.desc("tokens")))).withColumn("percent", F.when(mean > 0, rounded((F.col("tokens") - mean) * 100 / mean)))


def peak(sums: DataFrame) -> DataFrame:
    """The largest bucket, the earliest of equals."""
    return sums.orderBy(F.desc("tokens"), "bucket").limit(1)


def pace(rows: DataFrame, boundary: int, seconds: int) -> DataFrame:
    """rows(timestamp, source, ..token columns) -> tokens in the `seconds` from boundary on and in as many before it, and the
    change in whole percent (null where there was nothing before)."""
    near = rows.filter((F.col("timestamp") >= boundary - seconds) & (F.col("timestamp") < boundary + seconds))
    now = F.col("timestamp") >= boundary
    sums = near.groupBy("source").agg(F.coalesce(F.sum(F.when(now, total_tokens())), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(~now, total_tokens())), F.lit(0)).alias("before"))
    return sums.withColumn("percent", F.when(F.col("before") > 0, rounded((F.col("tokens") - F.col("before")) * 100 / F.col("before"))))


def small_multiples(rows: DataFrame, unit: str = "month") -> DataFrame:
    """(source, tokens, share, series): one little chart for each source, its values in the order of the calendar."""
    filled = trend(rows, unit)
    each = filled.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.transform(F.sort_array(F.collect_list(F.struct("bucket", "tokens"))), lambda x: x["tokens"]).alias("series"))
    return each.withColumn("share", F.col("tokens") / F.sum("tokens").over(W.Window.partitionBy(F.lit(0))))


def owners(rows: DataFrame) -> DataFrame:
    """(model, source): the source that used the model last (of equals the later in order), with all that did."""
    return rows.filter("model is not null").groupBy("model").agg(F.max_by("source", F.struct("bucket", "source")).alias("source"), F.array_sort(F.collect_set("source")).alias("sources"))
