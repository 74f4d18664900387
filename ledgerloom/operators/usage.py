"""Questions about a usage ledger: windows, prices, summaries, series and breakdowns.

Everything is DataFrame in, DataFrame out. Costs are computed after the tokens are summed to (day, model), never
row by row. An unknown is null and stays null: a sum of reasoning tokens that nobody reported is null, and a cost
is null where nothing could be priced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens")
RATES = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")
#: How catalogs rank, the lower the better; any other catalog is a publisher's own.
CATALOG_RANKS = {"litellm": 1, "openrouter": 2}
AUTO_REVIEW, AUTO_REVIEW_AS = "codex-auto-review", "gpt-5.6-luna"  # fixed values


@dataclass(frozen=True)
class Filters:
    """None or empty: no constraint. start is included, end is not."""

    sources: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    project: str | None = None
    start: int | None = None
    end: int | None = None

    def apply(self, ledger: DataFrame) -> DataFrame:
        if self.sources:
            ledger = ledger.filter(F.col("source").isin(*self.sources))
        if self.models:
            ledger = ledger.filter(F.col("model").isin(*self.models))
        if self.project is not None:
            ledger = ledger.filter(F.col("project") == self.project)
        if self.start is not None:
            ledger = ledger.filter(F.col("timestamp") >= self.start)
        if self.end is not None:
            ledger = ledger.filter(F.col("timestamp") < self.end)
        return ledger

    def apply_days(self, rows: DataFrame, tz: str = "UTC") -> DataFrame:
        """For tables that know local days only; models and projects don't apply."""
        if self.sources:
            rows = rows.filter(F.col("source").isin(*self.sources))
        if self.start is not None:
            rows = rows.filter(F.col("day") >= bucket(F.lit(self.start), tz))
        if self.end is not None:
            rows = rows.filter(F.col("day") <= bucket(F.lit(self.end - 1), tz))
        return rows


def bucket(timestamp: Column, tz: str = "UTC", hourly: bool = False) -> Column:
    """The local day or hour of an epoch second."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(timestamp), tz), "yyyy-MM-dd HH:00" if hourly else "yyyy-MM-dd")


def total_tokens() -> Column:
    return sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))


def normalize_model(model: Column) -> Column:
    """Lower case, after the last slash, without a trailing date of eight digits."""
    return F.regexp_replace(F.substring_index(F.lower(model), "/", -1), "-[0-9]{8}$", "")


def rank_of(catalog: Column) -> Column:
    ranked = F.lit(0)
    for name, rank in CATALOG_RANKS.items():
        ranked = F.when(catalog == name, rank).otherwise(ranked)
    return ranked


def resolve_rates(models: DataFrame, rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """models(model), distinct -> (model, RATES, origin): the override, else of the catalog rows under the model's name
    and under its normal form the one of the better catalog, the name itself in a tie. Unpriced models have no row."""
    asked = models.select("model").filter("model is not null").distinct()
    by_override = asked.join(overrides, "model").select("model", "input", "output", F.coalesce("cache_read", F.lit(0)).alias("cache_read"), F.coalesce("cache_write", F.lit(0)).alias("cache_write_5m"), F.coalesce("cache_write", F.lit(0)).alias("cache_write_1h"), F.lit("override").alias("origin"), F.lit(-1).alias("rank"), F.lit(0).alias("way"))
    keys = asked.select("model", F.explode(F.array(F.struct(F.lit(1).alias("way"), F.col("model").alias("key")), F.struct(F.lit(2).alias("way"), normalize_model(F.col("model")).alias("key")), F.struct(F.lit(3).alias("way"), F.when(F.col("model") == AUTO_REVIEW, AUTO_REVIEW_AS).alias("key")))).alias("k")).select("model", "k.*")
    listed = rates.withColumnRenamed("model", "key").select("key", *RATES, F.col("catalog").alias("origin"), rank_of(F.coalesce("catalog", F.lit(""))).alias("rank"))
    # The stand-in of automatic reviews answers only where nothing else does.
    by_key = keys.join(listed, "key").select("model", *RATES, "origin", F.when(F.col("way") == 3, 9).otherwise(F.col("rank")).alias("rank"), "way")
    best = W.Window.partitionBy("model").orderBy("rank", "way")
    return by_override.unionByName(by_key).withColumn("best", F.row_number().over(best)).filter("best = 1").select("model", *RATES, "origin")


def price_at_day(days: DataFrame, history: DataFrame) -> DataFrame:
    """days(model, day) and history(model, day, priced, RATES): the last snapshot up to the day, else the first later
    one with a price. Every day keeps a row; one without a price has null rates."""
    first = history.filter("priced").groupBy("model").agg(F.sort_array(F.collect_list(F.struct("day", *RATES))).alias("priced_days"))
    marks = days.select("model", "day").distinct().select("model", "day", F.lit(1).alias("asked"), F.lit(None).cast("boolean").alias("priced"), *[F.lit(None).cast(history.schema[r].dataType).alias(r) for r in RATES])
    rows = marks.unionByName(history.select("model", "day", F.lit(0).alias("asked"), "priced", *RATES))
    before = W.Window.partitionBy("model").orderBy("day", "asked").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    seen = F.last(F.when(F.col("asked") == 0, F.struct("priced", *RATES)), ignorenulls=True).over(before)
    held = rows.withColumn("seen", seen).filter("asked = 1").select("model", "day", "seen").join(first, "model", "left")
    later = F.get(F.filter("priced_days", lambda x: x["day"] > F.col("day")), F.lit(0))
    return held.select("model", "day", *[F.when(F.col("seen.priced"), F.col(f"seen.{r}")).otherwise(later[r]).alias(r) for r in RATES])


def priced(sums: DataFrame, rates: DataFrame) -> DataFrame:
    """sums(model, TOKENS, ..) -> with cost, priced_tokens, unattributed_tokens, unpriced and cache_estimated."""
    known = F.col("r_input").isNotNull()
    total = total_tokens()
    cost = sum((F.col(t) * F.col(f"r_{r}") for t, r in zip(TOKENS[1:], RATES[1:], strict=True)), F.col(TOKENS[0]) * F.col("r_input"))
    gap = F.lit(False)
    for t, r in zip(TOKENS[2:], RATES[2:], strict=True):
        gap = gap | ((F.col(t) > 0) & (F.col(f"r_{r}") == 0))
    table = rates.select(F.col("model").alias("r_model"), *[F.col(r).alias(f"r_{r}") for r in RATES])
    joined = sums.join(table, F.col("model") == F.col("r_model"), "left")
    return joined.select(
        *sums.columns,
        F.when(known, cost).otherwise(0).alias("cost"),
        F.when(known, total).otherwise(0).alias("priced_tokens"),
        F.when(F.col("model").isNull(), total).otherwise(0).alias("unattributed_tokens"),
        (F.col("model").isNotNull() & ~known & (total > 0)).alias("unpriced"),
        F.coalesce(known & gap, F.lit(False)).alias("cache_estimated"),
    )


def _counted(rows: DataFrame, keys: list[str], session: list[str]) -> DataFrame:
    """One pass over rows: sums by (keys, model), and one row for each distinct (keys, session) with `is_session` set. Both
    come from the same grouping sets, so that the ledger is read and shuffled once."""
    sums = [F.sum(c).alias(c) for c in (*TOKENS, "api_calls", "reasoning_tokens")]
    sets = rows.select(*keys, *session, "model", *TOKENS, "api_calls", "reasoning_tokens").groupingSets([[*keys, "model"], [*keys, *session]], *keys, "model", *session)
    return sets.agg(F.grouping("model").cast("boolean").alias("is_session"), *sums)


def _priced_once(counted: DataFrame, rates: DataFrame, session: list[str]) -> DataFrame:
    """`priced` rows of the sums; rows of sessions add nothing but one to `convs`, where no part of the session is null."""
    known = F.lit(True)
    for c in session:
        known = known & F.col(c).isNotNull()
    own = lambda c: F.when(~F.col("is_session"), F.col(c)).alias(c)
    kept = [c for c in counted.columns if c not in (*TOKENS, "api_calls", "reasoning_tokens", "model", *session)]
    rows = counted.select(*kept, own("model"), *map(own, (*TOKENS, "api_calls", "reasoning_tokens")), F.when(F.col("is_session") & known, 1).otherwise(0).alias("convs"))
    return priced(rows, rates)


def summary(ledger: DataFrame, rates: DataFrame, filters: Filters = Filters(), tz: str = "UTC") -> DataFrame:
    """One row for the window."""
    session = ["source", "session_id"]
    names = lambda flag: F.array_sort(F.collect_set(F.when(F.col(flag), F.col("model"))))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    head = _priced_once(_counted(filters.apply(ledger), [], session), rates, session).agg(
        zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), zero("cache_read_tokens").alias("cache_read_tokens"),
        zero(F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).alias("cache_write_tokens"), zero("api_calls").alias("requests"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), zero("priced_tokens").alias("priced_tokens"), zero("unattributed_tokens").alias("unattributed_tokens"),
        names("unpriced").alias("unpriced_models"), names("cache_estimated").alias("cache_estimated_models"), zero("convs").alias("convs"),
    )
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    paid = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return head.select(
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", total.alias("total_tokens"), "requests",
        F.when((F.col("priced_tokens") > 0) | (total == 0), F.col("cost")).alias("cost"), (F.size("unpriced_models") > 0).alias("has_unpriced"), "unattributed_tokens",
        "unpriced_models", "cache_estimated_models", F.when(paid > 0, F.col("cache_read_tokens") / paid).otherwise(0.0).alias("cache_hit_rate"), "convs",
    )


def series(ledger: DataFrame, rates: DataFrame, filters: Filters = Filters(), hourly: bool = False, tz: str = "UTC") -> DataFrame:
    """One row for each (bucket, source): tokens by model, cost (never null), flags, reasoning, sessions."""
    rows = filters.apply(ledger).withColumn("bucket", bucket(F.col("timestamp"), tz, hourly))
    by_model = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("model").isNotNull() & (F.col("tokens") > 0), F.struct("model", "tokens")))))
    points = _priced_once(_counted(rows, ["bucket", "source"], ["session_id"]), rates, ["session_id"])
    return points.withColumn("tokens", total_tokens()).groupBy("bucket", "source").agg(
        by_model.alias("by_model"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.coalesce(F.bool_or("unpriced"), F.lit(False)).alias("has_unpriced"), F.bool_or("cache_estimated").alias("cache_estimated"),
        F.sum("unattributed_tokens").alias("unattributed_tokens"), *[F.sum(c).alias(c) for c in TOKENS], F.sum("reasoning_tokens").alias("reasoning"), F.sum("convs").cast("long").alias("convs"),
    )


def breakdown(ledger: DataFrame, rates: DataFrame, by: str, filters: Filters = Filters(), tz: str = "UTC") -> DataFrame:
    """by: model (split by source), project or tool. A missing model keeps its row; a missing project is 'unknown'."""
    key = {"model": F.col("model"), "project": F.coalesce("project", F.lit("unknown")), "tool": F.col("source")}[by]
    of = F.col("source") if by == "model" else F.lit(None).cast("string")
    rows = filters.apply(ledger).select(key.alias("key"), of.alias("of"), "model", "session_id", *TOKENS, "api_calls", "reasoning_tokens")
    out = _priced_once(_counted(rows, ["key", "of"], ["session_id"]), rates, ["session_id"]).groupBy("key", "of").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.sum(F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).alias("cache_write_tokens"), F.sum(total_tokens()).alias("total_tokens"), F.sum("api_calls").alias("requests"),
        F.when(F.sum("priced_tokens") > 0, F.sum("cost")).alias("cost"), F.sum("reasoning_tokens").alias("reasoning_tokens"), F.bool_or("cache_estimated").alias("cache_estimated"),
        F.coalesce(F.bool_or("unpriced"), F.lit(False)).alias("has_unpriced"), F.sum("unattributed_tokens").alias("unattributed_tokens"), F.sum("convs").cast("long").alias("convs"),
    )
    return out.withColumnRenamed("of", "source")


def displayed_models(ledger: DataFrame, rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every model of the ledger with the source that uses it most, its rates and its pricing state."""
    counts = ledger.filter("model is not null").groupBy("model", "source").agg(F.count("*").alias("n"))
    main = counts.groupBy("model").agg(F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("source"))
    found = resolve_rates(main, rates, overrides).withColumnRenamed("model", "m")
    absent = (F.col("cache_read") == 0) | (F.col("cache_write_5m") == 0)
    state = F.when(F.col("origin") == "override", "override").when(F.col("origin").isNull(), "unpriced").when(absent, "est").otherwise("ok")
    return main.join(found, F.col("model") == F.col("m"), "left").select("model", "source", *[F.nullif(F.col(r), F.lit(0)).alias(r) for r in RATES], "origin", state.alias("state"))
