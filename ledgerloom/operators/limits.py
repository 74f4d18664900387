"""How many tokens a percent of a limit is worth, from readings of the limit and the usage between them.

Readings of one (source, window_key) are walked in the order of time: sorted partitions stream through the walk, which
holds one open stretch and one open epoch a series, never a group's rows. Usage between two readings comes from running
sums over seconds. Runs, representatives and cores then work on a few rows for each epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.functions.formats import tone

SERIES = ["source", "account_id", "plan", "metering_regime", "limit_id", "model_scope"]
#: Seconds by which stamps of one epoch may differ, and the policy of the estimate.
JITTER = 600
SEVEN_DAYS, RECENT_WINDOWS, REPRESENTATIVES, REQUIRED = 7 * 86_400, 6, 5, 3
LEAST_MOVES, LEAST_POINTS, SPREAD = 2, 10, 1.25
#: The first identity that a reading lacks, in this order, says why it proves nothing.
MISSING = (("account_id", "missing-account-identity"), ("plan", "missing-plan-identity"), ("metering_regime", "missing-metering-regime"), ("limit_id", "missing-limit-identity"), ("model_scope", "missing-model-scope"))

WALKED = "source string, window_key string, account_id string, plan string, metering_regime string, limit_id string, model_scope string, epoch long, window_minutes long, from_pct long, to_pct long, t0 long, t1 long, reason string, n long"


def displayed_windows(readings: DataFrame) -> DataFrame:
    """(source, window_key, window_minutes, used_pct, resets_at, observed_at): the newest epoch of each window."""
    each = ("window_minutes", "used_pct", "observed_at")
    epochs = readings.groupBy("source", "window_key", "resets_at").agg(*[F.max(c).alias(c) for c in each])  # a row an epoch
    newest = F.max("resets_at").over(W.Window.partitionBy("source", "window_key"))
    rows = epochs.withColumn("newest", newest).filter(F.col("resets_at") >= F.col("newest") - JITTER)
    return rows.groupBy("source", "window_key").agg(*[F.max(c).alias(c) for c in (*each, "resets_at")])


def plan_of(readings: DataFrame) -> DataFrame:
    """(source, plan): the newest plan that is known."""
    return readings.filter("plan is not null").groupBy("source").agg(F.max_by("plan", F.struct("observed_at", "plan")).alias("plan"))


class _Limit:
    """The walk over one limit's readings."""

    def __init__(self, source: str, window_key: str):
        self.key = (source, window_key)
        self.epochs: dict[tuple, tuple[int, int]] = {}
        self.since = None  # the reading that anchors the stretch, with its place
        self.highest, self.spoiled = 0, False
        self.refused: dict[str, int] = {}

    def refuse(self, reason: str) -> None:
        self.refused[reason] = self.refused.get(reason, 0) + 1

    def _epoch(self, series: tuple, resets_at: int, pct: int) -> int:
        epoch, high = self.epochs.get(series, (None, 0))
        stays = epoch is not None and (resets_at == epoch or (abs(resets_at - epoch) <= JITTER and pct >= high))
        if not stays:
            epoch, high = resets_at, pct
        self.epochs[series] = (epoch, max(high, pct))
        return epoch

    def step(self, r: dict) -> tuple | None:
        """Takes the next reading; an interval if it completes one."""
        pct = int(min(max(r["used_pct"], 0.0), 100.0) + 0.5)
        lacks = next((why for field, why in MISSING if r[field] is None), None)
        if lacks:
            self.refuse(lacks)
            if self.since is not None:  # it proves nothing, but may end the stretch
                ends = "percentage-decrease" if pct < self.highest else "percentage-saturation" if pct >= 100 else "known-external-activity" if r["external_activity"] is not None else None
                if ends:
                    self.refuse(ends)
                    self.since = None
                self.highest = max(self.highest, pct)
            return None
        series = tuple(r[c] for c in SERIES)
        here = (series, self._epoch(series, r["resets_at"], pct))
        if self.since is None:
            self._anchor(r, here, pct)
            return None
        before, was, from_pct = self.since
        if was != here:
            self.refuse("reset-boundary" if was[0] == series else "identity-change")
            self._anchor(r, here, pct)
            return None
        self.spoiled |= r["external_activity"] is not None
        if pct < self.highest:
            self.refuse("percentage-decrease")
        elif pct == from_pct:
            return None
        elif pct >= 100:
            self.refuse("percentage-saturation")
        elif self.spoiled:
            self.refuse("known-external-activity")
        elif before["observed_at"] == r["observed_at"]:
            self.refuse("ambiguous-reading-order")
        elif r["covered_from"] is None or r["covered_from"] > before["observed_at"]:
            self.refuse("unproven-source-completeness")
        else:
            self._anchor(r, here, pct)
            return (*series[:1], self.key[1], *series[1:], here[1], r["window_minutes"], from_pct, pct, before["observed_at"], r["observed_at"], None, 1)
        self._anchor(r, here, pct)
        return None

    def _anchor(self, r: dict, here: tuple, pct: int) -> None:
        self.since, self.spoiled, self.highest = (r, here, pct), False, pct

    def refusals(self) -> list[tuple]:
        return [(*self.key, *[None] * 11, why, n) for why, n in self.refused.items()]


def walk(readings: DataFrame) -> DataFrame:
    """Candidate intervals (reason null) and refusals (reason, n) of every limit. Readings of an instant keep the order of
    (resets_at, source_order). A percent that is no number is an error; a scope that is neither 'all' nor a list of models
    counts as missing. Readings that only repeat the one before are dropped before the walk, which they don't change."""
    fields = ["source", "window_key", "window_minutes", "used_pct", "resets_at", "observed_at", "account_id", "plan", "metering_regime", "limit_id", "model_scope", "covered_from", "external_activity"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, limit = [x.split()[0] for x in WALKED.split(", ")], None
        shaped = lambda rows: pd.DataFrame(rows, columns=names, dtype=object).where(lambda d: d.notna(), None)
        for frame in frames:
            rows = []
            for values in frame[fields].astype(object).where(frame[fields].notna(), None).itertuples(index=False, name=None):
                r = dict(zip(fields, values, strict=True))
                if limit is None or limit.key != (r["source"], r["window_key"]):
                    rows += limit.refusals() if limit else []
                    limit = _Limit(r["source"], r["window_key"])
                if (found := limit.step(r)) is not None:
                    rows.append(found)
            if rows:
                yield shaped(rows)
        if limit and limit.refused:
            yield shaped(limit.refusals())

    whole = F.when(F.isnan("used_pct") | (F.abs("used_pct") == float("inf")), F.raise_error(F.lit("a limit reading's percent is no number"))).otherwise(F.col("used_pct"))
    models = F.from_json("model_scope", "array<string>")
    scope = F.when((F.col("model_scope") == "all") | (F.size(models) > 0) & ~F.exists(models, lambda m: m.isNull()), F.col("model_scope"))
    usable = readings.withColumn("used_pct", whole).withColumn("model_scope", scope).select(*fields, F.coalesce("source_order", F.lit(0)).alias("source_order"))
    one = W.Window.partitionBy("source", "window_key").orderBy("observed_at", "resets_at", "source_order", "used_pct")
    told = F.struct("account_id", "plan", "metering_regime", "limit_id", "model_scope", "resets_at", F.floor(F.least(F.greatest(F.col("used_pct"), F.lit(0.0)), F.lit(100.0)) + 0.5).alias("pct"))
    plain = F.col("external_activity").isNull()
    for c in ("account_id", "plan", "metering_regime", "limit_id", "model_scope"):
        plain = plain & F.col(c).isNotNull()
    seen = usable.withColumn("repeats", plain & F.coalesce(F.lag(told).over(one) == told, F.lit(False)))
    return seen.filter("not repeats").sortWithinPartitions("source", "window_key", "observed_at", "resets_at", "source_order", "used_pct").mapInPandas(run, WALKED)


def with_usage(candidates: DataFrame, usage: DataFrame) -> DataFrame:
    """candidates: `walk`'s rows without reason; usage(source, account_id, timestamp, model, tokens), where records without
    an account count for any. Adds tokens of (t0, t1], and the reason where the usage refuses the interval. Every record
    stands under 'all models' and its own model; running sums at the two ends, subtracted, are the interval's usage."""
    cand = candidates.withColumn("id", F.struct(*SERIES, "window_key", "epoch", "t0", "t1"))
    scoped = F.when(F.col("model_scope") == "all", F.array(F.lit("*"))).otherwise(F.concat(F.transform(F.from_json("model_scope", "array<string>"), lambda m: F.concat(F.lit("="), m)), F.array(F.lit("?"))))
    ends = cand.select("id", "source", F.explode(F.array(F.col("account_id"), F.lit(None))).alias("who"), F.explode(scoped).alias("what"), "t0", "t1")
    ends = ends.select("id", "source", "who", "what", F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("t1").alias("t"), F.lit(1).alias("sign")))).alias("e")).select("id", "source", "who", "what", "e.*")
    own = F.when(F.col("model").isNull(), "?").otherwise(F.concat(F.lit("="), F.col("model")))
    seconds = usage.select("source", F.col("account_id").alias("who"), F.explode(F.array(F.lit("*"), own)).alias("what"), F.col("timestamp").alias("t"), "tokens").groupBy("source", "who", "what", "t").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
    marks = ends.select("id", "source", "who", "what", "t", "sign", F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("records"))
    all_ = marks.unionByName(seconds.select(F.lit(None).cast(cand.schema["id"].dataType).alias("id"), "source", "who", "what", "t", F.lit(0).alias("sign"), "tokens", "records"))
    upto = W.Window.partitionBy("source", "who", "what").orderBy("t").rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    summed = all_.withColumn("tokens", F.sum("tokens").over(upto)).withColumn("records", F.sum("records").over(upto)).filter("sign <> 0")
    per = summed.groupBy("id").agg(F.sum(F.when(F.col("what") != "?", F.col("sign") * F.col("tokens")).otherwise(0)).alias("tokens"), F.sum(F.when(F.col("what") == "?", F.col("sign") * F.col("records")).otherwise(0)).alias("nameless"))
    joined = per.select("id.*", "tokens", "nameless")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*SERIES, "window_key", "epoch", "t0", "t1")]
    both = cand.drop("id", "reason").alias("c").join(joined.alias("s"), on, "left").select("c.*", "s.tokens", "s.nameless")
    return both.withColumn("reason", F.when(F.col("nameless") > 0, "unattributed-model-usage").when(F.coalesce("tokens", F.lit(0)) == 0, "zero-local-usage")).drop("nameless")


def intervals(readings: DataFrame, usage: DataFrame) -> DataFrame:
    return with_usage(walk(readings).filter("reason is null"), usage)


def rejections(walked: DataFrame, weighed: DataFrame) -> DataFrame:
    """(source, window_key, reason, n) of every refusal of readings and intervals."""
    both = walked.filter("reason is not null").select("source", "window_key", "reason", "n").unionByName(weighed.filter("reason is not null").select("source", "window_key", "reason", F.lit(1).cast("long").alias("n")))
    return both.groupBy("source", "window_key", "reason").agg(F.sum("n").alias("n"))


def runs(accepted: DataFrame) -> DataFrame:
    """accepted intervals -> chains of intervals that begin where the last one ended, in time and in percent."""
    part = [*SERIES, "window_key", "epoch"]
    by = W.Window.partitionBy(*part).orderBy("t0", "t1")
    fresh = F.coalesce((F.lag("t1").over(by) != F.col("t0")) | (F.lag("to_pct").over(by) != F.col("from_pct")), F.lit(True))
    chained = accepted.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by))
    out = chained.groupBy(*part, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("tokens").alias("tokens"), F.sum(F.col("to_pct") - F.col("from_pct")).alias("movement"), F.count("*").alias("moves"), F.max("window_minutes").alias("window_minutes"))
    return out.withColumn("qualifies", (F.col("moves") >= LEAST_MOVES) & (F.col("movement") >= LEAST_POINTS))


def representatives(found: DataFrame) -> DataFrame:
    """One row for each epoch: its qualifying run of greatest movement, or the reason why there is none (no qualifying run,
    or several of that movement)."""
    part = [*SERIES, "window_key", "epoch"]
    far = F.max(F.when(F.col("qualifies"), F.col("movement"))).over(W.Window.partitionBy(*part))
    top = F.col("qualifies") & (F.col("movement") == F.col("far"))
    one = lambda c: F.max(F.when(top, F.col(c))).alias(c)
    out = found.withColumn("far", far).groupBy(*part).agg(F.count_if(top).alias("ties"), F.max("window_minutes").alias("window_minutes"), *[one(c) for c in ("tokens", "movement", "moves", "t0", "t1")])
    reason = F.when(F.col("ties") == 0, "no-qualifying-run").when(F.col("ties") > 1, "ambiguous-greatest-run")
    return out.withColumn("reason", reason).withColumn("ratio", F.when(F.col("ties") == 1, F.col("tokens") / F.col("movement"))).drop("ties")


def _disagree(some: list[tuple[float, float, float | None]]) -> str | None:
    """(ratio, lower, upper) of candidates -> why they can't have one ratio."""
    uppers = [u for _, _, u in some if u is not None]
    if uppers and max(low for _, low, _ in some) > min(uppers):
        return "quantization-ranges-disjoint"
    ratios = [r for r, _, _ in some]
    return "ratio-spread-exceeded" if max(ratios) / min(ratios) > SPREAD else None


def core_of(some: list[tuple[float, float, float | None]]) -> tuple[list[int], str | None]:
    """The one largest agreeing set (of at least three quarters, and at least three) or the reason why there is none."""
    n, why = len(some), None
    for size in range(n, max(REQUIRED, -(-3 * n // 4)) - 1, -1):
        told = [(c, _disagree([some[i] for i in c])) for c in combinations(range(n), size)]
        good = [c for c, bad in told if bad is None]
        why = why or next((bad for _, bad in told if bad), None)
        if len(good) == 1:
            return list(good[0]), None
        if good:
            return [], "competing-stable-cores"
    return [], why


def horizon(minutes: float | None) -> int:
    return SEVEN_DAYS if minutes is None else max(SEVEN_DAYS, RECENT_WINDOWS * int(minutes) * 60)


def _evaluated(epochs: list[dict], at: int) -> tuple[float | None, list[dict], int, str | None]:
    """(tokens a percent, candidates, horizon, reason) of one series' epochs at an instant."""
    past = sorted((e for e in epochs if e["epoch"] <= at), key=lambda e: -e["epoch"])
    span = horizon(next((e["window_minutes"] for e in past if e["window_minutes"] is not None), None))
    some = [e for e in past if e["epoch"] >= at - span and e["ratio"] is not None][:REPRESENTATIVES]
    if len(some) < REQUIRED:
        return None, some, span, "insufficient-recent-epochs"
    ranges = [(e["ratio"], e["tokens"] / (e["movement"] + 1), e["tokens"] / (e["movement"] - 1) if e["movement"] > 1 else None) for e in some]
    core, why = core_of(ranges)
    return (median(ranges[i][0] for i in core) if core else None), some, span, why


def answer(current: dict, epochs: list[dict], at: int) -> tuple[str, float | None, int, str | None, int | None]:
    """(state, tokens a percent, candidates, reason, next_evaluation_at) of one limit at an instant. current: its newest reading;
    epochs(epoch, window_minutes, tokens, movement, ratio): what its windows up to then have shown."""
    lacks = next((why for field, why in MISSING if current[field] is None), None)
    if current["resets_at"] <= at:
        lacks = "no-current-reading"
    elif lacks is None and (current["covered_from"] is None or current["covered_from"] != current["covered_from"]):
        lacks = "unproven-source-completeness"
    if lacks:
        return "blocked", None, 0, lacks, None
    value, some, span, why = _evaluated(epochs, at)
    state = "ready" if value is not None else "unstable" if len(some) >= REQUIRED else "gathering"
    if state == "gathering" and any(_evaluated(epochs, e["epoch"])[0] is not None for e in epochs if e["epoch"] <= at):
        state, why = "stale", "historical-core-aged-out"
    due = min(t for t in (current["resets_at"], *(e["epoch"] + span + 1 for e in some)) if t > at)
    return state, value, len(some), why, due


ESTIMATE = ", ".join(f"{c} string" for c in SERIES) + ", window_key string, state string, tokens_per_pct double, candidates int, reason string, next_evaluation_at long"


def estimates(epochs: DataFrame, current: DataFrame, evaluated_at: int) -> DataFrame:
    """epochs: `representatives`; current(SERIES, window_key, resets_at, covered_from): the newest reading of each limit.
    One row for each limit: blocked, ready (with tokens_per_pct), unstable, stale or gathering at that instant."""
    keys = [*SERIES, "window_key"]
    past = epochs.filter(F.col("epoch") <= evaluated_at).select(*keys, F.struct("epoch", "window_minutes", F.col("tokens").cast("double").alias("tokens"), F.col("movement").cast("double").alias("movement"), "ratio").alias("e"))
    gathered = past.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("es"))  # one entry for each epoch of a window
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    joined = current.alias("c").join(gathered.alias("g"), on, "left").select(*[f"c.{k}" for k in keys], "c.resets_at", "c.covered_from", "g.es")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                es = [{k: (None if v is None or v != v else v) for k, v in dict(e).items()} for e in (r["es"] if r["es"] is not None else [])]
                rows.append((*[r[k] for k in keys], *answer(r, es, evaluated_at)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ESTIMATE.split(", ")])

    return joined.mapInPandas(run, ESTIMATE)


def current_readings(readings: DataFrame, evaluated_at: int) -> DataFrame:
    """The newest reading of each limit up to an instant; one that proves its series goes before one that doesn't."""
    proven = F.lit(True)
    for field, _ in MISSING:
        proven = proven & F.col(field).isNotNull()
    rest = F.struct("account_id", "plan", "metering_regime", "limit_id", "model_scope", "resets_at", "covered_from", "used_pct", "observed_at")
    rows = readings.filter(F.col("observed_at") <= evaluated_at)
    return rows.groupBy("source", "window_key").agg(F.max_by(rest, F.struct(proven, "observed_at", "resets_at", "used_pct")).alias("r")).select("source", "window_key", "r.*")


def window_view(shown: DataFrame, now: int) -> DataFrame:
    """Displayed windows with whole percents used and left; a window that has reset shows none used."""
    used = F.when(F.col("resets_at") <= now, 0).otherwise(F.floor(F.least(F.greatest(F.col("used_pct"), F.lit(0.0)), F.lit(100.0)) + 0.5)).cast("long")
    return shown.withColumn("used", used).withColumn("left", 100 - used).withColumn("tone", tone(100 - used))



def window_bar(shown: DataFrame, now: int, mode: str = "left") -> DataFrame:
    """`window_view` rows with the percent that is drawn (left or used) and the tick: where now lies between the window's start
    and its reset, in the same framing; none for windows of unknown length or that have reset."""
    gone = F.col("resets_at") <= now
    left = (F.col("resets_at") - now) / (F.col("window_minutes") * 60.0)
    tick = F.when(~gone & (F.col("window_minutes") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), left if mode == "left" else 1 - left)))
    return shown.withColumn("drawn", F.col("left") if mode == "left" else F.col("used")).withColumn("tick", tick)


def next_due(estimated: DataFrame, now: int) -> DataFrame:
    """(due): the next instant at which time alone changes an answer."""
    return estimated.agg(F.min(F.when(F.col("next_evaluation_at") > now, F.col("next_evaluation_at"))).alias("due"))


def cards(catalog: DataFrame, shown: DataFrame, plans: DataFrame, failures: DataFrame) -> DataFrame:
    """catalog(place, key, limits), shown(source, observed_at, ..), plans(source, plan), failures(source, failure) -> one card for
    each source with limits: (place, source, state, plan, observed_at, windows). State is live, signed-out, error (any other
    failure) or nothing-recorded (a source that is only read from logs and has none)."""
    held = shown.groupBy("source").agg(F.max("observed_at").alias("observed_at"), F.count("*").alias("windows"))
    rows = catalog.filter("limits is not null").withColumnRenamed("key", "source").join(held, "source", "left").join(plans, "source", "left").join(failures, "source", "left")
    state = F.when(F.col("failure") == "signed-out", "signed-out").when(F.col("failure").isNotNull(), "error").when(F.col("windows") > 0, "live").when(F.col("limits") == "live", "signed-out").otherwise("nothing-recorded")
    live = state == "live"
    return rows.select("place", "source", state.alias("state"), F.when(live, F.col("plan")).alias("plan"), "observed_at", F.when(live, F.col("windows")).otherwise(0).cast("long").alias("windows"))


def page(readings: DataFrame, usage: DataFrame, evaluated_at: int) -> DataFrame:
    """The limits page: each displayed window with its view, its plan and what a percent of it is worth at an instant."""
    known = readings.filter(F.col("observed_at") <= evaluated_at)
    view = window_bar(window_view(displayed_windows(known), evaluated_at), evaluated_at)
    found = representatives(runs(intervals(readings, usage).filter("reason is null")))
    worth = estimates(found, current_readings(readings, evaluated_at), evaluated_at).select("source", "window_key", "state", "tokens_per_pct", "reason", "next_evaluation_at")
    return view.join(worth, ["source", "window_key"], "left").join(plan_of(known), "source", "left")
