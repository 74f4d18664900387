"""Calendar windows of the pages as expressions over dates: ranges, presets, buckets' bounds, month grids, panel periods,
and spans of time in words. Seconds are those of local midnights, so days with a change of clocks have their own length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calendar presets that can be configured, bounds of a rolling one in days, and slots for them.
CALENDAR = ("lastMonth", "lastQuarter", "lastYear")
ROLLING, SLOTS = (2, 1825), 4


def midnight(day: Column, tz: str = "UTC") -> Column:
    """The second at which a local day begins."""
    return F.unix_timestamp(F.to_utc_timestamp(day.cast("timestamp"), tz))


def _span(first: Column, last: Column, start: Column, end: Column) -> Column:
    return F.struct(first.cast("string").alias("first"), last.cast("string").alias("last"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def range_window(name: str, today: Column, low: Column | None = None, high: Column | None = None, tz: str = "UTC") -> Column:
    """struct(first, last, start, end) of day, week (7 days), month (30 days), total or custom; days with both ends, seconds
    with an excluded end. Only a custom range, whose ends may come in any order, has an end in seconds."""
    open_ = F.lit(None)
    back = {"day": 0, "week": 6, "month": 29}
    if name in back:
        first = F.date_sub(today, back[name])
        return _span(first, today, midnight(first, tz), open_)
    if name == "total":
        return _span(open_, open_, open_, open_)
    a, b = F.least(low, high), F.greatest(low, high)
    return _span(a, b, midnight(a, tz), midnight(F.date_add(b, 1), tz))


def heat_window(today: Column, tz: str = "UTC") -> Column:
    """The 365 days up to today."""
    first = F.date_sub(today, 364)
    return _span(first, today, midnight(first, tz), midnight(F.date_add(today, 1), tz))


def bounds(custom_first: Column, custom_last: Column, first: Column, last: Column) -> Column:
    """An empty end of a custom range is the ledger's own."""
    pick = lambda x, own: F.coalesce(F.nullif(x, F.lit("")), own)
    return F.struct(pick(custom_first, first).alias("first"), pick(custom_last, last).alias("last"))


def preset(key: str, last: Column, days: int = 0) -> Column:
    """struct(key, first, last): the days of a preset for a ledger whose last day is `last`."""
    month, quarter, year = (F.trunc(last, unit) for unit in ("month", "quarter", "year"))
    ends = {
        "yesterday": (F.date_sub(last, 1), F.date_sub(last, 1)), "thisMonth": (month, last), "last90": (F.date_sub(last, 89), last), "thisYear": (year, last),
        "lastMonth": (F.add_months(month, -1), F.date_sub(month, 1)), "lastQuarter": (F.add_months(quarter, -3), F.date_sub(quarter, 1)), "lastYear": (F.add_months(year, -12), F.date_sub(year, 1)),
        "rolling": (F.date_sub(last, days - 1), last),
    }[key]
    return F.struct(F.lit(key).alias("key"), ends[0].alias("first"), ends[1].alias("last"))


def valid_slots(slots: list) -> list[tuple[str, int] | None]:
    """Configured presets as far as they are valid: SLOTS places, holes stay holes."""

    def checked(slot) -> tuple[str, int] | None:
        if not slot:
            return None
        key, days = slot
        if key in CALENDAR:
            return key, 0
        return (key, days) if key == "rolling" and isinstance(days, int) and ROLLING[0] <= days <= ROLLING[1] else None

    return [checked(s) for s in [*slots, *[None] * SLOTS][:SLOTS]]


def presets(first: Column, last: Column, slots: list = ()) -> Column:
    """The shipped presets and the configured ones, cut to the ledger's first day; those that lie before it go."""
    asked = [(k, 0) for k in ("yesterday", "thisMonth", "last90", "thisYear")] + [s for s in valid_slots(list(slots)) if s]
    found = F.filter(F.array(*[preset(k, last, n) for k, n in asked]), lambda p: p["last"] >= first)
    return F.transform(found, lambda p: F.struct(p["key"].alias("key"), F.greatest(p["first"], first).cast("string").alias("first"), p["last"].cast("string").alias("last")))


def month_cells(day: Column) -> Column:
    """The month of a day as weeks from Monday, with nulls before and after its days."""
    first, last = F.trunc(day, "month"), F.last_day(day)
    pad = lambda n: F.array_repeat(F.lit(None).cast("date"), n)
    lead = F.weekday(first)
    return F.concat(pad(lead), F.sequence(first, last), pad((7 - (lead + F.dayofmonth(last)) % 7) % 7))


def calendar_span(first: Column, last: Column) -> Column:
    """Days from first to last, both counted, one at least."""
    return F.greatest(F.lit(1), F.datediff(F.to_date(last), F.to_date(first)) + 1)


def bucket_bounds(key: Column, per: str, tz: str = "UTC") -> Column:
    """struct(start, end): the seconds of an hour, day, week or month key, the end excluded."""
    if per == "hour":
        begin = F.to_timestamp(key, "yyyy-MM-dd HH:mm")
    else:
        begin = F.to_timestamp(F.to_date(F.concat(key, F.lit("-01")) if per == "month" else key))
    end = begin + F.expr({"hour": "interval 1 hour", "month": "interval 1 month", "week": "interval 7 days", "day": "interval 1 day"}[per])
    second = lambda t: F.unix_timestamp(F.to_utc_timestamp(t, tz))
    return F.struct(second(begin).alias("start"), second(end).alias("end"))


def panel_windows(period: str, now: Column, tz: str = "UTC") -> Column:
    """struct(start, end, prev_start, prev_end) in seconds of today, yesterday or days30, with the window it is compared to:
    today so far with yesterday up to this time, the others with as many days before."""
    today = F.to_date(F.from_utc_timestamp(F.timestamp_seconds(now), tz))
    at = lambda n: midnight(F.date_add(today, n), tz)
    ends = {"today": (at(0), at(1), at(-1), now - 86_400), "yesterday": (at(-1), at(0), at(-2), at(-1)), "days30": (at(-29), at(1), at(-59), at(-29))}[period]
    return F.struct(*[e.cast("long").alias(n) for e, n in zip(ends, ("start", "end", "prev_start", "prev_end"), strict=True)])


def bucket_keys(start: Column, end: Column, now: Column, hourly: bool, tz: str = "UTC") -> Column:
    """Keys of the local hours or days of a window that have begun; an hour that the clocks repeat is one key."""
    last = F.least(end - 1, now)
    local = lambda s: F.from_utc_timestamp(F.timestamp_seconds(s), tz)
    if hourly:
        return F.array_distinct(F.transform(F.sequence(start, last, F.lit(3600).cast("long")), lambda s: F.date_format(local(s), "yyyy-MM-dd HH:00")))
    return F.transform(F.sequence(F.to_date(local(start)), F.to_date(local(last))), lambda d: d.cast("string"))


def duration(minutes: Column) -> Column:
    """The two largest units of a span; minutes are left out beside days."""
    n = F.greatest(minutes, F.lit(0))
    days, hours, rest = F.floor(n / 1440), F.floor(n % 1440 / 60), F.floor(n % 60 + 0.5)
    part = lambda x, unit, ok: F.when(ok & (x > 0), F.concat(x.cast("string"), F.lit(unit)))
    return F.coalesce(F.nullif(F.concat_ws(" ", part(days, "d", F.lit(True)), part(hours, "h", F.lit(True)), part(rest, "m", days == 0)), F.lit("")), F.lit("0m"))


def freshness(via: Column, observed_at: Column, now: Column) -> Column:
    """checkedNow or checkedAgo for live readings, observedAgo or observedOld (past a day) for those from logs."""
    age = F.greatest(F.lit(0), now - observed_at)
    return F.when(observed_at.isNull(), None).when(via == "live", F.when(age < 30, "checkedNow").otherwise("checkedAgo")).otherwise(F.when(age > 86_400, "observedOld").otherwise("observedAgo"))


def since(at: Column, now: Column) -> Column:
    """How long ago the last scan was; a dash if there was none."""
    s = F.greatest(F.lit(0), now - at)
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(at <= 0, "—").when(s < 60, "just now").when(s < 3600, ago(60, " min ago")).otherwise(ago(3600, "h ago"))
