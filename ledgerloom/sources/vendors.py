"""Limit windows from what vendors answer: payloads in, rows (fetched_at, window_key, window_minutes, used_pct, resets_at, limit_id,
model_scope) out. A window without a percent or a reset is none."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.formats import iso_epoch, window_key

#: Windows over a whole source, by the kind and by the key that name them, with minutes.
SOURCE_WIDE = (("session", "five_hour", 300), ("weekly_all", "seven_day", 10080))
#: Known quota buckets, with the windows they are.
BUCKETS = {"gemini-5h": ("gemini:w300", 300), "gemini-weekly": ("gemini:w10080", 10080), "3p-5h": ("3p:w300", 300), "3p-weekly": ("3p:w10080", 10080)}
#: Names under which a rate limit tells its percent, reset and time to the reset.
PERCENTS, RESETS, AFTER = ("used_percent", "used_percentage", "utilization"), ("reset_at", "resets_at"), ("reset_after_seconds", "resets_in_seconds")
_NAMED = "fetched_at long, window_key string, window_minutes long, used_pct double, reset string, shape string"


def _when(reset: Column) -> Column:
    return F.coalesce(reset.try_cast("bigint"), iso_epoch(reset))


def _wide(name: Column, value) -> Column:
    out = F.lit(None)
    for row in SOURCE_WIDE:
        out = F.when(name.isin(row[0], row[1]), value(row)).otherwise(out)
    return out


def _named_objects(payloads: DataFrame, shape: str) -> DataFrame:
    """Objects of payloads(fetched_at, payload), at any depth outside lists, that carry a percent: a payload is a small document."""

    def found(node: object, name: str) -> Iterator[tuple[str, dict]]:
        if isinstance(node, dict):
            number = lambda k: isinstance(node.get(k), (int, float)) and not isinstance(node.get(k), bool)
            if shape == "named" and number("utilization") and node.get("resets_at") is not None:
                yield name, {"pct": node["utilization"], "minutes": None, "reset": node["resets_at"]}
            elif shape == "rates" and (pct := next((node[k] for k in PERCENTS if number(k)), None)) is not None and (number("limit_window_seconds") or number("window_minutes")):
                minutes = node["limit_window_seconds"] // 60 if number("limit_window_seconds") else node["window_minutes"]
                at = next((node[k] for k in RESETS if number(k)), None)
                after = next((node[k] for k in AFTER if number(k)), None)
                yield name, {"pct": pct, "minutes": minutes, "reset": at if at is not None else None if after is None else f"+{after}"}
            else:
                for key, value in node.items():
                    yield from found(value, key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _NAMED.split(", ")]
        for frame in frames:
            rows = []
            for at, text in zip(frame["fetched_at"], frame["payload"], strict=True):
                try:
                    body = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += [(at, name, w["minutes"], float(w["pct"]), None if w["reset"] is None else str(w["reset"]), shape) for name, w in found(body, "")]
            yield pd.DataFrame(rows, columns=names).astype({"window_minutes": "Int64"})

    return payloads.select("fetched_at", "payload").mapInPandas(run, _NAMED)


def claude_windows(payloads: DataFrame) -> DataFrame:
    """The list of limits where there is one with a window, else objects that tell a utilization, by the names they have."""
    item = "array<struct<kind: string, percent: double, resets_at: string, scope: struct<model: struct<display_name: string>>>>"
    rows = payloads.select("fetched_at", "payload", F.monotonically_increasing_id().alias("n"), F.from_json(F.get_json_object("payload", "$.limits"), item).alias("items"))
    listed = rows.select("n", "fetched_at", F.explode("items").alias("w")).withColumn("resets_at", _when(F.col("w.resets_at"))).filter("w.percent is not null and resets_at is not null")
    kind, model = F.col("w.kind"), F.col("w.scope.model.display_name")
    scoped = (kind == "weekly_scoped") & model.isNotNull()
    key = F.coalesce(_wide(kind, lambda r: F.lit(r[1])), F.when(scoped, F.concat(F.lit("seven_day_"), F.regexp_replace(F.lower(model), "[^a-z0-9]", "_"))), F.nullif(kind, F.lit("")))
    minutes = F.coalesce(_wide(kind, lambda r: F.lit(r[2])), F.when(scoped, SOURCE_WIDE[1][2]))
    whole = _wide(kind, lambda r: F.lit(r[0]))
    first = listed.select("n", "fetched_at", key.alias("window_key"), minutes.cast("long").alias("window_minutes"), F.col("w.percent").alias("used_pct"), "resets_at", whole.alias("limit_id"), F.when(whole.isNotNull(), "all").alias("model_scope")).filter("window_key is not null")
    others = _named_objects(rows.join(first.select("n").distinct(), "n", "left_anti").select("fetched_at", "payload"), "named")
    name = F.col("window_key")
    whole = _wide(name, lambda r: F.lit(r[0]))
    minutes = F.coalesce(_wide(name, lambda r: F.lit(r[2])), F.when(name.startswith("seven_day_"), SOURCE_WIDE[1][2]))
    second = others.select("fetched_at", "window_key", minutes.cast("long").alias("window_minutes"), "used_pct", _when(F.col("reset")).alias("resets_at"), whole.alias("limit_id"), F.when(whole.isNotNull(), "all").alias("model_scope"))
    return first.drop("n").unionByName(second).filter("resets_at is not null")


def codex_windows(payloads: DataFrame) -> DataFrame:
    """Rate limits with a percent and a length, wherever they lie; a reset that is told as a time to go counts from the fetch."""
    rows = _named_objects(payloads, "rates")
    after = F.col("reset").startswith("+")
    at = F.when(after, F.col("fetched_at") + F.substring("reset", 2, 20).try_cast("bigint")).otherwise(F.col("reset").try_cast("bigint"))
    key = window_key(F.col("window_minutes"))
    return rows.select("fetched_at", key.alias("window_key"), "window_minutes", "used_pct", at.alias("resets_at"), F.concat(F.lit("codex:"), key).alias("limit_id"), F.lit("all").alias("model_scope")).filter("resets_at is not null")


def copilot_windows(payloads: DataFrame) -> DataFrame:
    """The finite premium requests: what is used of the entitlement, in percent."""
    quota = "$.quota_snapshots.premium_interactions"
    of = lambda name: F.get_json_object("payload", f"{quota}.{name}")
    whole, left = of("entitlement").try_cast("double"), F.coalesce(of("quota_remaining").try_cast("double"), of("remaining").try_cast("double"))
    at = F.coalesce(_when(of("quota_reset_at")), iso_epoch(F.get_json_object("payload", "$.quota_reset_date_utc")))
    none = F.lit(None)
    rows = payloads.filter((of("unlimited") == "false") & (whole > 0) & (left >= 0) & (left <= whole) & (at > 0))
    return rows.select("fetched_at", F.lit("premium_requests").alias("window_key"), none.cast("long").alias("window_minutes"), ((whole - left) * 100 / whole).alias("used_pct"), at.alias("resets_at"), none.cast("string").alias("limit_id"), none.cast("string").alias("model_scope"))


def antigravity_windows(payloads: DataFrame) -> DataFrame:
    """Known buckets of groups, under either spelling of their fields, that are on and tell the fraction that is left."""
    bucket = "bucketId: string, bucket_id: string, disabled: boolean, remainingFraction: double, remaining_fraction: double, resetTime: string, reset_time: string"
    groups = F.from_json(F.get_json_object("payload", "$.groups"), f"array<struct<buckets: array<struct<{bucket}>>>>")
    rows = payloads.select("fetched_at", F.explode(F.flatten(F.transform(groups, lambda g: F.coalesce(g["buckets"], F.array())))).alias("b"))
    table = F.create_map(*[F.lit(x) for name, (key, minutes) in BUCKETS.items() for x in (name, f"{key}|{minutes}")])
    known = F.try_element_at(table, F.coalesce("b.bucketId", "b.bucket_id"))
    left, at = F.coalesce("b.remainingFraction", "b.remaining_fraction"), iso_epoch(F.coalesce("b.resetTime", "b.reset_time"))
    none = F.lit(None).cast("string")
    found = rows.filter(known.isNotNull() & ~F.coalesce("b.disabled", F.lit(False)) & left.isNotNull() & at.isNotNull())
    return found.select("fetched_at", F.substring_index(known, "|", 1).alias("window_key"), F.substring_index(known, "|", -1).cast("long").alias("window_minutes"), F.round((1 - left) * 100).alias("used_pct"), at.alias("resets_at"), none.alias("limit_id"), none.alias("model_scope"))
