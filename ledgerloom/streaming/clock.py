"""Answers about limits that change when their time comes, without a new reading.

What is known of a limit, its newest reading and what its windows have shown, is kept in the state store. An answer says at which
second time alone will change it: when the window resets, or when a window that counts stops being recent. A timer of the state store is
set to that second, and the limit is judged anew when it fires. New evidence judges at once and sets the timer anew; evidence of a
later revision takes the place of an earlier one, so late records correct answers too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators import limits
from ledgerloom.streaming import ledger
from ledgerloom.streaming.sessions import use_rocksdb

_SERIES = ", ".join(f"{c} string" for c in limits.SERIES)
#: kind: reading (resets_at, covered_from, used_pct, observed_at) or epoch (epoch, window_minutes, tokens, movement, ratio).
EVIDENCE = f"kind string, {_SERIES}, window_key string, revision long, resets_at long, covered_from long, used_pct double, observed_at long, epoch long, window_minutes long, tokens double, movement double, ratio double"
ANSWERS = f"{_SERIES}, window_key string, state string, tokens_per_pct double, candidates int, reason string, next_evaluation_at long, evaluated_at long, by_timer boolean"
_READING = f"{_SERIES}, resets_at long, covered_from long, used_pct double, observed_at long"
_ROW = Row(*[f.split()[0] for f in ANSWERS.split(", ")])


class LimitClock(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", _READING)
        self.epochs = handle.getMapState("epochs", "series string, epoch long", "window_minutes long, tokens double, movement double, ratio double, revision long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [f.split()[0] for f in _READING.split(", ")]
        best = dict(zip(names, self.current.get(), strict=True)) if self.current.exists() else None
        for r in (x.asDict() for x in rows):
            if r["kind"] == "reading":
                if best is None or _rank(r) > _rank(best):
                    best = {n: r[n] for n in names}
                continue
            at = (_name(r), r["epoch"])
            if not self.epochs.containsKey(at) or self.epochs.getValue(at)[4] <= r["revision"]:
                self.epochs.updateValue(at, (r["window_minutes"], r["tokens"], r["movement"], r["ratio"], r["revision"]))
        if best is not None:
            self.current.update(tuple(best[n] for n in names))
            yield self._answer(key, best, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.current.exists():
            yield self._answer(key, dict(zip([f.split()[0] for f in _READING.split(", ")], self.current.get(), strict=True)), timerValues, True)

    def _answer(self, key, reading: dict, timerValues, by_timer: bool) -> Row:
        now = timerValues.getCurrentProcessingTimeInMs() // 1000
        own = _name(reading)
        known = [(k[1], v) for k, v in self.epochs.iterator() if k[0] == own]
        epochs = [{"epoch": e, "window_minutes": v[0], "tokens": v[1], "movement": v[2], "ratio": v[3]} for e, v in sorted(known, key=lambda x: x[0])]
        state, value, n, why, due = limits.answer(reading, epochs, now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(due * 1000)
        return _ROW(*[reading[c] for c in limits.SERIES], key[1], state, value, n, why, due, now, by_timer)


def _rank(r: dict) -> tuple:
    """Readings that prove their series go before others, then the newest."""
    return (all(r[f] is not None for f, _ in limits.MISSING), r["observed_at"], r["resets_at"], r["used_pct"])


def _name(r: dict) -> str:
    return json.dumps([r[c] for c in limits.SERIES])


def clock(evidence: DataFrame) -> DataFrame:
    """A stream of EVIDENCE -> a stream of ANSWERS: one whenever something new is known of a limit, and one when its time comes. A
    stream that begins again where it ended runs no batch until something arrives, and so no timers: each second arrives, without rows."""
    spark = evidence.sparkSession
    use_rocksdb(spark)
    seconds = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter("false")
    both = evidence.unionByName(seconds.select([F.lit(None).cast(f.dataType).alias(f.name) for f in evidence.schema]))
    return both.groupBy("source", "window_key").transformWithState(LimitClock(), ANSWERS, "Append", "ProcessingTime")


def evidence(spark: SparkSession, table: str, readings: DataFrame, since: int = -1, at: int | None = None) -> DataFrame:
    """EVIDENCE of the limits of those sources whose records changed after revision `since` of the ledger at `table`. at: an instant
    up to which readings count (none: all)."""
    moved = ledger.signals(spark, table, since).select("source").distinct()
    some = readings.join(moved, "source", "left_semi") if at is None else readings.filter(F.col("observed_at") <= at).join(moved, "source", "left_semi")
    shown = limits.representatives(limits.runs(limits.intervals(some, ledger.usage_of(spark, table, moved)).filter("reason is null")))
    revision = F.lit(ledger.committed(spark, table)).cast("long").alias("revision")
    number = lambda c: F.col(c).cast("double").alias(c)
    own = [*limits.SERIES, "window_key"]
    newest = limits.current_readings(some, 1 << 60).select(F.lit("reading").alias("kind"), *own, revision, "resets_at", "covered_from", "used_pct", F.col("observed_at"))
    epochs = shown.select(F.lit("epoch").alias("kind"), *own, revision, "epoch", "window_minutes", number("tokens"), number("movement"), "ratio")
    both = newest.unionByName(epochs, allowMissingColumns=True)
    return both.select([f.split()[0] for f in EVIDENCE.split(", ")])
