"""The limit walk and its estimates on small timelines."""

from __future__ import annotations

import itertools
import json

import pytest

from ledgerloom.operators import limits

SCHEMA = "source string, window_key string, window_minutes long, used_pct double, resets_at long, observed_at long, account_id string, plan string, metering_regime string, limit_id string, model_scope string, source_order long, covered_from long, external_activity string"


def reading(at, pct, resets=100_000, account="a", scope="all", covered=0, activity=None, plan="p"):
    return ("s", "w300", 300, float(pct), resets, at, account, plan, "r", "l", scope, None, covered, activity)


def walked(spark, rows):
    out = limits.walk(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.from_pct, r.to_pct, r.t0, r.t1) for r in out if r.reason is None), {r.reason: r.n for r in out if r.reason}


CASES = [
    ("movement from the last anchor", [reading(10, 1), reading(20, 1), reading(30, 4)], [(1, 4, 10, 30)], {}),
    ("a decrease ends the stretch", [reading(10, 5), reading(20, 3), reading(30, 6)], [(3, 6, 20, 30)], {"percentage-decrease": 1}),
    ("saturation trains nothing", [reading(10, 90), reading(20, 100)], [], {"percentage-saturation": 1}),
    ("a reset is a boundary", [reading(10, 5), reading(20, 1, resets=200_000), reading(30, 2, resets=200_000)], [(1, 2, 20, 30)], {"reset-boundary": 1}),
    ("a jittering stamp is no reset", [reading(10, 5), reading(20, 7, resets=100_300)], [(5, 7, 10, 20)], {}),
    ("another account is a change", [reading(10, 5), reading(20, 7, account="b")], [], {"identity-change": 1}),
    ("a reading without account passes through", [reading(10, 5), reading(15, 6, account=None), reading(20, 7)], [(5, 7, 10, 20)], {"missing-account-identity": 1}),
    ("but may end the stretch", [reading(10, 5), reading(15, 4, account=None), reading(20, 7)], [], {"missing-account-identity": 1, "percentage-decrease": 1}),
    ("known activity elsewhere spoils", [reading(10, 5), reading(20, 7, activity="x"), reading(30, 9)], [(7, 9, 20, 30)], {"known-external-activity": 1}),
    ("coverage must reach back", [reading(10, 5), reading(20, 7, covered=11)], [], {"unproven-source-completeness": 1}),
    ("one instant bounds nothing", [reading(10, 5), reading(10, 7)], [], {"ambiguous-reading-order": 1}),
    ("a scope that is no list is missing", [reading(10, 5, scope="m1"), reading(20, 7, scope="[]"), reading(30, 7, scope='["m1", null]')], [], {"missing-model-scope": 3}),
    ("repeats change nothing", [reading(10, 1), reading(11, 1), reading(12, 1), reading(13, 4), reading(14, 4), reading(15, 100), reading(16, 100), reading(17, 3), reading(18, 3)], [(1, 4, 10, 13)], {"percentage-saturation": 1, "percentage-decrease": 1}),
    ("a plan is part of the series", [reading(10, 5), reading(20, 7, plan=None)], [], {"missing-plan-identity": 1}),
]


@pytest.mark.parametrize("name, rows, found, refused", CASES, ids=[c[0] for c in CASES])
def test_walk(spark, name, rows, found, refused):
    assert walked(spark, rows) == (found, refused)


@pytest.mark.parametrize("pct", [float("nan"), float("inf")])
def test_a_percent_that_is_no_number_is_an_error(spark, pct):
    with pytest.raises(Exception, match="no number"):
        walked(spark, [reading(10, 1), reading(20, pct)])


def test_usage_of_intervals(spark):
    scope = json.dumps(["m1", "m2"])
    rows = [reading(10, 1), reading(20, 3), reading(30, 5), *[reading(at, pct, scope=scope)[:1] + ("w1440",) + reading(at, pct, scope=scope)[2:] for at, pct in ((10, 1), (20, 3), (30, 5))]]
    usage = [("s", None, 10, "m1", 1000), ("s", "a", 11, "m1", 5), ("s", None, 20, "m3", 7), ("s", "b", 15, "m1", 900), ("t", None, 15, "m1", 900), ("s", None, 25, None, 3), ("s", None, 31, "m1", 50)]
    out = limits.intervals(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(usage, "source string, account_id string, timestamp long, model string, tokens long"))
    assert sorted((r.window_key, r.t0, r.tokens, r.reason) for r in out.collect()) == [("w1440", 10, 5, None), ("w1440", 20, 0, "unattributed-model-usage"), ("w300", 10, 12, None), ("w300", 20, 3, None)]


def brute_core(some):
    n = len(some)
    for size in range(n, max(3, -(-3 * n // 4)) - 1, -1):
        good = [c for c in itertools.combinations(range(n), size) if limits._disagree([some[i] for i in c]) is None]
        if good:
            return list(good[0]) if len(good) == 1 else []
    return []


def test_cores():
    near = lambda r: (r, 0.9 * r, 1.1 * r)
    for some in ([near(x) for x in xs] for xs in ((100, 101, 102), (100, 101, 102, 200), (100, 100, 100, 300, 301), (1, 2, 3), (100, 101, 102, 124, 126))):
        assert limits.core_of(some)[0] == brute_core(some)


EPOCHS = ", ".join(f"{c} string" for c in limits.SERIES) + ", window_key string, epoch long, window_minutes long, tokens long, movement long, ratio double"
DAY = 86_400


def estimate(spark, ratios, at, resets=None, covered=0):
    series = ("s", "a", "p", "r", "l", "all", "w")
    epochs = [(*series, e, 300, int(r * 50), 50, float(r)) for e, r in ratios]
    current = [(*series, resets or at + 100, covered)]
    keys = ", ".join(f"{c} string" for c in limits.SERIES) + ", window_key string"
    row = limits.estimates(spark.createDataFrame(epochs, EPOCHS), spark.createDataFrame(current, f"{keys}, resets_at long, covered_from long"), at).first()
    return row.state, row.tokens_per_pct, row.reason


def test_states(spark):
    at = 40 * DAY
    steady = [(at - k * DAY, r) for k, r in ((1, 1000), (2, 1010), (3, 990))]
    assert estimate(spark, steady, at) == ("ready", 1000.0, None)
    assert estimate(spark, steady[:2], at)[0] == "gathering"
    assert estimate(spark, [(at - DAY, 1000), (at - 2 * DAY, 2000), (at - 3 * DAY, 4000)], at)[0] == "unstable"
    assert estimate(spark, [(at - k * DAY, 1000) for k in (20, 21, 22)], at) == ("stale", None, "historical-core-aged-out")
    assert estimate(spark, steady, at, resets=at) == ("blocked", None, "no-current-reading")
    assert estimate(spark, steady, at, covered=None) == ("blocked", None, "unproven-source-completeness")


def test_runs_and_representatives(spark):
    series = ("s", "a", "p", "r", "l", "all", "w300")
    rows = [(*series, 900, 300, a, b, t0, t1, 1000 * (b - a)) for a, b, t0, t1 in ((0, 6, 0, 10), (6, 12, 10, 20), (13, 30, 30, 40), (30, 32, 40, 50), (40, 41, 60, 70))]
    schema = ", ".join(f"{c} string" for c in limits.SERIES) + ", window_key string, epoch long, window_minutes long, from_pct long, to_pct long, t0 long, t1 long, tokens long"
    found = limits.runs(spark.createDataFrame(rows, schema))
    assert sorted((r.t0, r.t1, r.movement, r.moves, r.qualifies) for r in found.collect()) == [(0, 20, 12, 2, True), (30, 50, 19, 2, True), (60, 70, 1, 1, False)]
    best = limits.representatives(found).first()
    assert (best.movement, best.tokens, best.ratio, best.reason) == (19, 19_000, 1000.0, None)
