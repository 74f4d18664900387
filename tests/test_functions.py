"""Words of command lines, windows of dates and amounts against plain versions and fixed cases."""

from __future__ import annotations

import random
import shlex
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import dates, formats, shell

LINES = [
    ('git commit -m "a b"', ["git", "commit", "-m", "a b"]),
    ("echo 'it''s' \"q\\\"x\"", ["echo", "its", 'q"x']),
    ("open 'never closed", ["open", "never closed"]),
    ('a\\ b "" c', ["a\\", "b", "c"]),
    ("", []),
    ('x="1 2" y', ["x=1 2", "y"]),
]


def cut_words(spark, lines: list[str]) -> list[list[str]]:
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return [r.w for r in rows.select("i", shell.words(F.col("line")).alias("w")).orderBy("i").collect()]


def plain_words(line: str) -> list[str]:
    """The same, character by character."""
    out, word, quote, at = [], "", None, 0
    while at < len(line):
        c = line[at]
        if quote == '"' and c == "\\":
            at += 1
            word += line[at : at + 1]
        elif quote:
            quote, word = (None, word) if c == quote else (quote, word + c)
        elif c in "\"'":
            quote = c
        elif c.isspace():
            out, word = [*out, word], ""
        else:
            word += c
        at += 1
    return [w for w in [*out, word] if w]


def test_words(spark):
    assert cut_words(spark, [line for line, _ in LINES]) == [words for _, words in LINES]


def test_words_of_any_line(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab c\"'\\\n\t|é　") for _ in range(rng.randrange(24))) for _ in range(3000)]
    for line, got in zip(lines, cut_words(spark, lines), strict=True):
        assert got == plain_words(line), line
        if "\\" not in line and "　" not in line and line.count('"') % 2 == 0 and line.count("'") % 2 == 0:
            try:
                assert got == [w for w in shlex.split(line) if w]
            except ValueError:
                continue


RUNS = [
    ('bash -lc "git add x"', "git", "git add", "unknown"),
    ("env FOO=1 rtk npm run build:all", "npm", "FOO=1 rtk", "unknown"),
    ("FOO=1 /usr/bin/git push", "git", "FOO=1 /usr/bin/git", "git_local"),
    ("npm run build; ls", "npm", "npm run", "build"),
    ("cd x && git push", "cd", "cd x", "git_remote"),
    ("ls;", "ls;", "ls;", "shell_inspect"),
    ("echo a | wc", "echo", "echo a", "compound"),
    ("   ", "unknown", "unknown", "unknown"),
    (None, "unknown", "unknown", "unknown"),
]


def test_what_runs(spark):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RUNS)], "i int, line string").withColumn("cut", shell.cut(F.col("line")))
    got = {r.i: (r.exe, r.cmd) for r in rows.select("i", shell.executable(F.col("cut.run")).alias("exe"), shell.signature(F.col("cut.run")).alias("cmd")).collect()}
    assert got[0] == ("git", "git add") and got[3] == ("npm", "npm run") and got[5] == ("ls;", "ls;") and got[7] == got[8] == ("unknown", "unknown")
    assert got[2][0] == "git"
    kinds = {r.i: r.kind for r in rows.select("i", shell.kind(F.coalesce("line", F.lit("")), F.col("cut.words")).alias("kind")).collect()}
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [kinds[i] for i in (3, 4, 5, 6, 7, 8)] == ["build", "git_remote", "shell_inspect", "compound", "unknown", "unknown"]


def test_amounts_are_rounded_by_their_shortest_decimals(spark):
    rng = random.Random(2)
    values = [0.0, 2.675, 1.005, 999.995, 1560.0, 1234567.891, 0.125] + [round(rng.random() * 10 ** rng.randrange(1, 8), rng.randrange(0, 5)) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", formats.amount(F.col("v")).alias("t")).collect()
    for r in got:
        assert r.t == f"{Decimal(repr(r.v)).quantize(Decimal('0.01'), ROUND_HALF_UP):,}"


def test_fixed_digits_take_the_exact_value(spark):
    values = {2.105: "2.10", 0.125: "0.13", 2.5: "2.50", 1.005: "1.00", 1234.5678: "1234.57"}
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", formats.fixed(F.col("v"), 2).alias("t")).collect()
    assert {r.v: r.t for r in got} == values


def test_slots_of_presets():
    assert dates.valid_slots([("rolling", 1), ("lastYear", 9), None, ("rolling", 2), ("rolling", 3)]) == [None, ("lastYear", 0), None, ("rolling", 2)]
    assert dates.valid_slots([]) == [None] * 4


def test_days_with_a_change_of_clocks(spark):
    row = spark.range(1).select(
        F.size(dates.bucket_keys(F.lit(1710046800).cast("long"), F.lit(1710129600).cast("long"), F.lit(1 << 40), True, "America/New_York")).alias("spring"),
        F.size(dates.bucket_keys(F.lit(1730606400).cast("long"), F.lit(1730696400).cast("long"), F.lit(1 << 40), True, "America/New_York")).alias("autumn"),
        dates.bounds(F.lit(""), F.lit("2024-02-01"), F.lit("2023-01-01"), F.lit("2024-12-31")).alias("b"),
    ).first()
    assert (row.spring, row.autumn) == (23, 24) and (row.b.first, row.b.last) == ("2023-01-01", "2024-02-01")
