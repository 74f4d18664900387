"""Awkward rows that every operator of the subpackage has to survive, and small brute-force pieces."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, node int, fp string, cell int, spans double, pattern string, words string, digest string, __w int"


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t), "h", 1, "fp", 2, 0.5, "p", "w", "d", 3) for i, t in rows], SCHEMA)


def awkward() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "the", "of", "straße", "naïve", "日本", "x1", "end."]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    same = prose(90)
    long = prose(30_000)
    return [
        (1, same), (2, same), (2, same), (3, None), (4, ""), (4, ""), (5, " \t\n\r\x0b\x0c "), (6, "one"), (7, "one two three"),
        (None, prose(70)), (None, None), (8, prose(60) + "\n\n" + prose(5)), (9, long), (10, "\x00\x1f odd   blanks here"), (11, "a " * 300), (12, "word\n" * 60),
        (13, 'password = "hunter2secret99" and token:abc123xyz AKIA' + "Q" * 20 + " " + "0123456789abcdef" * 3), (14, "😀" * 40 + " secret=" + "Zz9" * 8), (-15, prose(55)),
    ]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def documents(spark: SparkSession, small: str) -> list[tuple[int, str]]:
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
