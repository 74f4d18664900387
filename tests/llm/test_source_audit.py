"""The audit of sources against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import SparkSession

from ledgerloom.llm import source_audit
from tests.llm.helpers import awkward

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows: list[tuple[str | None, str | None, str | None]], min_docs: int, ranks: int) -> set[tuple]:
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or ""))
        counts[lang, source].update(terms)
        df[lang].update(terms.keys())
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out |= {(lang, s, "pair", o.decode(), -f, i) for i, (f, o) in enumerate(far, 1)}
            best = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:ranks]
            out |= {(lang, s, "term", t.decode(), -f, i) for i, (f, t) in enumerate(best, 1)}
    return out


def check(spark: SparkSession, rows, min_docs=3, ranks=7) -> None:
    docs = spark.createDataFrame([(i, *r, 1, 2, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, g int, value long, item string")
    got = [tuple(r) for r in source_audit.audit(docs, min_docs, ranks).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert set(got) == brute(rows, min_docs, ranks) and len(got) == len(set(got))


def some_rows(n: int = 260) -> list[tuple]:
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "abcdeé日😀ÀZ" for b in ("x", "Yz", "", "qq", "ß")]
    rows = [(t, "en", "web") for _, t in awkward()[:8]]
    for _ in range(n):
        source = rng.choice(["hot", "hot", "hot", "b", "c", None, "", "日本"])
        some = words if source != "b" else words[:20]
        rows.append((" ".join(rng.choice(some) + rng.choice(["", ",", "1", "_"]) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "en", "de", None]), source))
    return rows + [("nothing kept here", "xx", "one"), ("other terms there", "xx", "two"), ("123 456", "yy", "alone"), (None, None, None)]


def test_audit(spark):
    check(spark, some_rows())


def test_ties_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "SORTED", 3)
    monkeypatch.setattr(source_audit, "HELD", 40)
    monkeypatch.setattr(source_audit, "PAIRS", 2)
    monkeypatch.setattr(source_audit, "CHUNK", 64)
    same = ["long" * 3 + a + b for a in "abcdefgh" for b in ("", "x", "xx", "é", "日")]
    check(spark, [(" ".join(same), "en", "a")] * 4 + [(" ".join(["other", *same[:3]]), "en", "b")] * 4, ranks=9)


def test_terms_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(spark, some_rows(60), min_docs=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_documents(spark):
    assert source_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
