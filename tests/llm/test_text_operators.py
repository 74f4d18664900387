"""Secret scans, token ids in ORC, language-model scores and quality rules against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import lm_score, quality_classifier, quality_rules, queries, secret_scan, token_orc
from tests.llm.helpers import awkward, documents, frame, lower, rows_of, words

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text) if ok(m))


def test_base_secrets(spark, small):
    rows = awkward() + documents(spark, small)
    got = sorted(map(str, ((r["doc_id"], [(x["start"], x["kind"], x["end"]) for x in r["base"]]) for r in rows_of(secret_scan.scan(frame(spark, rows))))))
    assert got == sorted(map(str, ((i, base_spans(t or "")) for i, t in rows)))


def test_added_spans_are_high_entropy_and_apart(spark, small):
    for r in rows_of(secret_scan.scan(frame(spark, awkward() + documents(spark, small)))):
        added = [x for x in r["spans"] if x["kind"] == 3]
        assert len(added) + len(r["base"]) == len(r["spans"])
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in added for b in r["base"])


def test_window_entropy_is_that_of_counting_anew(spark):
    from pyspark.sql import functions as F

    texts = ["a" * 25, "abcdefghijklmnopqrst", "0123456789abcdef0123456789abcdef", "aaaaabbbbbccccc0123456789xyzXYZ", "short"]

    def best(t: str) -> float:
        windows = [Counter(t[i : i + 20]) for i in range(len(t) - 19)]
        return max([0.0, *(-sum(n / 20 * math.log2(n / 20) for n in c.values()) for c in windows)])

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan.best_window_bits(F.col("t")).alias("b")).collect()
    for r in got:
        assert r.b == pytest.approx(best(r.t), abs=1e-9)


def test_entropy_finds_random_strings_and_leaves_words(spark):
    rows = [(1, "key 7fK2pQ9xLm4RtZ8vWb3NcY6dHs1J here"), (2, "see internationalization_of_documents_2024 there"), (3, "4f9a0c7be2d81365 is short"), (4, "EXAMPLE7fK2pQ9xLm4RtZ8vWb3NcY"), (5, "latest-9fK2mQ7xT4vB8nL1pZ6wR3yC5d"), (6, "/example-org/9fK2mQ7xT4vB8nL1pZ6wR3yC5d"), (7, "token=abc123xyz/9fK2mQ7xT4vB8nL1pZ6wR3yC5d"), (8, "password: hunter22, 9fK2mQ7xT4vB8nL1pZ6wR3yC5d")]
    got = {r["doc_id"]: len(r["spans"]) for r in rows_of(secret_scan.scan(frame(spark, rows)))}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: 2}


def test_planted_keys_are_found_and_names_are_left(spark):
    import random
    import string
    import uuid

    rng = random.Random(6)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    keys = [key(string.ascii_letters + string.digits, rng.randrange(28, 60)) for _ in range(150)] + [key(string.ascii_uppercase + string.digits, 40) for _ in range(50)] + [key("0123456789ABCDEF", 40) for _ in range(50)]
    word = lambda: rng.choice("alpha beta gamma request handler service controller index module value".split())
    names = [rng.choice("_-/").join(word() for _ in range(rng.randrange(4, 8))) + str(rng.randrange(3000)) for _ in range(150)] + [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(50)] + ["2024-01-02-13-45-59-000123", "1234567890123456789012", "a" * 40 + "1"]
    rows = [(i, f"some text {x} and more") for i, x in enumerate(keys + names)]
    hit = {r["doc_id"] for r in rows_of(secret_scan.scan(frame(spark, rows))) if any(x["kind"] == 3 for x in r["spans"])}
    assert sum(i in hit for i in range(len(keys))) >= 0.95 * len(keys)
    assert sum(i in hit for i in range(len(keys), len(rows))) <= 0.02 * len(names)


def test_many_matches_of_one_text_have_their_places(spark):
    text = " é ".join(f"token=abcdef{i}" for i in range(1500))
    got = rows_of(secret_scan.scan(frame(spark, [(1, text)])))[0]["base"]
    assert [(x["start"], x["kind"], x["end"]) for x in got] == base_spans(text)


def test_redaction_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "token=abcdef123", 7, "s", "h")], "doc_id long, text string, __secrets int, `a.b` string, hits string")
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and rows_of(out) == [{"doc_id": 1, "text": "[secret]", "__secrets": 7, "a.b": "s", "hits": "h"}]


def test_redaction(spark):
    docs = frame(spark, awkward())
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in rows_of(out)}
    assert "hunter2secret99" not in got[13]["text"] and "[secret]" in got[13]["text"] and got[13]["n_chars"] == len(got[13]["text"])
    assert got[3]["text"] is None and got[7]["text"] == "one two three" and got[9]["text"] == dict(awkward())[9]


def test_token_ids(spark, small, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in awkward() if i is not None] + [(1000 + i, t) for i, t in documents(spark, small)]
    t = Tokenizer.from_file(token_orc.default_tokenizer())
    path = token_orc.write_ids(frame(spark, rows), str(tmp_path / "ids"), files=5)
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    got = sorted(tuple(r) for r in token_orc.checksums(spark, path).collect())
    assert got == sorted(want)
    one = rows_of(token_orc.read_ids(spark, path, doc_ids=[9]))
    assert [r["start"] for r in one] == [w[1] for w in want if w[0] == 9] and one[0]["ids"][-1] == 2
    assert len(rows_of(token_orc.read_ids(spark, path))) == len(rows)


def test_token_ids_of_nothing_and_of_null_ids(spark, tmp_path):
    assert rows_of(token_orc.checksums(spark, token_orc.write_ids(frame(spark, []), str(tmp_path / "none")))) == []
    got = rows_of(token_orc.checksums(spark, token_orc.write_ids(frame(spark, awkward()), str(tmp_path / "odd"))))
    assert len(got) == len(awkward()) and sum(r["doc_id"] is None for r in got) == 2


def lm_brute(rows, train):
    """n_tokens, n_known, N, base and score from exact counts of words, pairs and triples."""
    tokens = lambda t: [*words(lower(t or "")), "\n"]
    ones, twos, threes = Counter(), Counter(), Counter()
    for t in train:
        w = ["\n", "\n", *tokens(t)]
        ones.update(w[2:])
        twos.update(zip(w[1:], w[2:]))
        threes.update(zip(w, w[1:], w[2:]))
    total, distinct = sum(ones.values()), len(ones)
    low, high = lambda c: 2.0 ** (c.bit_length() - 1) if c else 0.0, lambda c: 2.0 ** c.bit_length() - 1
    for i, t in rows:
        w, base, score = ["\n", "\n", *tokens(t)], 0.0, 0.0
        for at in range(2, len(w)):
            x, y, z = w[at - 2 : at + 1]
            alone = (ones[z] + 1) / (total + distinct + 1)
            one = (low(twos[y, z]) + lm_score.PULL[0] * alone) / (ones[y] + lm_score.PULL[0]) if ones[y] else alone
            two = (low(threes[x, y, z]) + lm_score.PULL[1] * one) / (high(twos[x, y]) + lm_score.PULL[1]) if at > 2 and twos[x, y] else one
            base, score = base + math.log10(alone), score + math.log10(two)
        yield i, len(w) - 2, sum(ones[x] > 0 for x in w[2:]), total, base, score


by_counts = lambda rows: sorted(rows, key=lambda r: str((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 3))))


def test_lm_scores_are_those_of_exact_counts(spark, small):
    from pyspark.sql import functions as F

    rows = awkward() + documents(spark, small)
    docs = frame(spark, rows).withColumn("held_out", F.lit(False))
    got = by_counts(rows_of(lm_score.score(docs, docs.filter("doc_id % 3 <> 0"))))
    want = sorted(lm_brute(rows, [t for i, t in rows if i is not None and i % 3]), key=lambda r: str((*r[:3], round(r[4], 3))))
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [w[:4] for w in want]
    exact = 0
    for r, w in zip(got, want, strict=True):
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        # A false level (a chance of under 1 % an absent pair or triple) changes a token's chance, mostly upwards.
        assert r["score"] == pytest.approx(w[5], abs=0.02 * r["n_tokens"] + 2.5)
        exact += math.isclose(r["score"], w[5], rel_tol=1e-9)
    assert exact > len(got) / 3
    assert sum(r["score"] for r in got) == pytest.approx(sum(w[5] for w in want), rel=0.005)


def test_lm_filter_has_every_level_and_few_false_ones():
    import numpy as np

    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64), rng.geometric(0.3, 50_000)
    filled = lm_score.build_filter(keys, counts)
    assert len(filled) == lm_score.level_of(counts).sum() * lm_score.BITS
    found = lm_score.probe(filled, keys)
    assert (found >= lm_score.level_of(counts)).all() and (found > lm_score.level_of(counts)).mean() < 0.01
    assert (lm_score.probe(filled, rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)) > 0).mean() < 0.01
    assert (lm_score.least_count(lm_score.level_of(counts)) <= counts).all() and (lm_score.most_count(lm_score.level_of(counts)) >= counts).all()


def test_lm_pairs_raise_the_score_of_seen_order(spark):
    from pyspark.sql import functions as F

    train = frame(spark, [(i, "red fish blue fish one fish two fish") for i in range(1, 40)])
    docs = frame(spark, [(1, "red fish blue fish"), (2, "fish red fish blue")]).withColumn("held_out", F.lit(True))
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in rows_of(lm_score.score(docs, train))}
    assert got[1] > got[2]


def test_lm_scores_do_not_depend_on_buckets_and_slices(spark, small):
    from pyspark.sql import functions as F

    docs = frame(spark, awkward() + documents(spark, small)).withColumn("held_out", F.lit(False))
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    one, other = (by_counts(rows_of(lm_score.score_where(docs, train, bits, size))) for bits, size in ((4, 1 << 20), (6, 3000)))
    assert len(one) == len(other)
    for a, b in zip(one, other, strict=True):
        assert b["base_score"] == pytest.approx(a["base_score"], rel=1e-9)
        assert b["score"] == pytest.approx(a["score"], abs=0.02 * a["n_tokens"] + 2.5)  # other filters have other false levels


def test_lm_pairs_seen_once_count(spark):
    from pyspark.sql import functions as F

    train = frame(spark, [(1, "alpha beta gamma delta")])
    docs = frame(spark, [(1, "beta gamma delta"), (2, "gamma beta delta")]).withColumn("held_out", F.lit(True))
    got = {r["doc_id"]: (r["base_score"], r["score"]) for r in rows_of(lm_score.score(docs, train))}
    assert got[1][0] == pytest.approx(got[2][0]) and got[1][1] > got[2][1]


def test_lm_without_training_rows(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, awkward()).withColumn("held_out", F.lit(True))
    assert {r["score"] for r in rows_of(lm_score.score(docs, docs.limit(0)))} == {0.0}
    assert rows_of(lm_score.score(docs.limit(0), docs)) == []


def rules_brute(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeated = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_counts(spark, small):
    rows = awkward() + documents(spark, small)
    got = rows_of(quality_rules.judge(frame(spark, rows)))
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(str, ((r["doc_id"], *(r[k] for k in keys)) for r in got))) == sorted(map(str, ((i, *rules_brute(t)) for i, t in rows)))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert all(0 <= r["quality"] <= 1 for r in got)


def test_posteriors_are_those_of_plain_em(spark):
    k, share = quality_rules.PRIOR_WEIGHT, quality_rules.PRIOR_SHARE
    rules = len(quality_rules.RULES)
    patterns = [(3**rules - 1, 60), (0, 10), (3**rules - 1 - 2 * 3**2, 20), (1 + 3 * 2, 10)]
    got = dict(map(tuple, quality_rules.posteriors(spark.createDataFrame(patterns, "pattern int, n long")).collect()))
    votes = {p: [p // 3**r % 3 for r in range(rules)] for p, _ in patterns}
    good, bad, total = [list(quality_rules.PRIOR_GOOD)] * rules, [list(quality_rules.PRIOR_BAD)] * rules, sum(n for _, n in patterns)
    odds = lambda p: 1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(math.log(good[r][v] / bad[r][v]) for r, v in enumerate(votes[p])))))
    for _ in range(quality_rules.EM_ROUNDS):
        q = {p: odds(p) for p, _ in patterns}
        of = lambda weight, prior: [[(sum(weight(p) * n / total for p, n in patterns if votes[p][r] == v) + k * prior[v]) / (sum(weight(p) * n / total for p, n in patterns) + k) for v in range(3)] for r in range(rules)]
        new = of(lambda p: q[p], quality_rules.PRIOR_GOOD), of(lambda p: 1 - q[p], quality_rules.PRIOR_BAD), (sum(q[p] * n / total for p, n in patterns) + k * quality_rules.PRIOR_SHARE) / (1 + k)  # noqa: B023
        moved = max(abs(x - y) for a, b in zip(new[:2], (good, bad)) for r, s in zip(a, b) for x, y in zip(r, s))
        moved = max(moved, abs(new[2] - share))
        good, bad, share = new
        if moved <= quality_rules.SETTLED:
            break
    else:
        raise AssertionError("plain EM did not settle")
    for p, _ in patterns:
        assert got[p] == pytest.approx(odds(p), abs=1e-9)


def test_keep_good_keeps_rows_and_columns(spark):
    docs = frame(spark, awkward())
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and rows_of(quality_rules.keep_good(docs.limit(0))) == []
    ids = [r["doc_id"] for r in rows_of(out)]
    assert ids.count(2) in (0, 2) and 4 not in ids and 11 not in ids


def auc(pairs: list[tuple[float, int]]) -> float:
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows_of(queries.queries()["op1_quality_classifier"](spark, sf))}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert auc(held) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_normal_equations_and_ridge_are_those_of_one_matrix(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality_classifier, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    width = len(quality_classifier.STATISTICS)
    x, y, fold = rng.normal(size=(300, width)), rng.integers(0, 2, 300), rng.integers(0, 3, 300)
    train = spark.createDataFrame([(int(f), a.tolist(), float(b)) for f, a, b in zip(fold, x, y, strict=True)], "fold int, stats array<double>, y double").repartition(7)
    kernel = quality_classifier.Kernel(x.mean(axis=0), x.std(axis=0))
    z = kernel(x)
    got = quality_classifier.normal_equations(train, kernel)
    for f in range(3):
        zf, yf = z[fold == f], y[fold == f]
        assert np.allclose(got[f][0], zf.T @ zf) and np.allclose(got[f][1], zf.T @ yf) and got[f][2] == len(yf)
    penalty = np.diag([quality_classifier.RIDGE * 300] * quality_classifier.FEATURES + [1e-9 * 300])
    assert np.allclose(quality_classifier.solve(list(got.values())), np.linalg.inv(z.T @ z + penalty) @ (z.T @ y), atol=1e-6)


def test_random_features_are_near_the_gaussian_kernel():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, len(quality_classifier.STATISTICS))) * 0.5
    kernel = quality_classifier.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = kernel(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-(quality_classifier.WIDTH**2) * apart / 2)).mean() < 0.08


def test_isotonic_is_the_least_squares_fit():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(20):
        n = int(rng.integers(1, 30))
        x, y, w = np.arange(n) + 0.5, rng.random(n), rng.integers(1, 9, n).astype(float)
        mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        knots, values = quality_classifier.isotonic(x, y, w)
        assert sorted({round(v, 9) for v in values}) == sorted({round(v, 9) for v in want}) and (np.diff(knots) > 0).all()


def test_classifier_on_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, awkward())
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (4, 0), (9, 1), (None, 1), (12, 7), (77, 0)], "doc_id long, quality int")
    out = rows_of(quality_classifier.classify(docs, labels, F.lit(True), F.lit(0)))
    assert len(out) == len(awkward()) and all(0 <= r["score"] <= 1 for r in out)
    none = rows_of(quality_classifier.classify(docs, labels.limit(0), F.lit(True), F.lit(0)))
    assert {r["score"] for r in none} == {0.5}
    assert rows_of(quality_classifier.classify(docs.limit(0), labels, F.lit(True), F.lit(0))) == []


def test_secret_digest_of_the_query(spark, small):
    got = {r["doc_id"]: r for r in rows_of(queries.queries()["op2_secret_scan"](spark, small))}
    for i, t in documents(spark, small):
        spans = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_words_apart_are_the_tokenizers_whole_texts():
    import random

    import public_tokenizers

    rng = random.Random(4)
    letters = "abcÄÖßéİıſKİ̸̇ªµǅǆAB.,;'’#*_-0129½²   \n\t日本<>|😀'sɏɐσΣ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(2000)] + ["<|endoftext|> a<|endoftext|>. x", "x" * 5000, ""]
    for name, apart in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        e = token_orc.Encoder(public_tokenizers.path(name))
        assert e.by_word == apart
        assert e.encode(texts) == [b"".join(i.to_bytes(4, "little") for i in e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_of_letters_are_not_normalised_and_split_again(monkeypatch):
    e = token_orc.Encoder(token_orc.default_tokenizer())
    whole, rows = [], e._ids
    monkeypatch.setattr(e, "_ids", lambda texts: whole.extend(texts) or rows(texts))
    texts = ["Größe, alpha (beta) Alpha. x.y 12 größe", "", "ÉTÉ été, alpha alpha\x1cb", "don't stop, don't"]
    want = [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for _ in range(2):
        ids, ends = e.flat(texts, (2).to_bytes(4, "little"))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert sorted(whole) == sorted([",", ".", "(beta)", "x.y", "12", "", "alpha\x1cb", "don't"])  # once each; letters by the model alone


def test_added_tokens_are_found_before_letters_are_lower_cased():
    e = token_orc.Encoder(token_orc.default_tokenizer())
    texts = ["A <|ENDOFTEXT|> b", "<|endoftext|>", "X<|EndOfText|>, Y<|endoftext|>Z <|STARTOFTEXT|>\x1cQ", "the <|endoftext|> END"]
    assert e.encode(texts) == [b"".join(i.to_bytes(4, "little") for i in e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert e.tokenizer.token_to_id("<|endoftext|>") in np.frombuffer(e.encode(texts)[2], "<u4")


def test_few_characters_are_encoded_at_once_and_words_forgotten(monkeypatch):
    monkeypatch.setattr(token_orc, "CHARS", 50)
    monkeypatch.setattr(token_orc, "ROWS", 4)
    monkeypatch.setattr(token_orc, "WORDS", 3)
    texts = ["a" * 30, "b c " * 5, "d" * 200, "", "e, f", "g " * 40, "h", "a b, c"]
    parts = list(token_orc._pieces(pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])))
    assert [t for _, p in parts for t in p] == texts and [part.column(0).to_pylist() for part, _ in parts] == [[0, 1], [2], [3], [4], [5], [6, 7]]
    e = token_orc.Encoder(token_orc.default_tokenizer())
    for _, p in parts:
        assert e.encode(p) == [b"".join(i.to_bytes(4, "little") for i in e.tokenizer.encode(t, add_special_tokens=False).ids) for t in p]
    assert len(e.numbers) < 10 and e.encode([]) == []


def scanned(df) -> int:
    """Rows that the scan of df hands on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path):
    import glob

    from pyarrow import orc

    rows = [(2 * i, f"alpha beta {i}") for i in range(6000)]
    path = token_orc.write_ids(frame(spark, rows), str(tmp_path / "ids"), files=1)
    name = max(glob.glob(f"{path}/part-*.orc"), key=lambda f: orc.ORCFile(f).nrows)
    file = orc.ORCFile(name)
    assert file.nrows == 6000 and file.nstripes >= 1 and file.row_index_stride == 1000
    stored = spark.read.schema(token_orc.FORMAT.format(id="bigint")).orc(path).select("doc_id", "n_tokens")
    assert scanned(stored) == 6000
    assert scanned(stored.filter("doc_id = 5000")) <= 1000  # by the row index
    assert scanned(stored.filter("doc_id = 5001")) == 0  # inside the range of a row group: by the Bloom filter
