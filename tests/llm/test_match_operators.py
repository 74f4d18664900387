"""SentencePiece, repeated substrings, licences, SimHash links and decontamination against brute force; the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ledgerloom.llm import common, components, decontaminate, license_scan, pieces, simhash, substring_dedup
from tests.llm.helpers import awkward, documents, frame, lower, rows_of, words


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def odd_texts() -> list[str]:
    rng = random.Random(3)
    letters = "abcdefgh ABC.,_-0129éßüñ日本語\n\t²½😀‍"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["x" * 3000, "antidisestablishmentarianism" * 40, "  two  blanks  ", "\n\n\n", "▁under"]


def test_pieces_are_the_librarys(spark, small, library):
    rows = list(enumerate(odd_texts())) + [(10_000 + i, t) for i, t in documents(spark, small)[:60]] + awkward()
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in rows_of(pieces.encode(frame(spark, rows))))
    want = Counter((i, tuple(library.encode(t or ""))) for i, t in rows)
    assert got == want


def test_pieces_decode_as_in_the_library(spark, library):
    rows = list(enumerate(odd_texts()))
    back = {r["doc_id"]: r["text"] for r in rows_of(pieces.decode(pieces.encode(frame(spark, rows))))}
    assert all(back[i] == library.decode(library.encode(t)) for i, t in rows)


def test_round_trip_and_empty_table(spark, small):
    out = rows_of(pieces.round_trip(frame(spark, documents(spark, small))))
    assert all(r["exact"] for r in out)
    assert rows_of(pieces.encode(frame(spark, []))) == []


def test_window_of_the_search_stays_bounded():
    v = pieces.Codec().v
    widest = [0]
    text = "antidisestablishmentarianism" * 400
    pieces.viterbi(v, text, widest)
    assert 0 < widest[0] <= 4 * (v.longest + pieces.EVERY)


def repeats_brute(rows, width):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, d in data:
        for at in range(len(d) - width + 1):
            seen[d[at : at + width]] += 1
    for i, d in data:
        gone = np.zeros(len(d) + 2, np.int8)
        for at in range(len(d) - width + 1):
            if seen[d[at : at + width]] > 1:
                gone[at + 1 : at + width + 1] = 1
        edge = np.flatnonzero(np.diff(gone))
        kept = bytes(b for b, g in zip(d, gone[1:], strict=False) if not g)
        yield i, len(d), int(gone.sum()), len(edge) // 2, kept


def repeat_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (24, 25, 40, 300)]
    rows = [(i, text(rng.randrange(0, 80)) + rng.choice(shared) + text(rng.randrange(0, 60)) + rng.choice(["", rng.choice(shared)])) for i in range(60)]
    return rows + [(100 + i, shared[3]) for i in range(9)] + [(200, "z" * 500), (201, "zy" * 200), (202, None), (203, ""), (203, ""), (None, shared[2]), (204, text(5000))]


@pytest.mark.parametrize("runs_in_a_group", [1024, 2])
def test_repeated_substrings(spark, monkeypatch, runs_in_a_group):
    monkeypatch.setattr(substring_dedup, "GROUP_RUNS", runs_in_a_group)
    rows = repeat_rows()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in rows_of(substring_dedup.remove_repeats(frame(spark, rows), width=24, gram=8)))
    assert got == Counter(repeats_brute(rows, 24))


def test_sorted_order_is_that_of_bytes():
    from ledgerloom.llm.substring_core import sorted_order

    rng = np.random.default_rng(3)
    for letters, n in ((2, 700), (256, 300), (1, 40)):
        rows = rng.integers(0, letters, (n, 24), dtype=np.uint8)
        rows[n // 2 :] = rows[rng.integers(0, n // 2 + 1, n - n // 2)]
        order, group = sorted_order(rows)
        texts = [bytes(rows[i]) for i in order]
        assert texts == sorted(map(bytes, rows)) and sorted(order.tolist()) == list(range(n))
        assert all((group[i] == group[i + 1]) == (texts[i] == texts[i + 1]) for i in range(n - 1))


def test_a_passage_in_many_documents_makes_no_large_group(spark, monkeypatch):
    """One passage between different texts: its windows are counted, not gathered; nothing else is removed."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(40))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + passage + "".join(rng.choice("abcdefgh ") for _ in range(60))) for i in range(3000)]
    monkeypatch.setattr(substring_dedup, "GROUP_RUNS", 64)
    got = rows_of(substring_dedup.remove_repeats(frame(spark, rows), width=40, gram=16))
    assert Counter((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in got) == Counter((i, n, kept) for i, _, n, _, kept in repeats_brute(rows, 40))


def test_repeated_substrings_of_documents(spark, small):
    rows = sorted(documents(spark, small), key=lambda r: len(r[1] or ""))[:150]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in rows_of(substring_dedup.remove_repeats(frame(spark, rows))))
    assert got == Counter(repeats_brute(rows, substring_dedup.WIDTH))


def test_repeated_substrings_of_awkward_rows(spark):
    assert len(rows_of(substring_dedup.remove_repeats(frame(spark, awkward())))) == len(awkward())
    assert rows_of(substring_dedup.remove_repeats(frame(spark, []))) == []


def test_licences(spark, small):
    import duckdb

    got = sorted(map(str, map(tuple, license_scan.op6_license_scan(spark, small).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    assert got == sorted(map(str, con.execute(license_scan.oracle_sql()).fetchall()))


def test_licence_texts_in_other_clothes(spark):
    mit = dict(license_scan.TEXTS[::-1])["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper()), (2, mit.replace("license", "licence").replace(",", " ,")), (3, mit + " and more"), (4, "prose\nLicensed under the Apache License, Version 2.0.\nmore"), (4, "prose\nLicensed under the Apache License, Version 2.0.\nmore")]
    got = [(r["doc_id"], r["license"], r["n_notices"]) for r in rows_of(license_scan.scan(frame(spark, rows)))]
    assert sorted(got, key=str) == sorted([(1, "MIT", 0), (2, "MIT", 0), (3, None, 0), (4, None, 1), (4, None, 1)], key=str)
    assert len(rows_of(license_scan.scan(frame(spark, awkward())))) == len(awkward())
    assert rows_of(license_scan.scan(frame(spark, []))) == []


def test_licence_texts_in_any_line_width(spark):
    import textwrap

    rows, want = [], {}
    for licence, text in license_scan.TEXTS:
        for width in (9, *range(20, 101, 8), 72, 79):
            for before, mark in (("", ""), ("Copyright (c) 2020 Someone\n", ""), ("# Copyright Some One\n# All rights reserved.\n", "# "), ("copyright: 2020, Someone\n", "")):
                body = "\n\n".join(textwrap.fill(p, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
                want[len(rows)] = licence
                rows.append((len(rows), before + body))
    assert any(line.startswith("copyright notice") for _, t in rows for line in t.split("\n"))
    assert {r["doc_id"]: r["license"] for r in rows_of(license_scan.scan(frame(spark, rows)))} == want


def fingerprint_brute(text: str | None) -> int:
    w = words(lower(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(prints: dict[int, int], bits: int = 4) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits and (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_fingerprints_and_links_of_documents(spark, small):
    rows = documents(spark, small)
    got = {r["doc_id"]: r for r in rows_of(simhash.near_duplicates(frame(spark, rows)))}
    prints = {i: fingerprint_brute(t) for i, t in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components_brute(prints)


@pytest.mark.parametrize("cell_rows", [8192, 40, 3])
def test_links_of_close_fingerprints(spark, cell_rows):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = {}
    for i in range(260):
        p = rng.choice(seeds)
        for _ in range(rng.randrange(0, 7)):
            p ^= 1 << rng.randrange(64)
        prints.setdefault(p, i)
    nodes = {i: p for p, i in prints.items()}
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in nodes.items()], "fp long, node long")
    roots = {r.node: r.root for r in components.components(simhash.links(table, cell_rows=cell_rows)).collect()}
    assert {i: roots.get(i, i) for i in nodes} == components_brute(nodes)


def test_simhash_of_awkward_rows(spark):
    docs = frame(spark, awkward())
    got = [(r["doc_id"], r["component_id"]) for r in rows_of(simhash.near_duplicates(docs))]
    assert len(got) == len(awkward()) and (2, 1) in got and {c for i, c in got if i in (3, 4, 5)} == {3}
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in rows_of(kept)]
    assert kept.columns == docs.columns and ids.count(None) == 2 and 1 in ids and 2 not in ids and 4 not in ids
    assert rows_of(simhash.near_duplicates(frame(spark, []))) == []


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta"]) + str(rng.randrange(40)) for _ in range(n))
    a, b, c = prose(60), prose(60), prose(60)
    rows = [("x", a), ("x", b), ("y", a), ("z", c), ("z", c), (None, b)]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id string, text string, row int, fp string")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows_of(simhash.keep_one(docs))))) == sorted(map(str, [("x", a), ("x", b), ("z", c), (None, b)]))
    got = Counter((r["doc_id"], r["component_id"]) for r in rows_of(simhash.near_duplicates(docs)))
    assert got == Counter([("x", "x"), ("x", "x"), ("y", "x"), ("z", "z"), ("z", "z"), (None, "x")])


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 1000 for i in range(1000, 1100))


def leaks_brute(t: np.ndarray, item: np.ndarray) -> int:
    """Least edits that turn item into some part of text."""
    text = t
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (t != c))
        full = np.concatenate(([i], step)) - np.arange(len(text) + 1)
        row = np.minimum.accumulate(full) + np.arange(len(text) + 1)
    return int(row.min())


def test_leaks(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(30) for _ in range(6)] + [prose(30).replace("a", "ä").replace("e", "日") for _ in range(2)] + ["tiny", "", None, prose(9), "short of ten", "abcd efgh ijkl mnop q", "thirty characters are this one"]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(60):
        body = list(rng.choice([x for x in items if x and len(x) > 8]))
        for _ in range(rng.randrange(0, 2 * len(body) // 10)):
            at = rng.randrange(len(body))
            body[at : at + 1] = rng.choice([[], ["k"], [body[at], "k"]])
        rows.append((i, (prose(20) + " " + "".join(body).upper() + " " + prose(20)) if i % 2 else prose(60)))
    rows += [(200, None), (201, ""), (202, "tiny"), (None, items[0])]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.find_leaks(frame(spark, rows), benchmark))}
    want = set()
    for i, t in rows:
        for k, x in enumerate(items):
            p = decontaminate.plain(x or "")
            if len(p) >= decontaminate.LEAST and leaks_brute(decontaminate.plain(t or ""), p) <= decontaminate.budget(len(p), decontaminate.EDIT_FRACTION):
                want.add((i, k))
    assert got == want and len(want) > 10
    docs = frame(spark, rows)
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in rows_of(kept)} == {i for i, _ in rows} - {i for i, _ in want}
    assert rows_of(decontaminate.find_leaks(docs.limit(0), benchmark)) == [] and rows_of(decontaminate.find_leaks(docs, benchmark.limit(0))) == []


def test_long_items_and_many_blocks(spark, monkeypatch):
    """Items of many lengths in one slice, blocks that need several passes, a null item_id."""
    rng = random.Random(10)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate((4000, 3, 500, 8, 40, 90))] + [(None, prose(12))]
    rows = [(k, prose(5) + " " + text + " " + prose(5)) for k, (_, text) in enumerate(items)] + [(99, prose(200))]
    benchmark, want = spark.createDataFrame(items, "item_id long, text string"), {(k, i) for k, (i, _) in enumerate(items)}
    found = lambda: {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.find_leaks(frame(spark, rows), benchmark))}
    assert found() == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontaminate, "SENT_BLOCKS", 2)
    assert found() == want
    assert [r["doc_id"] for r in rows_of(decontaminate.drop_leaks(frame(spark, rows), benchmark))] == [99]


def copies_brute(texts: dict[int, str | None]) -> dict[int, int]:
    """Components of texts whose fingerprints of five words are within 4 bits or whose sets of them are similar to 0.8."""
    sets = {}
    for i, t in texts.items():
        w = words(lower(t or ""))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    prints = {}
    for i, t in texts.items():
        w = words(lower(t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 5]).encode(), 42) for k in range(max(1, len(w) - 4))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        alike = shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared)
        if (alike or (prints[a] ^ prints[b]).bit_count() <= 4) and (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, group = [], {}
    for k in range(60):
        base = prose(rng.randrange(60, 300))
        for c in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(0 if c == 0 else max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            group[len(rows)] = k
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, " ".join(prose(80))) for i in range(100)]
    want = copies_brute(dict(rows))
    kept = {r["doc_id"] for r in rows_of(simhash.keep_one(frame(spark, rows)))}
    assert {i for i, _ in rows if i >= 1000} <= kept
    # A text is compared with the least of those it meets only; what that may miss is a link, never a document.
    assert kept >= set(want.values()) and len(kept - set(want.values())) <= 0.02 * len(rows)


def test_pipeline_equals_its_stages_by_brute_force(spark, small, library):
    """Every stage against a plain version of what it promises, on what its predecessor kept."""
    from ledgerloom.llm import quality_rules, secret_scan

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept: list[dict] = rows_of(docs)
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, small)
        rows = rows_of(out)
        if name == "quality_rules":
            good = {r["doc_id"] for r in rows_of(quality_rules.judge(before)) if r["kept"]}
            assert {r["doc_id"] for r in rows} == good
        elif name == "simhash_near_dedup":
            roots = copies_brute({r["doc_id"]: r["text"] for r in kept})
            assert {r["doc_id"] for r in rows} == set(roots.values())
        elif name == "benchmark_decontamination":
            items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            by_gram = defaultdict(set)
            for k, x in enumerate(items):
                for at in range(0, len(x) - 7, 8):
                    by_gram[bytes(x[at : at + 8])].add(k)
            leaky = set()
            for r in kept:
                p = decontaminate.plain(r["text"] or "")
                maybe = {k for at in range(len(p) - 7) for k in by_gram.get(bytes(p[at : at + 8]), ())}
                if any(leaks_brute(p, items[k]) <= decontaminate.budget(len(items[k]), decontaminate.EDIT_FRACTION) for k in maybe):
                    leaky.add(r["doc_id"])
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept} - leaky
        elif name == "secret_scans":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept}
            assert not any(r["base"] for r in rows_of(secret_scan.scan(out)))
        else:
            assert {r["doc_id"]: r["ids"] for r in rows} == {r["doc_id"]: library.encode(r["text"] or "") for r in kept}
            continue
        assert out.columns == docs.columns
        kept = rows
    whole = Counter((r["doc_id"], tuple(r["ids"])) for r in rows_of(corpus_pipeline.run(spark, small)))
    assert whole == Counter((r["doc_id"], tuple(r["ids"])) for r in rows_of(out))


def test_pipeline_on_awkward_rows(spark, small):
    out = frame(spark, awkward())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, small)
        assert name == "sentencepiece" or len(out.columns) == 14
    assert len(rows_of(out)) >= 1
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert rows_of(empty) == []


def test_kept_digest_of_the_query(spark, small):
    got = {r["doc_id"]: r for r in rows_of(substring_dedup.op4_suffix_dedup(spark, small))}
    whole = {r["doc_id"]: bytes(r["kept"]) for r in rows_of(substring_dedup.remove_repeats(frame(spark, documents(spark, small))))}
    assert {i: r["kept_sha256"] for i, r in got.items()} == {i: hashlib.sha256(k).hexdigest() for i, k in whole.items()}


def test_a_head_hides_no_pair(spark):
    """The least of the texts that share a key is like none of them, and a fingerprint's other text has a copy of its own."""
    words = [f"w{i}" for i in range(100)]
    a, b, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(100))
    docs = spark.createDataFrame([(1, other), (2, a), (3, b)], "digest long, text string")
    prints = spark.createDataFrame([(1, 10, [7]), (2, 20, [7]), (3, 30, [7])], "digest long, fp long, bands array<long>")
    assert {tuple(sorted(r)) for r in simhash.near_copies(docs, prints, 5, 0.8).collect()} == {(20, 30)}
    prints = spark.createDataFrame([(1, 20, [5]), (2, 20, [7]), (3, 30, [7])], "digest long, fp long, bands array<long>")
    assert {tuple(sorted(r)) for r in simhash.near_copies(docs, prints, 5, 0.8).collect()} == {(20, 30)}


def test_edited_copies_are_linked_without_comparing_all_pairs(spark, monkeypatch):
    """Copies edited lightly and heavily, with edits in common: the links of brute force from few comparisons, and no table stays."""
    rng = random.Random(33)
    base, texts = [f"w{rng.randrange(3000)}" for _ in range(150)], {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 10])):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(20)}"
        texts[i] = " ".join(words)
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in texts.items()}
    edges = [(i, j) for i, j in combinations(texts, 2) if (k := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - k)]
    asked, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, least: (asked.append(pairs.count()), similar(pairs, least))[1])
    docs = spark.createDataFrame(list(texts.items()), "digest long, text string")
    prints = [(i, i, simhash._band_keys(np.array(sorted(s), np.uint64))) for i, s in sets.items()]
    found = simhash.near_copies(docs, spark.createDataFrame(prints, "digest long, fp long, bands array<long>"), 5, 0.8)
    roots = lambda e: {r.node: r.root for r in components.components(e).collect()}
    assert roots(found) == roots(spark.createDataFrame(edges, "u long, v long")) and len(set(texts) - {i for e in edges for i in e}) > 20
    assert sum(asked) < 3 * len(texts)
    folder = common.shared_dir(spark)
    before = set(os.listdir(folder))
    assert len(rows_of(simhash.keep_one(frame(spark, list(texts.items()))))) < len(texts)
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["kept"]
