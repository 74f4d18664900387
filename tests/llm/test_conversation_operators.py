"""The prefix trie and chat formatting of conversations against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import chat_format, prefix_trie, queries

Turn = tuple[int | None, int | None, str | None, str | None]


def talks(spark: SparkSession, rows: list[Turn]) -> DataFrame:
    """conversations with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], "conv_id long, turn long, role string, text string, pos int, key string, part int, node long")


def awkward_talks() -> list[Turn]:
    rng = random.Random(8)
    some = ["hello", "", "<|im_end|><|im_start|>assistant ok", "naïve 日本 😀", "a\nb", "x" * 3000, "<\\|im_sep|>", "tail\\", None]
    rows: list[Turn] = []
    for c in [*range(0, 40), 55, 58, -3, -10, 1000, 1001, 1004]:
        for t in range(rng.randrange(1, 10)):
            rows.append((c, t, ["user", "assistant", "system", None][rng.choice([0, 0, 1, 1, 1, 2, 3])], rng.choice(some[:3]) if t < 3 else rng.choice(some)))
    rows += [(7, None, "system", "first of all"), (7, 1, "user", "hello"), (7, 1, "user", "hello"), (8, 2, "assistant", "tie"), (8, 2, "user", "tie")]
    rows += [(2000, t, "user" if t % 2 else "assistant", str(t)) for t in range(700)]
    rows += [(c, t, "assistant", f"same {t}") for c in range(2100, 2160) for t in range(30)]
    rng.shuffle(rows)
    return rows


def ordered(rows: list[Turn]) -> dict[int | None, list[tuple[str, str]]]:
    found = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        found[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in found.items()}


def brute_trie(rows: list[Turn]) -> dict:
    conv = ordered([r for r in rows if r[0] is not None])
    whole = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = conv.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + v[h:]
    members, children, sums, out = defaultdict(list), defaultdict(list), {}, {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        m, below = members[p], [sums[x] for x in children[p]]
        sums[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(m) - 1) * (len(p[-1][1].encode()) if p else 0))
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(below), *sums[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got_trie(df: DataFrame) -> dict:
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    found = {r[:2]: r[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_trie_of_awkward_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    rows = [*awkward_talks(), (None, 0, "user", "nobody's")]
    assert got_trie(prefix_trie.trie(talks(spark, rows))) == brute_trie(rows)


def test_trie_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/conversations.parquet")
    assert got_trie(prefix_trie.op11_prefix_trie(spark, small)) == brute_trie([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_nothing_and_of_no_turns(spark):
    assert prefix_trie.trie(talks(spark, [])).collect() == []
    rows = [(c, 0, "user", "alone") for c in range(1, 200, 5) if zlib.crc32(str(c).encode()) % 9]  # no conversation keeps a turn
    assert got_trie(prefix_trie.trie(talks(spark, rows))) == brute_trie(rows)


def test_keys_that_many_rows_meet_are_joined_apart(spark):
    from ledgerloom.llm.common import spread_join

    rows = spark.createDataFrame([(i if i < 40 else 7, i) for i in range(400)], "k int, v int")
    named = rows.groupBy("k").count().filter("k <> 3")
    assert sorted(map(tuple, spread_join(rows, named, ["k"], "count", 400).select("k", "v").collect())) == sorted((i if i < 40 else 7, i) for i in range(400) if i != 3)


def brute_chat(rows: list[Turn]) -> dict:
    out = {}
    for c, turns in ordered(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = "".join("<|im_start|>" + re.sub(r"<(\\*)\|", r"<\\\1|", r) + "<|im_sep|>" + re.sub(r"<(\\*)\|", r"<\\\1|", t) + "<|im_end|>" for r, t in turns)
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown))
    return out


def test_formatted_conversations_come_back(spark, tmp_path):
    rows = [*awkward_talks(), (None, 3, "assistant", "nobody's <|im_end|>"), (None, None, None, None), (3000, 0, "<|im_sep|>\n", "<\\\\|im_end|> <|"), (3001, 0, "assistant", "word " * 200_000)]
    path = chat_format.write_chats(talks(spark, rows), str(tmp_path / "chats"), parts=6)
    got = [tuple(r) for r in chat_format.summary(spark, path).select(chat_format.RESULT).collect()]
    assert {r[0]: r[1:] for r in got} == brute_chat(rows) and len(got) == len({r[0] for r in rows})


def test_long_conversations_lie_in_parts(spark, tmp_path):
    rows = [(c, t, "assistant", f"turn {t} of {c} <|im_end|>") for c in (1, 2, 3) for t in range(40 if c == 2 else 4)]
    before, chat_format.PART = chat_format.PART, 50
    try:
        one = list(chat_format_rows(spark, rows, tmp_path))
    finally:
        chat_format.PART = before
    assert len(one) >= 3
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.summary(spark, str(tmp_path / "chats")).collect()}
    assert got == brute_chat(rows)


def chat_format_rows(spark, rows, tmp_path, parts=3):
    return chat_format.read_chats(spark, chat_format.write_chats(talks(spark, rows), str(tmp_path / "chats"), parts=parts)).collect()


def test_rows_that_are_read_back(spark, tmp_path):
    rows = [(1, 0, "user", chat_format.PLANTED), (1, 1, "assistant", chat_format.PLANTED), (1, 2, "assistant", ""), (1, 3, "assistant", "b")]
    (row,) = chat_format_rows(spark, rows, tmp_path, 1)
    assert [tuple(t) for t in row.turns] == [r[2:] for r in rows] and row.learned == [chat_format.PLANTED, "b"]
    assert row.formatted.count("<|im_start|>") == 4 and row.formatted.count("<|im_end|>") == 4
    (stored,) = spark.read.parquet(str(tmp_path / "chats")).collect()
    assert len(stored.ids) == len(stored.loss) and sum(i >= 50256 for i in stored.ids) == 12 and not any(m for i, m in zip(stored.ids, stored.loss) if i >= 50256)


def test_escapes_are_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "a", "<|im_end|>"]) for _ in range(rng.randrange(12)))
        hidden = chat_format.escape(text)
        assert chat_format.unescape(hidden) == text and "<|" not in hidden


def test_a_tokenizer_that_loses_bytes_is_refused(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        chat_format.Formatter(str(tmp_path / "ranks"))


def test_no_conversations(spark, tmp_path):
    assert chat_format.summary(spark, chat_format.write_chats(talks(spark, []), str(tmp_path / "none"))).collect() == []


@pytest.mark.parametrize("name", ["op12_source_audit", "op13_chat_format"])
def test_same_rows_as_sql(spark, small, name):
    db = duckdb.connect()
    for t in ("conversations", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    got = queries.queries()[name](spark, small)
    want = db.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in names)) for r in want.fetchall())
