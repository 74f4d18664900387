r"""Conversations as token ids with a loss mask.

A turn is <|im_start|>role<|im_sep|>text<|im_end|>. Roles and texts are encoded each for itself, as ordinary text, and the three
marks are spliced in as reserved ids behind the tokenizer's vocabulary, so no text can ever make one of their ids. In the
formatted text, too, no role or text can look like a mark: every <| in it, with the backslashes that may stand between, gets one
backslash more (<\|), and loses it again when it is read. Assembly is arithmetic over a batch of turns: sums of the segments'
lengths say where ids go, and the mask is the running sum of +1 where an assistant's text begins and -1 where it ends; the
marks and roles are never under it.

Turns are ranged and sorted by (conversation, turn, digest) and encoded behind the shuffle. A row of the files is a conversation,
or a part of one that has more than PART ids or lies across two ranges; parts carry their range and place. What was read back from
rows that hold a whole conversation is hashed there, and the parts of the others meet by conversation, in order, in a task that
keeps only the state of the hashes (SHA-256 takes its input in order).

Edge cases: null roles and texts are empty; turns come in ascending order, null first, and turns with the same number in the order
of their digests; null conv_ids are one conversation; repeated rows are turns of their own; extra columns are ignored; an empty
table gives no rows (the query still has its planted conversation -1; rows that have that id join it).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh_path
from ledgerloom.llm.prefix_trie import digest

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
LEARNED = "assistant"
#: Ids of a row from which on the next turn begins a new one; turns that are encoded at once.
PART, ROWS = 1 << 18, 256
PLANTED = "<|im_end|><|im_start|>assistant ok"
STORED = "conv_id {id}, range int, place long, whole boolean, ids array<int>, loss array<boolean>"
RESULT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Formatter:
    """tokenizer: a file of byte pairs' ranks, a line each, its token in base64. Such a tokenizer gives every text back as it was."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        first = max(ranks.values()) + 1
        self.start, self.sep, self.end = first, first + 1, first + 2
        self.bytes = [b""] * (first + 3)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the tokenizer has no token for {len(missing)} bytes: it can't give texts back as they were")
        self.tokenizer = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode_ordinary(t), np.int32) for t in texts]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [b"".join(map(self.bytes.__getitem__, x.tolist())).decode() for x in ids]

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, loss, ends) of the turns, one behind the other."""
        names = list(dict.fromkeys(roles))
        known = dict(zip(names, self.encode([escape(r) for r in names]), strict=True))
        parts, heads = self.encode([escape(t) for t in texts]), [known[r] for r in roles]
        n_head, n_text = np.array([len(x) for x in heads], np.int64), np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(n_head + n_text + 3)
        starts = ends - n_head - n_text - 3
        said = starts + 2 + n_head  # where the text begins
        ids = np.empty(int(ends[-1]), np.int32)
        ids[starts], ids[said - 1], ids[ends - 1] = self.start, self.sep, self.end
        for at, n, some in ((starts + 1, n_head, heads), (said, n_text, parts)):
            flat = np.arange(int(n.sum())) + np.repeat(at - (np.cumsum(n) - n), n)
            ids[flat] = np.concatenate(some)
        learn = np.array([r == LEARNED for r in roles])
        step = np.zeros(len(ids) + 1, np.int8)
        step[said[learn]] += 1
        step[said[learn] + n_text[learn]] -= 1
        return ids, np.cumsum(step[:-1], dtype=np.int8) > 0, ends

    def turns(self, rows: list[np.ndarray]) -> list[list[tuple[str, str]]]:
        """(role, text) of the turns of each row of ids, still escaped."""
        cuts = [(np.flatnonzero(r == self.start), np.flatnonzero(r == self.sep), np.flatnonzero(r == self.end)) for r in rows]
        said = iter(self.decode([x for r, c in zip(rows, cuts, strict=True) for s, p, e in zip(*c, strict=True) for x in (r[s + 1 : p], r[p + 1 : e])]))
        return [[(next(said), next(said)) for _ in c[0]] for c in cuts]

    def learned(self, rows: list[np.ndarray], losses: list[np.ndarray]) -> list[list[str]]:
        """What stands under the loss mask of each row, run by run, still escaped."""
        edges = [np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]]))) for x in losses]
        runs = [list(zip(e[::2], e[1::2], strict=True)) for e in edges]
        said = iter(self.decode([r[a:b] for r, some in zip(rows, runs, strict=True) for a, b in some]))
        return [[next(said) for _ in some] for some in runs]


@lru_cache(maxsize=2)
def formatter(path: str) -> Formatter:
    return Formatter(path)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.array([], np.int32), kind))


def write_chats(conversations: DataFrame, path: str, tokenizer: str | None = None, parts: int | None = None) -> str:
    """Write the formatted conversations as Parquet. parts: how many ranges (the session's shuffle partitions)."""
    name, parts = tokenizer or default_tokenizer(), parts or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", empty("role"), empty("text")).withColumn("key", digest(F.col("role"), F.col("text")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "key"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, part, place = formatter(name), TaskContext.get().partitionId(), 0
        nobody = object()
        now, whole, ids, loss, size = nobody, False, [], [], 0
        kind = None

        def flush(out: list, closed: bool) -> None:
            if ids:
                out.append((now, closed and whole, np.concatenate(ids), np.concatenate(loss)))
                ids.clear(), loss.clear()

        def batch_of(out: list) -> pa.RecordBatch:
            nonlocal place
            places = np.arange(place, place + len(out), dtype=np.int64)
            place += len(out)
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], kind), pa.array(np.full(len(out), part, np.int32)), pa.array(places), pa.array([o[1] for o in out], pa.bool_()), _lists([o[2] for o in out], pa.int32()), _lists([o[3] for o in out], pa.bool_())],
                names=["conv_id", "range", "place", "whole", "ids", "loss"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, ROWS):
                some, out = batch.slice(at, ROWS), []
                convs = some.column(0).to_pylist()
                all_ids, all_loss, ends = f.assemble(some.column(1).to_pylist(), some.column(2).to_pylist())
                before = 0
                for conv, end in zip(convs, ends.tolist(), strict=True):
                    if conv != now or now is nobody:
                        flush(out, True)
                        now, whole, size = conv, now is not nobody, 0
                    elif size > PART:
                        whole = False
                        flush(out, False)
                        size = 0
                    ids.append(all_ids[before:end])
                    loss.append(all_loss[before:end])
                    size, before = size + end - before, end
                if out:
                    yield batch_of(out)
        out = []
        flush(out, False)
        if out:
            yield batch_of(out)

    ranged.mapInArrow(run, STORED.format(id=conversations.schema["conv_id"].dataType.simpleString())).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def read_chats(spark: SparkSession, path: str, id_type: str = "bigint", tokenizer: str | None = None) -> DataFrame:
    """(conv_id, range, place, turns, learned, formatted): each row's turns as (role, text), the texts under its mask, both unescaped,
    and the formatted text."""
    name = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = formatter(name)
        for some in _slices(batches):
            turns, learned = _read(f, some)
            texts = ["".join(f"{MARKS[0]}{r}{MARKS[1]}{t}{MARKS[2]}" for r, t in x) for x in turns]
            plain = pa.array([[{"role": unescape(r), "text": unescape(t)} for r, t in x] for x in turns], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), plain, pa.array([[unescape(t) for t in x] for x in learned], pa.list_(pa.string())), pa.array(texts, pa.string())], names=["conv_id", "range", "place", "turns", "learned", "formatted"])

    return _stored(spark, path, id_type).mapInArrow(run, f"conv_id {id_type}, range int, place long, turns array<struct<role: string, text: string>>, learned array<string>, formatted string")


def _stored(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(STORED.format(id=id_type)).parquet(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _read(f: Formatter, some: pa.RecordBatch) -> tuple[list[list[tuple[str, str]]], list[list[str]]]:
    ids = _rows(some.column(4))
    return f.turns(ids), f.learned(ids, _rows(some.column(5)))


def summary(spark: SparkSession, path: str, id_type: str = "bigint", tokenizer: str | None = None) -> DataFrame:
    """RESULT of every conversation, from the files alone."""
    name, schema = tokenizer or default_tokenizer(), f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        f = formatter(name)
        marks = sum(map(len, MARKS))
        for some in _slices(batches):
            said = []
            for turns, learned in zip(*_read(f, some), strict=True):
                loss = "".join(map(unescape, learned))
                said.append((len(turns), "".join(f"{unescape(r)}\n{unescape(t)}\n" for r, t in turns), loss, sum(len(r) + len(t) + marks for r, t in turns)))
            yield some, said

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, said in parts(batches):
            yield _result(some.column(0), [(n, hashlib.sha256(t.encode()).hexdigest(), len(x), hashlib.sha256(x.encode()).hexdigest(), c) for n, t, x, c in said])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, said in parts(batches):
            columns = [pa.array([x[i] for x in said], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), *columns], names=["conv_id", "range", "place", "n", "turns", "loss", "chars"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nobody, kind = object(), None
        now, state = nobody, None
        for batch in batches:
            kind, ids, done = batch.column(0).type, [], []
            for conv, n, turns, loss, chars in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)), strict=True):
                if now is nobody or conv != now:
                    if state is not None:
                        ids.append(now)
                        done.append(_closed(state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1].update(turns.encode())
                state[3].update(loss.encode())
                state[0], state[2], state[4] = state[0] + n, state[2] + len(loss), state[4] + chars
            yield _result(pa.array(ids, kind), done)
        if state is not None:
            yield _result(pa.array([now], kind), [_closed(state)])

    stored = _stored(spark, path, id_type)
    at_once = stored.filter("whole").mapInArrow(whole, schema)
    pieces = stored.filter("not whole").mapInArrow(opened, f"conv_id {id_type}, range int, place long, n long, turns string, loss string, chars long")
    return at_once.unionByName(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "range", "place").mapInArrow(chained, schema))


def _closed(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _result(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=RESULT)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, LEARNED, PLANTED)], "conv_id long, turn long, role string, text string")
    return summary(spark, write_chats(table.unionByName(planted), fresh_path(spark, "chats")))


ORACLE_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE '{LEARNED}' END, '{PLANTED}' FROM range(2) r(n)
), keyed AS (
  SELECT *, sha256(strlen(role) || ':' || role || text) AS k,
    length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + {sum(map(len, MARKS))} AS chars
  FROM turns
), told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, k) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, k) FILTER (WHERE role = '{LEARNED}'), '') AS learned, sum(chars) AS chars
  FROM keyed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM told
"""
