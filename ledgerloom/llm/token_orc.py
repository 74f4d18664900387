"""Token ids in ORC files.

Documents are range-partitioned and sorted by doc_id, encoded after the shuffle (texts are smaller than their
ids) and written as ORC: one file a range, in ascending order. The ids are an integer list column, which ORC
writes in its run-length encoding, stripe by stripe; row indexes and a Bloom filter on doc_id let readers skip
stripes and row groups. Each row carries its file's number and the place of its ids in that file, so a reader
needs the files' totals only (as many rows as files) to place any document in the whole stream, and stripes can
be read in parallel.

Where the tokenizer lower-cases and never looks across white space (its own description is asked), words are encoded once
and remembered by number, so that a text is a list of numbers and its ids are gathered for many texts at a time: the marks
behind a word of letters are a word of their own to it, and words of letters need none of its normalising and splitting, so
the library's model gets many of them at a time. Any other tokenizer gets whole texts. Edge cases: null and empty texts get the end id alone. Repeated rows are written one by
one; equal doc_ids are ordered by their text, null doc_ids come first. Extra columns are ignored. An empty table
gives files without rows and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import documents, fresh_path, text_or_empty

END = 2
#: Words that a worker remembers before it starts anew.
WORDS = 800_000
#: Documents, and characters of them if there are more than one, that are encoded at once.
ROWS, CHARS = 256, 1 << 20
#: Characters at which Python splits words and the tokenizers' patterns don't.
_NO_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_WORD = re.compile(r"[\S\x1c-\x1f]+")
#: Marks that may stand behind a word of letters.
_MARKS = string.punctuation
#: Up to this letter, lower case and the kinds of letters are the same to Python and to the tokenizers.
_LAST_LETTER = "ɏ"
#: Words of letters that are encoded as one text.
JOINED = 2000
#: The normaliser, the splitter and the mark of a word's end with which words can be encoded apart.
_NORMALIZERS = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
_SPLITTERS = [("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}), ("ByteLevel", None)]
_END_OF_WORD = "</w>"
FILE_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
#: file: its number; place: of the row in it; first: ids before the row in it.
FORMAT = "doc_id {id}, file int, place long, first long, n_tokens long, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _lower(text: str) -> str:
    """A-Z in lower case, as the tokenizer's normaliser makes them: fewer different words to remember."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def _words(text: str, added: Sequence[str] = ()) -> list[str]:
    """A text's words in lower case. Added tokens are found before the tokenizer lower-cases: words that only then hold one stay as they are."""
    low = _lower(text)
    if any(a in low for a in added):
        return [w if any(a in x for a in added) else x for w in _WORD.findall(text) for x in (_lower(w),)]
    return _WORD.findall(low) if any(c in low for c in _NO_SPACE) else low.split()


class _Numbers(dict):
    """The numbers of words. A new word gets the next number and waits in `new` for its ids."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        said = json.loads(self.tokenizer.to_str())
        #: Whether words between white space can be encoded apart and lower-cased; other tokenizers get whole texts.
        self.by_word = (
            [(n["type"], n.get("pattern")) for n in (said["normalizer"] or {}).get("normalizers", [])] == _NORMALIZERS
            and [(n["type"], n.get("pattern")) for n in (said["pre_tokenizer"] or {}).get("pretokenizers", [])] == _SPLITTERS
            and not any(t["content"].split() != [t["content"]] or t["normalized"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"])
        )
        self.added = [_lower(t["content"]) for t in said["added_tokens"]]
        #: Tokens that end a word of letters, where the model marks them.
        self.last = None
        if said["model"].get("end_of_word_suffix") == _END_OF_WORD:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for t, i in said["model"]["vocab"].items() if t.endswith(_END_OF_WORD)]] = True
        #: The same model behind a split at blanks alone: letters that are lower-cased and in its alphabet of bytes need no more.
        self.plain = None
        if self.by_word and self.last is not None and not any(t["content"].isalpha() for t in said["added_tokens"]):
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.in_bytes = {c: in_bytes(chr(c))[0][0] for c in range(128, ord(_LAST_LETTER) + 1) if chr(c).isalpha()}

    def _forget(self) -> None:
        self.numbers = _Numbers()
        #: The ids of all words one behind the other, how many of them are in use; where a number's ids begin, and how many they are.
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, numbers: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        end = self.used + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while len(self.numbers) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        self.pool[self.used : end] = ids
        self.count[numbers] = counts
        self.start[numbers] = self.used + np.cumsum(counts) - counts
        self.used = end

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one behind the other, and where each word's end."""
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.start[numbers] - ends + counts, counts) + np.arange(counts.sum())], ends

    def _whole(self, numbers: list[int], texts: list[str]) -> None:
        rows = self._ids(texts)
        self._put(numbers, np.frombuffer(b"".join(rows), "<u4"), np.array([len(r) // 4 for r in rows], np.int64))

    def _letters(self, numbers: list[int], words: list[str]) -> None:
        """Words of letters: encoded as one text, cut behind the tokens that end a word."""
        if self.plain is None:
            return self._whole(numbers, words)
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            text = " ".join(part)
            [got] = self.plain.encode_batch_fast([text if text.isascii() else text.translate(self.in_bytes)], add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer's ends of words do not fit its words")
            self._put(numbers[at : at + JOINED], ids, np.diff(ends, prepend=0))

    def _learn(self) -> None:
        """Ids of new words. Letters and the marks behind them are separate words to the tokenizer."""
        new, number = self.numbers.new, self.numbers.__getitem__
        first, plain, accented, odd, marked, parts = len(self.numbers) - len(new), [], [], [], [], array("q")
        for n, w in enumerate(new, first):  # grows by the letters and the marks of its words
            if w.isalpha() and w.isascii():
                plain.append(n)
                continue
            stem = w.rstrip(_MARKS)
            low = stem if stem.isascii() else stem.lower()
            if not low.isalpha() or not low.isascii() and max(low) > _LAST_LETTER:
                odd.append(n)
            elif low == w:
                accented.append(n)
            else:
                marked.append(n)
                parts.append(number(low))
                parts.append(number(w[len(stem) :]))
        for learn, some in ((self._letters, plain), (self._letters, accented), (self._whole, odd)):
            if some:
                learn(some, [new[n - first] for n in some])
        if marked:
            ids, ends = self._gathered(np.frombuffer(parts, np.int64))
            self._put(marked, ids, np.diff(ends[1::2], prepend=0))
        new.clear()

    def flat(self, texts: list[str], tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with those of tail behind it, one behind the other, and where each text's end."""
        if not self.by_word:
            rows = [ids + tail for ids in self._ids(texts)]
            return np.frombuffer(b"".join(rows), "<u4"), np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)
        if len(self.numbers) > WORDS:
            self._forget()
        if tail not in self.numbers:  # bytes are no word of a text
            self.numbers[tail] = len(self.numbers)
            self._put([self.numbers[tail]], np.frombuffer(tail, "<u4"), np.array([len(tail) // 4]))
        number, last, numbers, ends = self.numbers.__getitem__, self.numbers[tail], array("q"), []
        for t in texts:
            numbers.extend(map(number, _words(t, self.added)))
            numbers.append(last)
            ends.append(len(numbers) - 1)
        self._learn()
        ids, word_ends = self._gathered(np.frombuffer(numbers, np.int64))
        return ids, word_ends[ends]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not texts:
            return []
        ids, ends = self.flat(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch's rows with their texts, as many as are encoded at once."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        texts, begin, held = part.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            if i > begin and held + len(t) > CHARS:
                yield part.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(t)
        yield part.slice(begin), texts[begin:]


def _ids_column(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, files: int | None = None) -> str:
    """Write the ids of docs to ORC files under path. files: how many ranges (the session's shuffle partitions)."""
    name, tail = tokenizer or default_tokenizer(), np.array([end], "<u4").tobytes()
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, file, place, first = encoder(name), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part, texts in _pieces(batch):
                ids, ends = e.flat(texts, tail)
                n = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(n), file, np.int32)), pa.array(place + np.arange(len(n))), pa.array(first + ends - n), pa.array(n), _ids_column(ids, ends)],
                    names=["doc_id", "file", "place", "first", "n_tokens", "ids"],
                )
                place, first = place + len(n), first + int(ends[-1])

    text = docs.select("doc_id", text_or_empty().alias("text"))
    ranged = text.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = FORMAT.format(id=docs.schema["doc_id"].dataType.simpleString())
    ranged.mapInArrow(run, schema).write.mode("overwrite").options(**FILE_OPTIONS).orc(path)
    return path


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files. doc_ids: only these, found by the files' indexes."""
    stored = spark.read.schema(FORMAT.format(id=id_type)).orc(path)
    wanted = stored if doc_ids is None else stored.filter(F.col("doc_id").isin(doc_ids))
    return _placed(stored, wanted).select("doc_id", "start", "n_tokens", "ids")


def _placed(stored: DataFrame, rows: DataFrame) -> DataFrame:
    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = W.Window.orderBy("file").rowsBetween(W.Window.unboundedPreceding, -1)  # one row for each file
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "file").withColumn("start", F.col("base") + F.col("first"))


def checksums(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy().tolist()
            raw = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            n = [b - a for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "file", "first", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(FORMAT.format(id=id_type)).orc(path)
    read = stored.select("doc_id", "file", "first", "ids").mapInArrow(run, f"doc_id {id_type}, file int, first long, n_tokens long, ids_crc32 long")
    return _placed(stored, read).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return checksums(spark, write_ids(docs, fresh_path(spark, "token-ids")), docs.schema["doc_id"].dataType.simpleString())
