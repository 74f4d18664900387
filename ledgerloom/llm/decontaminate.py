"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in a plain form, character by character: lower case, every run of ASCII characters other than letters
and digits one space. An item of n plain characters may be found with up to k edits, k being the edit fraction of n.
The item's q-grams are taken at every q-th character, so that an edit spoils one of them at most: any occurrence within k
edits keeps floor(n/q) - k of them, on diagonals (place in the text less place in the item) no more than k apart. q is 8,
or the greatest less than 8 by which that is at least 1 (items of 10 to 31 characters). Shared q-grams are counted in
bands of 2k+2 diagonals that overlap by half; bands that reach the bound are kept as regions and verified by banded
alignment of the whole item, free at both ends of the region.

The benchmark is a stated query set: it is handled in blocks of at most BLOCK_BYTES, SENT_BLOCKS of them are sent to all
tasks for one pass over the documents, which are never shuffled. Only whole items are found: a part of a long item is no
occurrence of it. Edge cases: null and empty texts hold nothing; items shorter than LEAST plain characters can't be told
from chance and never match; items without an id are found like any other, under a null item_id; repeated items match one
by one under their item_id; repeated rows are searched one by one. Places are plain characters from the start of the plain
text. Extra columns are ignored by `find_leaks` and kept by `drop_leaks`, whatever their names. Empty documents or an
empty benchmark give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import documents, text_or_empty

Q = LEAST = 8
EDIT_FRACTION = 0.1
#: Characters of benchmark items in a block, and blocks that are sent to the tasks for one pass.
BLOCK_BYTES, SENT_BLOCKS = 4 << 20, 16
#: Plain characters of documents that are searched at once, and that a task holds while it goes over the blocks.
SLICE_BYTES, HELD_BYTES = 2 << 20, 16 << 20
#: Cells of the bands that are aligned at once.
CELLS = 1 << 20

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str) -> np.ndarray:
    """The code points of the plain form."""
    clean = b" ".join(text.lower().encode().translate(_PLAIN).split())
    return np.frombuffer(clean, np.uint8).astype("<u4") if clean.isascii() else np.frombuffer(clean.decode().encode("utf-32-le"), "<u4")


_STEP = 0x9E3779B97F4A7C15


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters at every place: the sum of each times a power of _STEP. Hashes that meet by chance only
    add regions for the alignment to refuse."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    out = np.zeros(len(data) - q + 1, np.uint64)
    for i in range(q):
        out = out * np.uint64(_STEP) + data[i : i + len(out)].astype(np.uint64)
    return out


def budget(n: int, fraction: float) -> int:
    return int(n * fraction)


def gram_length(n: int, k: int) -> int:
    """The greatest q of at most Q by which an item of n characters keeps a q-gram after k edits (0: there is none)."""
    return next((q for q in range(Q, 0, -1) if n // q > k), 0)


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


class _Index:
    """The sampled q-grams of those items that have the same q."""

    def __init__(self, q: int, items: list[np.ndarray], numbers: list[int]):
        self.q = q
        sampled = [np.ascontiguousarray(grams(items[i], q)[::q]) for i in numbers]
        gram = np.concatenate(sampled)
        item = np.repeat(np.array(numbers), [len(s) for s in sampled])
        place = np.concatenate([np.arange(len(s)) * q for s in sampled])
        order = np.argsort(gram, kind="stable")
        self.gram, self.first, self.many = np.unique(gram[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[_slot(self.gram)] = True

    def shared(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in data) of every shared q-gram."""
        g = grams(data, self.q)
        at = np.flatnonzero(self.maybe[_slot(g)])
        k = np.searchsorted(self.gram, g[at])
        k[k == len(self.gram)] = 0
        sure = self.gram[k] == g[at]
        at, k = at[sure], k[sure]
        many = self.many[k]
        entry = np.repeat(self.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return self.item[entry], self.place[entry], np.repeat(at, many)


class Block:
    """A block of items, ready for searching."""

    def __init__(self, items: list[np.ndarray], fraction: float):
        self.items = items
        self.k = np.array([budget(len(x), fraction) for x in items], np.int64)
        q = np.array([gram_length(len(x), k) if len(x) >= LEAST else 0 for x, k in zip(items, self.k.tolist(), strict=True)], np.int64)
        self.least = np.array([len(x) for x in items], np.int64) // np.maximum(q, 1) - self.k
        self.indexes = [_Index(size, items, np.flatnonzero(q == size).tolist()) for size in np.unique(q[q > 0]).tolist()]

    def regions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first diagonal, last diagonal) of the bands of data that reach the bound."""
        each = [x.shared(data) for x in self.indexes]
        item, within, at = (np.concatenate(c) if each else np.empty(0, np.int64) for c in (list(zip(*each, strict=True)) or ((), (), ())))
        if not len(item):
            return item, within, at
        half = self.k[item] + 1
        shift = 1 << 32  # diagonals may be negative, by less than an item
        band = (at - within + shift) // half
        # Each diagonal lies in two bands: the one that begins at its half and the one that ends there. A q-gram of the
        # item counts once in a band, however often it is there.
        both = np.stack((np.concatenate((within, within)), np.concatenate((band, band - 1)), np.concatenate((item, item))))
        both = both[:, np.lexsort(both)]
        new = np.concatenate(([True], (both[:, 1:] != both[:, :-1]).any(axis=0)))
        band, item = both[1, new], both[2, new]
        first = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (item[1:] != item[:-1]))))
        counts = np.diff(np.concatenate((first, [len(band)])))
        band, item = band[first], item[first]
        keep = counts >= self.least[item]
        item, band = item[keep], band[keep]
        half = self.k[item] + 1
        return item, band * half - shift, (band + 2) * half - 1 - shift

    def align(self, text: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits that turn the item into some part of the band, with that part's start and end."""
        n = len(item)
        length = np.array([len(self.items[i]) for i in item])
        deep, wide = int(length.max()), int((high - low).max()) + 1
        far = np.int32(1 << 20)
        source = np.zeros((n, deep), np.uint32)
        for r, i in enumerate(item):
            source[r, : length[r]] = self.items[i]
        inside = np.arange(wide)[None, :] <= (high - low)[:, None]
        place = low[:, None] + np.arange(wide)[None, :]
        cost = np.where(inside & (place >= 0) & (place <= len(text)), 0, far).astype(np.int32)
        begin = place.copy()
        final, f_begin = cost.copy(), begin.copy()
        slope = np.arange(wide, dtype=np.int64)
        for i in range(1, deep + 1):
            here = place + i  # the text ends here after i bytes of the item
            ok = inside & (here >= 0) & (here <= len(text))
            char = text[np.clip(here - 1, 0, len(text) - 1)]
            same = (char == source[:, i - 1 : i]) & (here >= 1)
            a = np.where(here >= 1, cost + np.where(same, 0, 1), far)
            b = np.concatenate((cost[:, 1:], np.full((n, 1), far, np.int32)), axis=1) + 1
            b_begin = np.concatenate((begin[:, 1:], begin[:, -1:]), axis=1)
            better = b < a
            step = np.where(better, b, a)
            origin = np.where(better, b_begin, begin)
            step = np.where(ok, step, far)
            # Text bytes that are skipped: the least of step[j'] + (j - j') over j' <= j, carried with its origin.
            packed = ((step.astype(np.int64) - slope) << 40) | (origin + (1 << 20))
            packed = np.minimum.accumulate(packed, axis=1)
            cost = np.where(ok, np.minimum((packed >> 40) + slope, far), far).astype(np.int32)
            begin = (packed & ((1 << 40) - 1)) - (1 << 20)
            last = length == i
            if last.any():
                final[last], f_begin[last] = cost[last], begin[last]
        best = final.argmin(axis=1)
        rows = np.arange(n)
        return final[rows, best], f_begin[rows, best], place[rows, best] + length

    def search(self, data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the occurrences in data, the best of those that overlap."""
        item, low, high = self.regions(data)
        size = np.array([len(self.items[i]) for i in item.tolist()], np.int64)
        order = np.argsort(size, kind="stable")  # regions of items of like length are aligned together, so many that they fit
        item, low, high, size = item[order], low[order], high[order], size[order]
        # For a region: its item's characters and some arrays as wide as its band.
        cells = np.maximum.accumulate(size + 8 * (high - low + 1)) if len(size) else size
        at = 0
        while at < len(item):
            stop = at + max(1, int(np.searchsorted(cells[at:] * np.arange(1, len(item) - at + 1), CELLS, "right")))
            edits, begin, end = self.align(data, item[at:stop], low[at:stop], high[at:stop])
            for i, b, e, c in zip(item[at:stop].tolist(), begin.tolist(), end.tolist(), edits.tolist(), strict=True):
                if c <= self.k[i]:
                    yield i, b, e, c
            at = stop


def _best(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping occurrences of an item in a row, the one with the fewest edits, then the leftmost."""
    kept: list[tuple[int, int, int, int, int]] = []
    for hit in sorted(set(found), key=lambda x: (x[0], x[1], x[4], x[2], x[3])):
        if not any(k[:2] == hit[:2] and k[2] < hit[3] and hit[2] < k[3] for k in reversed(kept) if k[:2] == hit[:2]):
            kept.append(hit)
    return kept


def search_texts(block: Block, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) for rows of plain texts. Rows are searched in slices that are joined by characters
    that no plain text holds; an occurrence that reaches over a joint is none."""
    out: list[tuple[int, int, int, int, int]] = []
    joint = np.zeros(16, "<u4")

    def flush(rows: list[int]) -> None:
        starts = np.cumsum([0, *(len(texts[r]) + len(joint) for r in rows)])
        hits = []
        for i, b, e, c in block.search(np.concatenate([x for r in rows for x in (texts[r], joint)])):
            r = int(np.searchsorted(starts, b, "right")) - 1
            if e <= starts[r] + len(texts[rows[r]]):
                hits.append((rows[r], i, b - int(starts[r]), e - int(starts[r]), c))
            else:  # what the region's best alignment hides is looked for in each row alone
                for x in range(r, int(np.searchsorted(starts, e, "left"))):
                    hits += [(rows[x], i2, b2, e2, c2) for i2, b2, e2, c2 in block.search(texts[rows[x]])]
        out.extend(_best(hits))

    rows, size = [], 0
    for r, t in enumerate(texts):
        rows.append(r)
        size += len(t)
        if size >= SLICE_BYTES:
            flush(rows)
            rows, size = [], 0
    if rows:
        flush(rows)
    return out


def _passes(benchmark: DataFrame) -> Iterator[list[Broadcast]]:
    """The items with a text, block by block, in lists of blocks for one pass; the driver holds one block at a time."""
    context = benchmark.sparkSession.sparkContext
    sent, block, size = [], [], 0
    for row in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= BLOCK_BYTES:
            sent.append(context.broadcast(block))
            block, size = [], 0
        if len(sent) == SENT_BLOCKS:
            yield sent
            sent = []
    if block:
        sent.append(context.broadcast(block))
    if sent:
        yield sent


class _Searcher:
    """Goes over the blocks for each stretch of texts; the last block's index is kept."""

    def __init__(self, sent: list[Broadcast], fraction: float):
        self.sent, self.fraction, self.at = sent, fraction, -1

    def _block(self, number: int) -> Block:
        if number != self.at:
            self.block, self.at = Block([plain(t) for _, t in self.sent[number].value], self.fraction), number
        return self.block

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, block, item, start, end, edits)"""
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at + len(held) < len(texts) and size < HELD_BYTES:
                held.append(plain(texts[at + len(held)].as_py() or ""))
                size += len(held[-1])
            for number in range(len(self.sent)):
                yield from ((at + row, number, *hit) for row, *hit in search_texts(self._block(number), held))
            at += len(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, fraction: float = EDIT_FRACTION) -> DataFrame:
    """(doc_id, item_id, start, end, edits): each place of docs that holds an item within its edit budget."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, start long, end long, edits long"
    text, out = docs.select("doc_id", text_or_empty().alias("text")), docs.sparkSession.createDataFrame([], schema)
    item_type = to_arrow_type(item_kind)
    for sent in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = _Searcher(sent, fraction)
            for batch in batches:
                hits = list(search(batch.column(1)))
                if hits:
                    ids = pa.array([sent[number].value[item][0] for _, number, item, *_ in hits], item_type)
                    row, _, _, start, end, edits = np.array(hits, np.int64).T
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ids, *map(pa.array, (start, end, edits))], names=["doc_id", "item_id", "start", "end", "edits"])

        out = out.unionByName(text.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, fraction: float = EDIT_FRACTION) -> DataFrame:
    """The rows of docs that hold no item; the task that searches a row hands it on, so nothing is shuffled."""
    out = docs
    for sent in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = _Searcher(sent, fraction)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[list({hit[0] for hit in search(batch.column(batch.schema.get_field_index("text")))})] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
