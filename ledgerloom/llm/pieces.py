"""SentencePiece encoding and decoding by a streaming Viterbi search.

Places between characters are the states, pieces the steps. A step into a place survives if it is the best
one; for a unigram model the best has the greatest sum of piece scores, for a BPE model the only one whose
piece may stand beside the piece before it (merging the two pieces' characters by rank gives back exactly these
two pieces), which makes the survivors of every prefix its BPE encoding. Only the last places within the
longest piece's length can still be stepped from. Whenever the paths back from all of them meet in one
boundary, the ids before it are committed and forgotten, so a text is encoded in a window however long it is.

Blanks are written as the library writes them: one put before the text, each as U+2581. No piece has a blank
behind another character, so a search starts anew at each word, and repeated words are looked up. Pieces of
blanks alone rank last in a BPE model and equal among themselves: a run of them is cut by the longest first.
Characters that no piece holds are spelt in byte pieces.

Edge cases: null and empty texts have no ids and decode to the empty text. Repeated rows are encoded one by one.
U+2581 itself decodes to a blank (as in the library). Byte ids that are not UTF-8 decode to U+FFFD. Extra
columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import documents, text_or_empty

BLANK = "▁"
#: Words and pairs of pieces that a worker remembers before it starts anew.
WORDS, PAIRS = 400_000, 1_000_000
#: Characters from which a text's chunks are not listed first.
LONG = 1 << 20
#: Places beyond the longest piece after which the paths are searched for a common boundary.
EVERY = 32
_WORDS = re.compile(r" *[^ \n]+| +|\n")
#: The same, cut between letters or digits (but the superscript two) and other characters as well.
_FINE = re.compile(r" *[^\W_²]+| *(?:[^\w \n]|[_²])+| +|\n")
_MIXED = re.compile(r"[^\W_²](?:\W|[_²])|(?:\W|[_²])[^\W_²]")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The pieces of a model file, with their scores."""

    def __init__(self, path: str, unigram: bool = False, proto: bytes | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto) if proto else sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.unigram, self.unk = unigram, model.unk_id()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.id = {p: i for i, (p, s) in enumerate(zip(self.text, special, strict=True)) if not s}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.id))
        self.known = {c for p in self.id for c in p if c in self.id or unigram}
        self.raw = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.text)]
        if not unigram:
            self.raw[self.unk] = " ⁇ ".encode()
        #: Lengths of the pieces that end in two given characters, the longest first.
        lengths: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 1:
                lengths.setdefault(p[-2:], {1}).add(len(p))
        self.lengths = {end: tuple(sorted(some, reverse=True)) for end, some in lengths.items()}
        #: No piece spans a cut of this pattern: every path has a boundary there.
        self.chunks = _WORDS if any(_MIXED.search(p.lstrip(BLANK)) for p in self.id) else _FINE
        self.blank_runs = sorted((len(p) for p in self.id if p.strip(BLANK) == ""), reverse=True)
        self._pairs: dict[int, bool] = {}
        self.rank = [-x for x in self.score]

    def merged(self, word: str, merges: int | None = None) -> list[str]:
        """The BPE pieces of a short string by merging: the best-ranked neighbours first, the leftmost of equals.
        merges: stop after so many."""
        parts, left = list(word), len(word) if merges is None else merges
        while len(parts) > 1 and left:
            left -= 1
            ranked = [(-self.score[i], at) for at in range(len(parts) - 1) if (i := self.id.get(parts[at] + parts[at + 1])) is not None]
            if not ranked:
                break
            at = min(ranked)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @cached_property
    def _last_merge(self) -> dict[int, tuple[int, int]]:
        """For every piece that merging its own characters makes, the two pieces of the last merge."""
        halves = {}
        for text, i in self.id.items():
            if len(text) > 1:
                parts = self.merged(text, len(text) - 2)
                if len(parts) == 2 and parts[0] in self.id and parts[1] in self.id:
                    halves[i] = (self.id[parts[0]], self.id[parts[1]])
        return halves

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether merging leaves left and right apart. Their last merges are undone from the latest back; a merge
        over the joint that ranks before what has been undone would have come first."""
        halves, rank = self._last_merge, self.rank
        before, ties = float("inf"), False
        while True:
            over = self.id.get(self.text[left] + self.text[right])
            if over is not None and (rank[over] < before or ties and rank[over] == before):
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and rank[left] > rank[right]:
                before, ties, left = rank[left], False, a[1]
            else:  # of equal merges the one over the joint lies further left
                before, ties, right = rank[right], True, b[0]

    def allowed(self, before: int, piece: int) -> bool:
        """Whether a BPE encoding may have `piece` after `before` (-1: at the start)."""
        if before < 0:
            return len(self.text[piece]) == 1 or piece in self._last_merge
        key = before << 32 | piece
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = (len(self.text[piece]) == 1 or piece in self._last_merge) and self._side_by_side(before, piece)
        return known

    def blanks(self, n: int) -> list[int]:
        out: list[int] = []
        for size in self.blank_runs:
            out += [self.id[BLANK * size]] * (n // size)
            n %= size
        return out


def viterbi(vocabulary: Vocabulary, text: str, widest: list[int] | None = None) -> list[int]:
    """The ids of a text whose characters all occur in pieces. Only the steps into the places since the last
    committed boundary are held; widest[0] gets the greatest number of them."""
    longest, get, pairs, allowed = vocabulary.longest, vocabulary.id.get, vocabulary._pairs, vocabulary.allowed
    known, unigram, scores, lengths = pairs.get, vocabulary.unigram, vocabulary.score, vocabulary.lengths.get
    one = (1,)
    # Entry i is the best step into place base + i: where it came from, its piece and, for a unigram model, its sum.
    out, base, came, ids, total = [], 0, [0], [-1], [0.0]
    for end in range(1, len(text) + 1):
        best, best_from, best_id = -math.inf, -1, -1
        for size in lengths(text[end - 2 : end], one) if end > 1 else one:
            at = end - size - base
            if at < 0 or (piece := get(text[end - size : end])) is None:
                continue
            if unigram:
                if came[at] >= 0 and (score := total[at] + scores[piece]) > best:
                    best, best_from, best_id = score, at, piece
            elif came[at] >= 0 and (ok if (ok := known(ids[at] << 32 | piece)) is not None else allowed(ids[at], piece)):
                best_from, best_id = at, piece
                break
        came.append(best_from)
        ids.append(best_id)
        if unigram:
            total.append(best)
        held = end - base
        if held >= longest + EVERY:
            if widest is not None:
                widest[0] = max(widest[0], held)
            paths = {p for p in range(held - longest + 1, held + 1) if came[p] >= 0}
            while len(paths) > 1:
                last = max(paths)
                paths.remove(last)
                paths.add(came[last])
            cut = paths.pop()
            if cut:
                out += _back(came, ids, cut)
                base += cut
                # What stood at the cut is the new start; steps from before it belong to paths that died out.
                came = [0, *(p - cut if p >= cut else -1 for p in came[cut + 1 :])]
                ids = ids[cut:]
                if unigram:
                    total = [t - total[cut] for t in total[cut:]]
    return out + _back(came, ids, len(text) - base)


def _back(came: list[int], ids: list[int], at: int) -> list[int]:
    out = []
    while at > 0:
        out.append(ids[at])
        at = came[at]
    return out[::-1]


class Codec:
    """Encodes and decodes whole texts; words that come again are remembered."""

    def __init__(self, path: str | None = None, unigram: bool = False, proto: bytes | None = None):
        self.v = Vocabulary(path or default_model(), unigram, proto)
        self.words: dict[str, bytes] = {}
        self.widest = [0]

    def _word(self, chunk: str) -> bytes:
        v, out, known = self.v, [], self.v.known
        word = chunk.lstrip(" ")
        n = len(chunk) - len(word)
        if v.unigram:
            word, n = BLANK * n + word, 0
        elif n:
            word, n = BLANK + word, n - 1
        at = 0
        while at < len(word):
            end = at
            while end < len(word) and word[end] in known:
                end += 1
            out += viterbi(v, word[at:end], self.widest)
            if end < len(word):
                out += [v.byte[b] for b in word[end].encode()] if v.byte else [v.unk]
                end += 1
            at = end
        if n and out and out[0] == v.id.get(BLANK):
            out, n = out[1:], n + 1
        return self._bytes(v.blanks(n) + out if n else out)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        words, parts = self.words, []
        marked = " " + text.replace(BLANK, " ")
        # A long text's chunks are taken one by one instead of all at once.
        for chunk in self.v.chunks.findall(marked) if len(marked) < LONG else (m[0] for m in self.v.chunks.finditer(marked)):
            ids = words.get(chunk)
            if ids is None:
                if len(words) >= WORDS:
                    words.clear()
                ids = self._word(chunk)
                if len(chunk) <= 64:
                    words[chunk] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.v.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _list_column(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))]))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of every text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [c.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), _list_column(rows), pa.array([len(r) // 4 for r in rows], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_chars, exact): every text encoded, its ids decoded again and compared."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                ids = c.encode(text)
                back = c.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), len(back), back == text))
            n, crc, chars, exact = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(chars, pa.int64()), pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "n_chars", "exact"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, n_chars long, exact boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
