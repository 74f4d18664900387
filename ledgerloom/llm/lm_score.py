"""Language-model scores from a log-frequency Bloom filter.

Tasks cut their documents into slices of bounded size and count each slice's words, pairs and triples of words as sorted
64-bit keys, cut into buckets by the keys' top bits. A shuffle brings each bucket's counts together: single words keep
exact counts (the base score needs them); a pair or triple enters the bucket's Bloom filter once for every level up to
its quantised count, where level l says "at least 2 ** (l - 1) times". The filter grows with the corpus, so it is not
sent whole to any task: the slices' own keys come with their counts, are probed in the bucket's filter (how many levels
in a row are there), and the answers go back to the slices, which score their documents. This is the only path, at every
size; the number of buckets follows the bytes of text, so that no bucket's filter grows.

Chances are smoothed from the shorter context up: a word alone has its add-one chance; after one word it is
(low + PULL[0] * alone) / (count of the word before + PULL[0]), after two words (low + PULL[1] * the chance after one)
/ (high + PULL[1]), low being the least count that the level of the pair or triple allows and high the greatest count
that the level of the pair before allows. So the chances of a context never add up to more than 1. Where the context
was never seen, the shorter one's chance stands.

Edge cases: a null or empty text is one end token. Repeated rows are scored one by one and alike; all of them
train. A null doc_id is in training. With no training documents every count is 0, N is 0 and every score is 0.
Extra columns are ignored. An empty table gives an empty table. Keys are XXH64; two words that share a
key would share a count (a chance of about 1 in 10^7 for a million words). A text longer than a slice is a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, held_out, materialize, text_or_empty

#: How strongly the shorter context pulls; chosen over a grid by a seventh of the training documents of sf0.1.
PULL = (1000.0, 10.0)
#: Filter bits for each (key, level), and bits set for each.
BITS, PROBES = 12, 6
#: Bits of a pair's or triple's key within its bucket: an absent key meets one of a bucket's couple of million by a chance of
#: 0.2 %, less than the filter errs.
KEY_BITS = 30
#: Tokens in a slice.
SLICE = 1 << 21
#: Bytes of text for each bucket of keys.
BUCKET_BYTES = 16 << 20
#: Words whose keys a worker remembers before it starts anew.
WORDS = 400_000
END_WORD = b"\n"  # no word holds white space


class Keys(dict):
    """word -> key, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word)
        return key


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def text_keys(keys: Keys, text: str) -> np.ndarray:
    """The keys of a text's words and of its end."""
    words = text.encode().lower().split()
    words.append(END_WORD)
    return np.fromiter(map(keys.__getitem__, words), np.uint64, len(words))


def _zip(numbers: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed, behind the number of bytes."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _zip(np.diff(keys, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data), dtype=np.uint64)


class Grams:
    """The distinct words, pairs and triples of some texts, and where each token's are among them."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, bucket_bits: int):
        self.starts = np.cumsum(lengths) - lengths
        end = np.uint64(xxhash.xxh64_intdigest(END_WORD))
        before = np.concatenate(([end], words[:-1]))  # a text begins after an end
        earlier = np.concatenate(([end], before[:-1]))
        earlier[self.starts] = end
        drop = np.uint64(max(0, 64 - bucket_bits - KEY_BITS))
        pairs = pair_keys(before, words) >> drop
        triples = pair_keys(pair_keys(earlier, before), words) >> drop
        each = [np.unique(x, return_inverse=True) for x in (words, pairs, triples)]
        self.distinct, self.places = [u for u, _ in each], [i for _, i in each]


def _rows(of: str) -> list[tuple[str, pa.DataType | None]]:
    kinds = [("slice", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("data", pa.binary()), ("n", pa.list_(pa.int64()))]
    return kinds + ([("total", pa.int64()), ("distinct", pa.int64())] if of == "answers" else [])


def _schema_of(of: str, kind: str) -> str:
    return "slice long, kind int, bucket long, keys binary, data binary, n array<long>" + (", total long, distinct long" if of == "answers" else "") + f", ids array<{kind}>, held array<boolean>"


def slices(docs: DataFrame, bucket_bits: int, size: int = SLICE) -> DataFrame:
    """Rows of docs(doc_id, held_out, train, text): for each slice one of kind 0 (its words as places in its sorted word
    keys, which are those of its rows of kind 1, with the documents' ids and lengths) and for each bucket its words (kind 1), pairs (2) and triples (3), each
    with its count in the slice's training documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, number = Keys(), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            name = task << 32 | number
            number += 1
            ids, out_, words, train = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), [w for h in held for w in h[2]], np.concatenate([h[3] for h in held])
            lengths = np.array([len(w) for w in words], np.int64)
            grams, counted = Grams(np.concatenate(words), lengths, bucket_bits), np.repeat(train, lengths)
            rows = [(name, 0, name, None, _zip(grams.places[0]), lengths.tolist())]
            for order, (keys, place) in enumerate(zip(grams.distinct, grams.places, strict=True), 1):
                counts = np.bincount(place[counted], minlength=len(keys))
                below = 64 - bucket_bits if order == 1 else min(64 - bucket_bits, KEY_BITS)
                ends = [0, *np.searchsorted(keys, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(below)).tolist(), len(keys)]
                rows += [(name, order, b, _pack(keys[x:y]), _zip(counts[x:y]), None) for b, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y > x]
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), _rows("slices"), strict=True)]
                docs_at = [0, *[len(ids)] * len(part)] if at == 0 else [0] * (len(part) + 1)  # the first row has the documents
                lists = [pa.ListArray.from_arrays(pa.array(docs_at, pa.int32()), x if at == 0 else x[:0]) for x in (ids, out_)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=[k for k, _ in _rows("slices")] + ["ids", "held"])

        for batch in batches:
            first, texts = 0, []
            for row, text in enumerate(batch.column(3)):
                texts.append(text_keys(known, text.as_py()))
                n += len(texts[-1])
                if n >= size or row == batch.num_rows - 1:
                    part = batch.slice(first, len(texts))
                    held.append((part.column(0), part.column(1), texts, part.column(2).to_numpy(zero_copy_only=False)))
                    first, texts = row + 1, []
                if n >= size:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return docs.select("doc_id", "held_out", "train", text_or_empty().alias("text")).mapInArrow(run, _schema_of("slices", kind))


def level_of(counts: np.ndarray) -> np.ndarray:
    """0 for none, else 1 + the whole part of log2(count)."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


def least_count(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** (level - 1), 0.0)


def most_count(level: np.ndarray) -> np.ndarray:
    return 2.0**level - 1


def _spots(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """The filter places of (key, level), one probe after another."""
    h = _mix(keys + np.array([level], np.uint64) * np.uint64(0xD1B54A32D192ED03))
    step = _mix(h) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64)


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of a filter that holds every key once for each level up to that of its count."""
    level = level_of(counts)
    filled = np.zeros(max(64, int(level.sum()) * BITS), bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        for spot in _spots(keys[level >= at], at, len(filled)):
            filled[spot] = True
    return filled


def probe(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many levels in a row the filter has of each key."""
    out, left, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(left):
        there = np.ones(len(left), bool)
        for spot in _spots(keys[left], level, len(filled)):
            there &= filled[spot]
        left = left[there]
        out[left] = level
        level += 1
    return out


def _answered(rows: pa.Table) -> pa.Table:
    """One bucket's counts from all slices -> what each slice asked about it, and the bucket's totals (slice -1)."""
    kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
    nothing = pa.nulls(rows.num_rows, pa.int64())
    if kind == 0:
        return rows.append_column("total", nothing).append_column("distinct", nothing).select([k for k, _ in _rows("answers")] + ["ids", "held"])
    asked = [_unpack(k) for k in rows["keys"].to_pylist()]
    every, counts = np.concatenate(asked), np.concatenate([_unzip(c) for c in rows["data"].to_pylist()]).astype(np.int64)
    keys, place = np.unique(every, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, counts)
    known = sums > 0
    answer = (sums if kind == 1 else np.minimum(probe(build_filter(keys[known], sums[known]), keys), 255))[place]
    cuts = np.cumsum([0, *map(len, asked)]).tolist()
    data = [_zip(answer[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    slice_ = [*rows["slice"].to_pylist(), -1]
    n, empty = len(slice_), pa.array([0] * (len(slice_) + 1), pa.int32())
    columns = {"slice": pa.array(slice_, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int64()), "keys": pa.array([*rows["keys"].to_pylist(), None] if kind == 1 else [None] * n, pa.binary()), "data": pa.array([*data, None], pa.binary()), "n": pa.nulls(n, pa.list_(pa.int64()))}
    columns |= {"total": pa.array([0] * (n - 1) + [int(sums.sum())], pa.int64()), "distinct": pa.array([0] * (n - 1) + [int(known.sum())], pa.int64())}
    lists = {name: pa.ListArray.from_arrays(empty, rows[name].combine_chunks().values[:0] if rows[name].num_chunks else pa.array([], rows.schema.field(name).type.value_type)) for name in ("ids", "held")}
    return pa.table(columns | lists)


def chances(counts: np.ndarray, pairs: np.ndarray, triples: np.ndarray, starts: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, smoothed) log10 chances of tokens with these counts and levels; texts begin at starts."""
    before = np.concatenate((counts[-1:], counts[:-1]))  # every text ends with an end, so one stands before each
    context = np.concatenate((pairs[-1:], pairs[:-1]))
    context[starts] = 0  # no pair stands before a text
    # A pair is no more frequent than either word, a triple than either pair, whatever the filter says.
    pairs = np.minimum(pairs, level_of(np.minimum(counts, before)))
    context = np.where(context > 0, np.minimum(context, level_of(before)), 0)
    triples = np.minimum(triples, np.minimum(pairs, context))
    alone = (counts + 1) / (total + distinct + 1)
    after_one = np.where(before > 0, (least_count(pairs) + PULL[0] * alone) / (before + PULL[0]), alone)
    after_two = np.where(context > 0, (least_count(triples) + PULL[1] * after_one) / (most_count(context) + PULL[1]), after_one)
    return np.log10(alone), np.log10(after_two)


_OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_where(docs: DataFrame, train: Column, bucket_bits: int | None = None, slice_tokens: int = SLICE) -> DataFrame:
    """docs(doc_id, held_out, text) scored by a model of those rows where `train` holds. Columns: see _OUT; scores are
    log10 chances of the whole text. docs should be a table or a scan: a lost task reads its rows again in the same order.
    bucket_bits: so many buckets of keys as a power of two (from the bytes of text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if bucket_bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bucket_bits = max(4, (size // BUCKET_BYTES).bit_length())
    cut = slices(docs.select("doc_id", "held_out", train.alias("train"), "text"), bucket_bits, slice_tokens)
    # As many partitions as the text needs, however many the session has set.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << bucket_bits)
    answers = materialize(cut.repartition(parts, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_answered, _schema_of("answers", kind)), "lm-answers")
    totals = answers.filter("slice = -1 and kind = 1").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = totals[0] or 0, totals[1] or 0

    def scored(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        of = rows["kind"].to_numpy()
        lengths = np.array(rows["n"][0].as_py(), np.int64)
        words = np.concatenate([_unpack(k.as_py()) for k in rows["keys"] if k.is_valid])[_unzip(rows["data"][0].as_py()).astype(np.int64)]
        grams, data = Grams(words, lengths, bucket_bits), rows["data"].to_pylist()
        counts, pairs, triples = (np.concatenate([_unzip(data[r]) for r in np.flatnonzero(of == k).tolist()]).astype(np.int64)[grams.places[k - 1]] for k in (1, 2, 3))
        base, smooth = chances(counts, pairs, triples, grams.starts, total, distinct)
        known, base, smooth = (np.add.reduceat(x, grams.starts) for x in ((counts > 0).astype(np.int64), base, smooth))
        ids, held = (rows[c].slice(0, 1).combine_chunks().flatten() for c in ("ids", "held"))
        return pa.table([ids, held, pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), total, np.int64)), pa.array(base), pa.array(smooth)], names=_OUT)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.filter("slice >= 0").repartition(parts, "slice").groupBy("slice").applyInArrow(scored, schema)


def score(docs: DataFrame, train: DataFrame, **how) -> DataFrame:
    """The same for a model of other rows, train(text), which are not scored themselves."""
    others = train.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), "text", F.lit(True).alias("train"))
    both = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text", F.lit(False).alias("train")).unionByName(others)
    return score_where(both, F.col("train"), **how).filter("held_out is not null")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out(7, 2))
    return score_where(docs, ~F.col("held_out"))
