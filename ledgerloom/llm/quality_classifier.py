"""A quality classifier: ridge scores over random Fourier features of document statistics, isotonically calibrated.

Every whole text is turned once into a row of statistics (never its labels, language, source or id). Random cosines
of the standardised statistics approximate a Gaussian kernel; each partition sums its normal equations, the sums
are added up in a tree whose groups don't grow, and a system of a fixed size is solved on the driver. Training rows are cut in
folds whose sums are kept apart, so that each row's raw score for the calibration comes from the other folds; the
calibration pools adjacent violators over a histogram of a fixed number of bins.

Edge cases: null and empty texts have statistics (zeros) and a score. Labels other than 0 and 1 are ignored,
several labels of a document count as their mean; repeated document rows are scored one by one and each
labelled one trains. Documents without a doc_id have no label. With no usable label every score is 0.5.
Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, held_out, materialize, text_or_empty
from ledgerloom.llm.quality_rules import FUNCTION_WORDS, SYMBOLS

FEATURES, SEED, WIDTH, RIDGE = 256, 20240131, 0.35, 1e-3
CLIP = 6.0
#: Bins of raw scores for the calibration, over this range.
BINS, LOW, HIGH = 1024, -0.5, 1.5
THRESHOLD = 0.7
#: Partial sums that are added up in one group.
FAN_IN = 32

_COMMON = frozenset(w.encode() for w in FUNCTION_WORDS)
_CLASSES = np.zeros((8, 256))
for _row, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:?'\"()-", SYMBOLS.encode(), b"!", b" \t\n\v\f\r", range(128, 256))):
    _CLASSES[_row, list(_chars)] = 1
STATISTICS = (
    "log_words", "log_lines", "mean_word", "spread_word", "distinct_words", "function_words", "repeat_lines", "log_line_words",
    "ended_lines", "repeat_pairs", "upper", "lower", "digits", "punctuation", "symbols", "exclaims", "blanks", "high_bytes", "byte_bits", "longest_word",
)


def statistics_of(text: str) -> np.ndarray:
    data = text.encode()
    words, lines = data.lower().split(), [x for x in data.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    total = max(1.0, counts.sum())
    classes = _CLASSES @ counts / total
    shares = counts[counts > 0] / total
    pairs = len(set(zip(words, words[1:])))
    return np.array([
        np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log(max(1, len(set(words)))) / np.log(n + 1),
        sum(map(_COMMON.__contains__, words)) / n, 1 - len(set(lines)) / m if lines else 0.0, np.log1p(len(words) / m),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / m, 1 - pairs / (n - 1) if len(words) > 1 else 0.0,
        *classes, -(shares * np.log2(shares)).sum(), np.log1p(lengths.max()),
    ])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, fold, stats) of docs(doc_id, held_out, fold, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t.as_py()) for t in batch.column(3)]
            flat = np.concatenate(rows) if rows else np.empty(0)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "held_out", "fold", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "fold", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, fold int, stats array<double>")


class Kernel:
    """Standardised statistics to random cosines, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = rng.normal(0.0, WIDTH, (len(mean), FEATURES))
        self.shifts = rng.uniform(0.0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        return np.concatenate((np.cos(z @ self.directions + self.shifts) * np.sqrt(2.0 / FEATURES), np.ones((len(z), 1))), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :].reshape(-1, len(STATISTICS))[: len(column)]


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(rows["sums"].iloc[0]) // 8)
    for part in rows["sums"]:
        total += np.frombuffer(part)
    return pd.DataFrame({"fold": rows["fold"].iloc[:1], "number": rows["number"].iloc[:1] // FAN_IN, "sums": [total.tobytes()]})


def normal_equations(train: DataFrame, kernel: Kernel) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """fold -> (ZtZ, Zty, rows) of train(fold, stats, y)."""
    size, schema = FEATURES + 1, "fold int, number int, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, z, y = batch.column(0).to_numpy(), kernel(_matrix(batch.column(1))), batch.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                zf, yf = z[fold == f], y[fold == f]
                sums[f] = sums.get(f, 0) + np.concatenate(((zf.T @ zf).ravel(), zf.T @ yf, [len(yf)]))
        if sums:
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([number] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["fold", "number", "sums"])

    last = train.select("fold", "stats", F.col("y").cast("double")).mapInArrow(run, schema)
    left = train.rdd.getNumPartitions()
    while True:
        last = last.groupBy("fold", F.floor(F.col("number") / FAN_IN)).applyInPandas(_added, schema)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    out = {}
    for row in last.collect():  # a matrix of a fixed size for each fold
        s = np.frombuffer(row.sums)
        out[row.fold] = (s[: size * size].reshape(size, size), s[size * size : -1], float(s[-1]))
    return out


def solve(parts: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray | None:
    rows = sum(p[2] for p in parts)
    if not rows:
        return None
    gram, right = sum(p[0] for p in parts), sum(p[1] for p in parts)
    penalty = np.full(len(right), RIDGE * rows)
    penalty[-1] = 1e-9 * rows
    return np.linalg.solve(gram + np.diag(penalty), right)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the non-decreasing fit of y at sorted x: one at the middle of each pooled block."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([yi * wi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


class Scorer:
    def __init__(self, kernel: Kernel, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.kernel, self.weights, self.knots = kernel, weights, knots

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        raw = self.kernel(stats) @ self.weights
        inside = np.clip((raw - LOW) / (HIGH - LOW), 0.0, 1.0)  # orders the rows of a pooled block
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * inside, 0.0, 1.0)


def _raw(rows: DataFrame, weights: dict[int, np.ndarray], kernel: Kernel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, z = batch.column(0).to_numpy(), kernel(_matrix(batch.column(1)))
            raw = np.zeros(len(fold))
            for f, w in weights.items():
                raw[fold == f] = z[fold == f] @ w
            place = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(2)], names=["place", "y"])

    return rows.select("fold", "stats", F.col("y").cast("double")).mapInArrow(run, "place int, y double")


def fit(train: DataFrame) -> Scorer | None:
    """train(fold, stats, y): y in 0..1."""
    each = range(len(STATISTICS))
    moments = train.agg(*[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in each], *[F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in each]).first()
    if moments["m0"] is None:
        return None
    kernel = Kernel(np.array([moments[f"m{i}"] for i in each]), np.array([moments[f"s{i}"] for i in each]))
    sums = normal_equations(train, kernel)
    whole = solve(list(sums.values()))
    apart = {f: w if (w := solve([s for g, s in sums.items() if g != f])) is not None else whole for f in sums}
    bins = _raw(train, apart, kernel).groupBy("place").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("place").collect()  # at most BINS rows
    place, y, n = (np.array([r[c] for r in bins], float) for c in ("place", "y", "n"))
    return Scorer(kernel, whole, isotonic(LOW + (place + 0.5) * (HIGH - LOW) / BINS, y / n, n))


def classify(docs: DataFrame, labels: DataFrame, training: Column, fold: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learnt from the labelled rows where `training`
    holds. labels(doc_id, quality). fold: an expression over docs that cuts the training rows for cross-fitting."""
    marked = docs.select("doc_id", (~training).alias("held_out"), fold.cast("int").alias("fold"), "text")
    stats = materialize(statistics(marked), "statistics")
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    train = materialize(stats.filter(~F.col("held_out")).join(known, "doc_id").select("fold", "stats", "y"), "labelled")
    scorer = fit(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scorer(_matrix(batch.column(2))) if scorer else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "held_out", "stats").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    return classify(documents(spark, sf_dir), labels, ~held_out(4, 2), fold)
