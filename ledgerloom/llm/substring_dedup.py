"""Removal of repeated substrings by sorting suffixes.

A window is a string of WIDTH bytes inside one text; a byte goes if some window over it starts anywhere else too.
Sorting every suffix of a corpus would ship it many times over, so suffixes are grouped first, without loss: a window's
anchor is a string of GRAM bytes that its own bytes choose, neighbouring windows mostly share one, and equal windows
have equal anchors at the same place. Windows whose anchor is found once are unique. Runs of windows under one
anchor that are equal as a whole are counted as one (this also folds groups of copies before anything is shipped); they
are known by their anchor and two hashes of all their bytes, of different kinds, 192 bits in all.
The suffixes that are left are range-partitioned by the bytes that lead at their anchor, with splitters that Spark
samples, sorted in each bucket by multikey quicksort and compared with their neighbours, byte by byte; the anchor is part
of the key, and a key never lies in two buckets, so no equal suffixes face each other across a boundary. An anchor with
more than GROUP_RUNS different runs is not sorted in one place: its windows are counted by their anchor and an XXH3 of
their bytes, added up before they are shuffled, and the counts joined back (tables on both sides, so that adaptive
execution splits a common window). So no group grows with the corpus.

Edge cases: null and empty texts keep nothing and lose nothing. Texts shorter than WIDTH lose nothing. Rows that
repeat a doc_id and text lose every byte that a window covers. A null doc_id is a value like any other. Extra
columns are ignored. An empty table gives an empty table. Windows are of bytes and may cut a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, materialize, text_or_empty
from ledgerloom.llm.substring_core import sorted_order, window_runs

WIDTH, GRAM = 200, 64
#: Bytes at the anchor by which suffixes are range-partitioned.
LEAD = 16
#: Bytes of texts that are hashed at once.
SLICE_BYTES = 2 << 20
#: Different runs of an anchor that are sorted together, and windows that are sorted at once.
GROUP_RUNS, SORTED = 1024, 150_000


def runs(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(anchor, whole, body, h, doc_id, first, windows, skip) of texts(h, doc_id, text); whole and body are hashes of a run's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.as_py().encode() for t in batch.column(2)]
            at = 0
            while at < len(data):
                stop, size = at, 0
                while stop < len(data) and (stop == at or size + len(data[stop]) <= SLICE_BYTES):
                    size += len(data[stop])
                    stop += 1
                ends = np.cumsum([len(d) for d in data[at:stop]])
                joined = b"".join(data[at:stop])
                anchor, whole, first, windows, skip = window_runs(joined, ends, width, gram)
                view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
                body = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (first + windows + (width - 1)).tolist(), strict=True)), np.uint64, len(first))
                row = np.searchsorted(ends, first, "right")
                begin = np.concatenate(([0], ends[:-1]))
                rows = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(body.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((first - begin[row]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(skip.astype(np.int32))],
                    names=["anchor", "whole", "body", "h", "doc_id", "first", "windows", "skip"],
                )
                at = stop

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"anchor long, whole long, body long, h long, doc_id {kind}, first int, windows int, skip int")


def _extract(texts: DataFrame, wanted: DataFrame, width: int, lead: int) -> DataFrame:
    """The bytes under the wanted runs, one row for each (body, windows); of runs under crowded anchors one row for each window (digest)."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    joined = texts.join(wanted.withColumnRenamed("doc_id", "d"), (F.col("h") == F.col("hw")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("h", "doc_id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows: list[tuple] = []

            def flush(batch=batch) -> pa.RecordBatch:
                index, *columns = zip(*rows, strict=True)
                rows.clear()
                index = pa.array(index)
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["h", "doc_id", "lead", "anchor", "body", "windows", "times", "first", "digest"])

            for r in range(batch.num_rows):
                data = batch.column(2)[r].as_py().encode()
                for w in batch.column(3)[r].as_py():
                    first, n = w["first"], w["windows"]
                    if w["crowded"]:
                        rows += [(r, None, w["anchor"], None, 1, w["times"], x, digest(data[x : x + width]) - (1 << 63)) for x in range(first, first + n)]
                    else:
                        rows.append((r, data[first + w["skip"] : first + w["skip"] + lead], w["anchor"], data[first : first + n + width - 1], n, w["times"], first, None))
                    if len(rows) >= 20_000:
                        yield flush()
            if rows:
                yield flush()

    return joined.mapInArrow(run, f"h long, doc_id {kind}, lead binary, anchor long, body binary, windows int, times long, first int, digest long")


def _compare(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in the order of (lead, anchor) -> intervals (h, doc_id, start, end) of repeated bytes, for
    the runs that are counted once."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bodies, count = table["body"].to_pylist(), table["windows"].to_numpy().astype(np.int64)
        padded = -(-width // 8) * 8
        rows = np.zeros((int(count.sum()), padded), np.uint8)
        at = 0
        for body, n in zip(bodies, count.tolist(), strict=True):
            rows[at : at + n, :width] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(body, np.uint8), width)
            at += n
        run = np.repeat(np.arange(len(bodies)), count)
        order, group = sorted_order(rows)
        times = table["times"].to_numpy()[run[order]]
        total = np.zeros(len(order), np.int64)
        np.add.at(total, group, times)
        twice = np.zeros(len(order), bool)
        twice[order] = total[group] > 1
        twice &= (table["times"].to_numpy() == 1)[run]
        hit = np.flatnonzero(twice)
        if not len(hit):
            return
        place = hit - (np.cumsum(count) - count)[run[hit]] + table["first"].to_numpy()[run[hit]]
        new = np.concatenate(([True], (run[hit][1:] != run[hit][:-1]) | (place[1:] > place[:-1] + width)))
        lo = np.flatnonzero(new)
        hi = np.concatenate((lo[1:], [len(hit)])) - 1
        rows_ = pa.array(run[hit][lo])
        taken = table.select(["h", "doc_id"]).take(rows_).combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(place[lo].astype(np.int32)), pa.array((place[hi] + width).astype(np.int32))], names=["h", "doc_id", "start", "end"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(batch.column("windows").to_numpy().sum())
        if size < SORTED:
            continue
        table = pa.Table.from_batches(held)
        anchor, weight = table["anchor"].to_numpy(), table["windows"].to_numpy().astype(np.int64)
        new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        if not len(new):
            continue
        done, since = 0, 0
        total = np.concatenate(([0], np.cumsum(weight)))
        for cut in new.tolist():
            if total[cut] - total[done] >= SORTED:
                yield from settle(table.slice(done, cut - done))
                done = cut
            since = cut
        if since > done:
            yield from settle(table.slice(done, since - done))
            done = since
        held = table.slice(done).combine_chunks().to_batches()
        size = int(total[-1] - total[done])
    if held:
        yield from settle(pa.Table.from_batches(held))


def repeated_intervals(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(texts(h, doc_id, text), intervals(h, doc_id, start, end)): the repeated bytes of each text, end excluded;
    intervals may overlap. h is a hash of doc_id and text."""
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64("doc_id", text_or_empty()).alias("h"), "doc_id", text_or_empty().alias("text"))
    found = materialize(runs(texts.filter(F.octet_length("text") >= width), width, gram), "runs")
    again = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    found = materialize(found.join(again, "anchor", "left_semi"), "repeated-anchors")
    wholes = found.groupBy("anchor", "whole", "body").agg(F.count("*").alias("times"), F.min(F.struct("h", "doc_id", "first", "windows", "skip")).alias("one"))
    wholes = materialize(wholes, "whole-runs")
    alike = found.join(wholes.filter("times > 1").select("anchor", "whole", "body"), ["anchor", "whole", "body"], "left_semi")
    alike = alike.select("h", "doc_id", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (width - 1)).alias("end"))
    mixed = wholes.groupBy("anchor").agg(F.count("*").alias("runs")).filter("runs > 1")
    open_ = materialize(wholes.join(mixed, "anchor").select("one.h", "one.doc_id", "one.first", "one.windows", "one.skip", "anchor", "times", "runs"), "open-runs")
    windows = open_.agg(F.sum("windows")).first()[0] or 0
    crowded = (F.col("runs") > GROUP_RUNS).alias("crowded")
    wanted = open_.groupBy("h", "doc_id").agg(F.collect_list(F.struct("anchor", "first", "windows", "skip", "times", crowded)).alias("wanted")).withColumnRenamed("h", "hw")
    taken = materialize(_extract(texts, wanted, width, min(LEAD, gram)), "suffixes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), windows // (4 * SORTED))
    keys, kind = ["lead", "anchor"], texts.schema["doc_id"].dataType.simpleString()
    suffixes = taken.filter("body is not null").select("h", "doc_id", "lead", "anchor", "body", "windows", "times", "first").repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
    sorted_ = suffixes.mapInArrow(lambda it: _compare(it, width), f"h long, doc_id {kind}, start int, end int")
    counted = taken.filter("digest is not null").select("h", "doc_id", "anchor", "digest", "times", "first")
    common = materialize(counted.groupBy("anchor", "digest").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor", "digest"), "common-windows")
    shared = counted.filter("times = 1").join(common, ["anchor", "digest"], "left_semi").select("h", "doc_id", F.col("first").alias("start"), (F.col("first") + width).alias("end"))
    return texts, alike.unionByName(materialize(sorted_, "sorted-suffixes")).unionByName(shared)


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed array<(start, end)>, kept binary) of every row of docs."""
    texts, intervals = repeated_intervals(docs, width, gram)
    each = intervals.groupBy("h", "doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnRenamed("h", "hs").withColumnRenamed("doc_id", "ds")
    joined = texts.join(each, (F.col("h") == F.col("hs")) & F.col("doc_id").eqNullSafe(F.col("ds")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                data, gone = t.as_py().encode(), _merge(s.as_py())
                edges = [0, *(x for g in gone for x in g), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in gone], kept))
            n, gone, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
