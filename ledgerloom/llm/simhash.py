"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits. Sorting the bits inside each segment
writes the segment's bit count in unary, so the Hamming distance of two *sorted* fingerprints is the
Manhattan distance of their count vectors, a lower bound of the Hamming distance of the fingerprints.

Two fingerprints within 4 bits have count vectors within Manhattan distance 4, hence within 2 on one
of the two halves of 16 segments. The grid's cells are the count vectors of a half; each fingerprint is
put in its own cell and in those one step away, and vectors within distance 2 share such a cell.
Fingerprints that share a cell are compared by the lower bound, then exactly. Cells that are too full for
one task are cut by blocks: two fingerprints within 4 bits are equal in one of five blocks of their bits, so
each goes to five of the cell's parts. What is still too full holds fingerprints a few bits apart and is linked
through shared midpoints. Nothing is lost, and there is no size at which fingerprints leave the grid.

Edge cases: a null or empty text (or one of white space) has fingerprint zero and is linked like any
other. The nodes are the distinct fingerprints, so doc_ids may repeat, be null or of any type that has an order:
component_id is the smallest doc_id of the component that is not null (null if there is none). Extra columns are
ignored by `near_duplicates` and kept by `keep_one`, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, materialize, scratch, text_or_empty, whole_row
from ledgerloom.llm.components import components

SEED = 42
SHINGLE = 4
#: What `keep_one` takes for near copies: shingles of so many words, and a Jaccard similarity of their sets.
COPY_SHINGLE, SIMILAR = 5, 0.8
#: Keys by which texts are brought together for that, and shingles that make a key: of two texts that are just similar enough
#: all keys differ with a chance of 2 in 10^9.
BANDS, ROWS = 28, 3
MAX_BITS = 4
#: Cells with more fingerprints than this are cut by blocks of bits.
CELL_ROWS = 8192
#: Shingles whose bits are unpacked at a time.
SLICE = 1 << 17


def shingle_hashes(text: str, width: int) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    last = min(width, len(words)) - 1
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[last : last + n].tolist(), strict=True)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; no hashes: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = np.array(hashes[at : at + SLICE], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the signed value of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


_ODD = 0x5555555555555555


def sorted_segments(fp: Column) -> Column:
    """The bits of each two-bit segment in order: the segment's count in unary."""
    odd = F.lit(_ODD).cast("long")
    low = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(odd)
    high = F.shiftleft(fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(odd), 1)
    return low.bitwiseOR(high)


def cells(counts: Column) -> Column:
    """Keys of the grid cells of a sorted fingerprint: for each half, its own cell and those one step away.
    The half's number is in bit 32 of the key."""
    halves = [counts.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(counts, 32)]

    def near(half: Column, number: int) -> Column:
        base = half.bitwiseOR(F.lit(number << 32).cast("long"))
        keys = [base]
        for i in range(0, 32, 2):
            low, high = half.bitwiseAND(F.lit(1 << i).cast("long")) != 0, half.bitwiseAND(F.lit(2 << i).cast("long")) != 0
            keys.append(F.when(~high, base.bitwiseXOR(F.lit(1 << i).cast("long"))))
            keys.append(F.when(low, base.bitwiseXOR(F.lit(2 << i).cast("long"))))
        return F.array(*keys)

    return F.filter(F.concat(near(halves[0], 0), near(halves[1], 1)), lambda k: k.isNotNull())


def _sorted_np(x: np.ndarray) -> np.ndarray:
    odd = np.uint64(_ODD)
    return ((x | (x >> np.uint64(1))) & odd) | ((x & (x >> np.uint64(1)) & odd) << np.uint64(1))


def _near(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, bits: int) -> np.ndarray:
    """Pairs that pass the Manhattan bound, then the exact test."""
    ok = np.bitwise_count(sx ^ sy) <= bits
    ok &= np.bitwise_count(x ^ y) <= bits
    return ok


def _tree(fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of one cell to the first member that reaches it inside the cell."""
    left, counts, us, vs = np.arange(len(fp)), _sorted_np(fp), [], []
    while len(left):
        root, front = left[0], left[:1]
        left = left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in front:
                hit |= _near(fp[at], fp[left], counts[at], counts[left], bits)
            front, left = left[hit], left[~hit]
            us.append(node[front])
            vs.append(np.full(len(front), node[root]))
    return (np.concatenate(us), np.concatenate(vs)) if us else (node[:0], node[:0])


def _link_cells(batches: Iterator[pa.RecordBatch], bits: int, cell_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, node) sorted by cell -> edges (u, v); rows of cells that are too large: (node, null, cell, fp)."""

    def emit(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        if len(u):
            u, v = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v))), axis=1)
        nothing = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), nothing, nothing], names=["u", "v", "cell", "fp"])

    def crowded(cell: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(cell), pa.array(fp.view(np.int64))], names=["u", "v", "cell", "fp"])

    def done(cell: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(cell)])))
        for a, n in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist(), strict=True):
            part = slice(a, a + n)
            yield emit(*_tree(fp[part], node[part], bits)) if n <= cell_rows else crowded(cell[part], fp[part], node[part])
        small = np.repeat(sizes <= 48, sizes)
        cell, fp, node = cell[small], fp[small], node[small]
        counts = _sorted_np(fp)
        for step in range(1, 48):
            same = np.flatnonzero(cell[step:] == cell[:-step])
            if not len(same):
                break
            ok = same[_near(fp[same], fp[same + step], counts[same], counts[same + step], bits)]
            if len(ok):
                yield emit(node[ok], node[ok + step])

    held: list[tuple[np.ndarray, ...]] = []
    over = None
    for batch in batches:
        cell, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(cell):
            continue
        fp = fp.view(np.uint64)
        if over is not None:
            n = int(np.searchsorted(cell, over, "right"))
            if n:
                yield crowded(cell[:n], fp[:n], node[:n])
            cell, fp, node = cell[n:], fp[n:], node[n:]
            if not len(cell):
                continue
            over = None
        held.append((cell, fp, node))
        cell, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        if cut:
            yield from done(cell[:cut], fp[:cut], node[:cut])
        held = [(cell[cut:], fp[cut:], node[cut:])]
        if len(cell) - cut > cell_rows:
            over = cell[-1]
            yield crowded(cell[cut:], fp[cut:], node[cut:])
            held = []
    if held:
        yield from done(*held[0])


def _midpoints(nodes: DataFrame) -> DataFrame:
    """Edges among the fingerprints (fp, node) of cells that are too large for one task. Two fingerprints are
    within 4 bits exactly if some value is within 2 bits of both, so each is put under the 2081 values around
    it, and all that share a value are linked to the smallest node there: a grouped minimum, no pairs."""
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))]
    signed = np.array(flips, dtype=np.uint64).view(np.int64).tolist()
    around = nodes.select("node", "fp", F.explode(F.array(*[F.lit(x).cast("long") for x in signed])).alias("flip")).select(
        "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")
    )
    least = around.groupBy("value").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return around.join(least, "value").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _blocks(cell: Column, fp: Column, bits: int) -> Column:
    """Keys of the parts of a crowded cell: one for each of bits + 1 blocks of the fingerprint's bits."""
    edges = [64 * i // (bits + 1) for i in range(bits + 2)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(cell, F.lit(i), fp.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])


def links(nodes: DataFrame, bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """nodes(fp, node), fp distinct -> edges(u, v) whose components are those of all links."""
    if bits > MAX_BITS:
        raise ValueError("the grid is laid out for at most 4 bits")

    def linked(put: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = put.repartition("cell").sortWithinPartitions("cell")
        found = materialize(found.mapInArrow(lambda it: _link_cells(it, bits, cell_rows), "u long, v long, cell long, fp long"), "links")
        return found.filter("v is not null").select("u", "v"), found.filter("v is null").select("cell", "fp", F.col("u").alias("node"))

    # Few bytes, but each row becomes some fifty: dealt out again before that.
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    edges, crowded = linked(nodes.select(F.explode(cells(sorted_segments(F.col("fp")))).alias("cell"), "fp", "node"))
    if crowded.isEmpty():
        return edges
    more, crowded = linked(crowded.select(F.explode(_blocks(F.col("cell"), F.col("fp"), bits)).alias("cell"), "fp", "node"))
    edges = edges.unionByName(more)
    if crowded.isEmpty():
        return edges
    if bits != MAX_BITS:
        raise ValueError("parts over cell_rows are handled for 4 bits only")
    return edges.unionByName(_midpoints(crowded.select("fp", "node").distinct()))


def _named(prints: DataFrame, bits: int, cell_rows: int, more: DataFrame | None = None) -> DataFrame:
    """prints(doc_id, fp) -> (fp, root, component_id): each fingerprint's component and the smallest doc_id of it. more: links
    (u, v) of fingerprints beside those of the grid."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = links(nodes.select("fp", F.col("fp").alias("node")), bits, cell_rows)
    roots = components(found if more is None else found.unionByName(more))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return materialize(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "named")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of docs."""
    prints = materialize(fingerprints(docs, width), "fingerprints")
    out = prints.join(_named(prints, bits, cell_rows), "fp")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _band_keys(hashes: np.ndarray) -> list[int]:
    """Keys of a text's set of shingle hashes: each of the ROWS least values under as many mixings."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE >> 6):
        mixed = hashes[None, at : at + (SLICE >> 6)] * odd[:, None]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), number) - (1 << 63) for number, row in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(keyed: DataFrame, width: int) -> DataFrame:
    """keyed(key, text) -> (key, fp, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, bands = np.zeros(batch.num_rows, np.uint64), []
            for row, t in enumerate(batch.column(1)):  # one text's hashes are held at a time
                hashes = np.array(shingle_hashes(t.as_py(), width), np.uint64)
                made[row] = fingerprint(hashes)
                bands.append(_band_keys(np.unique(hashes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["key", "fp", "bands"])

    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.select("key", text_or_empty().alias("text")).mapInArrow(run, f"key {kind}, fp long, bands array<long>")


def _similar(pairs: DataFrame, similar: float) -> DataFrame:
    """pairs(u, v, a, b), a and b being sets of shingle hashes -> (u, v) of those similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= similar * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Keys (and their n rows) that texts of more than one component have."""
    return rows.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high").select(key, "n")


def _apart(sets: DataFrame, similar: float) -> DataFrame:
    """sets(digest, root, size, shingles) -> pairs (x, y) of different roots, among them all that are similar enough.

    Shingles get one order: first those that a single root has, then by the number of texts that have them. Two texts similar enough
    share so many that the first they share is among the first size - similar * size + 1 of both, and that behind it enough are left.
    The first they share is in two roots, so the others are counted only."""
    shingles = sets.select("digest", "root", "size", F.explode("shingles").alias("shingle"))
    ranked = shingles.join(_mixed(shingles, "shingle"), "shingle").groupBy("digest", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("ranked"))
    first = (F.col("size") - F.size("ranked")).alias("first")
    reach = F.greatest(F.size("ranked") + 1 - F.ceil(similar * F.col("size") - 1e-6), F.lit(0)).cast("int")
    heads = ranked.select("digest", "root", "size", first, F.posexplode(F.slice("ranked", F.lit(1), reach)).alias("at", "head"))
    heads = materialize(heads.select("digest", "root", F.col("head.shingle").alias("shingle"), "size", (F.col("size") - F.col("first") - F.col("at")).alias("left")), "heads")
    heads = materialize(heads.join(_mixed(heads, "shingle").select("shingle"), "shingle"), "mixed-heads")
    x, y = (heads.select("shingle", F.col("digest").alias(d), *[F.col(c).alias(f"{d}_{c}") for c in ("root", "size", "left")]) for d in "xy")
    enough = _can_be_similar(F.least("x_left", "y_left"), F.col("x_size") + F.col("y_size"), similar)
    return x.join(y, "shingle").filter((F.col("x") < F.col("y")) & (F.col("x_root") != F.col("y_root")) & enough).select("x", "y").distinct()


def _can_be_similar(shared: Column, sizes: Column, similar: float) -> Column:
    """Whether sets whose sizes add up to `sizes` and that share so many at most can be similar enough; the slack is for rounding."""
    return shared * (1 + similar) >= similar * sizes - 1e-6


def near_copies(docs: DataFrame, prints: DataFrame, width: int, similar: float) -> DataFrame:
    """prints(digest, fp, bands) of docs(digest, text) -> links (u, v) of fingerprints that connect all whose texts share a key and
    have a Jaccard similarity of at least `similar`. Every different text is asked, also where several have one fingerprint.

    A shingle that only one text has is shared with none, so texts with too many of those have no near copy and go. The others are
    compared with one text of each key, that with the fewest such shingles, to which most of a group of copies are alike; then those
    of a key that are still in two components, with all that their rare shingles leave possible (`_apart`). All of these are bounds
    that no similar pair can fail, so nothing is left out. Tables on both sides of the joins let adaptive execution split a common key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), width), np.uint64)).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "fp", "size", "shingles"])

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        """pairs(x, y) of digests -> links of their fingerprints."""
        side = lambda d, fp, s: sets.select(F.col("digest").alias(d), F.col("fp").alias(fp), F.col("shingles").alias(s))
        return materialize(_similar(pairs.join(side("x", "u", "a"), "x").join(side("y", "v", "b"), "y"), similar), name)

    with scratch() as keep:
        one = materialize(prints.groupBy("digest", "fp").agg(F.first("bands").alias("bands")), "bands")
        keys = one.select("digest", F.explode("bands").alias("band"))
        shared = keys.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
        met = materialize(keys.join(shared, "band"), "met")  # keys that no other text has are gone
        texts = one.select("digest", "fp").join(met.select("digest").distinct(), "digest")
        wanted = docs.join(texts, "digest").dropDuplicates(["digest"]).select("digest", "fp", "text")
        sets = materialize(wanted.mapInArrow(run, "digest long, fp long, size long, shingles array<long>"), "sets")

        counted = sets.select("digest", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("digest").alias("digest"), F.count("*").alias("n"))
        own = counted.filter("n = 1").groupBy("digest").agg(F.count("*").alias("own"))
        able = sets.select("digest", "fp", "size").join(own, "digest", "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0)))
        able = able.filter(F.col("common") >= similar * F.col("size") - 1e-6).select("digest", "fp", "size", "common")
        met = materialize(met.join(able, "digest"), "able")
        head = F.min(F.struct((1 - F.col("common") / F.col("size")).alias("own"), F.col("digest").alias("y"), F.col("size").alias("y_size"), F.col("common").alias("y_common")))
        heads = met.groupBy("band").agg(head.alias("head"), F.count("*").alias("n")).filter("n > 1").select("band", "head.*")
        near = (F.col("digest") != F.col("y")) & _can_be_similar(F.least("common", "y_common"), F.col("size") + F.col("y_size"), similar)
        first = compared(met.join(heads, "band").filter(near).select(F.col("digest").alias("x"), "y").distinct(), "near-heads")

        roots = components(first)
        placed = materialize(met.join(roots, F.col("fp") == F.col("node"), "left").select("band", "digest", F.coalesce("root", "fp").alias("root")), "placed")
        still = placed.join(_mixed(placed, "band").select("band"), "band").select("digest", "root").distinct()
        rest = compared(_apart(materialize(sets.join(still, "digest"), "still"), similar), "near-rest")
        return keep(first).unionByName(keep(rest))


def keep_one(docs: DataFrame, width: int = COPY_SHINGLE, bits: int = MAX_BITS, cell_rows: int = CELL_ROWS, similar: float | None = SIMILAR) -> DataFrame:
    """Of each component the row with the smallest doc_id stays (of rows that share it, the one whose text has the
    smallest digest, of equal rows any). Rows with a null doc_id, which nothing can be said to repeat, stay. The columns
    are those of docs. Fingerprints within `bits` are linked, and those of texts whose shingles are `similar` (None: not),
    which 64 bits don't tell: at a similarity of 0.8 some ten of them differ."""
    digest = F.xxhash64(text_or_empty())
    keyed = docs.select(F.struct("doc_id", digest.alias("digest")).alias("key"), "text")
    with scratch() as keep:
        prints = materialize(_sketches(keyed, width).select("key.doc_id", "key.digest", "fp", "bands"), "fingerprints")
        more = None if similar is None else near_copies(docs.select(digest.alias("digest"), text_or_empty().alias("text")), prints, width, similar)
        named = _named(prints.select("doc_id", "fp"), bits, cell_rows, more).select("fp", "root")
        best = prints.filter("doc_id is not null").join(named, "fp").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("o"))
        best = keep(materialize(best.select(F.col("o.doc_id").alias("d"), F.col("o.digest").alias("g")), "kept"))
    # Whole rows are shuffled once: equal rows meet where they are kept.
    rows = docs.filter("doc_id is not null").select(whole_row(docs).alias("row"), "doc_id", digest.alias("digest"))
    kept = rows.join(best, (F.col("doc_id") == F.col("d")) & (F.col("digest") == F.col("g")), "left_semi").dropDuplicates(["doc_id", "digest"]).select("row.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
