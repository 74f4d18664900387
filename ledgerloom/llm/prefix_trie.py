"""The trie of conversations' prefixes, built level by level.

Turns become digests before anything is shuffled. They are ranged and sorted by conversation and turn and numbered within the
ranges; a conversation that lies in several ranges is put together by the ranges' last numbers (a row a range), so a
conversation of any length is never gathered. Equal whole sequences become one, with a weight, by sums of digests over their
places.

Down: at each depth the live sequences, those whose node holds another, are grouped by (parent node, next turn); the least conv_id
names the new node, and the pair of depth and conv_id is a node's identity. A sequence alone in its node leaves the loop: all below
is a chain of its own, whose rows follow from its turns. So the loop runs as deep as different sequences agree. Up: from the last
level to the root, children are added up by their parent and joined to it. A node that many sequences share is broadcast
where they are told it (`common.spread_join`), all others are shuffled. Every level is a table in the shared folder.

The ids of the members that end in a node are hashed in ascending order: sorted ranges join them to long strings, and those
alone meet in one task, which keeps nothing but the state of the hash (SHA-256 takes its input in order).

Edge cases: null roles and texts are empty; turns come in ascending order, null first, and turns with the same number in the order
of their digests, repeated rows included; rows without conv_id belong to no conversation and are left out; % is the remainder with
the sign of conv_id; extra columns are ignored; without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import forget, materialize, spread_join

#: How conversations are rebuilt. The first crc32(conv_id) % SHARED turns are those of conv_id - conv_id % FAMILY.
SHARED, FAMILY = 9, 5
#: Ids that are joined to one string.
JOINED = 20_000


def digest(role: Column, text: Column) -> Column:
    """32 bytes that tell turns apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, key, size) -> (conv_id, pos, key, size, upto): places from 1 by turn (null first), then key, and the
    sum of sizes to there. A table."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.filter("conv_id is not null").select("conv_id", "turn", "key", "size").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, pos, upto = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            at, sums = np.arange(len(ids)), np.cumsum(size)
            new = np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]])
            start = np.maximum.accumulate(np.where(new, at, -1))  # -1: goes on from the batch before
            place = at - start + np.where(start < 0, pos, 1)
            place[start < 0] = at[start < 0] + 1 + pos
            total = sums - np.where(start < 0, -upto, np.concatenate([[0], sums])[start])
            last, pos, upto = ids[-1], int(place[-1]), int(total[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(place), batch.column(2), batch.column(3), pa.array(total)], names=["conv_id", "part", "pos", "key", "size", "upto"])

    local = materialize(ranged.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, part int, pos long, key binary, size long, upto long"), "turns")
    ends = local.groupBy("part").agg(F.min("conv_id").alias("conv_id"), F.max(F.struct("conv_id", "pos", "upto")).alias("end"))  # a row for each range
    tails = ends.select(F.col("part").alias("t_part"), F.col("end.conv_id").alias("t_conv"), F.col("end.pos").alias("t_pos"), F.col("end.upto").alias("t_upto"))
    before = ends.join(tails, (F.col("t_conv") == F.col("conv_id")) & (F.col("t_part") < F.col("part"))).groupBy("part", "conv_id").agg(F.sum("t_pos").alias("more"), F.sum("t_upto").alias("bytes"))
    both = local.join(F.broadcast(before), ["part", "conv_id"], "left")  # no more rows than ranges
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("conv_id", (F.col("pos") + zero("more")).alias("pos"), "key", "size", (F.col("upto") + zero("bytes")).alias("upto"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns from `numbered` -> (heads, rows). heads(conv_id, length, total): what each rebuilt conversation holds. rows(conv_id,
    band, depth, key, size, upto): its turns, in folders by band, the logarithm of the depth. Both are tables."""
    most = SHARED - 1
    own = turns.groupBy("conv_id").agg(
        F.count("*").alias("len"), F.max("upto").alias("own_total"), F.sort_array(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", "key", "size", "upto")))).alias("front")
    )  # fronts hold `most` turns at most
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    own = materialize(own.withColumn("h", h.cast("int")), "fronts")
    base = own.select(F.col("conv_id").alias("base"), F.col("front").alias("base_front"), F.col("len").alias("base_len"))
    plan = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("base_len", F.lit(0))).cast("int")).withColumn("cut", F.least("h", "len").cast("int"))
    at = lambda front, n: F.when(F.col(n) > 0, F.element_at(front, F.greatest(F.col(n), F.lit(1))).getField("upto")).otherwise(0)
    plan = plan.withColumn("lift", at("base_front", "m") - at("front", "cut")).withColumn("move", F.col("m") - F.col("cut"))
    plan = materialize(
        plan.select("conv_id", "len", (F.col("len") + F.col("move")).alias("length"), (F.col("own_total") + F.col("lift")).alias("total"), "move", "lift", F.when(F.col("m") > 0, F.slice("base_front", 1, "m")).alias("first")), "plans"
    )
    rest, count = turns.filter(F.col("pos") > h), turns.count()
    rest = spread_join(rest, plan.select("conv_id", "len", "move", "lift"), ["conv_id"], "len", count)
    rest = rest.select("conv_id", (F.col("pos") + F.col("move")).alias("depth"), "key", "size", (F.col("upto") + F.col("lift")).alias("upto"))
    first = plan.select("conv_id", F.inline("first")).withColumnRenamed("pos", "depth")
    rows = first.unionByName(rest).withColumn("band", F.floor(F.log2("depth")).cast("int"))
    return plan.select("conv_id", "length", "total"), _in_bands(rows)


def _in_bands(rows: DataFrame) -> DataFrame:
    from ledgerloom.llm.common import fresh_path

    path = fresh_path(rows.sparkSession, "rebuilt")
    rows.write.partitionBy("band").parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.written_at = path
    return out


def distinct_sequences(heads: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, members): sequences(rep, w, length, total), one for each different sequence, named by the least conv_id of the w
    conversations that have it; members(rep, conv_id) of those with w > 1."""
    marks = ["x0", "x1", "x2"]
    seen = rows.groupBy("conv_id").agg(*[F.bit_xor(F.xxhash64(F.lit(i), "depth", "key")).alias(m) for i, m in enumerate(marks)])
    known = materialize(heads.join(seen, "conv_id", "left").select("conv_id", "length", "total", *[F.coalesce(m, F.lit(0)).alias(m) for m in marks]), "sequences")
    found = materialize(known.groupBy("length", *marks).agg(F.min("conv_id").alias("rep"), F.count("*").alias("w"), F.max("total").alias("total")), "distinct")
    many = found.filter("w > 1").select("length", *marks, "rep", "w")
    members = spread_join(known.drop("total"), many, ["length", *marks], "w", known.count())
    return found.select("rep", "w", "length", "total"), members.select("rep", "conv_id")


def joined_digests(members: DataFrame) -> DataFrame:
    """members(rep, conv_id) -> (rep, sha): the SHA-256 of the decimal conv_ids in ascending order, comma-joined."""
    kind = members.schema["conv_id"].dataType.simpleString()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [i for i in range(len(reps)) if i == 0 or reps[i] != reps[i - 1] or i % JOINED == 0]
            yield pa.RecordBatch.from_pydict(
                {"rep": pa.array([reps[a] for a in cuts], batch.column(0).type), "first": pa.array([ids[a] for a in cuts], batch.column(1).type), "ids": [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(reps)], strict=True)]}
            )

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and rep == now:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = rep, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict({"rep": pa.array([d[0] for d in done], batch.column(0).type), "sha": pa.array([d[1] for d in done], pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"rep": pa.array([now], pa.int64()), "sha": pa.array([state.hexdigest()], pa.string())})

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.repartitionByRange(parts, "rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    pieces = ranged.mapInArrow(strings, f"rep {kind}, first {kind}, ids string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(hashes, f"rep {kind}, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = numbered(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(role, text).alias("key"), F.octet_length(text).cast("long").alias("size")))
    heads, rows = rebuilt(turns)
    sequences, members = distinct_sequences(heads, rows)
    top = sequences.agg(F.min("rep").alias("least"), F.sum("w").alias("n"), F.count_if(F.col("length") > 0).alias("k"), F.min(F.when(F.col("length") == 0, F.col("rep"))).alias("rep"), F.sum(F.when(F.col("length") == 0, F.col("w"))).alias("w")).first()
    spark = conversations.sparkSession
    if top.n is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    levels = _down(sequences.filter("length > 0").withColumn("node", F.lit(top.least)), rows, top.k)
    solved, sums = _up(levels)
    below = sums.first() if sums is not None else (0, 1, 0)  # one row
    schema = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, end_convs long"
    root = spark.createDataFrame([(0, top.least, None, top.n, *below, top.rep, top.w)], schema)
    nodes = root
    for level in solved:
        nodes = nodes.unionByName(level)
    if levels:
        nodes = nodes.unionByName(_chains(levels, sequences, rows))
    hashed = nodes.join(joined_digests(members), F.col("end_rep") == F.col("rep"), "left")
    one = F.when(F.col("end_rep").isNull(), F.sha2(F.lit(""), 256)).when(F.col("end_convs") == 1, F.sha2(F.col("end_rep").cast("string"), 256)).otherwise(F.col("sha"))
    return hashed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", one.alias("ends_sha256"))


def _down(live: DataFrame, rows: DataFrame, count: int) -> list[DataFrame]:
    """The nodes of each depth from 1: (node, key, conv_id, n, k, size, rest, longest, end_rep, end_convs). node is the parent's
    conv_id, k how many different sequences go through, rest the bytes from here on where k is 1."""
    levels: list[DataFrame] = []
    while count:
        d = len(levels) + 1
        ended, before = F.col("length") == d, live
        turn = rows.filter((F.col("band") == d.bit_length() - 1) & (F.col("depth") == d)).select(F.col("conv_id").alias("rep"), "key", "size", "upto")
        now = live.join(turn, "rep")
        level = now.groupBy("node", "key").agg(
            F.min("rep").alias("conv_id"), F.sum("w").alias("n"), F.count("*").alias("k"), F.max("size").alias("size"), F.max(F.col("total") - F.col("upto") + F.col("size")).alias("rest"), F.max("length").alias("longest"),
            F.min(F.when(ended, F.col("rep"))).alias("end_rep"), F.sum(F.when(ended, F.col("w"))).alias("end_convs"),
        )
        level = materialize(level, f"level{d}")
        levels.append(level)
        left = level.filter("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.col("k") - F.when(F.col("end_rep").isNull(), 0).otherwise(1)), F.lit(0)).alias("live")).first()
        count = left.live
        if count:
            shared = level.filter("k > 1").select("node", "key", "conv_id", "k")
            live = materialize(spread_join(now.filter(~ended).select("rep", "w", "length", "total", "node", "key"), shared, ["node", "key"], "k", left.all).select("rep", "w", "length", "total", F.col("conv_id").alias("node")), f"live{d}")
        if d > 1:
            forget(before)
    return levels


def _up(levels: list[DataFrame]) -> tuple[list[DataFrame], DataFrame | None]:
    """The levels with their subtrees' sums, and the sums of depth 1."""
    solved, sums = [], None
    for d in range(len(levels), 0, -1):
        level, alone = levels[d - 1], F.col("k") == 1
        if sums is None:
            found = level.select("*", *[F.lit(None).cast("long").alias(c) for c in ("n_children", "leaves", "saved")])
        else:
            found = level.join(sums.withColumnRenamed("node", "conv_id"), "conv_id", "left")
        children = F.when(alone, (F.col("longest") > d).cast("long")).otherwise(F.coalesce("n_children", F.lit(0)))
        own = (F.col("n") - 1) * F.col("size")
        found = found.select(
            F.lit(d).cast("long").alias("depth"), "conv_id", F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), children.alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            F.when(alone, (F.col("n") - 1) * F.col("rest")).otherwise(own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "end_rep", "end_convs",
        )
        found = materialize(found, f"solved{d}")
        solved.append(found)
        sums = found.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return solved, None if sums is None else sums.drop("node").select("n_children", "leaves", "saved")


def _chains(levels: list[DataFrame], sequences: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes below those that hold one sequence."""
    alone = levels[0].filter("k = 1").select("conv_id", F.lit(1).alias("since"), "longest")
    for d, level in enumerate(levels[1:], 2):
        alone = alone.unionByName(level.filter("k = 1").select("conv_id", F.lit(d).alias("since"), "longest"))
    alone = alone.filter("longest > since").join(sequences.select(F.col("rep").alias("conv_id"), "w", "total", "length"), "conv_id")
    alone = materialize(alone.select("conv_id", "since", "w", "total", "length"), "chains")
    below = spread_join(rows.drop("band"), alone, ["conv_id"], "length", rows.count()).filter("depth > since")
    last, none = F.col("depth") == F.col("length"), F.lit(None).cast("long")
    return below.select(
        F.col("depth").cast("long").alias("depth"), "conv_id", F.col("conv_id").alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("upto") + F.col("size"))).alias("saved_tokens"), F.when(last, F.col("conv_id")).otherwise(none).alias("end_rep"), F.when(last, F.col("w")).otherwise(none).alias("end_convs"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
