"""How the sources of a language differ in the words they use.

Terms are counted by (lang, source) within tasks, then summed; a language keeps those of enough of its documents. Two reports
follow, in whole numbers throughout. p of a term is its share of the group's kept occurrences in billionths, each count five more.

Divergence of two sources is the sum of |p - p'| over all kept terms, but only terms that occur are touched. A term that a
source lacks has the source's baseline z there. So the sum is V |z - z'|, plus for either source the corrections of its own terms
against the other's baseline (from a histogram of its p, cumulated up to that baseline), plus a correction for the terms that both
have, which is summed pair by pair within tasks over ranges of terms and leaves a task as one row for each pair of sources.

Terms that stand out in a source (p above the language's q) are ranked by a radix select: histograms over ten bits of the value at a
time find each group's k-th value; ties there are cut by histograms over two bytes of the term's UTF-8 at a time, until no group
has more than SORTED of them left; only what is chosen is sorted. Groups that hold many terms are broadcast where a join meets
them, by `common.spread_join`.

Edge cases: null text, lang and source are empty strings, and the empty string is a language and a source like any other; repeated
rows count each, also as documents; texts without letters still make their group occur; a language without kept terms has
distances of zero; a single source has no pair; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import documents, materialize, spread_join

#: Documents of a language that a kept term needs, what is added to counts, the scale of shares, and ranks of terms.
MIN_DOCS, ADDED, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Different terms that a task holds before it hands them on, bytes of a text at a time, sums of pairs that a task holds.
HELD, CHUNK, PAIRS = 1_000_000, 1 << 22, 1_000_000
#: Bits of the values, bits and bytes of a histogram, and ties that are sorted.
BITS, STEP, BYTES, SORTED = 30, 10, 2, 4096
_ONE_DOC = 1 << 44
#: Letters in lower case and all bytes beyond ASCII stay, whatever else parts terms.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "lang string, source string, part string, item string, value long, rank int"


def _terms(text: str) -> Counter:
    plain = text.encode().translate(_KEEP)
    if len(plain) <= CHUNK:
        return Counter(plain.split())
    found, at = Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences, and documents with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                packed = np.fromiter(terms.values(), np.int64, len(terms))
                columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))), pa.array([source], pa.string()).take(pa.array(np.zeros(len(terms), np.int32)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(terms), pa.string()), pa.array(packed % _ONE_DOC), pa.array(packed // _ONE_DOC)], names=["lang", "source", "term", "count", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = held.setdefault((lang, source), {})
                before, get = len(terms), terms.get
                for term, n in _terms(text).items():
                    terms[term] = get(term, 0) + n + _ONE_DOC
                size += len(terms) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    raw = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return raw.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, whole: str = "whole") -> Column:
    """1 + floor(SCALE * (count + ADDED) / whole), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {ADDED} as decimal(19,0))) div cast({whole} as decimal(20,0))")


def profiles(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms), two tables. groups(lang, source, g, v, whole, z, n_terms, sum_p): every group that occurs, numbered within its
    language. terms(lang, source, g, term, p, q, z): the kept terms that occur in a group."""
    one = W.Window.partitionBy("lang", "term")
    kept = term_counts(docs).select("lang", "source", "term", "count", F.sum("docs").over(one).alias("df"), F.sum("count").over(one).alias("lang_count"), (F.min("source").over(one) == F.col("source")).alias("first"))
    kept = materialize(kept.filter(F.col("df") >= min_docs).drop("df"), "kept")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    there = docs.select(empty("lang"), empty("source")).distinct()
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("count").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("n_terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = there.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("n_terms"), zero("v"), zero("lang_n"))
    groups = groups.withColumn("whole", F.col("n") + ADDED * F.col("v")).withColumn("lang_whole", F.col("lang_n") + ADDED * F.col("v")).withColumn("g", F.row_number().over(W.Window.partitionBy("lang").orderBy("source")))
    groups = materialize(groups.withColumn("z", F.when(F.col("v") > 0, share("0")).otherwise(0)), "groups")
    terms = spread_join(kept, groups.filter("n_terms > 0").select("lang", "source", "g", "n_terms", "whole", "lang_whole", "z"), ["lang", "source"], "n_terms", kept.count())
    terms = materialize(terms.select("lang", "source", "g", "term", share("count").alias("p"), share("lang_count", "lang_whole").alias("q"), "z"), "terms")
    sums = terms.groupBy("lang", "g").agg(F.sum("p").alias("sum_p"))
    return groups.join(sums, ["lang", "g"], "left").select("lang", "source", "g", "v", "z", "n_terms", zero("sum_p")), terms


def shared_terms(terms: DataFrame) -> DataFrame:
    """(lang, lo, hi, both): over the terms that two groups of a language share, what |p - p'| differs from the corrections of
    either term against the other group's baseline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], int] = {}

        def add(rows: pa.Table) -> None:
            langs, n = rows.column("lang").combine_chunks().dictionary_encode(), rows.num_rows
            term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            g, p, z = (rows.column(c).to_numpy().astype(np.int64) for c in ("g", "p", "z"))
            far = 1
            while far < n:
                same = np.flatnonzero((term[far:] == term[:-far]) & (lang[far:] == lang[:-far]))
                if not len(same):
                    break  # rows of a term stand together, so none is as far apart
                a, b = same, same + far
                value = np.abs(p[a] - p[b]) + np.abs(z[a] - z[b]) - np.abs(p[a] - z[b]) - np.abs(p[b] - z[a])
                code = (np.minimum(g[a], g[b]) << 31) | np.maximum(g[a], g[b])
                order = np.lexsort((code, lang[a]))
                code, of, value = code[order], lang[a][order], value[order]
                starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])]))
                for i, k, s in zip(of[starts].tolist(), code[starts].tolist(), np.add.reduceat(value, starts).tolist(), strict=True):
                    key = (langs.dictionary[i].as_py(), k)
                    held[key] = held.get(key, 0) + s
                far += 1

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] >> 31 for k, _ in rows], pa.int32()), pa.array([k[1] & 0x7FFFFFFF for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.int64())], names=["lang", "lo", "hi", "both"]
            )

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = (batch.column(0)[-1], batch.column(1)[-1])
            cut = batch.num_rows
            while cut and (batch.column(0)[cut - 1], batch.column(1)[cut - 1]) == last:
                cut -= 1
            if cut:  # all before the last term, which may go on
                add(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            elif rest and (rest[-1].column(0)[-1], rest[-1].column(1)[-1]) != last:
                add(pa.Table.from_batches(rest))
                rest = []
            rest.append(batch.slice(cut))
            if len(held) > PAIRS:
                yield out()
        if rest:
            add(pa.Table.from_batches(rest))
        yield out()

    dealt = terms.select("lang", "term", "g", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "g")
    return dealt.mapInArrow(run, "lang string, lo int, hi int, both long").groupBy("lang", "lo", "hi").agg(F.sum("both").alias("both"))


def divergence(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): every ordered pair of a language's sources, with the sum of |p - p'| over its kept terms."""
    other = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"), F.col("z").alias("zb"))
    pairs = groups.withColumnRenamed("g", "a").join(other, "lang").filter("a <> b")  # as many rows as the result has
    ask = pairs.select("lang", "a", F.col("zb").alias("value"), F.lit(1).alias("ask"), "b", "source", "item", "v", "z", F.col("n_terms").alias("n_all"), F.col("sum_p").alias("p_all"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    bars = terms.groupBy("lang", F.col("g").alias("a"), F.col("p").alias("value")).agg(F.count("*").alias("n"))
    bars = bars.select("*", F.lit(0).alias("ask"), (F.col("n") * F.col("value")).alias("s"))
    upto = W.Window.partitionBy("lang", "a").orderBy("value", "ask").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    cum = ask.unionByName(bars, allowMissingColumns=True).select("*", F.sum("n").over(upto).alias("n_le"), F.sum("s").over(upto).alias("s_le")).filter("ask = 1")
    apart = F.abs(F.col("z") - F.col("value"))
    one_way = F.col("p_all") - F.col("n_all") * F.col("value") + 2 * (F.col("n_le") * F.col("value") - F.col("s_le")) - F.col("n_all") * apart
    ways = cum.select("lang", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), one_way.alias("x"), F.when(F.col("a") < F.col("b"), F.col("v") * apart).otherwise(0).alias("base"), F.when(F.col("a") < F.col("b"), F.col("source")).otherwise(F.col("item")).alias("lo_name"), F.when(F.col("a") < F.col("b"), F.col("item")).otherwise(F.col("source")).alias("hi_name"))
    both = shared_terms(terms).select("lang", "lo", "hi", F.col("both").alias("x"), F.lit(0).cast("long").alias("base"))
    sums = ways.unionByName(both, allowMissingColumns=True).groupBy("lang", "lo", "hi").agg((F.sum("x") + F.sum("base")).alias("value"), F.max("lo_name").alias("lo_name"), F.max("hi_name").alias("hi_name"))
    turned = F.explode(F.array(F.struct(F.col("lo_name").alias("source"), F.col("hi_name").alias("item")), F.struct(F.col("hi_name").alias("source"), F.col("lo_name").alias("item"))))
    return sums.select("lang", "value", turned.alias("x")).select("lang", "x.source", "x.item", "value")


def _kth(counts: DataFrame, group: list[str], order: Column) -> DataFrame:
    """counts(group, bin, n, need): the bin in which each group's need-th row lies, with what is still needed there."""
    upto = F.sum("n").over(W.Window.partitionBy(*group).orderBy(order).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    return counts.withColumn("upto", upto).filter("upto >= need and upto - n < need").select(*group, "bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("n").alias("ties"))


def top_k(rows: DataFrame, group: list[str], k: int = RANKS) -> DataFrame:
    """rows(group, item, value), a table, values from 0 to 2^BITS - 1, items of a group different -> the k rows of each group with the
    largest values, of equals those with the least items by their UTF-8 bytes, with their rank."""
    sizes = materialize(rows.groupBy(*group).agg(F.count("*").alias("size")), "sizes")
    total = rows.count()
    state = sizes.select(*group, "size", F.lit(0).cast("long").alias("bin_path"), F.least("size", F.lit(k)).cast("long").alias("need"), F.col("size").alias("ties"))
    for shift in range(BITS - STEP, -1, -STEP):
        live = spread_join(rows, state, group, "size", total).filter(F.shiftright("value", shift + STEP) == F.col("bin_path"))
        bins = live.groupBy(*group, F.shiftright("value", shift).alias("bin")).agg(F.count("*").alias("n"), F.max("need").alias("need"))
        state = materialize(_kth(bins, group, F.desc("bin")).withColumnRenamed("bin", "bin_path").join(sizes, group), "state")
    judged = spread_join(rows, state, group, "size", total)
    above = judged.filter("value > bin_path").select(*group, "item", "value")
    equal = judged.filter("value = bin_path")
    chosen = above.unionByName(equal.filter("ties = need").select(*group, "item", "value"))
    live = equal.filter("ties > need").select(*group, "item", "value", "need", "ties").withColumn("path", F.lit(""))
    at = 0
    while live.filter(F.col("ties") > SORTED).limit(1).count():
        step = F.hex(F.substring(F.encode("item", "UTF-8"), at * BYTES + 1, BYTES))
        live = materialize(live.withColumn("step", F.when(F.col("ties") > SORTED, step).otherwise("")), "ties")  # those with few are left as they are
        bins = live.groupBy(*group, F.col("step").alias("bin")).agg(F.count("*").alias("n"), F.max("need").alias("need"))
        cut = _kth(bins, group, F.asc("bin")).join(sizes, group)
        cut = spread_join(live.drop("need", "ties"), cut, group, "size", total)
        chosen = chosen.unionByName(cut.filter("step < bin or (step = bin and ties = need)").select(*group, "item", "value"))
        live = materialize(cut.filter("step = bin and ties > need").select(*group, "item", "value", "need", "ties", "path"), "ties")
        at += 1
    few = live.withColumn("place", F.row_number().over(W.Window.partitionBy(*group).orderBy("item"))).filter("place <= need")  # SORTED rows a group at most
    chosen = chosen.unionByName(few.select(*group, "item", "value"))
    return chosen.select("*", F.row_number().over(W.Window.partitionBy(*group).orderBy(F.desc("value"), "item")).alias("rank"))  # k rows a group


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """RESULT: for each group its distances to the language's other sources and the terms that stand out in it."""
    groups, terms = profiles(docs, min_docs)
    groups = materialize(groups, "profiles")
    pairs = divergence(groups, terms)
    ranked = pairs.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    above = materialize(terms.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "above")
    best = top_k(above, ["lang", "source"], ranks)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return ranked.select(columns("pair")).unionByName(best.select(columns("term")))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT r, lang, source, unnest(w) AS t FROM d
), kept AS (SELECT lang, t, count(*) AS n FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= {MIN_DOCS}
), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, t, count(*) AS n FROM o SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t
), gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (coalesce(gn.n, 0) + {ADDED} * v.v) AS p, 1 + ({SCALE}::HUGEINT * (k.n + {ADDED})) // (v.n + {ADDED} * v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t
), far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
), pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS f FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), told AS (
  SELECT lang, source, 'pair' AS part, item, f, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, item) AS k FROM pairs
  UNION ALL
  SELECT lang, source, 'term', t, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, t) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM told WHERE part = 'pair' OR k <= {RANKS}
"""
