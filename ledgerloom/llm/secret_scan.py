"""Secret scans in DataFrame and SQL expressions only.

Named patterns (assign, access, hex) give the base spans. The entropy scan adds spans: candidate strings are
runs of token characters; a window slides over each, its counts by character and the sum of c*log2(c) over them
are carried from step to step, changed by the one character that enters and the one that leaves.
A candidate is a secret if its best window reaches the entropy asked of its character class (hex digits,
one letter case with digits, both cases with digits) and no allow-list entry suppresses it. Parts that tell an
example (words like "sample" at either end of a part) are cut out first, so that what stands beside them is still judged,
and so are base spans. A candidate without a digit is none.

Positions come from one pass of a pattern: the pieces between matches and the matches themselves, summed
lengths in code points. Edge cases: null and empty texts have no spans. Repeated rows are scanned one by one.
Overlapping kinds are all reported; an entropy span that overlaps a base span is not added. Ties in start are
ordered by kind, in the order of KINDS. Extra columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, text_or_empty, whole_row

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, the first that fits counts: name, pattern of the whole candidate, least bits a character.
CLASSES = (
    ("hex", r"^(?=.*[0-9])[0-9a-fA-F]+$", 2.805),
    ("one_case", r"^(?=.*[0-9].*[0-9])(?:[a-z0-9+/_=-]+|[A-Z0-9+/_=-]+)$", 3.405),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.605),
)
#: Candidates that match one of these are known not to be secrets.
ALLOWED = (
    r"^[0-9]{8}-[0-9-]+$|^[0-9+/_=-]+$",  # dates, phone and card numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[A-Za-z]+(?:[+/_=-]+[A-Za-z]*)*[0-9]{0,4}$",  # words, paths and names, with a short number at the end
    r"^(?:[A-Za-z]*[0-9]{0,4}[/_-])+[A-Za-z]*[0-9]{0,4}$",  # paths and slugs
)
#: Parts of a candidate that begin or end with one of these words are no secrets, whatever else they hold.
_WORDS = "(?:example|sample|placeholder|dummy|changeme|your|x{4,}|test|lorem)"
EXAMPLES = rf"(?i)(?<![A-Za-z0-9])(?:{_WORDS}[A-Za-z0-9]*|[A-Za-z0-9]*{_WORDS})(?![A-Za-z0-9])"
#: Matches whose places are added up together.
CHUNK = 256
_SPAN = "array<struct<start:long,kind:int,end:long>>"


def _matches(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose `group` has at least `least` characters. Places are running sums of
    the lengths of gaps and matches, over chunks first, so that the work is not quadratic in the matches of a text."""
    lengths = lambda parts, name: F.transform(parts, lambda x: F.char_length(x).cast("long")).alias(name)
    pieces = [lengths(F.split(text, pattern), "gap"), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "hit")]
    if group:
        pieces.append(lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), "part"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + zero(x["hit"])
        counts = zero(x["part" if group else "hit"]) >= max(least, 1)
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(counts, F.concat(s["found"], F.array(found))).otherwise(s["found"]).alias("found"))

    def placed(zipped: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / CHUNK).cast("int")), lambda c: F.slice(zipped, c * CHUNK + 1, F.lit(CHUNK)))
        whole = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + zero(x["hit"]))
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        starts = F.aggregate(chunks, begin, lambda s, chunk: F.struct((s["at"] + whole(chunk)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        each = F.zip_with(chunks, starts, lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("found")), step, lambda s: s["found"]))
        return F.flatten(each)

    spans = F.transform(F.array(F.arrays_zip(*pieces)), placed)[0]
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(_SPAN))


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(0.0)


def best_window_bits(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any `window` characters in a row of text."""

    def put(counts: Column, c: Column, n: Column) -> Column:
        return F.map_concat(F.map_filter(counts, lambda k, _: k != c), F.create_map(c, n))

    def changed(s: Column, c: Column, by: int, ok: Column) -> Column:
        """The state with one more or one fewer of c."""
        n = F.coalesce(F.try_element_at(s["counts"], c), F.lit(0))
        new = F.struct(put(s["counts"], c, n + by).alias("counts"), (s["sum"] + _weight(n + by) - _weight(n)).alias("sum"), s["best"].alias("best"))
        return F.when(ok, new).otherwise(s)

    def step(s: Column, i: Column) -> Column:
        one = F.transform(F.array(changed(s, F.substring(text, i, F.lit(1)), 1, F.lit(True))), lambda t: changed(t, F.substring(text, i - window, F.lit(1)), -1, i > window))
        bits = lambda t: F.when(i >= window, F.log2(F.lit(float(window))) - t["sum"] / window).otherwise(0.0)
        return F.transform(one, lambda t: F.struct(t["counts"].alias("counts"), t["sum"].alias("sum"), F.greatest(t["best"], bits(t)).alias("best")))[0]

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    start = F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(text)), start, step, lambda s: s["best"])


def _is_random(part: Column) -> Column:
    needed = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        needed = F.when(F.rlike(part, F.lit(pattern)), bits).otherwise(needed)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(part, F.lit(pattern))
    some = (F.char_length(part) >= WINDOW) & F.rlike(part, F.lit("[0-9]"))
    return F.when(some, F.when(~allowed, F.coalesce(best_window_bits(part) >= needed, F.lit(False))).otherwise(False)).otherwise(False)


def is_secret(candidate: Column) -> Column:
    return F.when(F.rlike(candidate, F.lit("[0-9]")), F.exists(F.split(F.regexp_replace(candidate, EXAMPLES, " "), " +"), _is_random)).otherwise(False)


def _replaced(text: Column, hits: Column, by) -> Column:
    """text with every one of the sorted spans replaced by by(its length), overlapping ones by one."""

    def step(s: Column, x: Column) -> Column:
        start = F.greatest(x["start"], s["at"])
        between = F.substring(text, (s["at"] + 1).cast("int"), (start - s["at"]).cast("int"))
        more = F.greatest(x["end"] - start, F.lit(0)).cast("int")
        adds = F.when(x["start"] >= s["at"], F.concat(between, by(more, F.lit(True)))).otherwise(by(more, F.lit(False)))
        return F.struct(F.greatest(x["end"], s["at"]).alias("at"), F.concat(s["out"], F.array(adds)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    parts = F.aggregate(hits, start, step, lambda s: F.concat(s["out"], F.array(F.substring(text, (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))))
    return F.when(F.size(hits) > 0, F.array_join(parts, "")).otherwise(text)


def _entropy_spans(text: Column, base: Column) -> Column:
    """Random strings outside the base spans, which are blanked first."""
    rest = _replaced(text, base, lambda n, _: F.repeat(F.lit(" "), n))
    return F.transform(F.array(rest), lambda t: F.filter(_matches(t, CANDIDATE, 3), lambda x: is_secret(F.substring(t, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))))[0]


def spans(text: Column) -> Column:
    """All spans of a text: struct(base, spans), arrays of (start, kind, end) in order."""
    found = F.concat(_matches(text, ASSIGN, 0, ASSIGN_LEAST, 2), _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    both = F.transform(F.array(F.sort_array(found)), lambda base: F.struct(base.alias("base"), F.sort_array(F.concat(base, _entropy_spans(text, base))).alias("spans")))
    return both[0]


def as_text(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base and spans are arrays of (start, kind, end) in code points, the end excluded."""
    text = docs.select("doc_id", text_or_empty().alias("text"))
    return text.select("doc_id", spans(F.col("text")).alias("found")).select("doc_id", "found.base", "found.spans")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by `mark` (overlapping spans by one) and n_chars, where there is one,
    brought up to date; null texts stay null. The columns are those of docs, whatever their names."""
    found = docs.select(whole_row(docs).alias("row"), F.col("text").alias("text"), spans(text_or_empty())["spans"].alias("hits"))
    clean = found.select("row", "hits", _replaced(F.col("text"), F.col("hits"), lambda _, new: F.when(new, mark).otherwise("")).alias("text"))

    def column(name: str) -> Column:
        kept = F.col(f"row.`{name}`")
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.when(F.size("hits") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(kept).alias(name)
        return kept.alias(name)

    return clean.select(*map(column, docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
