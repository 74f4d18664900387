"""Quality rules by weak supervision, in DataFrame and SQL expressions only.

Every rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over the counts of vote
patterns (at most 3 to the power of the number of rules, whatever the corpus holds) estimates each rule's
accuracy on good and on bad documents and the share of good ones; a document is kept if its posterior
probability of being good is at least one half and the base rule does not fail it.

Edge cases: null, empty and white-space texts have no words, so the base rule fails them. Repeated rows are
judged one by one and alike. Null doc_ids keep their rows. Extra columns are ignored by `judge` and kept by
`keep_good`, whatever their names. An empty table gives an empty table. Texts are read whole; the work for one text of n words is
n log n (its three-word windows are sorted), whatever repeats in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, documents, materialize, text_or_empty, whole_row

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that for it on as with by at from this be are was "
    "de la le et les des en un une que qui du pour dans sur par au "
    "der die das und ist nicht mit von zu den ein eine "
    "el los las una por con para es se"
).split()
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
PRIOR_WEIGHT, PRIOR_SHARE = 0.2, 0.8
#: EM ends when no chance moves by more than SETTLED, or after so many rounds.
EM_ROUNDS, SETTLED = 200, 1e-6
#: Chances, before any data, that a rule votes bad, abstains or votes good on a good and on a bad document.
PRIOR_GOOD, PRIOR_BAD = (0.01, 0.19, 0.8), (0.3, 0.2, 0.5)


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    core = F.btrim(text, F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE))


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeat_words(words: Column) -> Column:
    """How many words stand in a three-word window that is found at least twice among `words`."""

    def covered(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        twice = _bind(
            F.sort_array(windows),
            lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bind(words, covered))


def features(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """doc_id (or `carried` under that name) and the counts the rules read, one row per document."""
    text = docs.select((F.col("doc_id") if carried is None else carried).alias("doc_id"), text_or_empty().alias("text"))
    parts = text.select("doc_id", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"))
    length = F.char_length
    return parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (length("text") - length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        (length("text") - length(without(F.col("text"), "!"))).cast("long").alias("n_exclaims"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long").alias("n_function_words"),
    )


#: name -> (bad, good): conditions over `features`; neither: the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 20", "n_words >= 50"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines >= 2"),
    "repeats": ("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    "capitals": ("10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    "exclaims": ("10 * n_exclaims > n_words", "33 * n_exclaims <= n_words"),
    "function_words": ("50 * n_function_words < n_words", "20 * n_function_words >= n_words"),
}

BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def vote_pattern() -> Column:
    """All votes as one number in base 3, the first rule's digit the lowest; digits are vote + 1."""
    digits = [F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) for bad, good in RULES.values()]
    return sum((d * 3**i for i, d in enumerate(digits[1:], 1)), digits[0]).cast("int")


def _log_odds(votes: Column, model: Column) -> Column:
    pair = F.zip_with(model["good"], model["bad"], lambda g, b: F.struct(g.alias("g"), b.alias("b")))
    term = F.zip_with(pair, votes, lambda m, v: F.log(F.get(m["g"], v) / F.get(m["b"], v)))
    return F.aggregate(term, F.log(model["share"] / (1 - model["share"])), lambda s, x: s + x)


def posteriors(patterns: DataFrame) -> DataFrame:
    """patterns(pattern, n), one row each -> (pattern, probability of good). EM over the chances that a rule votes
    bad, abstains or votes good on a bad and on a good document, with a weak prior by which good stays the class
    that the rules call good; everything happens in the expressions of one row."""
    k, rules = PRIOR_WEIGHT, len(RULES)
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("ps"), F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    votes = lambda p: F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), lambda r: (F.floor(p / F.pow(F.lit(3.0), r)) % 3).cast("int"))
    table = table.select(F.transform("ps", lambda p: F.struct(p["pattern"].alias("pattern"), (p["n"] / F.col("total")).alias("w"), votes(p["pattern"]).alias("v"))).alias("ps"))

    def prior(chances: tuple[float, float, float]) -> Column:
        return F.array_repeat(F.array(*[F.lit(x) for x in chances]), rules)

    def good_in(p: Column, model: Column) -> Column:
        return 1 / (1 + F.exp(-_log_odds(p["v"], model)))

    def total(qs: Column, of) -> Column:
        return F.aggregate(qs, F.lit(0.0), lambda s, x: s + of(x))

    def step(model: Column, _: Column) -> Column:
        def again(qs: Column) -> Column:
            def chances(weight, priors: tuple[float, float, float]) -> Column:
                each = lambda r, v: total(qs, lambda x: F.when(F.get(x["v"], r) == v, weight(x)).otherwise(0.0))
                mass = total(qs, weight) + k
                return F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), lambda r: F.array(*[(each(r, v) + k * priors[v]) / mass for v in range(3)]))

            share = (total(qs, lambda x: x["w"] * x["q"]) + k * PRIOR_SHARE) / (1 + k)
            new = F.struct(share.alias("share"), chances(lambda x: x["w"] * x["q"], PRIOR_GOOD).alias("good"), chances(lambda x: x["w"] * (1 - x["q"]), PRIOR_BAD).alias("bad"))
            return _bind(new, lambda m: F.struct(m["share"].alias("share"), m["good"].alias("good"), m["bad"].alias("bad"), moved(m).alias("moved")))

        def moved(new: Column) -> Column:
            apart = F.zip_with(F.flatten(F.concat(new["good"], new["bad"])), F.flatten(F.concat(model["good"], model["bad"])), lambda x, y: F.abs(x - y))
            return F.greatest(F.abs(new["share"] - model["share"]), F.array_max(apart))

        anew = _bind(F.transform("ps", lambda p: F.struct(p["w"].alias("w"), p["v"].alias("v"), good_in(p, model).alias("q"))), again)
        return F.when(model["moved"] <= SETTLED, model).otherwise(anew)

    start = F.struct(F.lit(PRIOR_SHARE).alias("share"), prior(PRIOR_GOOD).alias("good"), prior(PRIOR_BAD).alias("bad"), F.lit(1.0).alias("moved"))
    fitted = table.select("ps", F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step).alias("model"))
    return fitted.select(F.explode("ps").alias("p"), "model").select(F.col("p.pattern").alias("pattern"), good_in(F.col("p"), F.col("model")).alias("quality"))


def judge(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """features, base_failed, quality (the posterior) and kept, one row per row of docs."""
    seen = materialize(features(docs, carried).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("pattern", vote_pattern()), "rule-votes")
    quality = posteriors(seen.groupBy("pattern").agg(F.count("*").alias("n")))
    judged = seen.join(F.broadcast(quality), "pattern")  # at most 3 ** len(RULES) rows
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that `judge` keeps, with their columns; each row carries its votes, so texts are not shuffled."""
    return judge(docs, whole_row(docs)).filter("kept").select("doc_id.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
