"""The price catalog: which published rate a model gets, and how the pricing table shows it.

A catalog is a few thousand rows whatever the ledger holds, so its windows and joins are small; the ledger itself is only
ever read for its distinct models. Rates are null where a catalog says nothing; 0 stands for that once rates are published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.operators.usage import RATES, normalize_model

#: Publishers as the first catalog names them, the one that wins a collision first.
PUBLISHERS = ("anthropic", "openai", "gemini", "vertex_ai-language-models", "zai", "deepseek", "minimax", "xai", "mistral", "cohere", "ai21", "moonshot")
NO_PUBLISHER = 99
#: Names of the two catalogs, and how the pricing table labels them.
LISTED, ROUTED = "litellm", "openrouter"
LABELS = {LISTED: "LiteLLM", ROUTED: "OpenRouter"}


def publisher_rank(provider: Column) -> Column:
    out = F.lit(NO_PUBLISHER)
    for rank, name in enumerate(PUBLISHERS):
        out = F.when(provider == name, rank).otherwise(out)
    return out


def number_field(entry: Column, field: str) -> Column:
    """A rate that the first catalog gives as a JSON number; strings and nulls are no rates."""
    value = F.try_variant_get(entry, f"$.{field}", "double")
    return F.when(F.schema_of_variant(F.try_variant_get(entry, f"$.{field}", "variant")).rlike("^(DECIMAL|DOUBLE|FLOAT|BIGINT)"), value)


def positive_text(value: Column) -> Column:
    """A rate that the second catalog gives as a decimal string: only one above zero is a rate."""
    rate = value.try_cast("double")
    return F.when(rate > 0, rate)


def routed_rows(payload: DataFrame) -> DataFrame:
    """payload(id, pricing struct of strings, seq) -> (model, RATES, seq) of ids with a vendor and any price for input or output."""
    names = dict(zip(RATES, ("prompt", "completion", "input_cache_read", "input_cache_write", "input_cache_write_1h"), strict=True))
    rows = payload.filter(F.col("id").contains("/")).select(F.col("id").alias("model"), *[positive_text(F.col(f"pricing.{p}")).alias(r) for r, p in names.items()], "seq")
    return rows.filter("input is not null or output is not null")


def publisher_rows(listings: DataFrame) -> DataFrame:
    """listings(id, endpoints array<struct<tag, provider_name, pricing>>, seq) -> (model, publisher, RATES, seq): of each
    model's hosts the first whose tag names the model's own vendor and that has a price."""
    vendor = F.substring_index("id", "/", 1)
    names = dict(zip(RATES, ("prompt", "completion", "input_cache_read", "input_cache_write", "input_cache_write_1h"), strict=True))
    own = F.filter("endpoints", lambda e: (F.substring_index(e["tag"], "/", 1) == vendor) & (positive_text(e["pricing"]["prompt"]).isNotNull() | positive_text(e["pricing"]["completion"]).isNotNull()))
    rows = listings.select("id", F.get(own, F.lit(0)).alias("e"), vendor.alias("vendor"), "seq").filter("e is not null")
    return rows.select(F.col("id").alias("model"), F.coalesce("e.provider_name", "vendor").alias("publisher"), *[positive_text(F.col(f"e.pricing.{p}")).alias(r) for r, p in names.items()], "seq")


def merged_by_name(listed: DataFrame) -> DataFrame:
    """listed(model, rank, RATES) -> (model in normal form, best, RATES). Of the keys that share a normal form, in the order
    of the keys, one that outranks all before it takes their place and keeps what it lacks from them; the others fill gaps."""
    rows = listed.withColumn("name", normalize_model(F.col("model")))
    before = W.Window.partitionBy("name").orderBy("model").rowsBetween(W.Window.unboundedPreceding, -1)
    wins = F.coalesce(F.col("rank") < F.min("rank").over(before), F.lit(True))
    order = F.struct(F.when(wins, F.col("rank")).otherwise(NO_PUBLISHER + 1).alias("place"), F.col("model").alias("key"))
    known = lambda r: F.min_by(r, F.when(F.col(r).isNotNull(), F.col("order"))).alias(r)
    return rows.withColumn("order", order).groupBy("name").agg(F.min("rank").alias("best"), *map(known, RATES)).withColumnRenamed("name", "model")


def filled_publishers(published: DataFrame, listed: DataFrame, merged: DataFrame) -> DataFrame:
    """Rates that a publisher leaves out, from the catalog's row of the same key, else of the same normal form."""
    exact = listed.select(F.col("model").alias("e_model"), *[F.col(r).alias(f"e_{r}") for r in RATES])
    loose = merged.select(F.col("model").alias("m_model"), *[F.col(r).alias(f"m_{r}") for r in RATES])
    rows = published.join(exact, F.col("model") == F.col("e_model"), "left").join(loose, normalize_model(F.col("model")) == F.col("m_model"), "left")
    found = F.col("e_model").isNotNull()
    return rows.select("model", "publisher", "seq", *[F.coalesce(r, F.when(found, F.col(f"e_{r}")).otherwise(F.col(f"m_{r}"))).alias(r) for r in RATES])


def published_rates(listed: DataFrame, routed: DataFrame, publishers: DataFrame) -> DataFrame:
    """(model, RATES, catalog): every key that a model can be priced by. listed(model, provider, RATES) is the first catalog,
    routed(model, RATES, seq) the second, publishers(model, publisher, RATES, seq) what publishers quote themselves. A
    publisher's rate goes before the first catalog's, that before the second's, and in each the key before its normal form;
    a key of the first catalog yields to a better publisher's row of the same normal form."""
    listed = listed.filter("input is not null or output is not null").withColumn("rank", publisher_rank(F.coalesce("provider", F.lit(""))))
    merged = merged_by_name(listed)
    own = filled_publishers(publishers, listed, merged)
    better = merged.select(F.col("model").alias("b_model"), F.col("best").alias("b_best"))
    kept = listed.join(better, (F.col("model") == F.col("b_model")) & (F.col("b_best") < F.col("rank")), "left_anti")

    def turn(rows: DataFrame, number: int, catalog: Column, seq: Column, loose: bool = False) -> DataFrame:
        return rows.select((normalize_model(F.col("model")) if loose else F.col("model")).alias("model"), F.lit(number).alias("turn"), seq.cast("long").alias("seq"), catalog.alias("catalog"), *RATES)

    none = F.lit(0)
    turns = [turn(own, 1, F.col("publisher"), F.col("seq")), turn(own, 2, F.col("publisher"), F.col("seq"), True), turn(kept, 3, F.lit(LISTED), none), turn(merged, 4, F.lit(LISTED), none), turn(routed, 5, F.lit(ROUTED), F.col("seq")), turn(routed, 6, F.lit(ROUTED), F.col("seq"), True)]
    every = turns[0]
    for t in turns[1:]:
        every = every.unionByName(t)
    first = every.groupBy("model").agg(F.min_by(F.struct("catalog", *RATES), F.struct("turn", "seq")).alias("r")).select("model", "r.*")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.select("model", zero("input").alias("input"), zero("output").alias("output"), zero("cache_read").alias("cache_read"), zero("cache_write_5m").alias("cache_write_5m"), F.coalesce("cache_write_1h", "cache_write_5m", F.lit(0)).alias("cache_write_1h"), "catalog")


def lookup_targets(models: DataFrame, ids: DataFrame) -> DataFrame:
    """models(model), ids(id) -> (model, id): the id that is the model's name, else one of the same normal form (the last)."""
    asked = models.filter("model is not null").select("model").distinct()
    loose = ids.groupBy(normalize_model(F.col("id")).alias("name")).agg(F.max("id").alias("loose"))
    rows = asked.join(ids.select(F.col("id").alias("exact")).distinct(), F.col("model") == F.col("exact"), "left").join(loose, normalize_model(F.col("model")) == F.col("name"), "left")
    return rows.select("model", F.coalesce("exact", "loose").alias("id")).filter("id is not null")


def reads_due(targets: DataFrame, cached: DataFrame, now: int, max_age: int, ceiling: int) -> DataFrame:
    """targets(id), cached(id, fetched_at): the ids that were never read or are older than max_age seconds, the oldest first,
    at most `ceiling` of them (that many a refresh is the feature)."""
    rows = targets.select("id").distinct().join(cached, "id", "left").filter((F.col("fetched_at").isNull()) | (F.lit(now) - F.col("fetched_at") >= max_age))
    return rows.orderBy(F.asc_nulls_first("fetched_at"), "id").limit(ceiling)


def needing_lookup(models: DataFrame, resolved: DataFrame, attempted: DataFrame) -> DataFrame:
    """Models without a rate that no refresh has asked for."""
    asked = models.filter("model is not null").select("model").distinct()
    return asked.join(resolved.select("model"), "model", "left_anti").join(attempted.select("model"), "model", "left_anti")


def origin_label(origin: Column) -> Column:
    out = origin
    for name, label in LABELS.items():
        out = F.when(origin == name, label).otherwise(out)
    return out


def shown(models: DataFrame) -> DataFrame:
    """models(model, source, input, output, cache_read, cache_write, origin, overridden), rates null where absent -> with state,
    overall rate, whether it is a routed rate, and the label of its origin."""
    rates = ("input", "output", "cache_read", "cache_write")
    some = F.coalesce(*rates).isNotNull()
    overall = F.when(some, sum((F.coalesce(r, F.lit(0)) for r in rates[1:]), F.coalesce(rates[0], F.lit(0))))
    gap = F.col("input").isNotNull() & F.col("output").isNotNull() & (F.col("cache_read").isNull() | F.col("cache_write").isNull())
    state = F.when(F.col("overridden"), "override").when(F.col("origin").isNull(), "unpriced").when(gap, "est").otherwise("ok")
    return models.withColumn("state", state).withColumn("overall", overall).withColumn("routed", ~F.col("overridden") & F.coalesce(F.col("origin") == ROUTED, F.lit(False))).withColumn("label", origin_label(F.col("origin")))


def search(models: DataFrame, text: str = "", state: str = "all") -> DataFrame:
    """`shown` rows whose model or source holds the text, in any case, and that are in the state."""
    q = text.strip().lower()
    rows = models if state == "all" else models.filter(F.col("state") == state)
    return rows.filter(F.lower("model").contains(q) | F.lower("source").contains(q)) if q else rows


def chips(models: DataFrame) -> DataFrame:
    """How many models there are, and in each state that has a chip."""
    return models.agg(F.count("*").alias("all"), *[F.count_if(F.col("state") == s).alias(s) for s in ("unpriced", "override", "est")])


def natural_key(name: Column) -> Column:
    """A key by which names sort with their numbers as numbers: digits padded to ten."""
    padded = F.transform(F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)")), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 10, "0")).otherwise(p))
    return F.array_join(padded, "")


def ordered(models: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """`shown` rows with `place`, their place in the table: models without the price come last in both directions, ties go
    to the newest name. column: model, source (the rate's origin), overall or a rate."""
    newest = F.desc(natural_key(F.col("model")))
    turn = F.desc if descending else F.asc
    if column == "model":
        order = [turn(natural_key(F.col("model")))]
    elif column == "source":
        tier = F.when(F.col("state") == "unpriced", 2).when(F.col("state") == "override", 1).otherwise(0)
        order = [turn(tier), turn(F.when(tier == 0, F.lower("label")).otherwise("")), newest]
    else:
        order = [F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), newest]
    return models.withColumn("place", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy(*order)))  # a table of models


def frozen(observed: DataFrame) -> DataFrame:
    """observed(model, day, priced, RATES): what a model's price was found to be on each day -> (model, day, priced, RATES) as the daily
    freeze leaves them: a day's own price stays; a day without one takes the first later price, and keeps it."""
    later = W.Window.partitionBy("model").orderBy("day").rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing)
    held = F.first(F.when(F.col("priced"), F.struct(*RATES)), ignorenulls=True).over(later)
    return observed.withColumn("held", held).select("model", "day", F.col("held").isNotNull().alias("priced"), *[F.coalesce(F.col(f"held.{r}"), F.lit(0)).alias(r) for r in RATES])


def freeze_price(spark: SparkSession, table: str, current: DataFrame, day: str, model: str) -> None:
    """Write a day's price of one model, once or again, to the history at `table`, partitioned by day: current(model, RATES) is what
    resolves now. If there is a price, earlier days without one take it; no other day is ever changed."""
    rates = current.filter(F.col("model") == model).select(*RATES).head(1)  # one row
    now = tuple(rates[0]) if rates else (0,) * len(RATES)
    schema = "model string, day string, priced boolean, " + ", ".join(f"{r} {current.schema[r].dataType.simpleString()}" for r in RATES)
    rows = [(model, day, bool(rates), *now)]
    if rates and _exists(spark, table):
        known = spark.read.schema(schema).parquet(table).filter((F.col("model") == model) & ~F.col("priced") & (F.col("day") < day))
        rows += [(model, r.day, True, *now) for r in known.select("day").collect()]  # at most a row a day
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "day").parquet(table)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
