"""Reports: folders of CSV files, with empty cells for what is unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.formats import cost_basis
from ledgerloom.operators.usage import Filters, breakdown, bucket, summary

NAMELESS = "Unattributed usage"


def rows_of(part: DataFrame) -> DataFrame:
    """A breakdown's rows as a report shows them: named, largest first, with the basis of the cost and the cache's share."""
    paid = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    shown = part.withColumn("key", F.coalesce("key", F.lit(NAMELESS))).withColumn("cost_basis", cost_basis(F.col("cost"), F.col("has_unpriced"), F.col("unattributed_tokens")))
    rate = F.when(paid > 0, F.format_string("%.4f", F.col("cache_read_tokens") / paid))
    return shown.withColumn("cache_hit_rate", rate).orderBy(F.desc("total_tokens"), "key", "source")


def by_day(ledger: DataFrame, rates: DataFrame, filters: Filters = Filters(), tz: str = "UTC") -> DataFrame:
    days = filters.apply(ledger).withColumn("project", bucket(F.col("timestamp"), tz))
    return rows_of(breakdown(days, rates, "project")).withColumnRenamed("key", "day").orderBy("day").drop("source")


def share(tokens: Column, total: Column) -> Column:
    return F.format_string("%.4f", F.when(total > 0, tokens / total).otherwise(0.0))


def write_report(ledger: DataFrame, rates: DataFrame, folder: str, filters: Filters = Filters(), tz: str = "UTC") -> dict[str, str]:
    """Five CSV folders: summary, days, models, projects and tools. Unknown costs are empty cells. Returns their paths."""
    whole = summary(ledger, rates, filters, tz)
    whole = whole.select(*[F.array_join(c, " ").alias(c) if c.endswith("_models") else F.col(c) for c in whole.columns])
    parts = {"summary": whole, "days": by_day(ledger, rates, filters, tz), **{f"{by}s": rows_of(breakdown(ledger, rates, by, filters, tz)) for by in ("model", "project", "tool")}}
    for name, part in parts.items():
        part.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in parts}
