"""Where the context went: exact usage buckets, tool weights, and whole-number shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.operators.usage import Filters


def first_cache_writes(ledger: DataFrame) -> DataFrame:
    """(source, session_id, timestamp, dedup_key) of each session's first cache write, over the whole ledger. Hermes
    records stand for whole sessions, so they have none."""
    writes = ledger.filter("cache_write_5m_tokens + cache_write_1h_tokens > 0 and session_id is not null and source <> 'hermes'")
    first = writes.groupBy("source", "session_id").agg(F.min(F.struct("timestamp", "dedup_key")).alias("f"))
    return first.select(F.col("source").alias("f_source"), F.col("session_id").alias("f_session"), F.col("f.timestamp").alias("f_time"), F.col("f.dedup_key").alias("f_key"))


def buckets(ledger: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(source, history, new_input, system, response, reasoning)."""
    write = F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")
    rows = filters.apply(ledger).join(
        first_cache_writes(ledger), (F.col("source") == F.col("f_source")) & (F.col("session_id") == F.col("f_session")) & (F.col("timestamp") == F.col("f_time")) & (F.col("dedup_key") == F.col("f_key")), "left"
    )
    first = F.col("f_key").isNotNull()
    return rows.groupBy("source").agg(
        (F.sum("cache_read_tokens") + F.sum(F.when(~first & (write > 0), write).otherwise(0))).alias("history"),
        F.sum("input_tokens").alias("new_input"),
        F.sum(F.when(first, write)).alias("system"),
        F.greatest(F.sum("output_tokens") - F.coalesce(F.sum("reasoning_tokens"), F.lit(0)), F.lit(0)).alias("response"),
        F.sum("reasoning_tokens").alias("reasoning"),
    )


def tool_weights(rows: DataFrame, keys: list[str], filters: Filters = Filters(), count: str = "calls") -> DataFrame:
    """Sums of est_tokens and of a count over stored (keys, day) rows."""
    return filters.apply_days(rows).groupBy(*keys).agg(F.sum("est_tokens").alias("est_tokens"), F.sum(count).alias(count))


def resources(rows: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return filters.apply_days(rows).select("source", "kind", "name").distinct()


def allocate(rows: DataFrame, group: list[str], key: str, weight: str, total: str, out: str) -> DataFrame:
    """Largest-remainder shares of `total` (one value a group) among the rows of a group, by weight; remainders are
    whole numbers, ties go to the smaller key. Negative weights count as none; nothing to share gives zeros."""
    whole, w = W.Window.partitionBy(*group) if group else W.Window.partitionBy(F.lit(0)), F.greatest(F.col(weight), F.lit(0))
    weighed = rows.withColumn("__w", w).withColumn("__sum", F.sum("__w").over(whole))
    some = (F.col("__sum") > 0) & (F.col(total) > 0)
    weighed = weighed.withColumn("__base", F.when(some, F.expr(f"({total} * __w) div __sum")).otherwise(0)).withColumn("__rem", F.when(some, (F.col(total) * F.col("__w")) % F.col("__sum")).otherwise(0))
    ranked = weighed.withColumn("__left", F.when(some, F.col(total) - F.sum("__base").over(whole)).otherwise(0)).withColumn("__rank", F.row_number().over(whole.orderBy(F.desc("__rem"), key)))
    return ranked.withColumn(out, (F.col("__base") + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0)).cast("long")).drop("__w", "__sum", "__base", "__rem", "__left", "__rank")


def tool_category(name: Column) -> Column:
    return (
        F.when(name.rlike("^(Read|Write|Edit|Glob)$"), "File Ops").when(name == "Grep", "Search").when(name == "Bash", "Execution")
        .when(name.rlike("^Web(Fetch|Search)$"), "Web").when(mcp_server(name) != "", F.concat(F.lit("MCP: "), mcp_server(name))).when(name == "Skill", "Skill").otherwise("Other")
    )


def mcp_server(name: Column) -> Column:
    """The server of a tool called mcp__server__tool, else the empty string."""
    return F.when(name.startswith("mcp__"), F.coalesce(F.get(F.split(name, "__"), F.lit(1)), F.lit(""))).otherwise("")


def tool_tree(rows: DataFrame) -> DataFrame:
    """rows(source, name, est_tokens, calls, toolcalls): shares of a source's `toolcalls` by category and by tool."""
    named = rows.withColumn("category", tool_category(F.col("name")))
    cats = allocate(named.groupBy("source", "category").agg(F.sum("est_tokens").alias("w"), F.max("toolcalls").alias("t")), ["source"], "category", "w", "t", "category_tokens")
    leaves = named.join(cats.select("source", "category", "category_tokens"), ["source", "category"])
    return allocate(leaves, ["source", "category"], "name", "est_tokens", "category_tokens", "tokens").select("source", "category", "category_tokens", "name", "tokens", "calls")


def attribute(billed: str, parts: list[str]) -> list[Column]:
    """Exact shares of a billed count: each part's whole-number share, and the remainder on the first."""
    whole = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    shares = [F.when(whole > 0, F.expr(f"({billed} * {p}) div ({' + '.join(parts)})")).otherwise(0) for p in parts[1:]]
    return [(F.col(billed) - sum(shares[1:], shares[0])).alias(f"{parts[0]}_share"), *[s.alias(f"{p}_share") for s, p in zip(shares, parts[1:], strict=True)]]
