"""What the pages of a usage ledger show: splits, tables, bars, cost groups, panels, reports.

Inputs are daily points, series or breakdowns, a few thousand rows for a year of any ledger. Windows without a key run over
such rows only, never over records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.functions import formats
from ledgerloom.operators import context, usage
from ledgerloom.operators.report import NAMELESS
from ledgerloom.operators.usage import Filters

#: The categories of tokens, and the exact and estimated parts of a context.
CATEGORIES = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
CONTEXT = ("messages", "system", "reasoning", "toolcalls", "agents", "mcp", "skills")


def _whole() -> W.WindowSpec:
    return W.Window.partitionBy(F.lit(0))


def model_split(points: DataFrame) -> DataFrame:
    """(model, tokens, sources): each model's tokens with all sources that used it; null stands for unattributed usage."""
    return points.groupBy("model").agg(F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("sources"))


def category_totals(series: DataFrame) -> DataFrame:
    """(source, input, output, cache_read, cache_write, tokens) over a window's series."""
    sums = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens"}
    return series.groupBy("source").agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.sum(F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).alias("cache_write"), F.sum("tokens").alias("tokens"))


def daily_rows(series: DataFrame) -> DataFrame:
    """(label, total, input, output, cached, reasoning, convs) of each day; a session belongs to one source, so sessions add up."""
    return series.groupBy(F.substring("bucket", 1, 10).alias("label")).agg(
        F.sum("tokens").alias("total"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("cache_read_tokens").alias("cached"), F.sum("reasoning").alias("reasoning"), F.sum("convs").alias("convs")
    )


def table_order(rows: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Rows with `place` in a table sorted by a column, where unknown numbers count as -1; ties go by the label."""
    value = F.coalesce(F.col(column), F.lit(-1)) if column != "label" else F.col(column)
    return rows.withColumn("place", F.row_number().over(_whole().orderBy(value.desc() if descending else value.asc(), "label")))


def model_bars(models: DataFrame) -> DataFrame:
    """A model breakdown with each row's share of its source (null where a row is larger than its source, which tells that
    the two are of different windows) and the fractions of its categories."""
    whole = F.sum("total_tokens").over(W.Window.partitionBy("source"))
    own = F.greatest(F.lit(1), F.col("total_tokens"))
    return models.select("key", "source", "total_tokens", "cost", "cache_estimated", F.when((whole > 0) & (F.col("total_tokens") <= whole), F.col("total_tokens") / whole).alias("share"), *[(F.col(c) / own).alias(f"{c}_part") for c in CATEGORIES])


def skill_bars(skills: DataFrame, top: int = 10) -> DataFrame:
    """(source, place, name, tokens, uses, rest): each source's heaviest skills, the others as one row that says how many."""
    ranked = skills.withColumn("rn", F.row_number().over(W.Window.partitionBy("source").orderBy(F.desc("est_tokens"), "name")))
    more = F.col("rn") > top
    return ranked.groupBy("source", F.least("rn", F.lit(top + 1)).alias("place"), F.when(more, "").otherwise(F.col("name")).alias("name")).agg(
        F.sum("est_tokens").alias("tokens"), F.sum("uses").alias("uses"), F.sum(F.when(more, 1).otherwise(0)).alias("rest")
    )


def bucket_view(buckets: DataFrame) -> DataFrame:
    """Context buckets with messages (history, new input and response) and the total."""
    messages = F.col("history") + F.col("new_input") + F.col("response")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return buckets.withColumn("messages", messages).withColumn("total", messages + zero("system") + zero("reasoning"))


def kinds_of(resources: DataFrame, kinds: tuple[str, ...] = ("skill", "mcp_server", "agent", "memory_file")) -> DataFrame:
    """(source, meta): how many resources of each kind a source had, as words, in the order of kinds."""
    counts = resources.groupBy("source", "kind").agg(F.count("*").alias("n")).filter(F.col("kind").isin(*kinds))
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    words = F.concat_ws(" ", F.col("n").cast("string"), F.concat(F.replace("kind", F.lit("_"), F.lit(" ")), F.when(F.col("n") == 1, "").otherwise("s")))
    gathered = counts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), words.alias("words")))).alias("w"))
    return gathered.select("source", F.array_join(F.transform("w", lambda x: x["words"]), " · ").alias("meta"))


def source_totals(ledger: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(source, billed, reused, CONTEXT): what was billed as input, what of it was read from a cache, and the sums of the parts
    of a context, null where nothing says."""
    write = F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")
    return filters.apply(ledger).groupBy("source").agg(
        F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + write).alias("billed"), F.sum("cache_read_tokens").alias("reused"), *[F.sum(f"ctx_{c}").alias(c) for c in CONTEXT]
    )


def exec_facets(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """rows(source, kind, exe, cmd, est_tokens, calls), totals(source, bash): (source, facet, key, tokens, calls) by kind, by
    executable and by command, each facet sharing out a source's Bash tokens. One pass by grouping sets."""
    sets = rows.groupingSets([["source", "kind"], ["source", "exe"], ["source", "cmd"]], "source", "kind", "exe", "cmd")
    sums = sets.agg(F.sum("est_tokens").alias("w"), F.sum("calls").alias("calls"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "kind").when(F.col("g") == 5, "exe").otherwise("cmd")
    keyed = sums.select("source", facet.alias("facet"), F.coalesce("kind", "exe", "cmd").alias("key"), "w", "calls").join(totals, "source")
    return context.allocate(keyed, ["source", "facet"], "key", "w", "bash", "tokens").select("source", "facet", "key", "tokens", "calls")


def exec_signatures(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """(source, exe, cmd, tokens, calls): one row for each command; its executable goes with it."""
    sums = rows.groupBy("source", "cmd").agg(F.min("exe").alias("exe"), F.sum("est_tokens").alias("w"), F.sum("calls").alias("calls"))
    return context.allocate(sums.join(totals, "source"), ["source"], "cmd", "w", "bash", "tokens").select("source", "exe", "cmd", "tokens", "calls")


def cost_groups(models: DataFrame) -> DataFrame:
    """A model breakdown as a list by source: (place, source, group_cost, unpriced, unattributed, spot, model, cost). Known
    costs come first, the largest first, then names; a source's cost leaves out unattributed usage and unpriced models."""
    named = F.col("key").isNotNull()
    per = W.Window.partitionBy("source")
    rows = models.withColumn("group_cost", F.sum(F.when(named, F.col("cost"))).over(per)).withColumn("unpriced", F.sum(F.when(named & F.col("cost").isNull(), 1).otherwise(0)).over(per))
    rows = rows.withColumn("unattributed", F.sum(F.when(~named, F.col("unattributed_tokens")).otherwise(0)).over(per)).withColumn("model", F.coalesce("key", F.lit(NAMELESS)))
    rows = rows.withColumn("spot", F.row_number().over(per.orderBy(F.desc_nulls_last("cost"), "model"))).withColumn("place", F.dense_rank().over(_whole().orderBy(F.desc_nulls_last("group_cost"), "source")))
    return rows.select("place", "source", "group_cost", "unpriced", "unattributed", "spot", "model", "cost", "cache_estimated")


def source_cost_label(cost: Column, unpriced: Column, unattributed: Column, shown: Column) -> Column:
    """A source's cost as text (`shown`), marked as a lower bound and with what it leaves out."""
    nameless = F.when(unattributed > 0, NAMELESS)
    without = F.concat_ws(" · ", F.when((unpriced > 0) | (unattributed == 0), "unpriced").otherwise("unavailable"), nameless)
    left_out = F.concat_ws(" · ", F.when(unpriced > 0, F.concat(unpriced.cast("string"), F.lit(" unpriced"))), nameless)
    return F.when(cost.isNull(), without).when(left_out == "", shown).otherwise(F.concat(F.lit(formats.AT_LEAST), shown, F.lit(" · "), left_out))


def report_times(series: DataFrame) -> DataFrame:
    """A series over all sources as a report shows it; a cost of zero beside unpriced usage is unknown."""
    sums = series.groupBy(F.col("bucket").alias("key")).agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")], F.sum(F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).alias("cache_write_tokens"), F.sum("tokens").alias("total_tokens"),
        F.sum("convs").alias("sessions"), F.sum("cost").alias("cost"), F.bool_or("has_unpriced").alias("has_unpriced"), F.bool_or("cache_estimated").alias("cache_estimated"), F.sum("unattributed_tokens").alias("unattributed_tokens"),
    )
    return sums.withColumn("cost", F.when(~(F.col("has_unpriced") & (F.col("cost") == 0)), F.col("cost")))


def panel_chart(series: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(bucket), all buckets of a period -> (bucket, position, cost, tokens, height, is_peak, tick): heights are parts of the
    peak, which is the earliest of equals; the first, middle and last bucket carry a tick. No rows where nothing cost."""
    sums = series.groupBy("bucket").agg(F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"))
    rows = keys.join(sums, "bucket", "left").select("bucket", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    rows = rows.withColumn("position", F.row_number().over(_whole().orderBy("bucket")) - 1).withColumn("n", F.count("*").over(_whole())).withColumn("most", F.max("cost").over(_whole()))
    peak = F.row_number().over(_whole().orderBy(F.desc("cost"), "bucket")) == 1
    tick = (F.col("position") == 0) | (F.col("position") == F.expr("(n - 1) div 2")) | (F.col("position") == F.col("n") - 1)
    label = F.when(F.col("bucket").contains(" "), F.substring("bucket", 12, 5)).otherwise(F.substring("bucket", 6, 5))
    return rows.filter("most > 0").select("bucket", "position", "cost", "tokens", (F.col("cost") / F.col("most")).alias("height"), peak.alias("is_peak"), F.when(tick, label).alias("tick"))


def panel_rows(now: DataFrame, before: DataFrame, parts: DataFrame, top: int = 5) -> DataFrame:
    """now and before: summaries of two windows; parts: a breakdown. (delta, place, key, source, tokens, cost, share, overflow):
    the change of cost in percent (null where either is unknown or there was none) beside the `top` rows that cost most."""
    both = now.select(F.col("cost").alias("c"), F.col("total_tokens").alias("t")).join(F.broadcast(before.select(F.col("cost").alias("b"))))  # one row each
    delta = F.when((F.col("t") > 0) & (F.col("b") > 0), (F.col("c") / F.col("b") - 1) * 100)
    used = parts.filter("total_tokens > 0").withColumn("place", F.row_number().over(_whole().orderBy(F.desc_nulls_last("cost"), F.desc("total_tokens"), "key", "source")))
    used = used.withColumn("priced", F.sum("cost").over(_whole())).withColumn("overflow", F.greatest(F.lit(0), F.count("*").over(_whole()) - top)).filter(F.col("place") <= top)
    share = F.when(F.col("priced") > 0, F.coalesce("cost", F.lit(0)) / F.col("priced")).otherwise(0.0)
    return used.join(F.broadcast(both.select(delta.alias("delta")))).select("delta", "place", "key", "source", F.col("total_tokens").alias("tokens"), "cost", share.alias("share"), "overflow")


def in_catalog_order(rows: DataFrame, catalog: list[str]) -> DataFrame:
    """rows(source, tokens) of sources that were used, with `place`: sources of the catalog in its order, others behind by name."""
    at = F.array_position(F.array(*[F.lit(c) for c in catalog]), F.col("source"))
    used = rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    return used.withColumn("place", F.row_number().over(_whole().orderBy(F.when(at > 0, at).otherwise(len(catalog) + 1), "source")))


def stacked(points: DataFrame, catalog: list[str]) -> DataFrame:
    """(model, source, tokens, rank, place): models by size, and as a stacked bar holds them, by their source's place in the
    catalog and then by size. A model's source is the one that used it last."""
    sums = points.filter("model is not null").groupBy("model").agg(F.sum("tokens").alias("tokens"), F.max_by("source", F.struct("bucket", "source")).alias("source")).filter("tokens > 0")
    at = F.array_position(F.array(*[F.lit(c) for c in catalog]), F.col("source"))
    size = [F.desc("tokens"), F.col("model")]
    return sums.withColumn("rank", F.row_number().over(_whole().orderBy(*size))).withColumn("place", F.row_number().over(_whole().orderBy(F.when(at > 0, at).otherwise(len(catalog) + 1), *size)))


def window_parts(ledger: DataFrame, rates: DataFrame, filters: Filters = Filters(), tz: str = "UTC") -> DataFrame:
    """The window bundle: the summary and the three breakdowns in one table, named by `part`."""
    columns = ["key", "source", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "requests", "cost", "has_unpriced", "unattributed_tokens", "convs"]
    rate = F.when(F.col("paid") > 0, F.col("cache_read_tokens") / F.col("paid")).otherwise(0.0).alias("cache_hit_rate")
    none = F.lit(None).cast("string")
    parts = [("summary", usage.summary(ledger, rates, filters, tz).withColumn("key", none).withColumn("source", none)), *((by, usage.breakdown(ledger, rates, by, filters, tz)) for by in ("model", "project", "tool"))]
    out = None
    for name, part in parts:
        rows = part.select(F.lit(name).alias("part"), *columns).withColumn("paid", F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")).select("part", *columns, rate)
        out = rows if out is None else out.unionByName(rows)
    return out


def csv_cell(value: Column) -> Column:
    """A field as CSV: quoted where it holds a comma, a quote or an end of line; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_block(rows: DataFrame, block: int, columns: dict[str, Column], order: list[Column]) -> DataFrame:
    """(block, line, text): a block of a sectioned report, its header at line 0; no lines where there are no rows."""
    cells = F.array_join(F.array(*[csv_cell(c) for c in columns.values()]), ",")
    lines = rows.select(F.row_number().over(_whole().orderBy(*order)).alias("line"), cells.alias("text"))
    header = lines.filter("line = 1").select(F.lit(0).alias("line"), F.lit(",".join(columns)).alias("text"))
    return header.unionByName(lines).select(F.lit(block).alias("block"), "line", "text")


def usage_cells(first: str, with_source: bool = False, sessions: str | None = "convs") -> dict[str, Column]:
    """The columns of a report's usage block. Unknown costs are empty, costs have six decimals, dollars."""
    paid = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    names = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens"]
    return {
        first: F.col("key"), **({"source": F.col("source")} if with_source else {}), **{n: F.col(n) for n in names}, **({"sessions": F.col(sessions)} if sessions else {}),
        "cache_hit_rate": formats.fixed(F.when(paid > 0, F.col("cache_read_tokens") / paid).otherwise(0.0), 4), "cost_usd": formats.fixed(F.col("cost") / 1e9, 6),
        "cost_basis": formats.cost_basis(F.col("cost"), F.col("has_unpriced"), F.col("unattributed_tokens")), "unattributed_tokens": F.col("unattributed_tokens"), "cache_estimated": F.col("cache_estimated"),
    }


def report_lines(ledger: DataFrame, rates: DataFrame, filters: Filters = Filters(), tz: str = "UTC") -> DataFrame:
    """(block, line, text): a window's report in sections - by day, source, model and project. The lines of a block in order,
    blocks parted by an empty line, are the file."""
    named = lambda by: usage.breakdown(ledger, rates, by, filters, tz).withColumn("key", F.coalesce("key", F.lit(NAMELESS)))
    largest = [F.desc("total_tokens"), F.col("key"), F.col("source")]
    times = report_times(usage.series(ledger, rates, filters, tz=tz))
    out = csv_block(times, 1, usage_cells("day", sessions=None), [F.col("key")])
    for number, (by, first) in enumerate((("tool", "source"), ("model", "model"), ("project", "project")), 2):
        out = out.unionByName(csv_block(named(by), number, usage_cells(first, by == "model"), largest))
    return out


def bucket_csv(points: DataFrame) -> DataFrame:
    """(bucket, line, text): each bucket's models as CSV lines, largest first, with their shares of the models' total."""
    sums = points.filter("model is not null").groupBy("bucket", "model").agg(F.sum("tokens").alias("tokens"), F.max("source").alias("source")).filter("tokens > 0")
    whole = F.sum("tokens").over(W.Window.partitionBy("bucket"))
    rows = sums.withColumn("share", formats.fixed(F.col("tokens") / whole, 4))
    text = F.array_join(F.array(*[csv_cell(F.col(c)) for c in ("model", "source", "tokens", "share")]), ",")
    return rows.select("bucket", F.row_number().over(W.Window.partitionBy("bucket").orderBy(F.desc("tokens"), "model")).alias("line"), text.alias("text"))
