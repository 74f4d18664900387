"""Connected components by alternating large-star and small-star passes.

Every pass is a grouped minimum (combined before the shuffle), written as a table, and a join back on the node:
both sides of the join are shuffles of tables, so that adaptive execution can split a hub's side of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget, materialize


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = materialize(_clean(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "edges")
    forget(low)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    hung = edges.join(low, "u")
    out = materialize(_clean(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))), "edges")
    forget(low)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v), any order, repeats and loops allowed -> (node, root) for every node of an edge, where
    root is the smallest node reachable. Ends when a round changes nothing (a logarithm of the longest path)."""
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    now, seen = materialize(_clean(edges), "edges"), None
    for _ in range(max_rounds):
        before, large = now, _large_star(now)
        now = _small_star(large)
        forget(before)
        forget(large)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
