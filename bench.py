"""Times the headline queries: over the test tables at $BENCH_SF_DIR and over a synthetic ledger from spark.range."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.operators import usage
from ledgerloom.session import local_session

HEADLINE = ("summary", "window", "series_day", "breakdown_model", "ctx_buckets", "dedup_keep_max", "limits_displayed", "limit_intervals")
ROWS = (100_000, 1_000_000, 10_000_000)


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """The published generator's record i."""
    i = F.col("id")
    part = lambda prefix, k: F.concat(F.lit(prefix), (i % k).cast("string"))
    return spark.range(n).select(
        part("k", 1 << 40).alias("dedup_key"), part("s", 16).alias("source"), ((i * 7919) % (730 * 86400) + 1735689600).alias("timestamp"), part("m", 64).alias("model"), part("p", 256).alias("project"), part("x", 4096).alias("session_id"), F.lit(1).cast("long").alias("api_calls"),
        (1000 + i % 2000).alias("input_tokens"), (200 + i % 800).alias("output_tokens"), (i % 500).alias("cache_read_tokens"), (i % 100).alias("cache_write_5m_tokens"), (i % 25).alias("cache_write_1h_tokens"), (i % 120).alias("reasoning_tokens"),
    )


def timed(run) -> float:
    began = time.time()
    run().write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog.queries(), {}
    timed(lambda: found["summary"](spark, sf))  # starts the engine
    for name in HEADLINE:
        took[name] = timed(lambda name=name: found[name](spark, sf))
    rates = spark.range(64).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"), *[F.lit(1000).cast("long").alias(r) for r in usage.RATES])
    for n in ROWS:  # the first run of a size compiles its plan; the second is what a running engine takes
        took[f"synthetic_series_{n}_first"] = timed(lambda n=n: usage.series(synthetic(spark, n), rates))
        took[f"synthetic_series_{n}"] = timed(lambda n=n: usage.series(synthetic(spark, n), rates))
    print(json.dumps({"metric": "seconds over all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
