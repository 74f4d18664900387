"""What the training-data operators share: shared storage, text columns, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # fixed value: what separates words everywhere in this subpackage

_own: dict[str, str] = {}
#: What the open `scratch` blocks, the innermost last, have written.
_scratch: ContextVar[tuple[dict[str, DataFrame], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session (tests) gets
    a temporary folder of its own; on a cluster that would not be shared, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if master not in _own:
        _own[master] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _own[master], True)
    return _own[master]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _scratch.get():
        _scratch.get()[-1][path] = out
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a DataFrame from `materialize` that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `materialize` writes inside are deleted at the end, but those given to the function that this yields: they
    belong to the block around this one, if there is one."""
    around, made = _scratch.get(), {}
    token = _scratch.set((*around, made))

    def keep(df: DataFrame) -> DataFrame:
        made.pop(df.written_at)
        if around:
            around[-1][df.written_at] = df
        return df

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for df in made.values():
            forget(df)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(remainders: int, which: int) -> Column:
    """crc32 of the doc_id's decimal text, modulo `remainders`, equals `which`; a null id is in training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % remainders == which, F.lit(False))


#: A join's right side is met by so many rows at most that lie apart from the others.
HOT = 256


def spread_join(rows: DataFrame, named: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with `named`, which has one row for each key and, in `weight`, how many rows it meets; the weights add
    up to `total` at most. So no more than HOT keys can meet a HOT-th of all rows each: those are broadcast, and the others are
    shuffled, where no key is large."""
    large = F.col(weight) * HOT >= total
    top = F.broadcast(named.filter(large))
    return rows.join(top, on).unionByName(rows.join(F.broadcast(named.filter(large).select(*on)), on, "left_anti").join(named.filter(~large), on))
