"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where the setting is absent and all
    runs on this machine, as in local tests, a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("ringwise.shared.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ringwise-")
        spark.conf.set("ringwise.shared.dir", base)
    return f"{base.rstrip('/')}/ringwise/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The files survive lost executors, and several later reads cost no recomputation.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by their exact name under new names; other columns never clash.

    ``pick(docs, _id="doc_id")``; columns are found by position, so that a table that also
    has ``DOC_ID`` or a column called ``_id`` is no problem.
    """
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(old)}").alias(new) for new, old in columns.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def size_of(df: DataFrame, row_bytes: int) -> int:
    """Bytes of all rows: ``row_bytes`` each, and those of their strings."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return df.agg(F.coalesce(F.sum(sum(texts, F.lit(row_bytes)).cast("bigint")), F.lit(0)).alias("n")).first()["n"]


def bounded(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its rows, ``row_bytes`` each besides their strings, take ``most`` bytes at most.

    Beyond that it is returned as it is, and joins with it are Spark's to plan, by a shuffle.
    """
    return F.broadcast(df) if size_of(df, row_bytes) <= most else df


#: A key that more than one in so many rows hold is hot.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """Left join of ``left`` with ``right``, whose keys are unique and whose column ``count`` says how many rows of ``left`` hold the key.

    A small ``right`` is sent to all tasks. Of any other only the hot keys are, of which there are ``HOT_SHARE`` at most; no key
    of the rows that are shuffled holds more than one in ``HOT_SHARE`` of all, and rows without a key aren't shuffled. The count is dropped.
    """
    if size_of(right, row_bytes) <= most:
        return left.join(F.broadcast(right.drop(count)), key, "left")
    is_hot = F.col(count) * HOT_SHARE > left.count()
    hot = F.broadcast(right.where(is_hot).drop(count))
    rest = left.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti")
    found = left.join(hot, key).unionByName(rest.join(right.where(~is_hot).drop(count), key, "left"))
    return found.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within this block Python workers get at most ``rows`` texts at a time; they may be long, and each worker holds a few batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
