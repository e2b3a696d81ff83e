"""What a row owes to the rows before it, without sorting all rows of a key in one task.

Rows of a key are ordered by a whole number ``at`` (microseconds, or a sequence number) and by what tells rows of one ``at`` apart.
They are sorted within cells of ``cell`` numbers only; what the cells before add up to, or end with, is carried on over one row
a cell. So a key that holds most rows is the work of as many tasks as it has cells. Helper columns begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Key and cell, by which rows are dealt: a struct, as null keys have to meet as well.
KEYS = ["_key", "_cell"]


def _celled(rows: DataFrame, value: Column, by: list[str], at: str, cell: int) -> DataFrame:
    return rows.withColumn("_value", value).withColumn("_key", F.struct(*by, F.lit(0).alias("_"))).withColumn("_cell", F.floor(F.col(at) / cell))


def _before() -> Window:
    """All cells of a key before a cell."""
    return Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)


def _within(at: str, order: list[str]) -> Window:
    """A cell's rows, up to and with each."""
    return Window.partitionBy(*KEYS).orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)


def carry_last(rows: DataFrame, value: Column, by: list[str], at: str, order: list[str], cell: int) -> DataFrame:
    """``rows`` with ``_carried``: the last ``value`` that isn't null up to and with each row."""
    marked = _celled(rows, value, by, at, cell)
    last = marked.groupBy(*KEYS).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(at, *order))).alias("_last"))
    start = last.select(*KEYS, F.last("_last", ignorenulls=True).over(_before()).alias("_start"))
    inner = marked.withColumn("_now", F.last("_value", ignorenulls=True).over(_within(at, order)))
    return inner.join(start, KEYS, "left").withColumn("_carried", F.coalesce("_now", "_start")).drop("_now", "_start", "_value", *KEYS)


def previous(rows: DataFrame, value: Column, by: list[str], at: str, order: list[str], cell: int) -> DataFrame:
    """``rows`` with ``_previous``: the ``value`` of the row before; null for a key's first row. Values aren't null."""
    marked = _celled(rows, value, by, at, cell)
    ends = marked.groupBy(*KEYS).agg(F.max_by("_value", F.struct(at, *order)).alias("_end"))
    ends = ends.select(*KEYS, F.lag("_end").over(Window.partitionBy("_key").orderBy("_cell")).alias("_end"))
    inner = marked.withColumn("_lag", F.lag("_value").over(Window.partitionBy(*KEYS).orderBy(at, *order)))
    return inner.join(ends, KEYS, "left").withColumn("_previous", F.coalesce("_lag", "_end")).drop("_lag", "_end", "_value", *KEYS)


def running_sum(rows: DataFrame, value: Column, by: list[str], at: str, order: list[str], cell: int) -> DataFrame:
    """``rows`` with ``_sum``: of ``value`` up to and with each row."""
    marked = _celled(rows, value, by, at, cell)
    sums = marked.groupBy(*KEYS).agg(F.sum("_value").alias("_s"))
    starts = sums.select(*KEYS, F.coalesce(F.sum("_s").over(_before()), F.lit(0)).alias("_start"))
    inner = marked.withColumn("_own", F.sum("_value").over(_within(at, order)))
    return inner.join(starts, KEYS, "left").withColumn("_sum", F.col("_start") + F.col("_own")).drop("_start", "_own", "_value", *KEYS)
