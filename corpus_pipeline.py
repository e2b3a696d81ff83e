"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again; all but the last
return the columns of ``documents``. Rows are known by id and text, so null and repeated ids take no other text along; an empty
table passes every stage; texts of any length are read whole; further columns are handed on, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringwise.llm.common import shared_dir, table
from ringwise.llm.decontaminate import drop_contaminated
from ringwise.llm.exact_dedup import keep_first_copies
from ringwise.llm.jaccard_join import keep_one_of_each
from ringwise.llm.language_id import drop_rejected
from ringwise.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, as their text is null or has no letters, go. Rows that repeat stay or go together."""
    return drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, a null id being the smallest; of rows that repeat one does."""
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays, or any one where none has an id. Documents without words stay."""
    return keep_one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go; a null text is clean. An empty benchmark keeps all."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed, rows that repeat once each; a null text is an empty one."""
    return pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("decontaminate", clean), ("packing", sequences)]

#: Trained prediction and packing are beyond SQL; a test works out from the raw rows what each stage keeps, and compares the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline-{name}")
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
    return docs
