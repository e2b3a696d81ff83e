"""Exact deduplication by a streaming aggregation over disk-backed keyed state.

Arrivals are ``(identifier, locator, digest)`` rows. A Structured Streaming aggregation keeps
one state row per digest - the digest, the stable identifier that stays and its content locator, and the
number of copies - in the RocksDB state store, without expiry: a text seen years ago is still a
hit. Every hit is then checked on its full bytes, those of earlier ingests included, which the locators lead to; digests
under which different texts meet are resolved by the texts themselves.

Only DataFrame functions run on the data path. Texts are never shuffled unless their digest
occurs more than once, and copies are combined before any shuffle, so a group that holds a third
of all rows costs one row per task. Arrivals meet the state by joins in which only repeated digests take part, hot ones apart.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, join_counted, materialise, pick, shared_dir, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the session in which the stream runs.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each of many small stores reserves megabytes on disk before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as lowercase hex; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


@dataclass
class DedupState:
    """Keyed state that lives in ``path``; ``ingest`` may be called again for later arrivals.

    A locator is ``<ingest>-<row>``; it finds the row's text in ``contents``. Texts are kept beside the state with
    ``keep_texts``; without, ``contents`` are the rows of the only ingest themselves. ``key_bits``: bits of the digest that make
    the state key (256: all of it). Fewer bits make collisions, which the check on full bytes resolves; tests use that.
    """

    spark: SparkSession
    path: str
    key_bits: int = 256
    keep_texts: bool = True
    rows: DataFrame | None = None

    def ingest(self, rows: DataFrame) -> None:
        """Add ``(_id, _text)`` rows to the state."""
        # A session of its own: the state store's settings don't touch other work.
        session = self.spark.newSession()
        for k, v in STATE_CONF.items() | {("spark.sql.shuffle.partitions", self.spark.conf.get("spark.sql.shuffle.partitions"))}:
            session.conf.set(k, v)
        inbox = f"{self.path}/arrivals"
        number = uuid.uuid4().hex[:12]
        located = rows.select(F.col("_id").cast("bigint").alias("_id"), F.concat(F.lit(f"{number}-"), F.monotonically_increasing_id().cast("string")).alias("_loc"), "_text")
        if self.keep_texts:
            kept = f"{self.path}/contents/ingest={number}"
            located.select("_loc", "_text", "_id").write.option("compression", "zstd").parquet(kept)
            located = self.spark.read.schema(located.select("_loc", "_text", "_id").schema).parquet(kept)
        elif self.rows is not None:
            raise ValueError("later ingests need the texts of earlier ones: keep_texts")
        else:
            self.rows = rows
        text = ascii_lower(F.coalesce("_text", F.lit("")))
        arrivals = located.select("_id", "_loc", digest_of(F.col("_text")).alias("_sha"), F.xxhash64(text).alias("_x"))
        arrivals.write.mode("append").option("compression", "zstd").parquet(inbox)
        seen = (
            session.readStream.schema(arrivals.schema).parquet(inbox)
            .groupBy(self.key().alias("_key"))
            .agg(F.max("_id").alias("_keep"), F.max_by("_loc", F.struct(F.coalesce("_id", F.lit(-(2**63))), "_loc")).alias("_keep_loc"), F.count(F.lit(1)).alias("_n"))
        )
        updates = f"{self.path}/updates"

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{updates}/batch={batch_id}")

        (
            seen.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{self.path}/state").foreachBatch(save).start().awaitTermination()
        )

    def key(self) -> Column:
        return F.substring("_sha", 1, self.key_bits // 4)

    def arrivals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/arrivals").withColumn("_key", self.key())

    def verdicts(self) -> DataFrame:
        """``(_key, _keep, _keep_loc, _n)`` as of the last ingest: later updates hold more rows."""
        schema = "_key string, _keep bigint, _keep_loc string, _n bigint, batch int"
        return (
            self.spark.read.schema(schema).parquet(f"{self.path}/updates")
            .groupBy("_key").agg(F.max("_keep").alias("_keep"), F.max_by("_keep_loc", "_n").alias("_keep_loc"), F.max("_n").alias("_n"))
        )

    def contents(self) -> DataFrame:
        """``(_loc, _text)`` of all rows that were ever ingested; without kept texts, ``(_text)`` of the only ingest."""
        if not self.keep_texts:
            return self.rows.select("_text")
        return self.spark.read.schema("_loc string, _text string").parquet(*[f"{self.path}/contents"])

    def fetch(self, locators: DataFrame) -> DataFrame:
        """``(_loc, _text)`` of each of ``locators(_loc)``."""
        return self.contents().join(bounded(locators.select("_loc").distinct(), 8), "_loc", "left_semi")

    def collisions(self, repeated: DataFrame) -> DataFrame:
        """Those of the keys ``repeated(_key)`` under which the full bytes differ. Grouping by the bytes themselves is the check; it
        combines copies before the shuffle, so each task sends a repeated text at most once."""
        text = ascii_lower(F.coalesce("_text", F.lit("")))
        hits = self.contents().select(digest_of(F.col("_text")).alias("_sha"), text.alias("_bytes")).withColumn("_key", self.key())
        distinct_texts = hits.join(bounded(repeated, 8), "_key", "left_semi").groupBy("_key", "_bytes").agg(F.count(F.lit(1)).alias("_m"))
        return materialise(distinct_texts.groupBy("_key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_key"), "collisions")

    def resolve(self, most: int = 32 << 20) -> DataFrame:
        """``(_id, _loc, _sha, _keep, _keep_loc, _n)`` of every arrival so far, after the check on full bytes."""
        arrivals = self.arrivals()
        repeated = materialise(self.verdicts().where("_n > 1"), "repeated")
        clash = self.collisions(repeated.select("_key"))
        groups = [repeated.select(F.col("_key").alias("_group"), "_keep", "_keep_loc", "_n")]
        if not clash.isEmpty():
            # Different texts under one key: those keys are split by the full digest and a second, independent one.
            groups[0] = groups[0].join(clash.withColumnRenamed("_key", "_group"), "_group", "left_anti")
            whole = F.concat("_sha", F.lit("/"), F.col("_x").cast("string"))
            arrivals = arrivals.join(bounded(clash.withColumn("_split", F.lit(True)), 8), "_key", "left")
            arrivals = arrivals.withColumn("_group", F.when(F.col("_split"), whole).otherwise(F.col("_key"))).drop("_split")
            groups.append(
                arrivals.where("_group != _key").groupBy("_group")
                .agg(F.max("_id").alias("_keep"), F.max_by("_loc", F.struct(F.coalesce("_id", F.lit(-(2**63))), "_loc")).alias("_keep_loc"), F.count(F.lit(1)).alias("_n"))
            )
        else:
            arrivals = arrivals.withColumn("_group", F.col("_key"))
        known = groups[0] if len(groups) == 1 else materialise(groups[0].unionByName(groups[1]), "groups")
        found = join_counted(arrivals, known.withColumn("_copies", F.col("_n")), "_group", "_copies", 40, most)
        # A digest that occurs once is its own group.
        return found.select("_id", "_loc", "_sha", F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_keep_loc", "_loc").alias("_keep_loc"), F.coalesce("_n", F.lit(1)).cast("bigint").alias("_n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 256, most: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with the
    largest id stays. A null text counts as empty. A null id is smaller than any other; of rows
    that repeat the same id and text exactly one is kept. An empty table gives an empty result. Texts of any length are
    compared whole; other columns are not read, whatever they are called. ``most``: bytes of a side of a join that are sent to all tasks.
    """
    state = DedupState(docs.sparkSession, shared_dir(docs.sparkSession, "dedup"), key_bits, keep_texts=False)
    state.ingest(pick(docs, _id=id_col, _text=text_col))
    found = state.resolve(most)
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_loc") == F.col("_keep_loc")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Rows that repeat the same id and text are reduced to one of them; null texts count as empty ones, and a null id as the
    smallest. An empty table gives none.
    """
    verdict = materialise(exact_dedup(docs, id_col, text_col), "dedup-kept")
    each = verdict.groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.bool_or("kept").alias("stays"))
    dropped = bounded(materialise(each.where("not stays").select("_id", "_sha"), "dropped"), 100)
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    own_id, own_text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    out = inner.join(dropped, own_id.eqNullSafe(F.col("_id")) & (digest_of(own_text) == F.col("_sha")), "left_anti")
    repeats = verdict.groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    if not repeats.isEmpty():
        out = out.withColumn("_sha", digest_of(own_text)).dropDuplicates([f"_c{names.index(id_col)}", "_sha"]).drop("_sha")
    return out.toDF(*names)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t
"""
