"""Best-fit packing of documents into sequences under several capacities at once.

A document is tokenized, ended by an id, and cut only if it is longer than a sequence: into full
pieces, of which the first may be shorter. Full pieces are sequences of their own; the others are
packed by vector best-fit. Each open bin has residual capacities - tokens, documents and attention
cost (sum of squared lengths) - and a piece, taken from long to short, goes to the bin that fits
under every constraint and scores best: by the norm of the weighted residual that would stay, or by the
weighted dot-product of demand and residual.

Pieces are dealt by a hash into groups of about ``group_rows`` and each group is packed by itself, so
the work spreads over the cluster and a task holds one group. A group leaves about one bin
unfilled, so groups of thousands of bins cost a fraction of a permille.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pick, small_batches, table
from .tokens import Encoder

LENGTH = 2048
END_ID = 0


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n ids: the first takes what full pieces leave."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


def pieces_of(docs: DataFrame, length: int, vocabulary: str, end_id: int) -> DataFrame:
    """``(_id, piece, start, length, ids_crc32)`` for each piece of ``docs(_id, _text)``."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocabulary)
        for b in batches:
            out = []
            for i, text in zip(b["_id"], b["_text"], strict=True):
                ids = np.append(np.array(encode(text or ""), "<u4"), np.uint32(end_id)).astype("<u4")
                out += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), length))]
            yield pd.DataFrame(out, columns=["_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("_id").cast("string").alias("_id"), "_text")
    out = rows.mapInPandas(run, "_id string, piece int, start bigint, length bigint, ids_crc32 bigint")
    return out.withColumn("_id", F.col("_id").cast(kind))


def best_fit(lengths: np.ndarray, length: int, max_documents: int, max_attention: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece.

    Open bins are rows of residual capacities, each as a share of the whole. Pieces come from long
    to short; equal scores go to the oldest bin. A bin is closed once nothing can fit any more.
    """
    capacity = np.array([length, max_documents, max_attention], np.float64)
    w = np.array(weights, np.float64)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    free = np.empty((max(1, len(lengths)), 3))  # of open bins, in whole units
    number = np.empty(max(1, len(lengths)), np.int64)
    used = opened = 0
    for i in order:
        n = float(lengths[i])
        demand = np.array([n, 1.0, n * n])
        open_ = free[:used]
        fits = (open_ >= demand).all(axis=1)
        if fits.any():
            where = np.flatnonzero(fits)
            rest = open_[where]
            score = (((rest - demand) / capacity) ** 2 @ w) if rule == "norm" else -((rest / capacity) * (demand / capacity)) @ w
            j = where[int(np.argmin(score))]
        else:
            j = used
            free[j], number[j] = capacity, opened
            used, opened = used + 1, opened + 1
        bins[i], offsets[i] = number[j], int(capacity[0] - free[j, 0])
        free[j] -= demand
        if free[j, 0] < least or free[j, 1] < 1 or free[j, 2] < least * least:
            free[j : used - 1], number[j : used - 1] = free[j + 1 : used].copy(), number[j + 1 : used].copy()
            used -= 1
    return bins, offsets


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_documents: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25), rule: str = "norm", group_rows: int = 8000, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``max_documents`` and ``max_attention`` bound the pieces of a sequence and their summed squared
    lengths; by default they are the most that ``length`` tokens can hold, so that no bin is closed before its
    tokens are used. ``weights`` of the residual tokens, documents and attention cost choose among the bins that
    a piece fits in. ``rule``: "norm" or "dot". A piece that exceeds a capacity by itself gets a sequence of its own.
    A null text is an empty one: the end id alone. Rows that repeat are packed once each; a null
    id stays null; an empty table gives no row. A text of any length is one row. Other columns are not read.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    most, attention = max_documents or length, max_attention or length * length
    pieces = pieces_of(pick(docs, _id=id_col, _text=text_col), length, vocabulary, end_id).withColumn("_row", F.monotonically_increasing_id())
    with small_batches(docs.sparkSession):
        pieces = materialise(pieces, "pieces")
    short = pieces.where(F.col("length") < length)
    groups = max(1, round(short.count() / group_rows))
    dealt = short.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("group"))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        b, o = best_fit(rows["length"].to_numpy(), length, most, attention, weights, rule)
        # Sequence numbers: packed groups count even numbers up, full pieces have the odd ones.
        return pd.DataFrame({"_row": rows["_row"], "sequence_id": 2 * (b * groups + key[0]), "offset": o})

    placed = dealt.groupBy("group").applyInPandas(fill, "_row bigint, sequence_id bigint, offset bigint")
    full = pieces.where(F.col("length") == length).select("_row", (2 * F.col("_row") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    out = pieces.join(placed.unionByName(full), "_row")
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
