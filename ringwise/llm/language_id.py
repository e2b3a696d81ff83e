"""Hierarchical language identification: the family first, then pairwise linear SVMs within it.

Features are hashed character 1- to 4-grams of the letters of the whole text, counted by numpy in
a few array operations a text, square-rooted and scaled to unit length. The model is small and
fitted on the driver from a bounded sample of labelled rows; all documents are scored in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialise, pick, small_batches, table

#: ISO 639-1 codes by language family. Codes that aren't listed are a family of their own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
}
#: Buckets for n-grams.
WIDTH = 4096
#: About so many labelled rows a language are learned from, picked by a hash of the id; all languages are learned.
PER_LANGUAGE = 300
#: About so many in all: with more than 64 languages each gets its equal share of this, one row at least.
MAX_ROWS = 64 * PER_LANGUAGE


def family_of(lang: str, families: dict[str, list[str]] | None = None) -> str:
    return next((f for f, codes in (families or FAMILIES).items() if lang in codes), lang)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a text; None without a letter."""
    if not text:
        return None
    # A letter is its code point, anything else a gap; runs of gaps count as one.
    low = text.lower()
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if low.isascii():
        letter = (c >= 97) & (c <= 122)
    else:
        high = np.unique(c[c > 127])
        letters = high[[chr(x).isalpha() for x in high]]
        letter = ((c >= 97) & (c <= 122)) | np.isin(c, letters)
    if not letter.any():
        return None
    gap = ~letter
    keep = letter | np.concatenate([[False], letter[:-1]])
    c = np.where(gap, np.uint32(32), c)[keep].astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    out = np.zeros(WIDTH, np.float32)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 5):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        out += np.bincount(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % WIDTH, minlength=WIDTH).astype(np.float32)
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 80) -> tuple[np.ndarray, float, float]:
    """Weights, bias and margin scale of a linear SVM with squared hinge loss for y in {-1, 1}.

    Classes weigh alike. Accelerated gradient descent; the loss is smooth and strongly convex. The
    scale turns a margin into a probability by the logistic function, fitted on the same rows.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1 / (1 / c + 2 * 2.0)  # rows with the bias have norm sqrt(2)
    for t in range(steps):
        push = weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - rate * (v / c - 2 * np.append(push @ x, push.sum()).astype(np.float32))
        v = new + (t / (t + 3)) * (new - w)
        w = new
    m = y * (x @ w[:-1] + w[-1])
    scales = np.linspace(0.5, 12, 47)
    loss = [(weight * np.logaddexp(0, -s * m)).sum() for s in scales]
    return w[:-1], float(w[-1]), float(scales[int(np.argmin(loss))])


@dataclass
class Model:
    """Linear models by family and by pair of languages of one family."""

    families: dict[str, list[str]]
    by_family: dict[str, tuple[np.ndarray, float, float]] = field(default_factory=dict)
    by_pair: dict[tuple[str, str], tuple[np.ndarray, float, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language and a score from 0 to 1 of a unit vector."""
        def chance(m: tuple[np.ndarray, float, float]) -> float:
            return float(1 / (1 + np.exp(-m[2] * (x @ m[0] + m[1]))))

        names = sorted(self.families)
        if len(names) == 1:
            family, p = names[0], 1.0
        else:
            each = {f: chance(self.by_family[f]) for f in names}
            family = max(names, key=lambda f: each[f])
            p = each[family] / max(1e-12, sum(each.values()))
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], p
        votes, total = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            q = chance(self.by_pair[a, b])
            votes[a if q >= 0.5 else b] += 1
            total[a] += q
            total[b] += 1 - q
        best = max(langs, key=lambda x: (votes[x], total[x]))  # the first in order on a tie
        return best, min(1.0, max(0.0, p * total[best] / (len(langs) - 1)))


def train(rows: list[tuple[str, np.ndarray]], families: dict[str, list[str]] | None = None) -> Model | None:
    """A model from (language, vector) pairs; None without any."""
    if not rows:
        return None
    langs, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows]).astype(np.float32)
    known: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        known.setdefault(family_of(lang, families), []).append(str(lang))
    fam = np.array([family_of(v, families) for v in langs])
    model = Model(known)
    if len(known) == 2:  # one model tells two families apart
        a, b = known
        w, bias, scale = fit_svm(x, np.where(fam == a, 1, -1).astype(np.float32))
        model.by_family = {a: (w, bias, scale), b: (-w, -bias, scale)}
    elif known:
        model.by_family = {f: fit_svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in known if len(known) > 1}
    for members in known.values():
        for a, b in combinations(members, 2):
            own = (langs == a) | (langs == b)
            model.by_pair[a, b] = fit_svm(x[own], np.where(langs[own] == a, 1, -1).astype(np.float32))
    return model


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> list[tuple[str, np.ndarray]]:
    """Vectors of a bounded sample of ``docs(_id, _text, _lang)``: labelled rows outside fold 2.

    One scan counts the rows of each language, which gives the share of them to take; a second one takes those whose hash of
    the id is below that share. Nothing is sorted. Of rows that repeat an id the text with the least hash counts,
    so ids that hold many rows are one row each, combined before the shuffle.
    """
    labelled = docs.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id")) != 2))
    counted = materialise(labelled.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("n")), "languages")
    each = max(1, min(per_language, max_rows // max(1, counted.count())))
    edges = counted.select(F.col("_lang").alias("_l"), F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    place = F.shiftrightunsigned(F.xxhash64(F.col("_id"), F.lit(17)), 11) / F.lit(float(1 << 53))
    own = labelled.join(bounded(edges, 64), F.col("_lang") == F.col("_l")).where(place < F.col("share"))
    once = own.groupBy("_lang", "_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(lang, v) for lang, t in zip(b["_lang"], b["_text"], strict=True) if (v := features(t)) is not None]
            if found:
                yield pd.DataFrame({"lang": [f[0] for f in found], "v": [f[1].astype(np.float16).tobytes() for f in found]})

    rows = once.select("_lang", "_text").mapInPandas(vectors, "lang string, v binary").collect()  # about `each` rows a language
    return [(lang, np.frombuffer(v, np.float16)) for lang, v in sorted((r["lang"], bytes(r["v"])) for r in rows)]


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; ``und`` with score 0 without a letter or a model."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a vector a family, and one a pair of languages within it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            found = [("und", 0.0) if m is None or (v := features(t)) is None else m.predict(v) for t in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"], "held_out": b["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rows = pick(docs, _id=id_col, _text=text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    rows = rows.select(F.col("_id").cast("string").alias("_id"), "_text", F.coalesce(fold(F.col("_id")) == 2, F.lit(False)).alias("held_out"))
    out = rows.mapInPandas(run, "_id string, held_out boolean, lang_pred string, score double")
    return out.select(F.col("_id").cast(kind).alias(id_col), "held_out", "lang_pred", "score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    The model learns from the text and language of rows whose crc32(id as text) mod 4 isn't 2
    (``held_out``: it is 2; false for a null id) and predicts from the text alone. ``lang_pred`` is
    a learned language, or ``und`` with score 0 where the text is null or has no letter, or where
    nothing could be learned. Repeated rows get equal results; an empty table gives none; texts of any length are read
    whole, one at a time. Other columns are not read, whatever they are called.
    """
    with small_batches(docs.sparkSession):
        model = train(training_rows(pick(docs, _id=id_col, _text=text_col, _lang=lang_col), per_language, max_rows))
    return identify(docs, model, id_col, text_col)


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject: tuple[str, ...] = ("und",)) -> DataFrame:
    """The rows of ``docs`` whose predicted language isn't rejected, with all columns.

    A null text and one without a letter count as "und", whatever was learned; where nothing could be learned all others
    stay. Rows that repeat stay or go together; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = pick(docs, _id=id_col, _text=text_col, _lang=lang_col)
    with small_batches(spark):
        model = spark.sparkContext.broadcast(train(training_rows(rows)))

        @F.pandas_udf("string")
        def predicted(texts: pd.Series) -> pd.Series:
            m = model.value
            return pd.Series(["und" if (v := features(t)) is None else "" if m is None else m.predict(v)[0] for t in texts], dtype="object")

        # What goes is little, so it is that which is kept apart: rows are known by their id and the hash of their text.
        judged = rows.select("_id", F.xxhash64("_text").alias("_h"), predicted(F.col("_text")).alias("_p"))
        gone = materialise(judged.where(F.col("_p").isin(list(reject))).select("_id", "_h").distinct(), "rejected")
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    own_id, own_text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    return inner.join(bounded(gone, 24), own_id.eqNullSafe(F.col("_id")) & (F.xxhash64(own_text) == F.col("_h")), "left_anti").toDF(*names)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
