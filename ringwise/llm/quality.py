"""Quality classification by co-training on two views of a page.

One classifier sees the text's content (hashed byte n-grams and a few ratios), the other the page's
metadata (source, language, length). From a bounded labelled sample each is fitted on its own view. In each of a few
rounds both score every unlabelled document of the corpus, and each labels a fixed number of those it is surest about
for the other one to learn from. Both are then calibrated on labelled rows that neither has seen and combined as
independent evidence; all documents are scored in one more pass.

Scores of a round are a small table. The surest rows are found by a histogram of the scores, combined before the
shuffle: rows in buckets above the edge, and by a hash as many of the edge's own bucket as are wanted. Nothing is sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialise, pick, small_batches, table

WIDTH = 2048
META_WIDTH = 512
STATS = 10
#: About so many labelled rows are learned from, picked by a hash of the id.
MAX_LABELLED = 2400
ROUNDS = 3
#: Rows that each classifier labels for the other in a round, as a share of the labelled sample and in the proportion of the classes.
SHARE = 0.04
#: Buckets of scores between zero and the surest one.
BUCKETS = 4096


def text_view(text: str | None) -> np.ndarray:
    """Content features: square-rooted n-gram counts of unit length, and ratios from 0 to 1."""
    out = np.zeros(WIDTH + STATS, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw.strip():
        out[WIDTH] = 1
        return out
    c = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = np.zeros(len(c), np.uint32)
    counts = np.zeros(WIDTH, np.float32)
    for n in range(1, 4):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(2654435761) + c[n - 1 :] + np.uint32(n)
        counts += np.bincount((h * np.uint32(2246822519)) >> np.uint32(21), minlength=WIDTH).astype(np.float32)
    counts = np.sqrt(counts)
    out[:WIDTH] = counts / np.linalg.norm(counts)
    words = raw.split()
    lines = raw.count(b"\n") + 1
    upper, digit = ((c >= 65) & (c <= 90)).mean(), ((c >= 48) & (c <= 57)).mean()
    symbol = ((c > 32) & (c < 127) & ~((c >= 48) & (c <= 57)) & ~((c >= 65) & (c <= 90)) & ~((c >= 97) & (c <= 122))).mean()
    out[WIDTH:] = [
        0, min(1, 4 * upper), min(1, 4 * digit), min(1, 4 * symbol), len(set(words)) / len(words), min(1, len(raw) / len(words) / 20),
        min(1, len(words) / lines / 100), min(1, np.log1p(len(words)) / 12), len({x[:1] for x in words}) / 256, (len(words) > 1) * sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
    ]
    return out


def meta_view(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Metadata features: indicators of source, language, length class, and of their pairs."""
    size = "null" if n_chars is None or n_chars != n_chars else str(int(np.log2(max(1.0, float(n_chars)))))
    parts = [f"s={source}", f"l={lang}", f"n={size}"]
    parts += [f"{a}&{b}" for i, a in enumerate(parts) for b in parts[i + 1 :]]
    out = np.zeros(META_WIDTH, np.float32)
    for p in parts:
        out[zlib.crc32(p.encode("utf-8", "surrogatepass")) % META_WIDTH] += 1
    return out / np.linalg.norm(out)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, steps: int = 150) -> np.ndarray:
    """Weights, the last one the bias, of a logistic regression; classes weigh alike. Accelerated gradient descent."""
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = v = np.zeros(xb.shape[1], np.float32)
    balance = weight * np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y == 0].sum())).astype(np.float32)
    rate = 1 / (1 / c + 0.25 * float((xb * xb).sum(axis=1).max()))
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ v, -30, 30)))
        new = v - rate * (v / c + xb.T @ (balance * (p - y)))
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into log-odds, by Newton steps with a weak prior on slope 1."""
    a, b = 1.0, 0.0
    x = np.stack([m, np.ones_like(m)], axis=1).astype(np.float64)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        grad = x.T @ (p - y) + [0.1 * (a - 1), 0.01 * b]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.01])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)), float(b)


@dataclass
class CoTrained:
    """Weights and calibration of both views; ``prior``: log-odds of the positive class."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float

    def chances(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by text, by metadata and by both: log-odds add up, less the prior that both contain."""
        lt = self.text_scale[0] * margin(t, self.text) + self.text_scale[1]
        lm = self.meta_scale[0] * margin(m, self.meta) + self.meta_scale[1]
        s = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return s(lt), s(lm), s(lt + lm - self.prior)


class CoTrainer:
    """Both learners: labelled views ``t, m`` with labels ``y``, of which a fifth only calibrates, and what each was given by the other."""

    def __init__(self, t: np.ndarray, m: np.ndarray, y: np.ndarray):
        hold = np.arange(len(y)) % 5 == 4
        if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
            hold = np.zeros(len(y), bool)
        on = hold if hold.any() else np.ones(len(y), bool)
        self.own = {"text": t[~hold], "meta": m[~hold]}
        self.y, self.rate = y[~hold].astype(np.float32), float(y[~hold].mean())
        self.held, self.held_y = {"text": t[on], "meta": m[on]}, y[on].astype(np.float64)
        self.given: dict[str, list[tuple[np.ndarray, int]]] = {"text": [], "meta": []}
        self.fit()

    def fit(self) -> None:
        self.w = {}
        for kind, base in self.own.items():
            new = self.given[kind]
            x = np.vstack([base, *[v[None] for v, _ in new]])
            z = np.concatenate([self.y, np.array([label for _, label in new], np.float32)])
            weight = np.concatenate([np.ones(len(base)), np.full(len(new), 0.5)]).astype(np.float32)
            self.w[kind] = fit_logistic(x, z, weight, 300.0 if kind == "text" else 30.0)

    def wanted(self, share: float) -> tuple[int, int]:
        """How many positives and negatives a classifier picks in a round."""
        picks = share * (len(self.y) + len(self.held_y))
        return max(1, round(picks * self.rate)), max(1, round(picks * (1 - self.rate)))

    def give(self, by: str, label: int, t: np.ndarray, m: np.ndarray) -> None:
        """A row that the classifier ``by`` is sure about goes to the other one."""
        other, view = ("meta", m) if by == "text" else ("text", t)
        self.given[other].append((view, label))

    def done(self) -> CoTrained:
        scale = {k: calibrate(margin(self.held[k], self.w[k]), self.held_y) for k in self.w}
        return CoTrained(self.w["text"], self.w["meta"], scale["text"], scale["meta"], float(np.log(self.rate / (1 - self.rate))))


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> CoTrained | None:
    """Co-training in memory by sorting a small pool, as ``learn`` does it for a corpus; None without both classes."""
    if len(y) < 2 or y.min() == y.max():
        return None
    both = CoTrainer(t, m, y)
    free = {"text": np.ones(len(pool_t), bool), "meta": np.ones(len(pool_t), bool)}
    for _ in range(rounds):
        score = {"text": margin(pool_t, both.w["text"]), "meta": margin(pool_m, both.w["meta"])}
        for by, s in score.items():
            for label, n in zip((1, 0), both.wanted(share), strict=True):
                sure = s if label else -s
                at = [i for i in np.argsort(-sure, kind="stable") if free[by][i] and sure[i] > 0][:n]
                free[by][at] = False
                for i in at:
                    both.give(by, label, pool_t[i], pool_m[i])
        both.fit()
    return both.done()


def _place(column: Column, seed: int) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _known(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_k``, a hash of all that is read of a row."""
    return docs.withColumn("_k", F.xxhash64("_id", "_text", "_source", "_lang", "_n"))


def _views(rows: DataFrame) -> list:
    """``(_key.., t, m)`` with both views for each of a bounded number of rows, in a fixed order."""
    keys = [f for f in rows.schema if f.name not in ("_text", "_source", "_lang", "_n")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[f.name for f in keys]].copy()
            out["t"] = [text_view(x).tobytes() for x in b["_text"]]
            out["m"] = [meta_view(s, v, n).tobytes() for s, v, n in zip(b["_source"], b["_lang"], b["_n"], strict=True)]
            yield out

    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    found = [(*[x[f.name] for f in keys], bytes(x["t"]), bytes(x["m"])) for x in rows.mapInPandas(run, f"{spec}, t binary, m binary").collect()]
    return [(*x[:-2], np.frombuffer(x[-2], np.float32), np.frombuffer(x[-1], np.float32)) for x in sorted(found)]


def labelled_views(docs: DataFrame, marked: DataFrame, max_labelled: int) -> list:
    """``(_id, _y, t, m)`` of about ``max_labelled`` labelled ids; of rows that repeat an id the one with the least hash counts."""
    part = min(1.0, max_labelled / max(1, marked.count()))
    some = marked.where(_place(F.col("_id"), 5) < part)
    fields = F.struct("_text", "_source", "_lang", "_n")
    once = _known(docs.join(bounded(some, 24), "_id")).groupBy("_id", "_y").agg(F.min_by(fields, "_k").alias("v")).select("_id", "_y", "v.*")
    return _views(once)


def _margins(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``(_id, _k, text, meta)``: both classifiers' margins of all rows."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kind = dict(docs.dtypes)["_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for b in batches:
            text = [margin(text_view(x)[None], w["text"])[0] for x in b["_text"]]
            meta = [margin(meta_view(s, v, n)[None], w["meta"])[0] for s, v, n in zip(b["_source"], b["_lang"], b["_n"], strict=True)]
            yield pd.DataFrame({"_id": b["_id"], "_k": b["_k"], "text": np.array(text, np.float32), "meta": np.array(meta, np.float32)})

    return _known(docs).mapInPandas(run, f"_id {kind}, _k bigint, text float, meta float")


def surest(scored: DataFrame, wanted: dict[tuple[str, int], int], used: dict[str, set[int]]) -> DataFrame:
    """``(_id, _k, by, label)``: for each classifier and label in ``wanted`` about that many rows of ``scored(_id, _k, text, meta)`` it is surest about.

    Only rows that it gives the label at all count, and none of ``used``, those it has picked before. Of rows with scores in the
    edge's bucket a share is taken by a hash; rows that repeat are one.
    """
    kinds = list(wanted)
    free = {by: ~F.col("_k").isin([int(k) for k in used[by]]) if used[by] else F.lit(True) for by in ("text", "meta")}
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.when(free[by], F.col(by) if label else -F.col(by)).alias("s")) for i, (by, label) in enumerate(kinds)])
    sides = scored.select("_id", "_k", F.explode(each).alias("x")).select("_id", "_k", "x.kind", "x.s").where("s > 0")
    top = {r["kind"]: r["m"] for r in sides.groupBy("kind").agg(F.max("s").alias("m")).collect()}
    if not top:
        return scored.sparkSession.createDataFrame([], f"_id {dict(scored.dtypes)['_id']}, _k bigint, by string, label int")
    limit = F.create_map(*[F.lit(x) for kv in top.items() for x in kv])
    placed = sides.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("s") / limit[F.col("kind")] * BUCKETS)).cast("int"))
    counts: dict[int, dict[int, int]] = {}
    for r in placed.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # at most BUCKETS rows a kind
        counts.setdefault(r["kind"], {})[r["bucket"]] = r["n"]
    chosen = F.lit(False)
    for kind, by_bucket in counts.items():
        left = wanted[kinds[kind]]
        edge, share = -1, 1.0
        for bucket in sorted(by_bucket, reverse=True):
            if by_bucket[bucket] >= left:
                edge, share = bucket, left / by_bucket[bucket]
                break
            left -= by_bucket[bucket]
        chosen = chosen | ((F.col("kind") == kind) & ((F.col("bucket") > edge) | ((F.col("bucket") == edge) & (_place(F.col("_k"), 7) < share))))
    name = F.element_at(F.array(*[F.struct(F.lit(by).alias("by"), F.lit(label).alias("label")) for by, label in kinds]), F.col("kind") + 1)
    return placed.where(chosen).select("_id", "_k", name.alias("n")).select("_id", "_k", "n.by", "n.label").distinct()


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, share: float = SHARE) -> CoTrained | None:
    """A model from ``docs(_id, _text, _source, _lang, _n)`` and ``labels(_id, _y)``, outside fold 2; None without labels of both classes."""
    docs = docs.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 != 2)
    marked = materialise(labels.where("_y is not null and _id is not null").groupBy("_id").agg(F.max("_y").cast("int").alias("_y")).where(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 != 2), "labelled")
    own = labelled_views(docs, marked, max_labelled)
    y = np.array([x[1] for x in own])
    if len(y) < 2 or y.min() == y.max():
        return None
    both = CoTrainer(np.stack([x[2] for x in own]), np.stack([x[3] for x in own]), y)
    used: dict[str, set[int]] = {"text": set(), "meta": set()}
    for _ in range(rounds):
        pos, neg = both.wanted(share)
        scored = materialise(_margins(docs, both.w), "margins")
        unlabelled = scored.join(bounded(marked.select("_id"), 16), "_id", "left_anti")
        wanted = {(by, label): n for by in ("text", "meta") for label, n in ((1, pos), (0, neg))}
        found = materialise(surest(unlabelled, wanted, used), "surest")
        fields = F.struct("_text", "_source", "_lang", "_n")
        rows = _known(docs).join(bounded(found.withColumnRenamed("_k", "_p"), 48), "_id").where("_k = _p").groupBy("_k", "by", "label").agg(F.first(fields).alias("v"))
        for k, by, label, t, m in _views(rows.select("_k", "by", "label", "v.*")):
            used[by].add(k)
            both.give(by, label, t, m)
        both.fit()
    return both.done()


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", n_col: str = "n_chars", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, p_text, p_meta, score, kept``.

    ``score``: probability of good quality by both views, ``kept``: it is 0.5 or more. Rows whose
    crc32(id as text) mod 4 is 2 are never learned from. A null text has its own feature; null
    metadata are values of their own. Of several labels of an id the highest counts. Without labels
    of both classes all scores are null and all rows kept. Repeated rows get equal results; an empty
    table gives none. Texts are read whole, however long; other columns are not read, whatever they are called.
    """
    rows = pick(docs, _id=id_col, _text=text_col, _source=source_col, _lang=lang_col, _n=n_col)
    rows = rows.withColumn("_n", F.col("_n").cast("double"))
    with small_batches(docs.sparkSession):
        model = docs.sparkSession.sparkContext.broadcast(learn(rows, pick(labels, _id=label_id, _y=label_col)))
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.value
        for b in batches:
            if w is None or not len(b):
                yield pd.DataFrame({"_id": b["_id"], "p_text": np.nan, "p_meta": np.nan, "score": np.nan, "kept": True})
                continue
            parts = []
            for i in range(0, len(b), 256):  # vectors of a few rows at a time
                x = b.iloc[i : i + 256]
                t = np.stack([text_view(v) for v in x["_text"]])
                m = np.stack([meta_view(s, v, n) for s, v, n in zip(x["_source"], x["_lang"], x["_n"], strict=True)])
                parts.append(np.stack(w.chances(t, m), axis=1))
            p = np.concatenate(parts).astype(np.float64)
            yield pd.DataFrame({"_id": b["_id"], "p_text": p[:, 0], "p_meta": p[:, 1], "score": p[:, 2], "kept": p[:, 2] >= 0.5})

    out = rows.withColumn("_id", F.col("_id").cast("string")).mapInPandas(run, "_id string, p_text double, p_meta double, score double, kept boolean")
    no_nan = lambda c: F.nullif(F.col(c), F.lit(float("nan"))).alias(c)
    return out.select(F.col("_id").cast(kind).alias(id_col), no_nan("p_text"), no_nan("p_meta"), no_nan("score"), "kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
