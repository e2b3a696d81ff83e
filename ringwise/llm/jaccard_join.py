"""Exact Jaccard self-join of word-shingle sets by universe partition and pigeonhole.

Two sets of sizes a and b with Jaccard similarity of at least t differ in at most
``H = floor((1 - t) / (1 + t) * (a + b))`` tokens. Tokens are dealt by a hash into ``m`` segments
that depend on a band of set sizes only. Each segment gets an allocation: 0 (not indexed), 1
(indexed by its content) or 2 (also by its content less any one token, its one-deletion
neighbourhood). If the allocations add up to more than H, two similar sets agree in some
segment: at 1 the segments are equal, at 2 they differ in at most one token.

Costs pick the allocation of a band: each candidate - how many segments get 2, how many spare ones get 0 -
costs its index entries plus the meetings with unrelated sets that its segments' sizes let expect (see ``Bands.cost``).
Bands of small sets come out with one-deletion neighbourhoods, which are fewer and better than
several tiny segments. Elsewhere ``m = H + 1 + spare`` and each set gives 0 to its least
selective segments: the ones with fewest tokens (empty ones first), which unrelated sets share
most. The order depends on a segment's content alone, so equal segments rank alike in both sets.
Of the ``m - h`` or more segments in which two sets agree that differ in at most h tokens, the
most selective one has all the others behind it in either set, so it is among the first h + 1 of
both, which are indexed.

Bands have sizes (L, U] with U = L / t, so similar sets lie in one band or in neighbours: a set is
indexed in its own band and the next one, with the segments of that band.

Links are not expanded inside groups. Equal sets are one representative from the start. Of each
bucket, all members are compared with its first, then those still apart with its last; links of
verified pairs merge components. After that only pairs of different components that meet in a
bucket are open, and those in large buckets are found by what they have beyond a common pivot (see
``_cross``). Each pair is verified on its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, join_counted, materialise, pick, small_batches, table
from .components import connected_components

M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a Python worker remembers; beyond that it starts anew.
REMEMBERED_WORDS = 200_000
#: Shingles of texts that were just compared.
REMEMBERED_SHINGLES = 50_000
#: 64-bit words of a bitmap of added tokens.
BIT_WORDS = 16
#: Cost model of the allocation: the chance that an unrelated set which shares a token of a segment shares a further one, and index
#: entries that a meeting is worth. They pick among exact plans and don't change results.
CHANCE, MEETING = 0.3, 100.0
#: Members of a bucket whose pairs are listed outright.
FEW = 8
#: One node in so many is counted to see which buckets are hot.
SAMPLED = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, lower-cased in A-Z, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """Distinct k-word shingles; with fewer words the whole sequence is one; without words empty."""
    w = tokens(text)
    if not w:
        return set()
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) > k else {tuple(w)}


class ShingleHasher:
    """64-bit hashes of the distinct shingles of a text, ascending."""

    def __init__(self, k: int):
        self.k, self.seen = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        w = tokens(text)
        if not w:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > REMEMBERED_WORDS:
            seen.clear()
        try:
            h = [seen[x] for x in w]
        except KeyError:
            for x in set(w):
                if x not in seen:
                    seen[x] = xxhash.xxh3_64_intdigest(x)
            h = [seen[x] for x in w]
        h = np.array(h, np.uint64)
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * M3 + h[i : len(h) - k + 1 + i])
        return np.unique(out)


class Plan(NamedTuple):
    """Segments of a band's sets, how many of them have one-deletion neighbourhoods, and how many are indexed."""

    segments: int
    doubled: int
    indexed: int


class Bands:
    """Size bands and their allocation for a threshold num/den; ``slack``: spare segments at most, as a share of the others."""

    def __init__(self, num: int, den: int, slack: float):
        self.t, self.slack = Fraction(num, den), slack
        self.tops = [1]  # band i holds sizes over tops[i-1] up to tops[i]
        self.c = (1 - self.t) / (1 + self.t)
        self.dealt: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] / self.t)))
        return int(np.searchsorted(self.tops, n))

    def top(self, band: int) -> int:
        while len(self.tops) <= band:
            self.of(self.tops[-1] + 1)
        return self.tops[band]

    def cost(self, n: int, most: int, doubled: int, spare: int) -> float:
        """Of a set of ``n`` tokens whose segments' allocations add up to ``most + 1``: entries, and meetings with unrelated sets.

        Segments have Poisson sizes around their mean, of which the smallest ``spare`` aren't indexed. An unrelated set that
        shares a first token shares each further one with the chance ``CHANCE``; a meeting costs ``MEETING`` entries.
        """
        single = most + 1 - 2 * doubled
        m = doubled + single + spare
        mean = n / m
        kept = meetings = 0.0
        wanted = 1 - spare / m
        chance = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(int(mean + 8 * math.sqrt(mean)) + 8)]
        for k in range(len(chance) - 1, -1, -1):
            part = min(chance[k], wanted - kept)
            kept += part
            meetings += part * CHANCE ** max(0, k - 1)
        one_less = max(1.0, mean) * CHANCE ** max(0.0, mean - 2)
        return single + doubled * (1 + mean) + MEETING * (single * meetings / wanted + doubled * one_less)

    def deal(self, band: int) -> tuple[int, int]:
        """The cheapest ``(doubled, spare)`` of a band."""
        if band not in self.dealt:
            u = self.top(band)
            most = int(self.c * 2 * u)
            spares = sorted({1, 2, 4, max(1, int(self.slack * (most + 1)))})
            options = [(0, z) for z in spares] + [(x, 0) for x in range(1, min(4, (most + 1) // 2) + 1)]
            self.dealt[band] = min(options, key=lambda o: self.cost(u, most, *o))
        return self.dealt[band]

    def plan(self, band: int, n: int) -> Plan:
        """What a set of ``n`` tokens indexes under a band.

        Segments depend on the band alone. Where none is doubled, a set has to index ``h + 1`` of them, where ``h`` is
        the most it can differ from a similar set within the band.
        """
        u = self.top(band)
        most = int(self.c * 2 * u)
        h = int(self.c * (n + min(u, int(n / self.t))))
        if h == 0:
            return Plan(1, 0, 0)  # only equal sets are similar, and those are one representative
        doubled, spare = self.deal(band)
        m = most + 1 - doubled + spare
        return Plan(m, doubled, m if doubled else h + 1)


def signatures(hashes: np.ndarray, band: int, plan: Plan) -> np.ndarray:
    """Index entries of a set (ascending distinct hashes) under a band."""
    m, doubled, indexed = plan
    if not indexed:
        return np.empty(0, np.uint64)
    seed = mix(np.array([band * 1_000_003 + m], np.uint64))[0]
    value = mix(hashes ^ seed)
    segment = (mix(value + M3) % np.uint64(m)).astype(np.int64)
    count = np.bincount(segment, minlength=m)
    order = np.argsort(segment, kind="stable")
    total = np.zeros(m, np.uint64)
    full = np.flatnonzero(count)
    total[full] = np.add.reduceat(value[order], np.concatenate([[0], np.cumsum(count[full])[:-1]]))
    place = M3 * (np.arange(m, dtype=np.uint64) + np.uint64(1))
    content = mix(total ^ seed)
    best = np.lexsort((content, np.arange(m), -count))[:indexed] if indexed < m else np.arange(m)
    out = [mix(content[best] + place[best])]
    if doubled:
        near = segment < doubled
        out.append(mix(mix((total[segment[near]] - value[near]) ^ seed) + place[segment[near]]))
    return np.concatenate(out)


def set_rows(docs: DataFrame, k: int, num: int, den: int, slack: float) -> DataFrame:
    """``(_id, _h, _n, _set, _sigs, _row)`` for each row: hash of the text, set size, digest of the set, index entries, row number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, bands = ShingleHasher(k), Bands(num, den, slack)
        for b in batches:
            n, digest, sigs = [], [], []
            for text in b["_text"]:
                h = hasher(text)
                n.append(len(h))
                digest.append(hashlib.sha256(h.tobytes()).digest()[:16] if len(h) else None)
                band = bands.of(len(h))
                s = [signatures(h, x, bands.plan(x, len(h))) for x in (band, band + 1)] if len(h) else []
                sigs.append(np.concatenate(s).view(np.int64) if s else np.empty(0, np.int64))
            yield pd.DataFrame({"_id": b["_id"].astype("Int64"), "_h": b["_h"], "_n": n, "_set": digest, "_sigs": sigs})

    return docs.mapInPandas(run, "_id bigint, _h bigint, _n bigint, _set binary, _sigs array<bigint>").withColumn("_row", F.monotonically_increasing_id())


def bucket_members(entries: DataFrame, hot_rows: int) -> DataFrame:
    """``(sig, parts, part, node, first, last)`` of all buckets with two nodes or more.

    One shuffle of the entries. A bucket that a sample shows to hold over ``hot_rows`` entries is
    dealt into parts of a quarter of that, each with a first and last node of its own, and the parts' first nodes meet once
    more, so some of its rows repeat. The sample only steers this: no entry is left out, and ``sig`` stays that of the
    whole bucket. ``part`` is -1 in all other buckets, ``parts`` 1.
    """
    seen = entries.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).groupBy("sig").agg(F.count(F.lit(1)).alias("k"))
    parts = F.ceil(F.col("k") * SAMPLED * 4 / hot_rows).cast("bigint")
    hot = materialise(seen.where(F.col("k") > max(8, hot_rows // SAMPLED)).select("sig", F.greatest(F.lit(2), parts).alias("parts")), "hot-buckets")
    if hot.isEmpty():
        w = Window.partitionBy("sig")
        entries = entries.select("sig", F.lit(1).cast("bigint").alias("parts"), F.lit(-1).cast("bigint").alias("part"), "node")
    else:
        salt = F.pmod(F.xxhash64("node", "sig"), F.col("parts"))
        entries = entries.join(bounded(hot, 24), "sig", "left").select("sig", F.coalesce("parts", F.lit(1)).alias("parts"), F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(salt).cast("bigint").alias("part"), "node")
        heads = entries.where("part >= 0").groupBy("sig", "parts", "part").agg(F.min("node").alias("node"))
        entries = entries.withColumn("own", F.col("part")).unionByName(heads.withColumn("own", F.lit(-1).cast("bigint")))
        w = Window.partitionBy("sig", "own")
    out = entries.select("sig", "parts", "part", "node", F.min("node").over(w).alias("first"), F.max("node").over(w).alias("last"))
    return out.where(F.col("first") < F.col("last"))


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(a, b, inter, total)`` of the shingle sets of each pair ``(a, b)`` whose sizes allow the threshold, from the words themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict = {}
        held = 0

        def of(node: int, text: str) -> set:
            nonlocal held
            if node not in sets:
                if held > REMEMBERED_SHINGLES:
                    sets.clear()
                    held = 0
                sets[node] = shingle_set(text, k)
                held += len(sets[node])
            return sets[node]

        for x in batches:
            both = [(len(p & q), len(p) + len(q)) for p, q in ((of(a, s), of(b, t)) for a, s, b, t in zip(x["a"], x["_ta"], x["b"], x["_tb"], strict=True))]
            inter = np.array([i for i, _ in both], np.int64)
            yield pd.DataFrame({"a": x["a"], "b": x["b"], "inter": inter, "total": np.array([t for _, t in both], np.int64) - inter})

    ta = texts.select(F.col("node").alias("a"), F.col("_text").alias("_ta"), F.col("n").alias("na"))
    tb = texts.select(F.col("node").alias("b"), F.col("_text").alias("_tb"), F.col("n").alias("nb"))
    fits = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    return pairs.select("a", "b").join(ta, "a").join(tb, "b").where(fits).select("a", "_ta", "b", "_tb").mapInPandas(run, "a bigint, b bigint, inter bigint, total bigint")


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, slack: float = 0.33, hot_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Rows are linked when ``den * |A & B| >= num * |A | B|`` for their sets of distinct k-word
    shingles; ``component_id`` is the smallest id that links reach, the own one included. Texts of
    fewer than k words have the whole sequence as their one shingle; a text without words and a
    null text have an empty set and link with nothing. Rows without an id may carry links, but
    never name a component that has an id. Rows that repeat, also with the same id, get equal
    results. An empty table gives an empty result; other columns are not read.
    """
    return _labelled(docs, k, num, den, slack, hot_rows, id_col, text_col).drop("_h", "stays")


def _labelled(docs: DataFrame, k: int, num: int, den: int, slack: float, hot_rows: int, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``jaccard_components``, the hash ``_h`` of the text, and ``stays``: whether a row without words, or the one of its component to keep."""
    with small_batches(docs.sparkSession):  # all that runs in Python is written within
        rows, of_set = _components(docs, k, num, den, slack, hot_rows, id_col, text_col)
    out = join_counted(rows.select("_id", "_h", "_n", "_set", "_row"), of_set, "_set", "copies", 60)
    alone = F.col("keeper").isNull()  # without words, or unlike all others
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(alone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), "_h", (alone | (F.col("_row") == F.col("keeper"))).alias("stays"))


def _components(docs: DataFrame, k: int, num: int, den: int, slack: float, hot_rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``set_rows`` of all rows, and ``(_set, component_id, keeper, copies)`` of each set that has copies or links."""
    spark = docs.sparkSession
    plain = pick(docs, _id=id_col, _text=text_col).withColumn("_id", F.col("_id").cast("bigint")).withColumn("_h", F.xxhash64("_text"))
    rows = materialise(set_rows(plain, k, num, den, slack), "sets")
    # Equal sets are one node, known by the row number of the copy with the smallest id.
    classes = materialise(
        rows.where("_n > 0").groupBy("_set").agg(F.min("_id").alias("least"), F.min_by("_row", F.struct(F.coalesce("_id", F.lit(2**63 - 1)), "_row")).alias("node"), F.max("_n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    repeated = classes.where("copies > 1").select("_set", "node", "copies")
    copies = materialise(join_counted(rows.where("_n > 0").select("_row", "_set"), repeated, "_set", "copies", 40).where("_row != node").select("_row"), "copies")
    entries = rows.join(bounded(copies, 16), "_row", "left_anti").select(F.explode("_sigs").alias("sig"), F.col("_row").alias("node"))
    members = materialise(bucket_members(entries, hot_rows), "members")
    # Texts of nodes that meet another one, fetched once.
    meeting = members.select("node").distinct().join(classes.select("node", "n"), "node")
    texts = materialise(_texts_of(plain, rows, meeting), "texts")
    tried = spark.createDataFrame([], "a bigint, b bigint, inter bigint, total bigint")
    label = None
    first = members.where("node != first").groupBy(F.col("node").alias("a"), F.col("first").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    for step in range(3):
        if step == 0:  # the first node that shares most buckets
            pairs = first.groupBy("a").agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("b"))
        elif step == 1:  # any first or last node that is still apart
            last = members.where("node != last").select(F.col("node").alias("b"), F.col("last").alias("a")).distinct()
            pairs = _apart(first.select("a", "b").unionByName(last.select("a", "b")).distinct(), label)
        else:
            pairs = _cross(members, label, texts, k, num, den)
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        done = materialise(verified(pairs, texts, k, num, den), "verified")
        tried = tried.unionByName(done)
        found = done.where(den * F.col("inter") >= num * F.col("total")).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if label is None:
            label = connected_components(found)
        elif not found.isEmpty():  # components so far are stars; new links join them
            label = connected_components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found))
    named = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min_by("node", F.struct(F.coalesce("least", F.lit(2**63 - 1)), "node")).alias("keeper"), F.count(F.lit(1)).alias("sets"))
    of_set = materialise(named.join(least, "component").where("copies > 1 or sets > 1").select("_set", "component_id", "keeper", "copies"), "labels")
    return rows, of_set


def _texts_of(plain: DataFrame, rows: DataFrame, meeting: DataFrame) -> DataFrame:
    """``(node, n, _text)``: the text of the row that represents each node, found by its id and the hash of its text."""
    ids = meeting.join(rows.select(F.col("_row").alias("node"), F.col("_id").alias("_i"), F.col("_h").alias("_g")), "node").select("node", "n", "_i", "_g")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))
    return plain.where("_text is not null").join(bounded(ids, 40), same).select("node", "n", "_text")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components so far."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def _cross(members: DataFrame, label: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components that meet in a bucket and may be similar.

    A bucket is taken as a whole, also one whose members were dealt into parts. One of up to ``FEW`` members gives its pairs, a constant number a member. In a larger
    one the least node of the component with most members is the pivot, and each member is known by its
    difference to the pivot: ``na`` added tokens, ``nr`` removed ones. Two members differ in
    ``|Ds| + |Db| - 2 |Ds & Db|`` tokens and can share min(nr) removed ones at most; what is left of the
    intersection they need must be added tokens. Members apart from the pivot's component differ a
    lot from it, so they need some, and added tokens are rare: pairs come from a join on the rarest of them, with
    the number that each pair needs. Sizes under which none are needed are paired by classes of sizes.
    """
    labelled = members.select("sig", "parts", "part", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = labelled.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("m"), F.max("parts").alias("parts"))
    mixed = per.groupBy("sig").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("kinds"), F.max_by("component", F.struct("m", -F.col("component"))).alias("pivot"), F.max("parts").alias("parts")).where("kinds > 1")
    # The rows of a bucket in parts stay spread over them.
    mixed = mixed.withColumn("part", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(-1).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))))
    rows = materialise(labelled.drop("parts").join(mixed.drop("kinds", "parts"), ["sig", "part"]).drop("part"), "mixed")
    few = rows.where(F.col("m") <= FEW)
    x = few.select("sig", F.col("node").alias("a"), F.col("component").alias("ca"))
    y = few.select("sig", F.col("node").alias("b"), F.col("component").alias("cb"))
    direct = x.join(y, "sig").where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()
    many = rows.where(F.col("m") > FEW).select("node", "component", "pivot").distinct()
    known = materialise(_differences(many.where("node != pivot"), texts, k), "differences")
    c = (den - num) / (den + num)
    # A node apart from the pivot that is similar to it after all is a pair by itself.
    apart = known.where("component != pivot")
    similar = apart.where(F.col("na") + F.col("nr") <= F.floor(c * (F.col("n") + F.col("np")) + 1e-9)).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    size = F.struct("node", "component", "n", "na", "nr")

    def need(s: str, b: str) -> Column:
        d = sum(F.col(f"{z}.{w}") for z in (s, b) for w in ("na", "nr"))
        most = F.floor(c * (F.col(f"{s}.n") + F.col(f"{b}.n")) + 1e-9)
        return F.ceil((d - most) / 2) - F.least(f"{s}.nr", f"{b}.nr")

    others = (F.col("s.component") != F.col("b.component")) & (F.col("s.node") != F.col("b.node"))
    # Classes of sizes, as wide as an eighth of what two texts like the pivot may differ in, and the least that a
    # pair of classes needs.
    width = F.greatest(F.lit(1), F.floor(F.col("np") * c / 8))
    cell = F.struct(F.floor(F.col("na") / width).alias("a"), F.floor(F.col("nr") / width).alias("r"))
    marked = known.withColumn("cell", cell).withColumn("far", F.col("component") != F.col("pivot"))
    marked = marked.join(similar.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("close")), ["node", "pivot"], "left").withColumn("far", F.col("far") & F.col("close").isNull()).drop("close")
    marked = materialise(marked.select("pivot", "far", "cell", "np", width.alias("w"), size.alias("x"), "added", "bits", "lost", "gone", "gone_lost"), "marked")
    s_cells = marked.where("far").select("pivot", "np", "w", F.col("cell").alias("sc")).distinct()
    b_cells = marked.select("pivot", F.col("cell").alias("bc")).distinct()
    w = F.col("w")
    low = sum(F.col(f"{z}.{v}") for z in ("sc", "bc") for v in ("a", "r")) * w
    n_top = 2 * F.col("np") + (F.col("sc.a") + F.col("bc.a") + 2) * w - 2 - (F.col("sc.r") + F.col("bc.r")) * w
    cells = materialise(s_cells.join(b_cells, "pivot").withColumn("low", F.ceil((low - F.floor(c * n_top + 1e-9)) / 2) - (F.least("sc.r", "bc.r") + 1) * w + 1), "cells")
    loose = cells.where("low < 1")
    # Prefix filter: with at least `low` tokens in common, two nodes share one among their rarest na - low + 1.
    # Tokens of one node only count for the position but can't meet.
    of_s = cells.groupBy("pivot", F.col("sc").alias("cell"), F.lit(True).alias("far")).agg(F.min("low").alias("low"))
    of_b = cells.groupBy("pivot", F.col("bc").alias("cell"), F.lit(False).alias("far")).agg(F.min("low").alias("low"))
    bound = marked.join(of_s.unionByName(of_b), ["pivot", "cell", "far"])
    tokens = bound.select("pivot", "far", "x", "bits", "lost", "gone", "gone_lost", (F.col("x.na") - F.greatest(F.lit(1), "low") + 1).alias("prefix"), F.explode("added").alias("token")).where("prefix > 0")
    met = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("f"), F.max("far").alias("wanted")).where("f > 1 and wanted").drop("wanted")
    own = Window.partitionBy("pivot", "x")
    # Tokens that no other node has, or none that is far, come before all that may meet.
    placed = tokens.join(met, ["pivot", "token"]).withColumn("at", F.row_number().over(own.orderBy("f", "token")) + F.col("x.na") - F.count(F.lit(1)).over(own))
    placed = placed.where(F.col("at") <= F.col("prefix"))
    placed = materialise(placed.select("pivot", "far", "token", "x", "bits", "lost", "gone", "gone_lost", (F.col("x.na") - F.col("prefix")).alias("beyond")), "prefixes")
    side = lambda z: placed.select("pivot", "token", F.col("x").alias(z), *[F.col(v).alias(f"{z}_{v}") for v in ("far", "bits", "lost", "gone", "gone_lost", "beyond")])
    once = ~F.col("b_far") | (F.col("s.node") > F.col("b.node"))
    # At most as many tokens in common as bits, and those that share a bit in the set where fewer do.
    both = lambda v: sum(F.bit_count(F.col(f"s_{v}")[i].bitwiseAND(F.col(f"b_{v}")[i])) for i in range(BIT_WORDS))
    common = both("bits") + F.least("s_lost", "b_lost")
    gone = F.least(both("gone") + F.least("s_gone_lost", "b_gone_lost"), "s.nr", "b.nr")
    # What the removed tokens surely don't share has to come from the added ones.
    enough = common + gone >= need("s", "b") + F.least("s.nr", "b.nr")
    shared = side("s").where("s_far").join(side("b"), ["pivot", "token"]).where(others & once & (need("s", "b") >= 1) & enough).groupBy("pivot", "s", "b").agg((F.count(F.lit(1)) + F.first("s_beyond") + F.first("b_beyond")).alias("k"))
    by_token = shared.where(F.col("k") >= need("s", "b")).select(F.col("s.node").alias("a"), F.col("b.node").alias("b"))
    within = lambda z, c: marked.select("pivot", F.col("x").alias(z), F.col("cell").alias(c), "far", *[F.col(v).alias(f"{z}_{v}") for v in ("bits", "lost", "gone", "gone_lost")])
    by_class = loose.select("pivot", "sc", "bc").join(within("s", "sc").where("far").drop("far"), ["pivot", "sc"]).join(within("b", "bc").withColumnRenamed("far", "b_far"), ["pivot", "bc"]).where(others & once & (need("s", "b") < 1) & enough)
    return direct.unionByName(similar).unionByName(by_token).unionByName(by_class.select(F.col("s.node").alias("a"), F.col("b.node").alias("b")))


def bitmap(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Bits of a token set, and how many tokens share a bit with another."""
    places = np.unique(hashes % np.uint64(64 * BIT_WORDS))
    bits = np.zeros(BIT_WORDS, np.uint64)
    np.bitwise_or.at(bits, (places // np.uint64(64)).astype(np.int64), np.uint64(1) << (places % np.uint64(64)))
    return bits.view(np.int64), len(hashes) - len(places)


def _differences(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``(node, component, pivot, n, np, na, nr, added, bits, lost)``: sizes, and the hashes of the tokens a node has beyond
    its pivot; also as a bitmap, and how many of them share a bit with another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, pivots = ShingleHasher(k), {}
        for x in batches:
            out = []
            for node, component, pivot, t, tp in zip(x["node"], x["component"], x["pivot"], x["_t"], x["_tp"], strict=True):
                if pivot not in pivots:
                    if len(pivots) > 64:
                        pivots.clear()
                    pivots[pivot] = hasher(tp)
                own, base = hasher(t), pivots[pivot]
                added = np.setdiff1d(own, base, assume_unique=True)
                removed = np.setdiff1d(base, own, assume_unique=True)
                out.append((node, component, pivot, len(own), len(base), len(added), len(removed), added.view(np.int64), *bitmap(added), *bitmap(removed)))
            yield pd.DataFrame(out, columns=["node", "component", "pivot", "n", "np", "na", "nr", "added", "bits", "lost", "gone", "gone_lost"])

    t = texts.select("node", F.col("_text").alias("_t"))
    tp = texts.select(F.col("node").alias("pivot"), F.col("_text").alias("_tp"))
    return pairs.join(t, "node").join(tp, "pivot").mapInPandas(run, "node bigint, component bigint, pivot bigint, n bigint, np bigint, na bigint, nr bigint, added array<bigint>, bits array<bigint>, lost bigint, gone array<bigint>, gone_lost bigint")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with all columns: the one with the smallest id, or any one where none has an id.

    Rows without words stay. Rows are known by their id and the hash of their text, so rows equal in both stay or go together.
    """
    found = _labelled(docs, 4, 85, 100, 0.33, 200_000, id_col, text_col)
    dropped = materialise(found.groupBy(F.col(id_col).alias("_id"), "_h").agg(F.bool_or("stays").alias("stays")).where("not stays").select("_id", "_h"), "dropped")
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    own_id, own_text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    return inner.join(bounded(dropped, 24), own_id.eqNullSafe(F.col("_id")) & (F.xxhash64(own_text) == F.col("_h")), "left_anti").toDF(*names)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') as t from documents),
s as (
  select distinct doc_id, array_to_string(t[p : p + 3], ' ') as g
  from (select doc_id, t, unnest(range(1, greatest(1, len(t) - 3) + 1)) as p from w where len(t) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 85 * (a.n + b.n - i)),
reach(x, y) as (
  select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) as y from reach group by x)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(least.y, w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join least on least.x = w.doc_id
"""
