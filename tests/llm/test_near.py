"""The exact Jaccard join against brute force over all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from conftest import odd_rows

from ringwise.llm import components as G
from ringwise.llm import jaccard_join as J


def brute(rows, k=4, num=85, den=100):
    sets = [J.shingle_set(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                i = len(x & y)
                if den * i >= num * (len(x) + len(y) - i):
                    group[max(find(a), find(b))] = min(find(a), find(b))
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            g = find(i)
            least[g] = min(doc, least.get(g, doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for n in (30, 120, 14):
        base = [r.choice(words) for _ in range(n)]
        for _ in range(80):
            p = r.choice([0.005, 0.01, 0.02, 0.03, 0.05])
            w = [r.choice(words) if r.random() < p else x for x in base]
            if r.random() < 0.3:
                w = w[: len(w) - r.randrange(1, max(2, n // 6))]
            if r.random() < 0.2:
                w = w + [r.choice(words) for _ in range(r.randrange(1, max(2, n // 6)))]
            out.append(" ".join(w))
    out += [" ".join(r.choice(words) for _ in range(r.randrange(0, 9))) for _ in range(40)] + ["", "a", "a b c", "A B C"]
    rows = list(enumerate(out))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "few", "hot"), [(0, 2, 200_000), (1, 2, 100), (2, 8, 200_000)])
def test_groups_of_edited_copies(spark, monkeypatch, seed, few, hot):
    monkeypatch.setattr(J, "FEW", few)
    rows = edited(seed)
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), hot_rows=hot)) == brute(rows)


def fillings(seed, pairs, single):
    """Texts of one template with different fillings, unlike each other but for pairs that only meet in segments of the template."""
    r = random.Random(seed)
    hasher, bands = J.ShingleHasher(4), J.Bands(85, 100, 0.33)
    template = [f"t{i}" for i in range(25)]
    text = lambda filling: " ".join([*template, *filling])
    filling = lambda: [f"f{r.randrange(10**6)}" for _ in range(2)]

    def signatures(t):
        h = hasher(t)
        band = bands.of(len(h))
        return {int(x) for b in (band, band + 1) for x in J.signatures(h, b, bands.plan(b, len(h)))}

    texts = [text(filling()) for _ in range(single)]
    shared = Counter(x for t in texts for x in signatures(t))
    while pairs:
        f = filling()
        g = [f[0], filling()[1]]
        both = signatures(text(f)) & signatures(text(g))
        if both and all(shared[x] > single // 5 for x in both):
            texts += [text(f), text(g)]
            pairs -= 1
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


def test_hot_buckets_of_unlinked_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "SAMPLED", 1)
    monkeypatch.setattr(J, "FEW", 2)
    rows = fillings(5, 12, 1000)
    want = brute(rows)
    assert sum(d != c for d, _, c in want) == 12
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), hot_rows=50)) == want


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_star_in_hot_buckets(spark, monkeypatch, most):
    """Texts that all link with one, in buckets that are dealt into parts, with and without broadcasts."""
    split = []
    members = J.bucket_members

    def seen(entries, hot_rows):
        out = members(entries, hot_rows)
        split.append(out.where("part >= 0").count())
        return out

    monkeypatch.setattr(J, "bucket_members", seen)
    plain = J.bounded
    monkeypatch.setattr(J, "bounded", lambda df, row_bytes: plain(df, row_bytes, most))
    base = "a b c d e f g h i"
    rows = [(i, f"{base} x{i}") for i in range(1, 6001)] + [(6001, base)]
    found = J.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), hot_rows=1)
    assert {r.component_id for r in found.select("component_id").distinct().collect()} == {1} and split[0] > 0


def test_odd_rows(spark):
    rows, extra, schema, wide = odd_rows()
    want = brute([(r[0], r[1]) for r in rows])
    assert got(J.jaccard_components(spark.createDataFrame(rows, schema))) == want
    df = spark.createDataFrame(extra, wide)
    assert got(J.jaccard_components(df)) == want
    kept = J.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for d, _, c in want if d is not None and d == c}
    assert J.jaccard_components(spark.createDataFrame([], schema)).count() == 0


def test_ids_that_repeat_with_other_texts(spark):
    base = [f"w{i}" for i in range(100)]
    edit = lambda i: " ".join([*base[:i], "x", *base[i + 1 :]])
    rows = [(1, "nothing alike at all here"), (1, " ".join(base)), (7, edit(99)), (None, edit(98)), (7, "one two three four five"), (9, edit(0)), (9, edit(0)), (None, "one two three four five")]
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_one_of_each_stays_where_ids_repeat_or_lack(spark):
    base = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    edit = lambda w, i: " ".join([*w[:i], "x", *w[i + 1 :]])
    rows = [(1, " ".join(base)), (2, edit(base, 99)), (2, "unlike all others, under an id that repeats"), (None, edit(base, 0)), (None, "unlike all others, without an id"), (None, " ".join(other)), (None, edit(other, 99)), (None, None)]
    kept = {(r.doc_id, r.text) for r in J.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    either = {rows[5], rows[6]}
    assert kept - either == {rows[0], rows[2], rows[4], rows[7]} and len(kept & either) == 1


def test_sample_of_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(J.jaccard_components(docs)) == brute(rows)


def test_every_allocation_covers_its_distance():
    bands = J.Bands(85, 100, 0.33)
    doubled = 0
    for n in (1, 5, 6, 7, 8, 12, 13, 14, 50, 500, 20_000):
        band = bands.of(n)
        assert bands.top(band) >= n and (band == 0 or bands.top(band - 1) < n)
        for b in (band, band + 1):
            p = bands.plan(b, n)
            most = int(bands.c * (n + min(bands.top(b), int(n / bands.t))))
            # More allocation than tokens may differ.
            assert p.indexed + p.doubled > most or most == 0
            assert p.segments >= p.indexed
            doubled += p.doubled > 0
    assert doubled


@pytest.mark.parametrize("deal", [None, (0, 1), (0, 3), (1, 0), (2, 0)])
def test_similar_sets_share_an_entry(deal):
    """Whatever allocation is chosen."""
    r = np.random.default_rng(6)
    bands = J.Bands(85, 100, 0.33)
    if deal:
        bands.deal = lambda band: deal if int(bands.c * 2 * bands.top(band)) + 1 >= 2 * deal[0] else (0, 1)
    for _ in range(1500):
        n = int(r.integers(7, 120))
        x = r.integers(0, 2**63, n).astype(np.uint64)
        gone, new = r.integers(0, 1 + n // 8, 2)
        y = np.concatenate([x[gone:], r.integers(0, 2**63, new).astype(np.uint64)])
        both = n - gone
        if 100 * both < 85 * (n + new) or not gone + new:
            continue
        i, j = bands.of(n), bands.of(len(y))
        entries = [{int(v) for b in (k, k + 1) for v in J.signatures(np.unique(z), b, bands.plan(b, len(z)))} for z, k in ((x, i), (y, j))]
        assert entries[0] & entries[1], (n, gone, new)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(501, 900)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges for x in (a, b) if a != b}
    found = {x.node: x.component for x in G.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == want
    assert G.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_few_edges_are_one_tasks_work(spark):
    """A small graph takes few jobs, and both ways give the same components."""
    r = random.Random(7)
    names = r.sample(range(-(10**12), 10**12), 900)
    edges = [(names[i], names[i + 1]) for i in range(299)] + [(names[300], names[i]) for i in range(301, 600)] + [(names[r.randrange(600, 900)], names[r.randrange(600, 900)]) for _ in range(140)]
    edges += [(v, u) for u, v in edges[::3]] + edges[::5] + [(names[0], names[0])]
    table = spark.createDataFrame(edges, "u bigint, v bigint").localCheckpoint()
    context = spark.sparkContext
    context.setJobGroup("few-edges", "")
    few = sorted(map(tuple, G.connected_components(table).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("few-edges"))
    context.setJobGroup("", "")
    assert jobs <= 12
    assert few == sorted(map(tuple, G.connected_components(table, few=0).collect()))
    assert {b for a, b in few if a in names[:300]} == {min(names[:300])} and {b for a, b in few if a in names[300:600]} == {min(names[300:600])}
    assert len(few) == len({x for u, v in edges if u != v for x in (u, v)})
