"""Exact deduplication and decontamination against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from conftest import odd_rows

from ringwise.llm import decontaminate as D
from ringwise.llm import exact_dedup as X


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_dedup(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return {t: (best(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}


def check_dedup(rows, got):
    want = brute_dedup(rows)
    by_sha = {v[2]: v for v in want.values()}
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_sha256) for r in got) == sorted((r[0] is None, r[0] or 0, want[lower(r[1])][2]) for r in rows)
    kept = defaultdict(int)
    for r in got:
        keep, n, _ = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (keep, n)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == keep
    assert set(kept.values()) == {1}


def test_odd_rows(spark):
    rows, extra, schema, wide = odd_rows()
    check_dedup(rows, X.exact_dedup(spark.createDataFrame(rows, schema)).collect())
    check_dedup(rows, X.exact_dedup(spark.createDataFrame(extra, wide)).collect())
    assert X.exact_dedup(spark.createDataFrame([], schema)).collect() == []


def test_collisions_are_resolved_by_bytes(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] * 2
    check_dedup(rows, X.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), key_bits=4).collect())


def test_state_survives_between_ingests(spark, tmp_path):
    for bits in (256, 4):  # with few bits nearly all meet under one key
        state = X.DedupState(spark, f"file://{tmp_path}/state-{bits}", bits)
        texts = [f"text {i}" for i in range(30)]
        for part in ([(1, "one"), *enumerate(texts, 100)], [(2, "two")], [(3, "ONE"), (None, "two"), (200, "TEXT 7")]):
            state.ingest(spark.createDataFrame(part, "_id bigint, _text string"))
        got = {(r._id, r._sha): (r._keep, r._n, r._loc == r._keep_loc, r._keep_loc) for r in state.resolve().collect()}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[1, sha("one")][:3] == (3, 2, False) and got[3, sha("one")][:3] == (3, 2, True)
        assert got[None, sha("two")][:3] == (2, 2, False) and got[107, sha("text 7")][:2] == (200, 2)
        assert got[101, sha("text 1")][:3] == (101, 1, True) and len(got) == 35
        # A locator leads to the content of whichever ingest it came with.
        kept = got[3, sha("one")][3]
        assert [r._text for r in state.fetch(spark.createDataFrame([(kept,)], "_loc string")).collect()] == ["ONE"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != X.ROCKSDB  # the caller's session is as it was


def test_hot_groups_without_broadcast(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(10_000 + i, "The same text, again" if i % 2 else "the SAME text, again") for i in range(len(rows))]
    check_dedup(rows, X.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), most=0).collect())


def test_stage_keeps_one_copy(spark):
    rows, extra, schema, wide = odd_rows()
    df = spark.createDataFrame(extra, wide)
    got = X.keep_first_copies(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert sorted(lower(r.text) for r in kept) == sorted(brute_dedup(rows))
    assert X.keep_first_copies(spark.createDataFrame([], schema)).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_decontaminate(docs, items, size=13):
    out = []
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        if w:
            m = min(size, len(w))
            for i in range(len(w) - m + 1):
                windows[tuple(w[i : i + m])].add(item)
    lengths = {len(k) for k in windows}
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if items_ := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= items_
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontaminate(spark):
    seq = [f"k{i}" for i in range(40)]
    items = [(1, " ".join(seq[:30])), (2, "short item here"), (3, None), (4, "  !! "), (5, " ".join(["the"] * 20)), (None, " ".join(seq[25:40])), (2, "short item here"), (7, "missing words zzz qqq")]
    docs = [
        (1, "x " * 50 + " ".join(seq[3:20]) + " y" * 400), (2, " ".join(seq[:12])), (3, "a SHORT-item, here b"), (4, None), (5, ""), (6, "the " * 14), (7, " ".join(seq[5:18] + ["z"] + seq[6:19])),
        (7, "short item here " * 5), (None, "short item here"), (8, " ".join(seq[26:40])), (9, "the " * 30_000 + "short item here"), (6, "the " * 14),
    ]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    d = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id bigint, text string, n_words int, term string")
    got = sorted((tuple(r) for r in D.decontaminate(d, b).collect()), key=str)
    assert got == brute_decontaminate(docs, items)
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {(r[0], r[1]) for r in got if r[5]}
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((i, t)) for i, t in docs if (i, len(WORD.findall(lower(t)))) not in bad)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated or r.n_hit for r in D.decontaminate(d, empty).collect())
    assert D.decontaminate(d.limit(0), b).count() == 0


def test_only_contaminated_rows_go(spark):
    b = spark.createDataFrame([(1, "short item here")], "item_id bigint, text string")
    rows = [(None, "short item here"), (None, "three clean words"), (7, "a short item here"), (7, "four quite clean words"), (8, None)]
    kept = D.drop_contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), b)
    assert {(r.doc_id, r.text) for r in kept.collect()} == {rows[1], rows[3], rows[4]}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x x b x c"), (2, "a " + "x " * 30 + "b c"), (3, "c b a"), (4, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(9, "a b c"), (8, "nothing there"), (7, None)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.find_near(d, q, slop=5).collect()) == [(1, 9), (3, 9)]


def test_counted_join_splits_hot_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ringwise.llm import common as K

    rows = [("hot", i) for i in range(400)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 1), (None, 2), ("alone", 3)]
    left = spark.createDataFrame(rows, "key string, v bigint")
    right = left.where("key is not null and key != 'alone'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    want = sorted(map(str, left.join(right.drop("n"), "key", "left").select("key", "v", "m").collect()))
    for share in (1000, 3):
        monkeypatch.setattr(K, "HOT_SHARE", share)
        for most in (32 << 20, 0):
            got = K.join_counted(left, right, "key", "n", 16, most)
            assert got.columns == ["key", "v", "m"] and sorted(map(str, got.collect())) == want
    assert K.size_of(right, 16) == sum(16 + len(r.key) for r in right.collect()) and K.size_of(right.limit(0), 16) == 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with K.small_batches(spark, 7):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
