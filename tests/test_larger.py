"""Queries on rows that only larger tables have, against DuckDB."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwise import catalog
from ringwise.operators import placement as P
from ringwise.operators import tree as T

from test_queries import DATA, TABLES, rows_of


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives what its SQL gives, where some tables are replaced by SQL over the small ones."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def check(name: str, **replaced: str) -> list[tuple]:
        for t in TABLES:
            if t in replaced:
                con.execute(f"copy ({replaced[t]}) to '{tmp_path}/{t}.parquet'")
            else:
                (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
        for t in replaced:
            con.execute(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet'")
        got, want = rows_of(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), rows_of(con.sql(catalog.ORACLE_SQL[name]).df())
        assert got == want and got[1]
        return got[1]

    return check


@pytest.mark.parametrize(("name", "most"), [("relay_gate", 9223372036854770000), ("labelled_counters", 5000000)])
def test_relay_of_large_ids(same, name, most):
    """Products beyond 20 digits."""
    same(name, events=f"select event_id + [0, 11103, 599000, {most}][event_id % 4 + 1] as event_id, * exclude (event_id) from events")


@pytest.mark.parametrize("name", ["memory_trace", "reservation_trace"])
def test_reads_without_duration(same, name):
    """Reads that take no time, end before they begin, or end at the begin of others."""
    rows = same(name, events="select * exclude (value), case when event_id % 97 = 5 then 0 when event_id % 211 = 7 then -3.5 when event_id % 7 = 1 then floor(value) else value end as value from events")
    assert sum("null" in r for r in rows) >= 10


def test_exposition_of_a_million_reads(same):
    """A gauge of counts is written in full."""
    rows = same("exposition_text", events="select event_id + i * 100000 as event_id, * exclude (event_id, i) from events, range(1001) t(i)")
    assert any("reads_all 1001000" in r for r in rows)


@pytest.mark.parametrize(("ids", "weights", "top"), [
    ([f"c{4 * i + 1:06}" for i in range(3000)], [(i % 97) ** 3 + 0.5 for i in range(3000)], 3), ([f"x{i}" for i in range(2000)] + [""], [1.0] * 2001, 1), ([f"d{i % 500}" for i in range(4000)], [1.0 + i % 9 for i in range(4000)], 3),
    ([f"h{i}" for i in range(2000)], [1e9] + [1.0] * 1999, 2), (["\u00e9" * (i % 7) + chr(200 + i) for i in range(1500)], [1e-9 * (i + 1) for i in range(1500)], 5),
])
def test_sieve_is_exact(ids, weights, top):
    """Gaps, an empty id, ids that repeat, a node that holds the weight, long characters."""
    keys = np.random.default_rng(5).integers(0, 2**63, 200).astype(np.uint64)
    rank = P.Ranker(np.array(ids, object), np.array(weights), top)
    best, score = rank._all(keys)
    assert rank.sieve is not None
    passed = rank.sieve(keys)[0]
    assert len(passed) < len(keys) * len(ids) / 8
    got = list(rank(keys))
    assert (rank.ids[np.concatenate([b for _, b, _ in got])] == rank.ids[best]).all() and (np.concatenate([s for *_, s in got]) == score).all()


@pytest.mark.parametrize("block", [50_000, 400])
def test_ranks_do_not_depend_on_the_sieve(spark, monkeypatch, block):
    monkeypatch.setattr(P, "NODE_BLOCK", block)
    keys = spark.range(100).selectExpr("id as key")
    nodes = spark.range(600).selectExpr("concat('Supplier#', lpad(id, 9, '0')) as node_id", "cast(id % 89 as double) as weight")
    ranked = lambda: sorted((r.key, r["rank"], r.node_id) for r in P.rank_nodes(keys, nodes, 3).collect())
    got = ranked()
    monkeypatch.setattr(P.Ranker, "SIEVED_SHARE", 10**9)
    assert got == ranked() and len(got) == 300


@pytest.mark.parametrize(("ids", "kinds"), [
    ([f"Supplier#{i:09d}" for i in range(5000)], 1), ([f"Customer#{4 * i + 1:09d}" for i in range(5000)], 2), ([f"n{i % 3}{'x' * (i % 4)}{i:04}" for i in range(5000)], 9),
])
def test_nodes_are_sieved_in_whole_blocks(ids, kinds):
    """Stems that end in the same bytes meet keys without being picked one by one; ranks are those of all scores."""
    weights = np.random.default_rng(3).uniform(1, 10_000, len(ids))
    rank = P.Ranker(np.array(ids, object), weights, 1)
    ends = {tuple(byte for byte, *_ in pieces) for *_, pieces in rank.sieve.blocks}
    assert len(ends) <= kinds + 1
    if kinds < 3:
        assert all(rows is None for *_, pieces in rank.sieve.blocks for _, rows, *_ in pieces)
    keys = np.random.default_rng(5).integers(0, 2**63, 300).astype(np.uint64)
    (at, best, score), (want, most) = next(rank(keys)), rank._all(keys)
    assert at == 0 and (best == want).all() and (score == most).all()


def test_nodes_that_are_small_are_sent_to_every_task(spark):
    """More nodes than a block holds, without groups of keys and nodes."""
    keys = spark.range(40).selectExpr("id as key")
    ids, weights = [f"Customer#{4 * i + 1:09d}" for i in range(60_000)], [1.0 + i % 97 for i in range(60_000)]
    nodes = spark.range(60_000).selectExpr("concat('Customer#', lpad(4 * id + 1, 9, '0')) as node_id", "cast(1 + id % 97 as double) as weight")
    ranked = P.rank_nodes(keys, nodes, 2)
    assert "CoGroup" not in ranked._jdf.queryExecution().toString()
    rank = P.Ranker(np.array(ids, object), np.array(weights), 2)
    want = {(k, r + 1, rank.ids[n]) for k, row in enumerate(rank._all(np.arange(40).astype(np.uint64))[0]) for r, n in enumerate(row)}
    assert {(r.key, r["rank"], r.node_id) for r in ranked.collect()} == want


def test_nodes_with_long_ids_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_BYTES", 20_000)
    keys = spark.range(50).selectExpr("id as key")
    nodes = spark.range(600).selectExpr("concat('Supplier#', lpad(id, 40, '0')) as node_id", "cast(id % 89 as double) as weight")
    ranked = lambda: sorted((r.key, r["rank"], r.node_id) for r in P.rank_nodes(keys, nodes, 3).collect())
    assert "CoGroup" in P.rank_nodes(keys, nodes, 3)._jdf.queryExecution().toString()
    got = ranked()
    monkeypatch.setattr(P, "BROADCAST_BYTES", 1 << 25)
    assert got == ranked() and len(got) == 150


def _tree_view(spark, n):
    return spark.range(n).selectExpr("concat('m', id) as id", "case when id % 5 = 0 then null when id % 7 = 0 then '' else concat('h:', id) end as addr", "cast(1 + id % 9 as double) as weight", "cast(id % 3 as int) as role", "1 as state")


def test_trees_are_not_sent_to_the_driver(spark):
    """A tree of many nodes isn't taken for as small as its key."""
    keys, view = spark.range(3).selectExpr("id as key"), _tree_view(spark, 50_000)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        trees = P.tree_nodes(keys, view, "m9")
        order = keys.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.concat(F.lit("m"), i.cast("string")))).alias("pos", "node_id"))
        found = T.fetch_targets(order, view, view.where("id like '%11'"))
        assert "Broadcast" not in plan(trees) + plan(found)
        assert trees.groupBy("key").count().collect() and found.where("target is not null").count() > 6000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize(("fanout", "root_fanout"), [(2, 1), (1, 3), (3, 2), (8, 1), (1, 1), (0, 1)])
def test_targets_are_the_nearest_usable_ancestors(spark, fanout, root_fanout):
    view = _tree_view(spark, 90)
    order = spark.range(4).selectExpr("id as key", "explode(sequence(0, 11 + 25 * id)) as pos").selectExpr("key", "cast(pos as int) as pos", "concat('m', (pos * 7 + key * 13 + 1) % 97) as node_id").orderBy(F.rand(3))
    broken = spark.createDataFrame([(f"h:{i}",) for i in range(0, 90, 11)] * 2, "addr string")
    shut = {f"h:{i}" for i in range(0, 90, 11)}
    addr = {r.id: r.addr for r in view.collect() if r.addr and r.addr not in shut}
    rows = order.collect()
    node = {(r.key, r.pos): r.node_id for r in rows}
    sized = order.join(order.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("k", F.lit(fanout)).withColumn("root_k", F.lit(root_fanout)).withColumn("pos", F.col("pos").cast("bigint"))
    up: dict = {}
    for r in sorted(T.ancestors(sized, ["key"]).collect(), key=lambda r: r.hop):
        if node[r.key, r.ancestor] in addr:
            up.setdefault((r.key, r.pos), []).append((r.ancestor, r.hop, addr[node[r.key, r.ancestor]]))
    want = set()
    for at, name in node.items():
        t = up.get(at, [])
        want.add((*at, name, t[0][2] if t else None, t[1][2] if t[1:] else None, None if not t else "root" if t[0][0] == 0 else "parent" if t[0][1] == 1 else "ancestor"))
    got = [tuple(r) for r in T.fetch_targets(order, view, broken, fanout, root_fanout).collect()]
    assert set(got) == want and len(got) == len(rows) and (fanout == 0 or any(r[5] for r in got))
