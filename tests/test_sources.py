from __future__ import annotations

from pyspark.sql import functions as F

from ringwise.operators import membership as M
from ringwise.operators import metrics as X
from ringwise.operators import ordered as O
from ringwise.operators import flights as L
from ringwise.sources import rosters as R


def test_block_source(spark, tmp_path):
    (tmp_path / "o").write_bytes(bytes(range(256)) * 10)
    spark.dataSource.register(R.BlockSource)
    rows = spark.read.format("blocks").option("size", 2560).option("blockSize", 1000).load(str(tmp_path / "o")).orderBy("block").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 999), (1000, 1999), (2000, 2559)] and b"".join(bytes(r.data) for r in rows) == bytes(range(256)) * 10


    whole = spark.read.format("blocks").option("blockSize", 1000).load(f"file://{tmp_path}/o")
    assert sorted((r.start, r.end) for r in whole.collect()) == [(0, 999), (1000, 1999), (2000, 2559)]  # the size is asked for


def test_discovery_tables(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"port":80,"endpoints":[{"addresses":["10.0.0.1","x"],"ready":true},{"addresses":["10.0.0.2"]},{"addresses":["10.0.0.3"],"ready":false},{"addresses":[]}]}\n{"endpoints":[{"addresses":["10.0.0.4"]}]}\n')
    assert [r.addr for r in R.endpoint_slices(spark, str(tmp_path / "s")).collect()] == ["10.0.0.1:80", "10.0.0.2:80"]
    seeds = spark.createDataFrame([("dns:peers.example:90",), ("a:1,b:2",), ("dns:none.example:1",), ("bad",)], "spec string")
    answers = spark.createDataFrame([("peers.example", "10.0.0.9"), ("peers.example", "fd00::1"), ("peers.example", "10.0.0.9")], "name string, ip string")
    assert sorted(r.addr for r in R.seed_addresses(seeds, answers).collect()) == ["10.0.0.9:90", "[fd00::1]:90", "a:1", "b:2"]


def test_rosters_and_leases(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"epoch":"7","members":[{"id":"a","addr":"h","weight":1,"role":0}]}\n{"epoch":"8","members":[{"id":"a","addr":"h","weight":1}]}\n{"epoch":"x","members":[]}\nnot json\n')
    assert sorted((str(r.epoch), r.valid) for r in R.read_rosters(spark, str(tmp_path / "r")).collect()) == [("7", True), ("8", False), ("None", False), ("x", False)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text('{"file":"f","node":"n","ttlMs":5,"op":"join","at":"1970-01-01T00:00:01Z","seq":1}\n{"file":"","node":"n","op":"join"}\nnot json\n{"file":"' + "x" * 70_000 + '","node":"n","op":"join"}\n')
    assert R.lease_events(spark, str(tmp_path / "l")).count() == 1
    assert R.lease_events(spark, str(tmp_path / "l")).first() == ("f", 1_000_000, 1, "n", "join", 5000)
    got = R.static_members(spark, "a@h:1#non-root, b@h:2,bad").collect()
    assert [(r.id, r.addr, r.role) for r in got] == [("a", "h:1", 2), ("b", "h:2", 0), (None, None, 0)]


def test_canonical_doesnt_depend_on_order(spark):
    rows = [("a", "x", 1.0, 0, s) for s in (3, 2, 0)] + [("b", "y", 2.0, 1, 1), ("b", "y", 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "id string, addr string, weight double, role int, state int")
    want = {("a", "x", 1.0, 0, 2), ("b", "y", 1.0, 1, 1)}
    for n in (1, 3, 7):
        assert {tuple(r) for r in M.canonical(df.repartition(n)).collect()} == want
    assert M.epoch(df.limit(0), b"d").count() == 1 and M.roster_digest(df.limit(0), b"d").count() == 1
    e = lambda d: M.epoch(M.canonical(d), b"d").first().epoch
    moved = df.withColumn("addr", F.lit("z"))
    assert e(df) == e(df.repartition(5)) == e(moved) and M.roster_digest(M.canonical(df), b"d").first() != M.roster_digest(M.canonical(moved), b"d").first()
    assert e(df) != e(df.withColumn("role", F.lit(2)))


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (0.05, 0.1, 0.5, 5.0, 100.0)], "v double").withColumn("g", F.lit(1))
    got = {r.le: r.n for r in X.histogram(df, ["g"], "v", [10.0, 0.1, 1.0, 1.0]).collect()}
    assert got == {"0.1": 2, "1": 3, "10": 4, "+Inf": 5}


def test_number_text(spark):
    want = {0.0: "0", 1.0: "1", -2.5: "-2.5", 100000.0: "100000", 1e6: "1e+06", 1234567.0: "1.234567e+06", 1.5e7: "1.5e+07", 0.0001: "0.0001", 0.00015: "0.00015", 0.00001: "1e-05", 1e21: "1e+21", 0.001: "0.001", 105.65: "105.65", 999999.5: "999999.5", 1e100: "1e+100", float("inf"): "+Inf"}
    df = spark.createDataFrame([(x,) for x in want], "x double")
    assert {r.x: r.t for r in df.select("x", X.number_column(F.col("x")).alias("t")).collect()} == want == {x: X.number_text(x) for x in want}
    assert X.number_text(float("nan")) == "NaN"


def test_exposition_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", 'he\\l"p\nx', "gauge", {"a": 'q"\n'}, 1.5), (2, "bare", "", "counter", {}, 2.0)], "seq int, name string, help string, kind string, labels map<string,string>, value double")
    X.write_exposition(df, str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ['# HELP m he\\\\l"p\\nx', "# TYPE m gauge", 'm{a="q\\"\\n"} 1.5', "# TYPE bare counter", "bare 2"]


def test_carried_over_cells(spark):
    """The last mark is carried over as many cells as there are, also for a key that holds most rows."""
    rows = [("hot", i, i if i % 37 == 5 else None) for i in range(400)] + [("cold", 390, 7), ("cold", 391, None), (None, 3, 4), (None, 300, None)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    for cell in (1, 10, 1000):
        got = {(r.k, r.t): r._carried for r in O.carry_last(df, F.col("v"), ["k"], "t", [], cell).collect()}
        assert got == {(k, t): (7 if k == "cold" else 4 if k is None else max((x for x in range(t + 1) if x % 37 == 5), default=None)) for k, t, _ in rows}
        sums = {(r.k, r.t): r._sum for r in O.running_sum(df, F.col("t") * 2, ["k"], "t", [], cell).collect()}
        assert sums == {(k, t): (t * (t + 1) if k == "hot" else sum(x * 2 for kk, x, _ in rows if kk == k and x <= t)) for k, t, _ in rows}
        before = {(r.k, r.t): r._previous for r in O.previous(df, F.col("t"), ["k"], "t", [], cell).collect()}
        assert before == {(k, t): (None if (k, t) in (("hot", 0), ("cold", 390), (None, 3)) else 3 if k is None else t - 1) for k, t, _ in rows}


def test_quantile_over_blocks(spark):
    rows = [("hot", i * 7 % 1000, i, float(i * 37 % 101)) for i in range(1000)] + [("cold", 5, i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, s bigint, i bigint, v double").select("k", F.timestamp_seconds(F.col("s") * 600).alias("ts"), "i", "v")
    got = {(r.k, r.i): r.quantile for r in L.ring_quantile(df, ["k"], ["ts", "i"], "v", 0.5, ring=20, fewest=5).collect()}
    for k in ("hot", "cold"):
        own = sorted((s, i, v) for kk, s, i, v in rows if kk == k)
        for j, (_, i, _) in enumerate(own):
            last = sorted(v for *_, v in own[max(0, j - 20) : j])
            assert got[k, i] == (last[min(len(last) // 2, len(last) - 1)] if len(last) >= 5 else None)


def test_quantile_index(spark):
    df = spark.range(101).select(F.lit(1).alias("g"), "id", F.col("id").cast("double").alias("v"), F.timestamp_seconds("id").alias("ts"))
    last = L.ring_quantile(df, ["g"], ["ts", "id"], "v", 0.99).orderBy(F.desc("id")).first()
    assert last["quantile"] == 99.0
    assert L.ring_quantile(df.where("id < 16"), ["g"], ["ts", "id"], "v", 0.5).where("quantile is not null").count() == 0


def test_flights_anchor_at_their_leader(spark):
    rows = [("k", t, i) for i, t in enumerate([0, 4, 8, 12, 30])]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint").select("k", F.timestamp_micros("t").alias("ts"), "i")
    assert sorted((r.leader, r.start_us, r.calls) for r in L.coalesced_flights(df, ["k"], "ts", "i", 10).collect()) == [(0, 0, 3), (3, 12, 1), (4, 30, 1)]
