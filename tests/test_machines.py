"""State machines by scripts of events, and their streaming forms against the batch ones."""

from __future__ import annotations

import pytest

from ringwise.operators import cachesim as C
from ringwise.streaming import live
from ringwise.streaming import machines as S

SECOND = 1_000_000


def state(b, at=None):
    return b.due("p", at).phase if at is not None else b.circuits["p"].phase


def test_breaker():
    b = S.Breaker(3, 5 * SECOND)
    record = lambda at, outcome: b.record("p", at, outcome) and state(b)
    assert [record(i, "soft_fail") for i in range(3)] == ["closed", "closed", "open"]
    assert record(4, "neutral") == "open"
    assert state(b, 2 + 5 * SECOND) == "half_open"
    assert record(3 + 5 * SECOND, "soft_fail") == "open"
    assert record(9 + 10 * SECOND, "answered") == "closed" and b.circuits["p"].failures == 0
    assert record(10 + 10 * SECOND, "hard_fail") == "open" and b.open_count(10 + 10 * SECOND) == 1 and b.open_count(16 * SECOND) == 0


@pytest.mark.parametrize("vetoed", [False, True])
def test_probes_wait_for_their_siblings(vetoed):
    b = S.Breaker(5, 60 * SECOND, probes=2)
    b.record("p", 0, "hard_fail")
    assert b.begin("p", 1) is None and b.begin("p", 1, enforce=False) is not None
    at = 120 * SECOND
    first, second = b.begin("p", at), b.begin("p", at)
    assert first.probe and second.probe and b.begin("p", at) is None
    assert b.record("p", at + 1, "answered", second) and state(b) == "half_open"  # its sibling is still under way
    assert b.begin("p", at + 2) is None  # nobody joins a cohort that was answered
    assert b.record("p", at + 3, "hard_fail" if vetoed else "neutral", first)
    assert state(b) == ("open" if vetoed else "closed")
    if not vetoed:
        assert b.begin("p", at + 4).generation == 2


def test_late_results_are_ignored():
    b = S.Breaker(1, 5 * SECOND)
    early = b.begin("p", 0)
    b.record("p", 1, "soft_fail")
    assert not b.record("p", 2, "answered", early) and state(b) == "open"
    probe = b.begin("p", 6 * SECOND)
    assert not b.record("p", 6 * SECOND + 1, "soft_fail", early) and b.circuits["p"].probing == 1
    assert b.record("p", 6 * SECOND + 2, "neutral", probe) and state(b) == "half_open" and b.circuits["p"].probing == 0


def test_capacity_of_a_breaker():
    b = S.Breaker(2, 5 * SECOND, capacity=3)
    for i, p in enumerate("abc"):
        b.record(p, i, "soft_fail")
    b.record("b", 5, "answered")
    old = b.begin("a", 6)
    b.record("d", 7, "soft_fail")  # b says nothing any more
    assert set(b.circuits) == {"a", "c", "d"}
    b.record("e", 8, "soft_fail")  # c was used least recently
    assert set(b.circuits) == {"a", "d", "e"}
    b.record("f", 9, "soft_fail")
    b.record("a", 10, "soft_fail")
    assert not b.record("a", 11, "answered", old)  # another circuit under the same address


def test_tracker():
    t = S.Tracker(3 * SECOND, 60 * SECOND)
    f = t.join(0, "f", "b", 6 * SECOND)
    t.join(1, "f", "a", 6 * SECOND)
    assert f.published == ["a", "b"] and f.epoch == 2  # growth at once
    t.join(2, "f", "a", 6 * SECOND)
    assert f.epoch == 2  # a renewal changes nothing
    assert t.leave(3, "f", "a").published == ["a", "b"]  # departures wait for the tick
    assert t.readers(4 * SECOND, "f").published == ["b"] and f.epoch == 3
    assert t.readers(8 * SECOND, "f").published == []  # the lease ran out
    t.join(9 * SECOND, "f", "c", 0)
    t.leave(9 * SECOND, "f", "c")
    assert not t.files and t.readers(9 * SECOND, "f").epoch == 0  # the last leave forgets the file


def test_any_call_sweeps_all_files():
    t = S.Tracker(3 * SECOND, 10 * SECOND)
    t.join(0, "f", "a", 2 * SECOND)
    t.join(0, "f", "b", 60 * SECOND)
    t.readers(4 * SECOND, "g")
    assert set(t.files["f"].leases) == {"b"} and t.files["f"].published == ["a", "b"]  # swept, but not published yet
    t.leave(5 * SECOND, "f", "b")
    assert not t.files
    t.join(6 * SECOND, "f", "a", SECOND)
    t.readers(16 * SECOND, "g")
    assert "f" in t.files  # idle for the grace time, not longer
    t.readers(20 * SECOND, "g")
    assert not t.files


def test_member():
    m = S.Member(10)
    assert m.event(0, "learn", "h", 0.0, 0) == ("new", False) and m.weight == 1.0
    assert m.event(5, "confirm", "", 0, 0) == ("confirmed", True)
    assert m.event(6, "member", "h", 2.0, 1) == ("updated", True) and m.role == 1
    assert m.event(7, "learn", "h", 3.0, 2)[1] and m.role == 1 and m.weight == 3.0  # a direct role stays
    assert m.event(8, "learn", "h", 3.0, 3) == ("bad_role", True) and m.event(8, "peer", "h", 3.0, 0, False) == ("bad_id", True)
    assert m.event(16, "learn", "h", 3.0, 0)[1]
    assert m.event(17, "learn", "h", 3.0, 0) == ("new", False)  # hearsay doesn't refresh the clock
    assert m.event(30, "confirm", "", 0, 0) == ("unknown", False)
    p = S.Member(10)
    assert p.event(0, "peer", "h", 9.0, 2) == ("new", True) and (p.role, p.weight) == (0, 1.0)
    p.event(1, "learn", "k", 4.0, 2)
    assert p.event(2, "peer", "h", 9.0, 1)[1] and (p.role, p.weight, p.addr) == (2, 4.0, "h")  # a call tells no role
    late = S.Member(10, refresh_us=20)
    late.event(1, "member", "h", 1.0, 0)
    assert late.event(19, "learn", "h", 1.0, 0)[1] and not late.event(21, "learn", "h", 1.0, 0)[1]  # forgotten when a view is published


def test_sketch_and_tiered():
    s = C.Sketch(10)
    assert s.estimate(5) == 0
    s.increment(5)
    assert s.estimate(5) == 1
    for _ in range(30):
        s.increment(5)
    assert s.estimate(5) == 16
    t = C.Tiered(10, 0.8)
    for k in range(8):
        t.put(k, True)
    for k in range(100, 300):
        t.put(k, False)
    assert all(k in t.owned.keys for k in range(8)) and len(t.borrowed.keys) == 2 and t.rejected >= 0
    assert C.split_slots(10, 0.8) == (8, 2) and C.split_slots(10, 0.0) == (0, 10) and C.split_slots(2, 0.99) == (1, 1)
    with pytest.raises(ValueError):
        C.split_slots(1, 0.5)


def test_sketch_halves():
    s = C.Sketch(16, least=16)
    assert (len(s.counts), len(s.door), s.reset_at) == (64, 128, 160)
    for _ in range(160):
        s.increment(5)
    assert s.estimate(5) == 16 and s.adds == 159
    s.increment(5)  # the reset: counters halve, the doorkeeper forgets
    assert s.estimate(5) == 7 and s.adds == 0
    s.increment(5)
    assert s.estimate(5) == 8
    assert C.Sketch(10).places(12345) == C.Places()(12345)


def test_arena():
    a = C.Arena(2)
    x = a.reserve()
    assert a.acquire(1) is None and a.publish(x, 1)  # unseen until it is published
    y = a.reserve()
    assert a.reserve() is None and (a.waits, a.bypasses) == (1, 1)  # all pinned
    assert not a.publish(y, 1)  # visible already: this one stays private
    a.release(y)
    z = a.reserve()
    a.publish(z, 2)
    a.release(x)
    a.release(z)
    assert a.acquire(1) == x
    a.release(x)  # let go last, so evicted last
    w = a.reserve(lambda victim: victim == 2)
    assert w and a.acquire(2) is None and a.reserve(lambda victim: False) is None and a.bypasses == 2
    assert a.acquire(1) == x and a.delete(1) and not a.delete(1) and x in a.held
    a.release(x)
    assert x not in a.held


def test_memory_tiers():
    t = C.MemoryTiers(10, 0.8, 16)
    fill = lambda k, owned: (at := t.reserve(k, owned)) and (t.commit(k, at), t.release(at))
    for k in range(8):
        fill(k, True)
    for k in (20, 21):
        fill(k, False)
    for _ in range(3):
        t.release(t.acquire(20))
    assert t.reserve(99, False) is not None  # as frequent as the one let go first, 21
    assert t.reserve(98, False) is None and t.rejected == 1  # 20 is warm
    mine, other = t.reserve(20, True), t.acquire(20)
    assert t.commit(20, mine) and 20 not in t.borrowed.index  # promoted: the borrowed copy goes
    t.release(other)
    t.release(mine)
    assert not C.MemoryTiers(4, 1.0, 16).reserve(1, False) and t.stats()[0] == 8


def test_admissions_wait_in_order(spark):
    from ringwise.operators import flights as L

    rows = [("n", 0, 1, 6, 100, False), ("n", 10, 2, 6, 5, False), ("n", 20, 3, 3, 5, False), ("n", 30, 4, 1, 5, True), ("n", 99, 5, 5, 1000, False), ("n", 200, 6, 9, 5, False), ("m", 0, 7, 11, 5, False)]
    df = spark.createDataFrame(rows, "node string, at bigint, load bigint, bytes bigint, takes_us bigint, speculative boolean")
    got = {r.load: (r.admitted, r.waited_us) for r in L.admissions(df, ["node"], 10, 4, 2, 85).collect()}
    # 2 waits for 1's bytes, but gives up before; 3 fits meanwhile; 4 leaves two bytes and a load; 5 waits for 1.
    assert got == {1: (True, 0), 2: (False, 85), 3: (True, 0), 4: (True, 0), 5: (True, 1), 6: (False, 85), 7: (False, 85)}


def test_lease_flights(spark):
    from ringwise.operators import flights as L

    rows = [("k", 0, 1, 50, None), ("k", 10, 2, 50, None), ("k", 50, 3, 40, 60), ("k", 55, 4, 40, 58), ("k", 56, 5, 30, None), ("k", 57, 6, 30, None), ("k", 200, 7, 10, 201), ("j", 0, 8, 5, None)]
    df = spark.createDataFrame(rows, "key string, at bigint, call bigint, load_us bigint, leaves_at bigint")
    got = {r.call: (r.leader, r.started, r.shared) for r in L.lease_flights(df, ["key"]).collect()}
    # 3 leaves at 60, so 5 leads for 6; 4 left while it waited.
    assert got == {1: (1, 0, False), 2: (1, 0, True), 3: (None, None, False), 4: (None, None, False), 5: (5, 60, False), 6: (5, 60, True), 7: (None, None, False), 8: (8, 0, False)}


def run_stream(df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/cp-{name}").start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def source(spark, path, rows, schema):
    """A stream of one file a batch; the last row's time moves the watermark on."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)


def test_streams_match_batch(spark, tmp_path):
    schema = "peer bigint, at bigint, seq bigint, outcome string"
    rows = [(i % 3, i * SECOND, i, "soft_fail" if i % 5 < 3 else "answered") for i in range(60)]
    stream = source(spark, f"{tmp_path}/in", [rows], schema)
    got = {}
    for r in run_stream(live.stream_breakers(stream, 2, 400 * SECOND, late="1 hour"), "breakers", tmp_path):
        got[r.peer] = (r.state, r.failures)
    want = {}
    for r in S.breaker_states(spark.createDataFrame(rows, schema), 2, 400 * SECOND).orderBy("seq").collect():
        want[r.peer] = (r.state, r.failures)
    assert got == want
    joins = [("f", i * SECOND, i, f"n{i % 4}", "join" if i % 6 else "leave", 5 * SECOND) for i in range(30)]
    schema = "file string, at bigint, seq bigint, node string, op string, ttl_us bigint"
    last = S.tracker_states(spark.createDataFrame(joins, schema)).orderBy("seq").collect()[-1]
    assert [(r.epoch, r.readers) for r in run_stream(live.stream_trackers(source(spark, f"{tmp_path}/in2", [joins], schema), late="1 hour"), "trackers", tmp_path)] == [(last.epoch, last.readers)]


def test_timers_fire_without_events(spark, tmp_path):
    schema = "peer string, at bigint, seq bigint, outcome string"
    batches = [[("a", SECOND, 1, "hard_fail")], [("b", 8 * SECOND, 2, "answered")], [("b", 900 * SECOND, 3, "answered")], [("b", 901 * SECOND, 4, "answered")]]
    got = [(r.peer, r.state) for r in run_stream(live.stream_breakers(source(spark, f"{tmp_path}/a", batches, schema)), "timed_breakers", tmp_path)]
    assert got.index(("a", "open")) < got.index(("a", "half_open"))  # its cooldown ended without a request
    schema = "file string, at bigint, seq bigint, node string, op string, ttl_us bigint"
    batches = [[("f", SECOND, 1, "n", "join", 5 * SECOND)], [("g", 9 * SECOND, 2, "m", "join", 900 * SECOND)], [("g", 100 * SECOND, 3, "m", "join", SECOND)], [("g", 101 * SECOND, 4, "m", "join", SECOND)]]
    got = [(r.file, r.epoch, list(r.readers)) for r in run_stream(live.stream_trackers(source(spark, f"{tmp_path}/b", batches, schema)), "timed_trackers", tmp_path)]
    assert ("f", 1, ["n"]) in got and ("f", 2, []) in got and ("f", 0, []) in got  # the lease ran out, then the file was forgotten
    schema = "id string, at bigint, seq bigint, addr string, weight double, role int, op string"
    batches = [[("a", SECOND, 1, "h", 1.0, 1, "member")], [("b", 70 * SECOND, 2, "h", 1.0, 0, "peer")], [("b", 71 * SECOND, 3, "h", 1.0, 0, "peer")]]
    got = [(r.id, r.published, r.role) for r in run_stream(live.stream_members(source(spark, f"{tmp_path}/c", batches, schema)), "timed_members", tmp_path)]
    assert got.index(("a", True, 1)) < got.index(("a", False, 0)) and ("b", True, 0) in got


def test_slow_subscribers_skip_versions(spark, tmp_path):
    schema = "subscriber string, version bigint"
    stream = source(spark, f"{tmp_path}/in", [[("a", 1), ("a", 2), ("b", 1)], [("a", 5), ("a", 4)]], schema)
    live.latest_versions(stream, f"{tmp_path}/out").awaitTermination()
    per_batch = {(r.batch, r.subscriber): r.version for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(v for (_, s), v in per_batch.items() if s == "a") == [2, 5]
    assert {r.subscriber: r.version for r in live.seen_versions(spark, f"{tmp_path}/out").collect()} == {"a": 5, "b": 1}
