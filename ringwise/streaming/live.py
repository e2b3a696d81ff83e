"""The same state machines as Structured Streaming operators.

State is keyed and kept by the state store. Events carry their time in microseconds (``at``); timers fire in event time
behind a watermark, as a stream has no wall clock of its own: cooldowns end, leases run out and members are forgotten
without a further event, and a key that says nothing any more leaves the state store. A micro-batch sorts the events
of a key before it folds them, so the source's rate limit bounds what a task holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.identity import valid_member_id
from .machines import Breaker, Circuit, Member, Reading, Tracker


def _stream(events: DataFrame, key: str, late: str, fields: str, load: Callable, step: Callable, tick: Callable, save: Callable, show: Callable) -> DataFrame:
    """One row of ``fields`` for each key that a batch touches or whose timer fires.

    ``load(saved or None) -> machine``; ``step(machine, row)`` folds an event, ``tick(machine, now)`` a timer;
    ``save(machine) -> (saved, due)``: the state and when its timer fires, None for a state that may go; ``show(machine)``: the row.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = load(json.loads(state.get[0]) if state.exists else None)
        seen = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            tick(machine, seen * 1000)
        else:
            for r in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples(index=False):
                step(machine, r)
        saved, due = save(machine)
        if due is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(saved),))
            state.setTimeoutTimestamp(max(-(-due // 1000), seen + 1))
        yield pd.DataFrame([(k[0], *show(machine))], columns=[f.split()[0] for f in fields.split(", ")])

    timed = events.withColumn("_ts", F.timestamp_micros("at")).withWatermark("_ts", late)
    return timed.groupBy(key).applyInPandasWithState(run, fields, "saved string", "update", GroupStateTimeout.EventTimeTimeout)


def stream_breakers(outcomes: DataFrame, threshold: int = 5, cooldown_us: int = 5_000_000, idle_us: int = 600_000_000, late: str = "0 seconds") -> DataFrame:
    """Streaming form of ``breaker_states``: ``(peer, state, failures)`` of each peer that a batch touches, and when its cooldown ends.

    A closed circuit without failures isn't kept; any other one is forgotten after ``idle_us`` without an event.
    """

    def load(saved: dict | None) -> tuple[Breaker, list]:
        b = Breaker(threshold, cooldown_us)
        if saved:
            b.circuits[""] = Circuit(1, threshold)
            b.circuits[""].__dict__.update(saved["circuit"])
        return b, [saved["last"] if saved else 0]

    def step(m: tuple[Breaker, list], r) -> None:
        m[0].record("", int(r.at), r.outcome)
        m[1][0] = int(r.at)

    def save(m: tuple[Breaker, list]) -> tuple[dict, int | None]:
        c, last = m[0].circuits[""], m[1][0]
        due = c.opened_at + cooldown_us if c.phase == "open" else last + idle_us
        return {"circuit": c.__dict__, "last": last}, None if (c.phase == "closed" and not c.failures) or m[1][1:] else due

    def tick(m: tuple[Breaker, list], now: int) -> None:
        if m[0].due("", now) and now >= m[1][0] + idle_us:
            m[1].append(now)  # idle: it goes

    kind = dict(outcomes.dtypes)["peer"]
    return _stream(outcomes, "peer", late, f"peer {kind}, state string, failures bigint", load, step, tick, save, lambda m: (m[0].circuits[""].phase, m[0].circuits[""].failures))


def stream_trackers(events: DataFrame, tick_us: int = 3_000_000, grace_us: int = 60_000_000, late: str = "0 seconds") -> DataFrame:
    """Streaming form of ``tracker_states``: ``(file, epoch, readers)`` of each file that a batch touches, and when leases run out.

    A file without a lease that nobody asked for in the grace time leaves the state.
    """

    def load(saved: dict | None) -> Tracker:
        t = Tracker(tick_us, grace_us)
        if saved:
            t.next_sweep = saved["sweep"]
            t.files[""] = Reading()
            t.files[""].__dict__.update(saved["file"])
        return t

    def tick(t: Tracker, now: int) -> None:
        t.sweep(now)
        if "" in t.files:
            t.refresh(now, t.files[""])

    def save(t: Tracker) -> tuple[dict, int | None]:
        f = t.files.get("")
        if f is None:
            return {}, None
        return {"sweep": t.next_sweep, "file": f.__dict__}, min(f.leases.values()) if f.leases else f.active + grace_us + 1

    def show(t: Tracker) -> tuple:
        f = t.files.get("", Reading())
        return f.epoch, f.published

    return _stream(events, "file", late, "file string, epoch bigint, readers array<string>", load, lambda t, r: t.call(int(r.at), r.op, "", r.node, int(r.ttl_us)), tick, save, show)


def stream_members(reports: DataFrame, forget_after_us: int = 60_000_000, late: str = "0 seconds") -> DataFrame:
    """Streaming form of ``membership_states``: ``(id, published, role, weight)`` of each member that a batch touches, and when it is forgotten."""

    def load(saved: dict | None) -> Member:
        m = Member(forget_after_us)
        m.__dict__.update(saved or {})
        return m

    def tick(m: Member, now: int) -> None:
        if now - m.last > forget_after_us:
            m.forget()

    checked = reports.withColumn("valid", valid_member_id(F.col("id")))
    step = lambda m, r: m.event(int(r.at), r.op, r.addr, r.weight, r.role, r.valid)
    return _stream(checked, "id", late, "id string, published boolean, role int, weight double", load, step, tick, lambda m: (m.__dict__, m.last + forget_after_us + 1 if m.known else None), lambda m: (m.known and m.confirmed, m.role, m.weight))


def latest_versions(versions: DataFrame, path: str, key: str = "subscriber", version: str = "version"):
    """Start a query that keeps the latest version a subscriber should see; a slow one skips those between."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(key).agg(F.max(version).alias(version)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return versions.writeStream.outputMode("append").option("checkpointLocation", f"{path}-state").foreachBatch(save).trigger(availableNow=True).start()


def seen_versions(spark, path: str, key: str = "subscriber", version: str = "version") -> DataFrame:
    """What ``latest_versions`` has kept: the latest version of each subscriber over all batches."""
    return spark.read.parquet(path).groupBy(key).agg(F.max(version).alias(version))
