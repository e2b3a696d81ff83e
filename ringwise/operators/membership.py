"""Membership views, filters, reports and rosters."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import u64
from .ordered import carry_last

JOINING, READY, SUSPECT, LEAVING = 0, 1, 2, 3
ORDINARY, ROOT_ONLY, NON_ROOT = 0, 1, 2


def state_rank(state: Column) -> Column:
    """Which state wins where an id is reported twice: ready, suspect, joining, any other."""
    return F.when(state == READY, 3).when(state == SUSPECT, 2).when(state == JOINING, 1).otherwise(0)


def canonical(members: DataFrame) -> DataFrame:
    """One row per id of ``members(id, addr, weight, role, state)``: best state, then least weight, role and address.

    The minimum of a struct combines before the shuffle, where a window would move every row.
    """
    order = F.struct((-state_rank(F.col("state"))).alias("r"), "weight", "role", "addr", "state")
    return members.groupBy("id").agg(F.min(order).alias("m")).select("id", "m.addr", "m.weight", "m.role", "m.state")


def ready(v: DataFrame) -> DataFrame:
    return v.where(F.col("state") == READY)


def live(v: DataFrame) -> DataFrame:
    return v.where(F.col("state").isin(READY, SUSPECT))


def state_name(state: Column) -> Column:
    return F.when(state == JOINING, "Joining").when(state == READY, "Ready").when(state == SUSPECT, "Suspect").when(state == LEAVING, "Leaving").otherwise("Unknown")


def roots(v: DataFrame) -> DataFrame:
    return ready(v).where(F.col("role") != NON_ROOT)


def readers(v: DataFrame) -> DataFrame:
    return ready(v).where(F.col("role") != ROOT_ONLY)


def expire(reports: DataFrame, now: Column, forget_after: Column) -> DataFrame:
    """``(id, last_contact)`` of members heard of directly within ``forget_after``; ``reports(id, ts, direct)``.

    Third-party reports neither confirm a member nor refresh its clock. Exactly at the limit it stays.
    """
    last = reports.where("direct").groupBy("id").agg(F.max("ts").alias("last_contact"))
    return last.where(now - F.col("last_contact") <= forget_after)


def refresh_targets(seeds: DataFrame, known: DataFrame, me: str) -> DataFrame:
    """Distinct addresses of seeds and known members, without the own and empty ones; each ``(addr)``."""
    return seeds.select("addr").union(known.select("addr")).where((F.col("addr") != me) & (F.col("addr") != "")).distinct()


def eligible_readers(reader_ids: DataFrame, view: DataFrame) -> DataFrame:
    """Readers that are ready, may read and have an address."""
    able = readers(view).where("addr is not null and addr != ''")
    return reader_ids.join(able, "id", "left_semi")


def complete_roster(roster: DataFrame, responder: DataFrame) -> DataFrame:
    """The roster with its responder added where it is missing."""
    return roster.unionByName(responder.join(roster, "id", "left_anti"))


def roster_conflicts(roster: DataFrame, responder: str) -> DataFrame:
    """Rows ``(id, n)`` for a responder that is listed more than once; such a roster is rejected."""
    return roster.where(F.col("id") == responder).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def select_roster(view: DataFrame, digest: str, known_digest: str, me: str) -> DataFrame:
    """Only the own row for a caller that knows the digest, else all members with an address."""
    if digest == known_digest:
        return view.where(F.col("id") == me)
    return view.where("addr is not null and addr != ''")


def decode_rosters(raw: DataFrame, col: str = "json") -> DataFrame:
    """``(*raw.columns, epoch, members, valid)``: rosters as JSON; each member must have a role."""
    shape = "struct<epoch:string,members:array<struct<id:string,addr:string,weight:double,role:int>>>"
    parsed = raw.withColumn("_r", F.from_json(col, shape))
    good = F.col("_r.epoch").rlike("^[0-9]+$") & ~F.exists(F.coalesce("_r.members", F.array()), lambda m: m["role"].isNull() | m["id"].isNull())
    return parsed.select(*raw.columns, F.col("_r.epoch").alias("epoch"), F.col("_r.members").alias("members"), F.coalesce(good, F.lit(False)).alias("valid"))


def as_of(events: DataFrame, versions: DataFrame, ts: str = "ts", valid_from: str = "valid_from", payload: tuple[str, ...] = ("epoch",), by: tuple[str, ...] = (), cell_us: int = 600_000_000) -> DataFrame:
    """``events`` with the payload of the latest version at or before each.

    Versions and events are one stream, in which the last version is carried on by cells of time: no range join, and no task
    sorts more than a cell.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("_at")
    pack = F.struct(*[F.col(p).alias(f"_{p}") for p in payload])
    e = events.select("*", F.lit(1).alias("_kind"), micros(ts), F.lit(None).cast(versions.select(pack.alias("p")).schema["p"].dataType).alias("_pack"))
    v = versions.select(*by, micros(valid_from), F.lit(0).alias("_kind"), pack.alias("_pack"))
    both = carry_last(e.unionByName(v, allowMissingColumns=True), F.col("_pack"), list(by), "_at", ["_kind"], cell_us)
    return both.where("_kind = 1").select(*events.columns, *[F.col(f"_carried._{p}").alias(p) for p in payload])


def _with_start(rows: DataFrame) -> DataFrame:
    """Rows in id order behind one without an id, so that a fold over none still starts."""
    start = rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.where("id is not null").unionByName(start).repartition(1).sortWithinPartitions("id")


def epoch(members: DataFrame, domain: bytes) -> DataFrame:
    """One row ``(epoch)``: the 64-bit fold of the canonical members in id order.

    ``domain`` is the deployment's label, folded first. Per member: id, unit separator, big-endian bits of
    the weight, role byte, record separator. A membership table is small, and the fold is ordered.
    """
    rows = _with_start(members.select("id", "weight", "role"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = np.full(1, u64.FNV_OFFSET, np.uint64)
        h = u64.np_fnv(h, [domain])
        for b in batches:
            for i, w, r in (x for x in zip(b["id"], b["weight"], b["role"], strict=True) if x[0] is not None):
                h = u64.np_fnv(h, [i.encode() + b"\x1f" + struct.pack(">d", w) + bytes([int(r)]) + b"\x1e"])
        yield pd.DataFrame({"epoch": u64.np_fmix64(h).view(np.int64)})

    return rows.mapInPandas(run, "epoch bigint")


def roster_digest(members: DataFrame, domain: bytes) -> DataFrame:
    """One row ``(digest)``: "v1-" and the SHA-256 of the members with an address, in id order, each field behind its length."""
    rows = _with_start(members.where("addr is not null and addr != ''").select("id", "addr", "weight", "role"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = hashlib.sha256(domain)
        for b in batches:
            for i, a, w, r in (x for x in zip(b["id"], b["addr"], b["weight"], b["role"], strict=True) if x[0] is not None):
                for s in (i.encode(), a.encode()):
                    h.update(struct.pack(">Q", len(s)) + s)
                h.update(struct.pack(">d", w) + bytes([int(r)]))
        yield pd.DataFrame({"digest": ["v1-" + h.hexdigest()]})

    return rows.mapInPandas(run, "digest string")


def endpoint_addresses(slices: DataFrame) -> DataFrame:
    """``(addr)``: first address of each ready-or-unknown endpoint with the slice's port, sorted.

    ``slices(port int, endpoints array<struct<addresses:array<string>,ready:boolean>>)``.
    """
    e = slices.where("port is not null").select("port", F.explode("endpoints").alias("e"))
    good = e.where(F.coalesce("e.ready", F.lit(True)) & (F.size("e.addresses") > 0))
    return good.select(F.concat_ws(":", F.col("e.addresses")[0], F.col("port").cast("string")).alias("addr")).distinct().orderBy("addr")


def reader_snapshots(responses: DataFrame) -> DataFrame:
    """``(object, tracker, epoch, readers)``: of ``responses(object, tracker, started, epoch, readers)`` the one that started last.

    A response that was asked for earlier can't replace a later one, however late it comes in.
    """
    last = F.struct("started", "epoch")
    return responses.groupBy("object", "tracker").agg(F.max_by("epoch", last).alias("epoch"), F.max_by("readers", last).alias("readers"))


def changed_readers(snapshots: DataFrame, by: list[str], order: str, readers: str = "readers") -> DataFrame:
    """The rows of ``snapshots`` whose reader set isn't that of the row before, in ``order``; sets are equal in any order."""
    w = Window.partitionBy(*by).orderBy(order)
    sets = snapshots.withColumn("_set", F.array_sort(F.array_distinct(readers)))
    return sets.withColumn("_was", F.lag("_set").over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col("_set"))).drop("_set", "_was")
