"""Queries over state machines, with their SQL: recursive queries that take one event of every key a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import LOG_SQL, access_log
from ..streaming import machines as S

HOUR = 3_600_000_000
#: Parameters of the queries, in hours where they are times.
THRESHOLD, COOLDOWN, PROBES, CAPACITY = 2, 24, 2, 16


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """The log, its times in microseconds, and outcomes: failed ones are soft or hard, every eleventh was cancelled."""
    log = access_log(spark, sf_dir)
    outcome = F.when(F.col("event_id") % 11 == 0, "neutral").when(F.col("failed"), F.when(F.col("event_id") % 7 == 0, "hard_fail").otherwise("soft_fail")).otherwise("answered")
    return log, F.unix_micros(F.col("ts").cast("timestamp")), outcome


_EVENTS = f"""
log as (select *, epoch_us(ts) as tm, case when event_id % 11 = 0 then 'neutral' when failed then case when event_id % 7 = 0 then 'hard_fail' else 'soft_fail' end else 'answered' end as outcome from ({LOG_SQL}))"""


def breaker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, at, outcome = _log(spark, sf_dir)
    return S.breaker_states(log.select(F.col("node").alias("peer"), at.alias("at"), F.col("event_id").alias("seq"), outcome.alias("outcome")), THRESHOLD, COOLDOWN * HOUR)


_BREAKERS = f"""{_EVENTS},
ev as (select node as peer, event_id as seq, tm, outcome, row_number() over (partition by node order by tm, event_id) as n from log),
s(peer, n, seq, st, fails, gen, opened) as (
  select distinct peer, 0::BIGINT, 0::BIGINT, 'closed', 0::BIGINT, 0::BIGINT, 0::BIGINT from ev
  union all
  select peer, n, seq, case when outcome = 'answered' then 'closed' when trips then 'open' else st end, case outcome when 'answered' then 0 when 'neutral' then fails else fails + 1 end,
    gen + case when trips or (outcome = 'answered' and st <> 'closed') then 1 else 0 end, case when trips then tm else opened end
  from (select *, ends_with(outcome, 'fail') and st <> 'open' and (outcome = 'hard_fail' or st = 'half_open' or fails + 1 >= {THRESHOLD}) as trips
    from (select ev.peer, ev.n, ev.seq, ev.tm, ev.outcome, s.fails, s.gen, s.opened, case when s.st = 'open' and ev.tm - s.opened >= {COOLDOWN * HOUR} then 'half_open' else s.st end as st
      from s join ev on ev.peer = s.peer and ev.n = s.n + 1)))"""
BREAKERS = f"with recursive {_BREAKERS} select peer, seq, st as state, fails as failures, gen as generation, opened as opened_at from s where n > 0"


def open_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers whose circuit is open an hour after the log's last event."""
    log, at, _ = _log(spark, sf_dir)
    end = log.agg((F.max(at) + HOUR).alias("end")).first()["end"]
    return S.open_circuits(breaker_trace(spark, sf_dir), F.lit(end), COOLDOWN * HOUR)


OPEN = f"""with recursive {_BREAKERS}, last as (select peer, max_by(st, n) as st, max_by(opened, n) as opened from s group by peer)
select count_if(st = 'open' and (select max(tm) from log) + {HOUR} - opened < {COOLDOWN * HOUR})::BIGINT as open from last"""


def breaker_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with permits: each takes up to 490 minutes, so that probes overlap and some results are late."""
    log, at, outcome = _log(spark, sf_dir)
    calls = log.select((F.col("node") % 25).alias("peer"), F.col("event_id").alias("req"), at.alias("began"), (at + F.floor(F.col("value") * 60_000_000).cast("bigint")).alias("ended_at"), outcome.alias("outcome"))
    return S.breaker_calls(calls, THRESHOLD, 6 * HOUR, PROBES)


CALLS = f"""
with recursive {_EVENTS},
twice as (select node % 25 as peer, event_id as req, outcome, tm, true as begins from log union all select node % 25, event_id, outcome, tm + floor(value * 60000000)::BIGINT, false from log),
ev as (select *, row_number() over (partition by peer order by tm, begins, req) as n from twice),
s(peer, n, req, begins, verdict, st, fails, gen, opened, probing, voted, permits) as (
  select distinct peer, 0::BIGINT, 0::BIGINT, false, '', 'closed', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, []::STRUCT(req BIGINT, gen BIGINT, probe BOOLEAN)[] from ev
  union all
  select peer, n, req, begins, case when begins then case when full_up then 'refused' when probe then 'probe' else 'admitted' end when mine is null then 'none' when live then 'counted' else 'late' end,
    case when closes then 'closed' when trips then 'open' else st end,
    case when closes or (ends and st = 'closed' and outcome = 'answered') then 0 when ends and ends_with(outcome, 'fail') then fails + 1 else fails end,
    gen + (closes or trips)::INTEGER, case when trips then tm else opened end, case when closes or trips then 0 else probing end, not closes and not trips and (voted or votes),
    case when not begins then list_filter(permits, lambda p: p.req <> ev_req) when full_up then permits else list_append(permits, {{'req': req, 'gen': gen, 'probe': probe}}) end
  from (select *, req as ev_req, ends and ends_with(outcome, 'fail') and st <> 'open' and (outcome = 'hard_fail' or st = 'half_open' or fails + 1 >= {THRESHOLD}) as trips,
      ends and outcome = 'answered' and st = 'half_open' as votes,
      ends and ((outcome = 'answered' and st = 'open') or (probing = 0 and st = 'half_open' and (outcome = 'answered' or (outcome = 'neutral' and voted)))) as closes
    from (select * exclude (probing), live and not begins as ends, begins and not full_up and st = 'half_open' as probe,
        case when begins then probing + (not full_up and st = 'half_open')::INTEGER when live and mine.probe then greatest(0, probing - 1) else probing end as probing
      from (select *, st = 'open' or (st = 'half_open' and (voted or probing >= {PROBES})) as full_up
        from (select * exclude (st, probing, voted), case when due then 'half_open' else st end as st, case when due then 0 else probing end as probing, voted and not due as voted
          from (select *, live and st = 'open' and tm - opened >= {6 * HOUR} as due
            from (select *, begins or coalesce(mine.gen = gen, false) as live
              from (select ev.peer, ev.n, ev.req, ev.tm, ev.begins, ev.outcome, s.st, s.fails, s.gen, s.opened, s.probing, s.voted, s.permits, list_filter(s.permits, lambda p: p.req = ev.req)[1] as mine
                from s join ev on ev.peer = s.peer and ev.n = s.n + 1))))))))
select peer, req, not begins as ended, verdict, st as state, fails as failures, gen as generation, probing from s where n > 0
"""


def breaker_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakers that hold few circuits, each over all peers of a file."""
    log, at, outcome = _log(spark, sf_dir)
    return S.breakers_of_nodes(log.select(F.col("file").alias("node"), F.col("node").cast("string").alias("peer"), at.alias("at"), F.col("event_id").alias("seq"), outcome.alias("outcome")), THRESHOLD, COOLDOWN * HOUR, CAPACITY)


ROOM = f"""
with recursive {_EVENTS},
ev as (select file as node, node::VARCHAR as peer, event_id as seq, tm, outcome, row_number() over (partition by file order by tm, event_id) as n from log),
s(node, n, seq, state, cs) as (
  select distinct node, 0::BIGINT, 0::BIGINT, '', []::STRUCT(peer VARCHAR, st VARCHAR, fails BIGINT, opened BIGINT, used BIGINT)[] from ev
  union all
  select node, n, seq, new.st, list_append(base, new)
  from (select node, n, seq, list_filter(base, lambda c: c.peer <> own) as base,
      {{'peer': own, 'st': case when outcome = 'answered' then 'closed' when trips then 'open' else st end, 'fails': case outcome when 'answered' then 0 when 'neutral' then fails else fails + 1 end,
        'opened': case when trips then tm else opened end, 'used': n}} as new
    from (select *, ends_with(outcome, 'fail') and st <> 'open' and (outcome = 'hard_fail' or st = 'half_open' or fails + 1 >= {THRESHOLD}) as trips
      from (select node, n, seq, own, tm, outcome, base, coalesce(c.fails, 0) as fails, coalesce(c.opened, 0) as opened,
          case when c.st = 'open' and tm - c.opened >= {COOLDOWN * HOUR} then 'half_open' else coalesce(c.st, 'closed') end as st
        from (select *, case when c is not null or len(cs) < {CAPACITY} then cs when len(kept) < len(cs) then kept else list_filter(cs, lambda x: x.used <> oldest) end as base
          from (select *, list_min(list_transform(cs, lambda x: x.used)) as oldest, list_filter(cs, lambda x: x.st <> 'closed' or x.fails <> 0) as kept, list_filter(cs, lambda x: x.peer = own)[1] as c
            from (select ev.*, ev.peer as own, s.cs from s join ev on ev.node = s.node and ev.n = s.n + 1)))))))
select node, seq, state, list_last(cs).fails as failures, len(cs)::BIGINT as known from s where n > 0
"""


def tracker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader sets of files, each with a tracker of its own; leases of up to ten hours."""
    log, at, _ = _log(spark, sf_dir)
    op = F.when(F.col("event_id") % 9 == 0, "leave").when(F.col("event_id") % 9 == 1, "readers").otherwise("join")
    e = log.select("file", at.alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("n"), (F.col("node") % 40).cast("string")).alias("node"), op.alias("op"), (F.col("event_id") % 13 * HOUR).alias("ttl_us"))
    return S.tracker_states(e, tick_us=3 * HOUR, grace_us=4 * HOUR, max_ttl_us=10 * HOUR).withColumn("readers", F.array_join("readers", ","))


#: The default lease of a tracker, for calls without one.
LEASE = 6_000_000
TRACKER = f"""
with recursive {_EVENTS},
ev as (select file, event_id as seq, tm, 'n' || (node % 40) as node, case event_id % 9 when 0 then 'leave' when 1 then 'readers' else 'join' end as op,
    tm + case when event_id % 13 = 0 then {LEASE} else least(event_id % 13, 10) * {HOUR} end as until, row_number() over (partition by file order by tm, event_id) as n from log),
s(file, n, seq, there, leases, pub, epoch, next_at, active, next_sweep) as (
  select distinct file, 0::BIGINT, 0::BIGINT, false, []::STRUCT(node VARCHAR, until BIGINT)[], []::VARCHAR[], 0::BIGINT, null::BIGINT, 0::BIGINT, null::BIGINT from ev
  union all
  select file, n, seq, there, leases, case when grows then list_sort(list_append(pub, own)) else pub end, epoch + grows::INTEGER, next_at, active, next_sweep
  from (select * exclude (pub, epoch), case when due then live else pub end as pub, epoch + (due and live <> pub)::INTEGER as epoch, op = 'join' and not list_contains(case when due then live else pub end, own) as grows
    from (select * exclude (leases, next_at), case when due then list_filter(leases, lambda x: x.until > now) else leases end as leases,
        case when due then list_sort(list_transform(list_filter(leases, lambda x: x.until > now), lambda x: x.node)) end as live, case when due then now + {3 * HOUR} else next_at end as next_at
      from (select *, there and op <> 'leave' and (next_at is null or now >= next_at) as due
        from (select file, n, seq, op, own, now, next_sweep, there, case when there then leases else [] end as leases, case when there then pub else [] end as pub, case when there then epoch else 0 end as epoch,
            case when there then next_at end as next_at, case when there and op <> 'leave' then now else active end as active
          from (select * exclude (leases, there), case op when 'join' then list_append(list_filter(leases, lambda x: x.node <> own), {{'node': own, 'until': until}}) when 'leave' then list_filter(leases, lambda x: x.node <> own) else leases end as leases,
              case op when 'join' then true when 'leave' then there and len(list_filter(leases, lambda x: x.node <> own)) > 0 else there end as there
            from (select * exclude (leases, there, pub, epoch, next_at), case when gone then [] else leases end as leases, there and not gone as there, case when gone then [] else pub end as pub,
                case when gone then 0 else epoch end as epoch, case when gone then null else next_at end as next_at
              from (select *, swept and there and len(leases) = 0 and now - active > {4 * HOUR} as gone
                from (select * exclude (leases, next_sweep), case when swept then list_filter(leases, lambda x: x.until > now) else leases end as leases, case when swept then now + {3 * HOUR} else next_sweep end as next_sweep
                  from (select ev.file, ev.n, ev.seq, ev.op, ev.node as own, ev.until, ev.tm as now, s.there, s.leases, s.pub, s.epoch, s.next_at, s.active, s.next_sweep,
                      ev.op <> 'leave' and (s.next_sweep is null or ev.tm >= s.next_sweep) as swept
                    from s join ev on ev.file = s.file and ev.n = s.n + 1))))))))))
select file, seq, epoch, array_to_string(pub, ',') as readers from s where n > 0
"""


def membership_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of members by others and by themselves, with ids and roles that are refused; views are published every six hours."""
    log, at, _ = _log(spark, sf_dir)
    op = F.when(F.col("failed"), "learn").when(F.col("event_id") % 3 == 0, "member").when(F.col("event_id") % 3 == 1, "confirm").otherwise("peer")
    name = F.when(F.col("node") % 17 == 0, F.concat(F.lit("no id "), F.col("node").cast("string"))).otherwise(F.col("node").cast("string"))
    e = log.select(name.alias("id"), at.alias("at"), F.col("event_id").alias("seq"), F.lit("h").alias("addr"), (F.col("value") - 100).alias("weight"), (F.col("event_id") % 4).cast("int").alias("role"), op.alias("op"))
    return S.membership_states(e, forget_after_us=24 * HOUR, refresh_us=6 * HOUR)


MEMBERSHIP = f"""
with recursive {_EVENTS},
ev as (select case when node % 17 = 0 then 'no id ' || node else node::VARCHAR end as id, node % 17 <> 0 as valid, event_id as seq, tm, value - 100 as w, event_id % 4 as r,
    case when failed then 'learn' when event_id % 3 = 0 then 'member' when event_id % 3 = 1 then 'confirm' else 'peer' end as op, row_number() over (partition by node order by tm, event_id) as n from log),
s(id, n, seq, verdict, known, conf, told, role, weight, last) as (
  select distinct id, 0::BIGINT, 0::BIGINT, '', false, false, false, 0::BIGINT, 1.0::DOUBLE, 0::BIGINT from ev
  union all
  select id, n, seq, case when op = 'confirm' then case when known then 'confirmed' else 'unknown' end when not valid then 'bad_id' when not takes then 'bad_role' when known then 'updated' else 'new' end,
    known or takes, conf or (known and op = 'confirm') or (takes and op <> 'learn'), told or (takes and op = 'member'),
    case when takes and (op = 'member' or (op = 'learn' and not told)) then r else role end, case when takes and op <> 'peer' then case when w > 0 then w else 1.0 end else weight end,
    case when (known and op = 'confirm') or (takes and (op <> 'learn' or not known)) then tm else last end
  from (select *, op <> 'confirm' and valid and (op = 'peer' or r < 3) as takes
    from (select id, n, seq, tm, op, valid, w, r, known and not gone as known, conf and not gone as conf, told and not gone as told, case when gone then 0 else role end as role,
        case when gone then 1.0 else weight end as weight, case when gone then 0 else last end as last
      from (select ev.*, s.known, s.conf, s.told, s.role, s.weight, s.last, s.known and ev.tm // {6 * HOUR} * {6 * HOUR} - s.last > {24 * HOUR} as gone from s join ev on ev.id = s.id and ev.n = s.n + 1))))
select id, seq, verdict, known and conf as published, role::INTEGER as role, weight from s where n > 0
"""

QUERIES = {
    "breaker_trace": breaker_trace, "open_circuits": open_circuits, "breaker_calls": breaker_calls, "breaker_capacity": breaker_capacity, "tracker_trace": tracker_trace, "membership_trace": membership_trace,
}
ORACLE_SQL = {"breaker_trace": BREAKERS, "open_circuits": OPEN, "breaker_calls": CALLS, "breaker_capacity": ROOM, "tracker_trace": TRACKER, "membership_trace": MEMBERSHIP}
