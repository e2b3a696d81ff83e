"""Queries over leases, transfers, latencies, failures and caches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import flights as L
from ..sources.tables import LOG_SQL, access_log, table

HOUR = 3_600_000_000


def lease_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lease_sessions(access_log(spark, sf_dir), ["file", "node"], "ts", 6 * HOUR)


LEASES = f"""
with t as (select file, node, epoch_us(ts) as t from ({LOG_SQL})),
n as (select *, case when t - lag(t) over (partition by file, node order by t) <= {6 * HOUR} then 0 else 1 end as new from t),
i as (select *, sum(new) over (partition by file, node order by t rows unbounded preceding) as g from n)
select file, node, min(t) as start_us, max(t) + {6 * HOUR} as end_us, count(*) as joins from i group by file, node, g
"""


def coalesced_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.coalesced_flights(access_log(spark, sf_dir), ["file"], "ts", "event_id", HOUR)


FLIGHTS = f"""
with recursive t as (select file, event_id, epoch_us(ts) as t from ({LOG_SQL})),
lead as (select file, min(t) as s from t group by file
  union all select l.file, (select min(t) from t where t.file = l.file and t.t >= l.s + {HOUR}) from lead l where l.s is not null),
f as (select file, s from lead where s is not null),
j as (select t.file, t.event_id, t.t, f.s from t asof join f on t.file = f.file and t.t >= f.s)
select file, min_by(event_id, t) as leader, s as start_us, count(*) as calls from j group by file, s
"""


def latency_ring_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = access_log(spark, sf_dir).where("not failed").withColumn("day", F.to_date("ts"))
    q = L.ring_quantile(log, ["day"], ["ts", "event_id"], "value", 0.99)
    return q.select("event_id", "quantile", L.hedge_delay(F.col("quantile"), (50.0, 400.0)).alias("delay"))


QUANTILE = f"""
with t as (select event_id, value, list(value) over (partition by ts::DATE order by ts, event_id rows between 256 preceding and 1 preceding) as v from ({LOG_SQL}) where not failed),
q as (select event_id, case when len(v) >= 16 then list_sort(v)[least(floor(0.99 * len(v)), len(v) - 1)::BIGINT + 1] end as quantile from t)
select event_id, quantile, case when quantile is not null then least(greatest(quantile, 50.0), 400.0) else null end as delay from q
"""


def hedge_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = access_log(spark, sf_dir).withColumn("eligible", F.col("source") != "cache")
    return L.hedge_limiter(log, ["node"], ["ts", "event_id"], "eligible").select("event_id", "may_hedge")


LIMITER = f"""
select event_id, e and sum(e::INTEGER) over (partition by node order by ts, event_id rows unbounded preceding) % 20 = 0 as may_hedge from (select *, source <> 'cache' as e from ({LOG_SQL}))
"""


def hedged_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = access_log(spark, sf_dir)
    n = F.col("event_id")
    result = lambda k: F.when(k % 13 == 0, "refused").when(k % 11 == 0, "buffer").when(k % 4 == 0, "failed").otherwise("held")
    r = L.race(F.col("value"), F.when(n % 10 != 0, F.lit(500.0) - F.col("value")), F.when(F.col("failed"), "failed").otherwise(result(n)), result(n * 7 + 3), F.lit(120.0), n % 2 == 0)
    return e.select("event_id", r.alias("r")).select("event_id", "r.winner", "r.hedged", "r.failover", F.round("r.at", 6).alias("at"))


_RESULT = "case when {0} % 13 = 0 then 'refused' when {0} % 11 = 0 then 'buffer' when {0} % 4 = 0 then 'failed' else 'held' end"
RACE = f"""
with t as (select event_id, value as t1, case when event_id % 10 <> 0 then 500.0 - value end as t2, case when failed then 'failed' else {_RESULT.format('event_id')} end as o1, {_RESULT.format('(event_id * 7 + 3)')} as o2, event_id % 2 = 0 as may from ({LOG_SQL})),
l as (select *, t2 is not null and may and t1 > 120 as hedged from t), f as (select *, t2 is not null and not hedged and o1 = 'failed' as failover from l),
e as (select event_id, 'primary' as who, t1 as tm, o1 as o from f union all select event_id, 'backup', case when hedged then 120.0 else t1 end + t2, o2 from f where hedged or failover),
d as (select event_id, min_by({{'who': who, 'o': o, 'tm': tm}}, (tm, case who when 'primary' then 0 else 1 end)) as x from e where o in ('held', 'refused') group by event_id),
last as (select event_id, max(tm) as tm from e group by event_id)
select f.event_id, case when x.o = 'refused' then 'refused' else coalesce(x.who, 'none') end as winner, hedged, failover, round(coalesce(x.tm, last.tm), 6) as at from f join last using (event_id) left join d using (event_id)
"""


def breaker_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.failure_streaks(access_log(spark, sf_dir), ["node"], ["ts", "event_id"], "failed").select("event_id", "streak")


STREAKS = f"""
with i as (select *, sum((not failed)::INTEGER) over (partition by node order by ts, event_id rows unbounded preceding) as g from ({LOG_SQL}))
select event_id, sum(failed::INTEGER) over (partition by node, g order by ts, event_id rows unbounded preceding)::BIGINT as streak from i
"""


def refresh_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 900 + 80).alias("lease"))
    return d.select("s_suppkey", F.posexplode(L.refresh_backoff(F.col("lease"))).alias("step", "wait")).select("s_suppkey", F.col("step").cast("bigint").alias("step"), F.col("wait").cast("bigint").alias("wait_ms"))


BACKOFF = """
with recursive b(s_suppkey, cap, step, w) as (
  select s_suppkey, (s_suppkey * 900 + 80) // 2, 0::BIGINT, least(50, (s_suppkey * 900 + 80) // 2)::BIGINT from supplier
  union all select s_suppkey, cap, step + 1, case when w >= cap // 2 then cap else least(w * 2, cap) end from b where step < 11)
select s_suppkey, step, w as wait_ms from b
"""


def rules_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grace of flights, validity of tokens and outcomes of requests."""
    e = access_log(spark, sf_dir)
    err = F.when(F.col("event_id") % 5 == 0, "dial").when(F.col("event_id") % 5 == 1, "refused").when(F.col("event_id") % 5 == 2, "reset")
    now = F.col("ts").cast("timestamp")
    return e.select("event_id", L.flight_grace((F.col("event_id") % 1000) * 400).cast("bigint").alias("grace_ms"), L.token_valid(now, now + F.make_dt_interval(secs=F.col("event_id") % 60)).alias("valid"), I.request_outcome(F.col("event_id") % 11 == 0, err).alias("outcome"))


RULES = """
select event_id, least(greatest(case when event_id % 1000 > 0 then (event_id % 1000) * 400 else 600000 end // 8, 25), 30000)::BIGINT as grace_ms, event_id % 60 > 30 as valid,
  case when event_id % 11 = 0 then 'neutral' when event_id % 5 in (1, 3, 4) then 'answered' when event_id % 5 = 0 then 'hard_fail' else 'soft_fail' end as outcome from events
"""


def receive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = access_log(spark, sf_dir).select("node", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), "bytes", "value").withColumn("e", F.col("s") + F.floor(F.col("value") * 100_000_000).cast("bigint"))
    return L.receive_budget(e, ["node"], "s", "e", "bytes")


BUDGET = f"""
with t as (select node, epoch_us(ts) as s, epoch_us(ts) + floor(value * 100000000)::BIGINT as e, bytes from ({LOG_SQL})),
x as (select node, s as t, bytes as b, 1 as d from t union all select node, e, -bytes, -1 from t),
r as (select node, sum(b) over w as b, sum(d) over w as d from x window w as (partition by node order by t, d, b rows unbounded preceding))
select node, max(b)::BIGINT as peak_bytes, max(d)::BIGINT as peak_loads from r group by node
"""


def prefetch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("block"))
    return L.prefetch_lead(li, ["l_orderkey"], "block", 2)


PREFETCH = "select l_orderkey, l_linenumber::BIGINT as block, max(l_linenumber) over (partition by l_orderkey order by l_linenumber rows between current row and 1 following)::BIGINT as window_end from lineitem"


def _loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of up to 490 minutes at a tenth of the nodes each; every third is speculative."""
    e = access_log(spark, sf_dir)
    return e.select((F.col("node") % 10).alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("load"), "bytes", F.floor(F.col("value") * 60_000_000).cast("bigint").alias("takes_us"), (F.col("event_id") % 3 == 0).alias("speculative"))


def _admitted(max_bytes: int, max_loads: int, reserve: int) -> str:
    """One load of each node a step; ``run`` holds the loads under way."""
    spare = f"case when speculative and {reserve} > 0 then {{}} else 0 end"
    return f"""
with recursive ev as (select node % 10 as node, event_id as load, epoch_us(ts) as tm, bytes, floor(value * 60000000)::BIGINT as takes, event_id % 3 = 0 as speculative, row_number() over (partition by node % 10 order by ts, event_id) as n from ({LOG_SQL})),
s(node, n, load, admitted, run) as (
  select distinct node, 0::BIGINT, 0::BIGINT, false, []::STRUCT(ends BIGINT, size BIGINT)[] from ev
  union all
  select node, n, load, ok, case when ok then list_append(run, {{'ends': tm + takes, 'size': bytes}}) else run end
  from (select *, len(run) < {max_loads} - {spare.format(1)} and bytes <= {max_bytes} - {spare.format(reserve)} - coalesce(list_sum(list_transform(run, lambda x: x.size)), 0) as ok
    from (select ev.*, list_filter(s.run, lambda x: x.ends > ev.tm) as run from s join ev on ev.node = s.node and ev.n = s.n + 1)))
select node, load, admitted, 0::BIGINT as waited_us, coalesce(list_sum(list_transform(run, lambda x: x.size)), 0)::BIGINT as bytes, len(run)::BIGINT as loads from s where n > 0
"""


def receive_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that a node takes on; speculative ones leave room for a block."""
    return L.admissions(_loads(spark, sf_dir), ["node"], 1 << 20, 4, 200 << 10)


RECEIVE = _admitted(1 << 20, 4, 200 << 10)


def prefetch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speculative loads within a budget of their own, without a reserve."""
    return L.admissions(_loads(spark, sf_dir), ["node"], 800 << 10, 3)


PREFETCHED = _admitted(800 << 10, 3, 0)


def flight_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which transfer serves each call; where the leader is refused, those who joined transfer alone."""
    log = access_log(spark, sf_dir).withColumn("refused", F.col("event_id") % 6 == 1)
    return L.flight_results(L.flight_calls(log, ["file"], "ts", "event_id", HOUR), log, ["file"], "event_id", "refused")


RESULTS = FLIGHTS[: FLIGHTS.rindex("select file, min_by")] + """, r as (select file, event_id as call, min_by(event_id, t) over (partition by file, s) as leader from j)
select file, call, case when call <> leader and leader % 6 = 1 then call else leader end as transfer, call <> leader and leader % 6 <> 1 as coalesced from r
"""


def lease_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of blocks, shared within a membership epoch and apart for terminal supply."""
    log = access_log(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    calls = log.select((F.col("node") % 5).alias("block"), F.floor(F.col("at") / (24 * HOUR)).alias("epoch"), (F.col("event_id") % 7 == 0).alias("supply"), "at", F.col("event_id").alias("call"), F.floor(F.col("value") * 30_000_000).cast("bigint").alias("load_us"), F.lit(None).cast("bigint").alias("leaves_at"))
    return L.lease_flights(calls, ["block", "epoch", "supply"])


LEASES_SHARED = f"""
with recursive ev as (select node % 5 as block, epoch_us(ts) // {24 * HOUR} as epoch, event_id % 7 = 0 as supply, event_id as call, epoch_us(ts) as tm, floor(value * 30000000)::BIGINT as takes,
    row_number() over (partition by node % 5, epoch_us(ts) // {24 * HOUR}, event_id % 7 = 0 order by ts, event_id) as n from ({LOG_SQL})),
s(block, epoch, supply, n, call, leader, started, ends) as (
  select block, epoch, supply, n, call, call, tm, tm + takes from ev where n = 1
  union all
  select ev.block, ev.epoch, ev.supply, ev.n, ev.call, case when ev.tm < s.ends then s.leader else ev.call end, case when ev.tm < s.ends then s.started else ev.tm end, case when ev.tm < s.ends then s.ends else ev.tm + ev.takes end
  from s join ev on ev.block = s.block and ev.epoch = s.epoch and ev.supply = s.supply and ev.n = s.n + 1)
select block, epoch, supply, call, leader, started, call <> leader as shared from s
"""

QUERIES = {
    "lease_sessions": lease_sessions, "coalesced_flights": coalesced_flights, "latency_ring_quantile": latency_ring_quantile, "hedge_limiter": hedge_limiter, "hedged_race": hedged_race, "breaker_streaks": breaker_streaks,
    "refresh_backoff": refresh_backoff, "rules_scalar": rules_scalar, "receive_budget": receive_budget, "prefetch_window": prefetch_window, "receive_admissions": receive_admissions, "prefetch_budget": prefetch_budget,
    "flight_results": flight_results, "lease_flights": lease_flights,
}
ORACLE_SQL = {
    "lease_sessions": LEASES, "coalesced_flights": FLIGHTS, "latency_ring_quantile": QUANTILE, "hedge_limiter": LIMITER, "hedged_race": RACE, "breaker_streaks": STREAKS, "refresh_backoff": BACKOFF, "rules_scalar": RULES,
    "receive_budget": BUDGET, "prefetch_window": PREFETCH, "receive_admissions": RECEIVE, "prefetch_budget": PREFETCHED, "flight_results": RESULTS, "lease_flights": LEASES_SHARED,
}
