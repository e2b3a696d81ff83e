"""Queries over counters, gauges, histograms and ratios, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import u64
from ..operators import membership as M
from ..operators import metrics as X
from ..sources.tables import LOG_SQL, MEMBERS_SQL, access_log, members, table
from . import addressing, caches, placing, states, temporal

MS_BOUNDS = [b * 1000 for b in X.LATENCY_BOUNDS]


def block_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.source_counts(access_log(spark, sf_dir), "source")


SOURCES = f"select source, count(*) as reads from ({LOG_SQL}) group by source"


def hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.hit_ratio(access_log(spark, sf_dir), "source")


RATIO = f"select count_if(source = 'cache') / count(*) as hit_ratio, count_if(source <> 'origin') / count(*) as in_cluster_ratio from ({LOG_SQL})"


def bytes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingress by source, each transfer once, with what clients got."""
    log = access_log(spark, sf_dir)
    got = log.groupBy("source").agg(F.sum("bytes").alias("client_bytes"))
    return X.ingress_bytes(log, "source", "bytes", "coalesced").join(got, "source")


BYTES = f"select source, coalesce(sum(bytes) filter (where not coalesced), 0)::BIGINT as bytes, sum(bytes)::BIGINT as client_bytes from ({LOG_SQL}) group by source"


def amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin bytes by delivered bytes, for each day."""
    log = access_log(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    origin = F.sum(F.when((F.col("source") == "origin") & ~F.col("coalesced"), F.col("bytes")).otherwise(0))
    return log.groupBy("day").agg(F.try_divide(origin, F.sum("bytes")).alias("amplification"))


AMPLIFICATION = f"select strftime(ts, '%Y-%m-%d') as day, coalesce(sum(bytes) filter (where source = 'origin' and not coalesced), 0)::DOUBLE / sum(bytes)::DOUBLE as amplification from ({LOG_SQL}) group by day"


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.histogram(access_log(spark, sf_dir), ["source"], "value", MS_BOUNDS)
    return h.select("source", "le", "n", F.round("sum", 4).alias("sum"), "total")


HISTOGRAM = f"""
with b as (select unnest({MS_BOUNDS}) as le), t as (select source, round(sum(value), 4) as sum, count(*) as total from ({LOG_SQL}) group by source)
select source, case when le = floor(le) then le::BIGINT::VARCHAR else le::VARCHAR end as le, (select count(*) from ({LOG_SQL}) l where l.source = t.source and l.value <= le) as n, sum, total from t, b
union all select source, '+Inf', total, sum, total from t
"""


def reader_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers of each file a day, in buckets of powers of two."""
    log = access_log(spark, sf_dir).withColumn("day", F.to_date("ts")).groupBy("file", "day").agg(F.count_distinct("node").cast("double").alias("readers"))
    return X.histogram(log, ["file"], "readers", X.READER_BOUNDS).select("file", "le", "n", "total")


READERS = f"""
with r as (select file, ts::DATE as d, count(distinct node) as readers from ({LOG_SQL}) group by all), b as (select unnest([0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) as le)
select file, le::VARCHAR as le, count_if(readers <= le)::BIGINT as n, count(*) as total from r, b group by file, le union all select file, '+Inf', count(*), count(*) from r group by file
"""


def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gauge_last(access_log(spark, sf_dir), ["node"], "value", "ts", "event_id")


GAUGE = f"select node, max_by(value, (ts, event_id)) as value from ({LOG_SQL}) group by node"


def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone sums; negative increments are ignored."""
    s = table(spark, sf_dir, "supplier").withColumn("inc", F.floor("s_acctbal").cast("bigint"))
    return X.counter(s, ["s_nationkey"], "inc")


COUNTER = "select s_nationkey, coalesce(sum(floor(s_acctbal)) filter (where floor(s_acctbal) > 0), 0)::BIGINT as total from supplier group by s_nationkey"


def labelled_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by label: fetch targets, relays served and declined, hedges and who won them, failovers, passed-through bytes by side."""
    named = lambda d, name, label: d.groupBy(label.alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit(name).alias("name"), "label", "n")
    race = temporal.hedged_race(spark, sf_dir)
    relay = addressing.relay_gate(spark, sf_dir)
    parts = [
        named(placing.fetch_targets(spark, sf_dir).where("target is not null"), "fetch_target", F.col("target")),
        named(relay, "relay", F.when(F.col("verdict") == "relay", "served").otherwise("declined")),
        named(race.where("hedged"), "hedge", F.lit("fired")), named(race.where("hedged and winner in ('primary', 'backup')"), "hedge_won", F.col("winner")), named(race.where("failover"), "failover", F.lit("all")),
        addressing.passthrough(spark, sf_dir).groupBy(F.when(F.col("page_id") % 2 == 0, "client").otherwise("peer").alias("label")).agg(F.sum("bytes").cast("double").alias("n")).select(F.lit("passthrough_bytes").alias("name"), "label", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _labelled_sql() -> str:
    return f"""
select name, label, n::DOUBLE as n from (
  select 'fetch_target' as name, target as label, count(*) as n from ({placing.TARGETS_OF}) where target is not null group by target
  union all select 'relay', case when verdict = 'relay' then 'served' else 'declined' end, count(*) from ({addressing.RELAY}) group by 2
  union all select 'hedge', 'fired', count(*) from ({temporal.RACE}) where hedged union all select 'hedge_won', winner, count(*) from ({temporal.RACE}) where hedged and winner in ('primary', 'backup') group by winner
  union all select 'failover', 'all', count(*) from ({temporal.RACE}) where failover
  union all select 'passthrough_bytes', case when page_id % 2 = 0 then 'client' else 'peer' end, sum(bytes) from ({addressing.PASSED}) group by 2)"""


LABELLED = _labelled_sql()


def root_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of dispatched fetches that go to the tree's root, by key."""
    return X.share(placing.fetch_targets(spark, sf_dir).where("target is not null"), ["key"], F.col("target") == "root", "root_share")


def _root_share_sql() -> str:
    return f"select key, count_if(target = 'root') / count(*) as root_share from ({placing.TARGETS_OF}) where target is not null group by key"


ROOT_SHARE = _root_share_sql()


def singleton_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the trackers' answers that publish one reader at most, by file."""
    answers = states.tracker_trace(spark, sf_dir).withColumn("n", F.size(F.array_remove(F.split("readers", ","), "")))
    return X.share(answers, ["file"], F.col("n") <= 1, "singleton_share")


def _singleton_sql() -> str:
    return f"select file, count_if(not contains(readers, ',')) / count(*) as singleton_share from ({states.TRACKER}) group by file"


SINGLETONS = _singleton_sql()


def scraped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposition of values that are sampled when they are read: what the caches hold and turned away."""
    names = {"owned_len": ("store_owned_blocks", "gauge", "Blocks in the owned budget.\n"), "rejected": ("store_admit_rejected_total", "counter", "Turned away \\ by estimate.")}
    lines = X.exposition(X.sampled(caches.cache_occupancy(spark, sf_dir).where("cache in ('click', 'view')"), names, ["cache"]))
    return lines.select("line")


def _scraped_sql() -> str:
    return f"""with o as (select * from ({caches.OCCUPANCY}) where cache in ('click', 'view'))
select unnest(['# HELP store_owned_blocks Blocks in the owned budget.' || chr(92) || 'n', '# TYPE store_owned_blocks gauge', '# HELP store_admit_rejected_total Turned away ' || chr(92) || chr(92) || ' by estimate.', '# TYPE store_admit_rejected_total counter']) as line
union all select 'store_owned_blocks{{cache="' || cache || '"}} ' || owned_len from o union all select 'store_admit_rejected_total{{cache="' || cache || '"}} ' || rejected from o"""


SCRAPED = _scraped_sql()


def bounds_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.col("s_suppkey") % 5, F.lit(3), F.col("s_suppkey") % 2, F.lit(1))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(X.normalise_bounds(a), lambda x: x.cast("string")), ",").alias("bounds"))


BOUNDS = "select s_suppkey, array_to_string(list_sort(list_distinct([s_suppkey % 5, 3, s_suppkey % 2, 1])), ',') as bounds from supplier"


def exposition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text exposition of reads by source and of a gauge."""
    c = X.source_counts(access_log(spark, sf_dir), "source")
    n = F.when(F.col("source") == "cache", 0).when(F.col("source") == "peer", 1).otherwise(2)
    reads = c.select(n.cast("bigint").alias("seq"), F.lit("block_reads_total").alias("name"), F.lit("Reads by source.").alias("help"), F.lit("counter").alias("kind"), F.create_map(F.lit("source"), "source").alias("labels"), F.col("reads").alias("value"))
    gauge = c.agg(F.sum("reads").alias("v")).select(F.lit(3).cast("bigint").alias("seq"), F.lit("reads_all").alias("name"), F.lit("All reads.").alias("help"), F.lit("gauge").alias("kind"), F.create_map().cast("map<string,string>").alias("labels"), F.col("v").alias("value"))
    return X.exposition(reads.unionByName(gauge)).select(F.col("seq.at").alias("at"), F.col("seq.s").alias("sample"), "line")


EXPOSITION = f"""
with c as (select source, count(*) as n, case source when 'cache' then 0 when 'peer' then 1 else 2 end as s from ({LOG_SQL}) group by source)
select 0::BIGINT as at, 0::BIGINT as sample, unnest(['# HELP block_reads_total Reads by source.', '# TYPE block_reads_total counter']) as line
union all select 3, 0, unnest(['# HELP reads_all All reads.', '# TYPE reads_all gauge'])
union all select 0, s, 'block_reads_total{{source="' || source || '"}} ' || n from c
union all select 3, 3, 'reads_all ' || sum(n)::BIGINT from c
"""


_SELF = "Customer#000000009"


def admin_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members as JSON, a line each, behind one with the view's epoch and the numbers of members that may be roots and readers."""
    v = M.canonical(members(spark, sf_dir))
    m = v.select("id", F.to_json(F.struct("id", "addr", "weight", M.state_name(F.col("state")).alias("state"), I.role_name(F.col("role")).alias("role"))).alias("json"))
    able = v.agg(F.count_if((F.col("state") == M.READY) & (F.col("role") != M.NON_ROOT)).alias("eligible_roots"), F.count_if((F.col("state") == M.READY) & (F.col("role") != M.ROOT_ONLY)).alias("eligible_readers"))
    epoch = M.epoch(v, b"roles-v1\0").select(u64.as_unsigned(F.col("epoch")).cast("string").alias("epoch"))
    head = epoch.crossJoin(able).select(F.lit("").alias("id"), F.to_json(F.struct(F.lit(_SELF).alias("self_id"), "epoch", "eligible_roots", "eligible_readers")).alias("json"))  # one row each
    return head.unionByName(m)


def _admin_sql() -> str:
    return f"""with mm as ({MEMBERS_SQL})
select id, '{{"id":"' || id || '","addr":"' || addr || '","weight":' || weight || ',"state":"' || ['Joining', 'Ready', 'Suspect', 'Leaving'][state + 1] || '","role":"' || ['ordinary', 'root-only', 'non-root'][role + 1] || '"}}' as json from mm
union all select '', '{{"self_id":"{_SELF}","epoch":"' || (case when epoch < 0 then epoch::HUGEINT + 18446744073709551616::HUGEINT else epoch::HUGEINT end) || '","eligible_roots":' || (select count(*) from mm where state = 1 and role <> 2)
  || ',"eligible_readers":' || (select count(*) from mm where state = 1 and role <> 1) || '}}' from ({placing.EPOCH})"""


ADMIN = _admin_sql()


def admin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cache's own report: its name, role and number of blocks."""
    o = caches.cache_occupancy(spark, sf_dir)
    return o.select("cache", F.to_json(F.struct(F.col("cache").alias("self_id"), (F.col("owned_len") + F.col("borrowed_len")).alias("cached_blocks"), I.role_name(F.lit(0)).alias("role"))).alias("json"))


def _stats_sql() -> str:
    return f"""select cache, '{{"self_id":"' || cache || '","cached_blocks":' || (owned_len + borrowed_len) || ',"role":"ordinary"}}' as json from ({caches.OCCUPANCY})"""


STATS = _stats_sql()

QUERIES = {
    "block_source_counts": block_source_counts, "hit_ratio": hit_ratio, "bytes_by_source": bytes_by_source, "amplification": amplification, "latency_histogram": latency_histogram, "reader_histogram": reader_histogram,
    "gauge_last": gauge_last, "counter_totals": counter_totals, "labelled_counters": labelled_counters, "bounds_normalise": bounds_normalise, "exposition_text": exposition_text, "admin_members": admin_members, "admin_stats": admin_stats, "root_share": root_share, "singleton_share": singleton_share, "scraped_text": scraped_text,
}
ORACLE_SQL = {
    "block_source_counts": SOURCES, "hit_ratio": RATIO, "bytes_by_source": BYTES, "amplification": AMPLIFICATION, "latency_histogram": HISTOGRAM, "reader_histogram": READERS,
    "gauge_last": GAUGE, "counter_totals": COUNTER, "labelled_counters": LABELLED, "bounds_normalise": BOUNDS, "exposition_text": EXPOSITION, "admin_members": ADMIN, "admin_stats": STATS, "root_share": ROOT_SHARE, "singleton_share": SINGLETONS, "scraped_text": SCRAPED,
}
