"""Queries over placement, trees and membership, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext as Q
from ..operators import membership as M
from ..operators import placement as P
from ..operators import tree as T
from ..sources.tables import LOG_SQL, MEMBERS_SQL, access_log, equal_nodes, members, table, weighted_nodes
from .states import _BREAKERS, COOLDOWN, HOUR, breaker_trace

_WEIGHTED = "select s_name as node_id, case when s_acctbal > 0 then s_acctbal else 1.0 end as weight from supplier"
_EQUAL = "select n_name as node_id, 1.0::DOUBLE as weight from nation"


def _keys(spark: SparkSession, sf_dir: str, name: str, col: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(col).alias("key"))


def _scored(keys: str, nodes: str) -> str:
    """CTEs that end in ``ranked(key, node_id, rank)``: all nodes of each key."""
    return f"""
keys as ({keys}), nodes as ({nodes}),
folded as (select key, {Q.fnv(Q.FNV_OFFSET, Q.int_bytes('key', 'little'))} as h0 from keys),
bytes as (select node_id, weight, {Q.chars('node_id')} as b from nodes),
hashed as (select key, node_id, weight, {Q.fmix(Q.fnv('h0', 'b'))} as h from folded, bytes),
scored as (select key, node_id, weight / -ln((h::DOUBLE + 0.5) / 18446744073709551616.0) as score from hashed),
ranked as (select key, node_id, row_number() over (partition by key order by score desc, node_id) as rank from scored)"""


def ring_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three weighted nodes of each part key."""
    return P.rank_nodes(_keys(spark, sf_dir, "part", "p_partkey"), weighted_nodes(spark, sf_dir), 3)


RING = f"with {_scored('select p_partkey as key from part', _WEIGHTED)} select key, rank::INTEGER as rank, node_id from ranked where rank <= 3"


def owner_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.owner_share(_keys(spark, sf_dir, "orders", "o_orderkey"), equal_nodes(spark, sf_dir))


OWNER = f"with {_scored('select o_orderkey as key from orders', _EQUAL)} select node_id as owner, count(*) as n_keys from ranked where rank = 1 group by node_id"


def weighted_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.owner_share(_keys(spark, sf_dir, "part", "p_partkey"), weighted_nodes(spark, sf_dir))


WEIGHTED = f"with {_scored('select p_partkey as key from part', _WEIGHTED)} select node_id as owner, count(*) as n_keys from ranked where rank = 1 group by node_id"


def rebalance_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that move when one more node joins."""
    after = equal_nodes(spark, sf_dir)
    return P.moved(_keys(spark, sf_dir, "part", "p_partkey"), after.where("node_id != 'NATION_3'"), after)


MOVED = f"""with {_scored('select p_partkey as key from part', _EQUAL)},
after as (select key, min_by(node_id, rank) as o from ranked group by key), before as (select key, min_by(node_id, rank) as o from ranked where node_id <> 'NATION_3' group by key)
select count(*) as n_keys, count_if(a.o <> b.o)::BIGINT as n_moved from after a join before b using (key)"""


def owned_or_borrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document's key at one node that holds two replicas of what it owns."""
    nodes = equal_nodes(spark, sf_dir)
    return P.storage_class(_keys(spark, sf_dir, "documents", "doc_id"), nodes, "NATION_7", replicas=2)


OWNED = f"""with {_scored('select doc_id as key from documents', _EQUAL)}
select key, case when count_if(node_id = 'NATION_7') > 0 then 'owned' else 'borrowed' end as storage_class from ranked where rank <= 2 group by key"""


def ring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First eight root-capable members of a few keys, with address, weight and role."""
    roots = M.roots(M.canonical(members(spark, sf_dir)))
    keys = _keys(spark, sf_dir, "region", "r_regionkey").select(F.col("key").cast("bigint").alias("key"))
    return P.ring(keys, roots.select(F.col("id").alias("node_id"), "addr", "weight", "role"))


REPORT = f"""with m as ({MEMBERS_SQL}), {_scored('select r_regionkey::BIGINT as key from region', 'select id as node_id, weight from m where state = 1 and role <> 2')}
select key, rank::INTEGER as rank, node_id, addr, weight, role from ranked join m on m.id = node_id where rank <= 8"""


def root_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First root with an address that answers; a member answers unless its number ends in 1."""
    m = M.roots(M.canonical(members(spark, sf_dir)))
    keys = _keys(spark, sf_dir, "supplier", "s_suppkey")
    answers = m.select(F.col("id").alias("node_id"), (~F.endswith("id", F.lit("1"))).alias("ok"))
    return P.walk(keys, m.select(F.col("id").alias("node_id"), "weight", "addr"), answers)


WALK = f"""with m as ({MEMBERS_SQL}), {_scored('select s_suppkey as key from supplier', "select id as node_id, weight from m where state = 1 and role <> 2 and addr <> ''")}
select key, min_by(node_id, rank) as node_id, min(rank)::INTEGER as tried from ranked where rank <= 64 and not ends_with(node_id, '1') group by key"""


def tracker_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker of each document: first of all ready members, whether root-capable or not."""
    v = M.ready(M.canonical(members(spark, sf_dir)))
    return P.owners(_keys(spark, sf_dir, "documents", "doc_id"), v.select(F.col("id").alias("node_id"), "weight"))


TRACKER = f"""with m as ({MEMBERS_SQL}), {_scored('select doc_id as key from documents', 'select id as node_id, weight from m where state = 1')} select key, node_id as owner from ranked where rank = 1"""

# Trees ------------------------------------------------------------------------------------------

_SHAPES = [(1, 2, 1), (2, 4, 1), (8, 2, 1), (8, 2, 2), (12, 2, 3), (16, 4, 1), (11, 1, 3), (5, 2, 8), (9, 8, 2), (8, 1, 1)]


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as one tree in several shapes, and small trees."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    big = n.select("n", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(r).cast("bigint").alias("root_k")) for k, r in ((2, 1), (3, 5), (1, 4))])).alias("s")).select("n", "s.*")
    small = spark.createDataFrame(_SHAPES, "n bigint, k bigint, root_k bigint")
    return big.unionByName(small).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("pos"))


_TREE = f"""
shapes as (select n, k, r from (select count(*) as n from supplier), (values (2, 1), (3, 5), (1, 4)) t(k, r) union all select * from (values {', '.join(map(str, _SHAPES))}) t(n, k, r)),
down(n, k, r, lo, hi, parent, depth) as (
  select n, k, r, 0::BIGINT, (n - 1)::BIGINT, -1::BIGINT, 0::BIGINT from shapes
  union all
  select n, k, r, s, s + base - (case when c < extra then 0 else 1 end), lo, depth + 1 from (
    select *, lo + 1 + c * base + least(c, extra) as s from (
      select d.*, (hi - lo) // f as base, (hi - lo) % f as extra, unnest(range(0, least(f, hi - lo))) as c from (select *, case when lo = 0 then r else k end as f from down where hi > lo) d)))
"""


def tree_parent_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_parents(_positions(spark, sf_dir))


PARENTS = f"with recursive {_TREE} select n, k::BIGINT as k, r::BIGINT as root_k, lo as pos, parent, depth from down"


def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = T.children(T.with_parents(_positions(spark, sf_dir)), ["n", "k", "root_k"])
    return kids.select("n", "k", "root_k", "parent", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


CHILDREN = f"with recursive {_TREE} select n, k::BIGINT as k, r::BIGINT as root_k, parent, string_agg(lo::VARCHAR, ',' order by lo) as children from down where parent >= 0 group by all"


def child_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How ranges of different widths are dealt into parts."""
    s = table(spark, sf_dir, "supplier").withColumn("lo", F.col("s_suppkey") % 7).withColumn("hi", F.col("s_suppkey") % 7 + F.col("s_suppkey") % 23).withColumn("k", F.col("s_suppkey") % 5)
    return s.select("s_suppkey", F.posexplode(T.child_segments(F.col("lo"), F.col("hi"), F.col("k"))).alias("part", "seg")).select("s_suppkey", F.col("part").cast("bigint").alias("part"), F.col("seg.start").alias("seg_start"), F.col("seg.end").alias("seg_end"))


DEAL = """
select s_suppkey, c as part, lo + 1 + c * base + least(c, extra) as seg_start, lo + 1 + c * base + least(c, extra) + base - case when c < extra then 0 else 1 end as seg_end
from (select *, n // k as base, n % k as extra, unnest(range(0, least(k, n))) as c from (select s_suppkey, s_suppkey % 7 as lo, s_suppkey % 23 as n, s_suppkey % 5 as k from supplier) where k >= 1 and n >= 1)
"""


#: Who asks: a member that may read, and one that only supplies.
_READER, _SUPPLIER = "Customer#000000009", "Customer#000000013"


def _tree_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir, "region", "r_regionkey").select(F.col("key").cast("bigint").alias("key"))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of each region's object: with a tracker's snapshot of readers, without tracking, and for a member that only supplies."""
    v = M.canonical(members(spark, sf_dir))
    keys = _tree_keys(spark, sf_dir)
    snapshot = v.where("id like '%7' or id like '%8'").select("id")
    trees = {"tracked": P.tree_nodes(keys, v, _READER, snapshot), "all": P.tree_nodes(keys, v, _READER), "supply": P.tree_nodes(keys, v, _SUPPLIER, snapshot)}
    out = [t.select(F.lit(name).alias("mode"), "key", F.col("pos").cast("bigint").alias("pos"), "node_id") for name, t in trees.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_TREES = f"""m as ({MEMBERS_SQL}), {_scored('select r_regionkey::BIGINT as key from region', 'select id as node_id, weight from m where state = 1')},
own as (select key, min_by(node_id, rank) as o from ranked join m on m.id = node_id where role <> 2 group by key),
rd as (select r.key, r.node_id, r.rank, addr <> '' as reached, id like '%7' or id like '%8' as listed, id = '{_READER}' as me from ranked r join m on m.id = r.node_id join own on own.key = r.key where role <> 1 and r.node_id <> o)"""
NODES = f"""with {_TREES}
select 'tracked' as mode, key, row_number() over (partition by key order by rank) as pos, node_id from rd where reached and (listed or me) union all select 'all', key, row_number() over (partition by key order by rank), node_id from rd
union all select mode, key, 0::BIGINT, o from own, (values ('tracked'), ('all'), ('supply')) t(mode)"""


def fetch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each member of the trees asks first and second: ancestors with an address whose circuit is closed, by the breaker's log."""
    v = M.canonical(members(spark, sf_dir))
    end = access_log(spark, sf_dir).agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("end")).first()["end"]
    last = breaker_trace(spark, sf_dir).groupBy("peer").agg(F.max_by(F.struct("state", "opened_at"), "seq").alias("c"))
    sick = last.where((F.col("c.state") == "open") & (F.lit(end) - F.col("c.opened_at") < COOLDOWN * HOUR)).select(F.concat(F.lit("Customer#"), F.lpad(F.col("peer").cast("string"), 9, "0")).alias("id"))
    broken = v.join(sick, "id", "left_semi").select("addr")
    return T.fetch_targets(P.tree_nodes(_tree_keys(spark, sf_dir), v, _READER), v, broken)


def _fetch_targets_sql() -> str:
    return f"""with recursive {_BREAKERS}, {_TREES},
ord as (select key, row_number() over (partition by key order by rank) as pos, node_id from rd union all select key, 0::BIGINT, o from own),
sick as (select 'Customer#' || lpad(peer::VARCHAR, 9, '0') as id from (select peer, max_by(st, n) as st, max_by(opened, n) as opened from s group by peer) where st = 'open' and (select max(tm) from log) - opened < {COOLDOWN * HOUR}),
usable as (select id, addr from m where addr <> '' and addr not in (select addr from m where id in (select id from sick))),
down(key, lo, hi, parent) as (
  select key, 0::BIGINT, max(pos), -1::BIGINT from ord group by key
  union all
  select key, st, st + base - (case when c < extra then 0 else 1 end), lo from (select *, lo + 1 + c * base + least(c, extra) as st from (
    select d.*, (hi - lo) // f as base, (hi - lo) % f as extra, unnest(range(0, least(f, hi - lo))) as c from (select *, case when lo = 0 then 1 else 2 end as f from down where hi > lo) d))),
up(key, pos, hop, anc) as (select key, lo, 1, parent from down where parent >= 0 union all select up.key, up.pos, hop + 1, down.parent from up join down on down.key = up.key and down.lo = up.anc where down.parent >= 0),
met as (select up.key, up.pos, hop, anc, addr from up join ord on ord.key = up.key and ord.pos = up.anc join usable on usable.id = ord.node_id),
t as (select key, pos, list({{'hop': hop, 'anc': anc, 'addr': addr}} order by hop) as t from met group by key, pos)
select ord.key, ord.pos, node_id, t[1].addr as primary, t[2].addr as backup, case when t is null then null when t[1].anc = 0 then 'root' when t[1].hop = 1 then 'parent' else 'ancestor' end as target from ord left join t using (key, pos)"""


TARGETS_OF = _fetch_targets_sql()


def hedge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two usable ancestors of each position; every fourth position has an open circuit, every seventh no address."""
    p = T.with_parents(_positions(spark, sf_dir).where("k = 2 and root_k = 1"))
    up = T.ancestors(p, ["n", "k", "root_k"]).where("ancestor % 4 != 3 and ancestor % 7 != 6")
    first = up.groupBy("n", "k", "root_k", "pos").agg(F.slice(F.sort_array(F.collect_list(F.struct("hop", "ancestor"))), 1, 2).alias("t"))
    return first.select("n", "k", "root_k", "pos", F.col("t")[0]["ancestor"].alias("primary"), F.get("t", F.lit(1))["ancestor"].alias("backup"))


HEDGE = f"""with recursive {_TREE}, p as (select n, k, r, lo as pos, parent from down where k = 2 and r = 1),
up(n, k, r, pos, hop, anc) as (select n, k, r, pos, 1, parent from p where parent >= 0 union all select up.n, up.k, up.r, up.pos, hop + 1, p.parent from up join p on p.n = up.n and p.pos = up.anc where p.parent >= 0)
select n, k::BIGINT as k, r::BIGINT as root_k, pos, list(anc order by hop)[1] as primary, list(anc order by hop)[2] as backup from up where anc % 4 <> 3 and anc % 7 <> 6 group by n, k, r, pos"""

# Membership -------------------------------------------------------------------------------------


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are reported several times under few ids."""
    k = F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint")
    return members(spark, sf_dir).withColumn("id", F.concat(F.lit("m"), (k % 60).cast("string")))


_DOUBLED = f"select 'm' || (regexp_extract(id, '([0-9]+)$', 1)::BIGINT % 60) as id, addr, weight, role, state from ({MEMBERS_SQL})"


def view_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.canonical(_doubled(spark, sf_dir))


CANONICAL = f"""select id, addr, weight, role, state from (select *, row_number() over (partition by id order by case state when 1 then 0 when 2 then 1 when 0 then 2 else 3 end, weight, role, addr) as rn from ({_DOUBLED})) where rn = 1"""


def view_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.canonical(members(spark, sf_dir))
    parts = {"members": v, "ready": M.ready(v), "live": M.live(v), "roots": M.roots(v), "readers": M.readers(v)}
    counted = [d.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).select(F.lit(name).alias("part"), "n", "first") for name, d in parts.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


ROLES = f"""with m as ({MEMBERS_SQL}) select part, count(*) as n, min(id) as first from (select 'members' as part, id from m union all select 'ready', id from m where state = 1
  union all select 'live', id from m where state in (1, 2) union all select 'roots', id from m where state = 1 and role <> 2 union all select 'readers', id from m where state = 1 and role <> 1) group by part"""


def membership_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes heard of directly (any event but a view) within a day before the end of the log."""
    log = access_log(spark, sf_dir).select(F.col("node").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("file") != "view").alias("direct"))
    end = log.agg(F.max("ts")).first()[0]
    return M.expire(log, F.lit(end), F.lit(86_400_000_000))


EXPIRE = f"""select node as id, max(epoch_us(ts)) as last_contact from ({LOG_SQL}) where file <> 'view' group by node having (select max(epoch_us(ts)) from events) - max(epoch_us(ts)) <= 86400000000"""


def refresh_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 99).cast("string"), F.lit(":8001")).alias("addr"))
    return M.refresh_targets(seeds, members(spark, sf_dir), "10.0.0.1:8001")


TARGETS = f"select distinct addr from (select '10.0.0.' || (s_suppkey % 99) || ':8001' as addr from supplier union select addr from ({MEMBERS_SQL})) where addr <> '' and addr <> '10.0.0.1:8001'"


def reader_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.canonical(members(spark, sf_dir))
    ids = access_log(spark, sf_dir).select(F.concat(F.lit("Customer#"), F.lpad(F.col("node").cast("string"), 9, "0")).alias("id")).distinct()
    return M.eligible_readers(ids, v)


READERS = f"select distinct id from (select 'Customer#' || lpad(user_id::VARCHAR, 9, '0') as id from events) where id in (select id from ({MEMBERS_SQL}) where state = 1 and role <> 1 and addr <> '')"


def roster_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters completed by their responder where it is missing."""
    m = members(spark, sf_dir)
    return M.complete_roster(m.where("state = 1"), m.where("id like '%9'")).select("id", "addr")


ANTI = f"with m as ({MEMBERS_SQL}) select id, addr from m where state = 1 union all select id, addr from m where id like '%9' and state <> 1"


def roster_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to a caller that doesn't know the digest, and to one that does."""
    v = M.canonical(members(spark, sf_dir))
    me = v.agg(F.min("id")).first()[0]
    a = M.select_roster(v, "v1-a", "v1-b", me).agg(F.count(F.lit(1)).alias("n")).select(F.lit("other").alias("caller"), "n")
    return a.unionByName(M.select_roster(v, "v1-a", "v1-a", me).agg(F.count(F.lit(1)).alias("n")).select(F.lit("same").alias("caller"), "n"))


SELECT = f"select 'other' as caller, count(*) as n from ({MEMBERS_SQL}) where addr <> '' union all select 'same', 1"


_ROSTERS = """'{"epoch":"' || case when s_suppkey % 5 = 0 then 'x' else '' end || s_suppkey || '","members":[{"id":"a","addr":"h:1","weight":1.5' || case when s_suppkey % 3 = 0 then '' else ',"role":1' end || '}' || case when s_suppkey % 4 = 0 then ',{"addr":"k:2","role":0}' else '' end || ']}'"""


def roster_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters as JSON; some members lack their role or id, some epochs are no numbers."""
    raw = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_ROSTERS).alias("json"))
    return M.decode_rosters(raw).select("s_suppkey", "epoch", "valid", F.size("members").cast("bigint").alias("n"))


DECODE = f"""
with t as (select s_suppkey, ({_ROSTERS})::JSON as j from supplier), p as (select s_suppkey, j ->> '$.epoch' as epoch, (j -> '$.members')::JSON[] as members from t)
select s_suppkey, epoch, regexp_full_match(epoch, '[0-9]+') and len(list_filter(members, lambda x: (x ->> '$.role') is null or (x ->> '$.id') is null)) = 0 as valid, len(members)::BIGINT as n from p
"""


def roster_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responders that their own roster lists more than once."""
    d = _doubled(spark, sf_dir)
    return M.roster_conflicts(d, "m7").unionByName(M.roster_conflicts(members(spark, sf_dir), _READER))


CONFLICTS = f"select id, count(*) as n from ({_DOUBLED}) where id = 'm7' group by id having count(*) > 1"


def asof_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that each request pinned: events as of daily versions."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    v = table(spark, sf_dir, "events").where("event_id % 97 = 5").select(F.col("ts").cast("timestamp").alias("valid_from"), F.col("event_id").alias("epoch"))
    return M.as_of(e, v).select("event_id", "epoch")


ASOF = "select e.event_id, v.event_id as epoch from events e asof left join (select * from events where event_id % 97 = 5) v on e.ts >= v.ts"


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda a, r: F.struct(F.array(*[F.concat(F.lit(x), F.col("s_suppkey").cast("string")) for x in a]).cast("array<string>").alias("addresses"), F.lit(r).cast("boolean").alias("ready"))
    slices = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 10 != 0, 8080).alias("port"), F.array(e(["10.1.0.", "10.2.0."], True), e(["10.3.0."], None), e(["10.4.0."], False), e([], True)).alias("endpoints"))
    return M.endpoint_addresses(slices)


ENDPOINTS = "select distinct p || s_suppkey || ':8080' as addr from supplier, (values ('10.1.0.'), ('10.3.0.')) t(p) where s_suppkey % 10 <> 0"


_EPOCH_LABEL, _ROSTER_LABEL = b"roles-v1\0", b"roster-v1\0"


def epoch_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement epoch and roster digest of the members."""
    v = M.canonical(members(spark, sf_dir))
    return M.epoch(v, _EPOCH_LABEL).crossJoin(M.roster_digest(v, _ROSTER_LABEL))


# The bits of a positive weight: its exponent, corrected for rounding, and what is left as a whole number.
EPOCH = f"""
with m as ({MEMBERS_SQL}), e as (select *, floor(log2(weight)) as e0 from m),
x as (select *, case when weight < pow(2, e0) then e0 - 1 when weight >= pow(2, e0 + 1) then e0 + 1 else e0 end as e1 from e),
b as (select *, (((e1 + 1023)::HUGEINT * 4503599627370496) + ((weight / pow(2, e1) - 1) * 4503599627370496)::HUGEINT)::BIGINT as bits from x),
f as (select flatten(list(list_concat({Q.chars('id')}, [31::UBIGINT], {Q.int_bytes('bits', 'big')}, [role::UBIGINT, 30::UBIGINT]) order by id)) as body from b),
d as (select string_agg(lpad(hex(length(id)::BIGINT), 16, '0') || hex(id) || lpad(hex(length(addr)::BIGINT), 16, '0') || hex(addr) || lpad(hex(bits), 16, '0') || lpad(hex(role::BIGINT), 2, '0'), '' order by id) as body from b where addr <> '')
select {Q.signed(Q.fmix(Q.fnv(Q.FNV_OFFSET, f"list_concat([{', '.join(f'{x}::UBIGINT' for x in _EPOCH_LABEL)}], f.body)")))} as epoch, 'v1-' || sha256(unhex('{_ROSTER_LABEL.hex()}' || d.body)) as digest from f, d
"""


def reader_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader sets of a file as its tracker last told, by the start of the calls."""
    e = access_log(spark, sf_dir).select(F.col("file").alias("object"), (F.col("node") % 7).alias("tracker"), ((F.col("event_id") * 7919) % 10007).alias("started"), F.col("event_id").alias("epoch"), F.array(F.col("node").cast("string")).alias("readers"))
    return M.reader_snapshots(e).select("object", "tracker", "epoch", F.array_join("readers", ",").alias("readers"))


SNAPSHOTS = f"select file as object, node % 7 as tracker, max_by(event_id, ((event_id * 7919) % 10007, event_id)) as epoch, max_by(node::VARCHAR, ((event_id * 7919) % 10007, event_id)) as readers from ({LOG_SQL}) group by all"



def reader_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose file's reader set (here: three nodes by remainder, in any order) isn't that of the event before."""
    e = access_log(spark, sf_dir).select(F.col("file").alias("object"), "event_id", F.array(F.col("node") % 3, (F.col("node") + F.col("event_id") % 2) % 3).alias("readers"))
    return M.changed_readers(e, ["object"], "event_id").select("object", "event_id")


CHANGES = f"""with s as (select file as object, event_id, least(node % 3, (node + event_id % 2) % 3) as a, greatest(node % 3, (node + event_id % 2) % 3) as b from ({LOG_SQL})),
w as (select *, lag((a, b)) over (partition by object order by event_id) as was from s) select object, event_id from w where was is null or was <> (a, b)"""

QUERIES = {
    "reader_snapshots": reader_snapshots, "ring_topn": ring_topn, "owner_share": owner_share, "weighted_share": weighted_share, "rebalance_moved": rebalance_moved, "owned_or_borrowed": owned_or_borrowed, "ring_report": ring_report, "root_walk": root_walk,
    "tracker_owner": tracker_owner, "tree_parent_depth": tree_parent_depth, "tree_children": tree_children, "child_segments": child_segments, "tree_nodes": tree_nodes, "hedge_targets": hedge_targets,
    "view_canonical": view_canonical, "view_roles": view_roles, "membership_expire": membership_expire, "refresh_targets": refresh_targets, "reader_semi": reader_semi, "roster_anti": roster_anti, "roster_select": roster_select,
    "roster_decode": roster_decode, "asof_view": asof_view, "endpoints": endpoints, "epoch_value": epoch_value, "fetch_targets": fetch_targets, "roster_conflicts": roster_conflicts, "reader_changes": reader_changes,
}
ORACLE_SQL = {
    "reader_snapshots": SNAPSHOTS, "ring_topn": RING, "owner_share": OWNER, "weighted_share": WEIGHTED, "rebalance_moved": MOVED, "owned_or_borrowed": OWNED, "ring_report": REPORT, "root_walk": WALK,
    "tracker_owner": TRACKER, "tree_parent_depth": PARENTS, "tree_children": CHILDREN, "child_segments": DEAL, "tree_nodes": NODES, "hedge_targets": HEDGE,
    "view_canonical": CANONICAL, "view_roles": ROLES, "membership_expire": EXPIRE, "refresh_targets": TARGETS, "reader_semi": READERS, "roster_anti": ANTI, "roster_select": SELECT,
    "roster_decode": DECODE, "asof_view": ASOF, "endpoints": ENDPOINTS, "epoch_value": EPOCH, "fetch_targets": TARGETS_OF, "roster_conflicts": CONFLICTS, "reader_changes": CHANGES,
}
