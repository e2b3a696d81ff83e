"""Queries over byte ranges, identities and headers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import sqltext as Q
from ..functions import u64
from ..functions.grid import Grid, clamp, relayable, valid_sizes
from ..operators import requests as R
from ..sources.tables import table

GRID = Grid(chunk=4096, block=1024)
NAMESPACE = "blocks"


def segments_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents as objects of n_chars bytes, asked for from somewhere within them up to their end or a bit before."""
    d = table(spark, sf_dir, "documents").where("n_chars > 0")
    d = d.select("doc_id", ((F.col("doc_id") * 131) % F.col("n_chars")).alias("start"), (F.col("n_chars") - 1 - F.col("doc_id") % 3).alias("end"))
    return GRID.explode_segments(d, "start", "end").select("doc_id", "chunk", "block", F.col("from").alias("from_byte"), F.col("to").alias("to_byte"))


SEGMENTS = """
select doc_id, b // 4 as chunk, b as block, greatest(s, b * 1024) as from_byte, least(e, b * 1024 + 1023) as to_byte
from (select doc_id, s, e, unnest(range(s // 1024, e // 1024 + 1)) as b from (select doc_id, (doc_id * 131) % n_chars as s, n_chars - 1 - doc_id % 3 as e from documents where n_chars > 0) where e >= s)
"""


def grid_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of chunk and block sizes are allowed."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 3).alias("chunk"), (F.col("p_partkey") % 7 - 1).alias("block"))
    return p.select("p_partkey", valid_sizes(F.col("chunk"), F.col("block")).alias("valid"))


SIZED = "select p_partkey, p_size > 3 and p_partkey % 7 > 1 and (p_size - 3) - (p_size - 3) // (p_partkey % 7 - 1) * (p_partkey % 7 - 1) = 0 as valid from part where p_partkey % 7 > 1 union all select p_partkey, false from part where p_partkey % 7 <= 1"


def block_index_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 977 + F.col("l_suppkey")).alias("off"))
    b = GRID.block_index(F.col("off"))
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), GRID.chunk_index(F.col("off")).alias("chunk"), b.alias("block"), GRID.chunk_of_block(b).alias("chunk_of_block"), GRID.block_start(b).alias("start"))


BLOCK_MATH = """
select l_orderkey, l_linenumber::BIGINT as l_linenumber, off // 4096 as chunk, off // 1024 as block, (off // 1024) // 4 as chunk_of_block, (off // 1024) * 1024 as start
from (select *, l_partkey * 977 + l_suppkey as off from lineitem)
"""


def tail_block_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("n_chars > 0")
    last = GRID.block_index(F.col("n_chars") - 1)
    return d.select("doc_id", last.alias("last_block"), GRID.block_len(F.col("n_chars"), last).alias("tail"))


TAIL = "select doc_id, (n_chars - 1) // 1024 as last_block, least(n_chars - (n_chars - 1) // 1024 * 1024, 1024) as tail from documents where n_chars > 0"


def serve_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("s", (F.col("doc_id") * 131) % 6000 - 200).withColumn("e", F.col("s") + (F.col("doc_id") * 17) % 3000)
    return d.select("doc_id", clamp(F.col("s"), F.col("e"), F.col("n_chars")).alias("c")).select("doc_id", "c.satisfiable", F.col("c.start").alias("start_byte"), F.col("c.end").alias("end_byte"))


CLAMP = """
select doc_id, s >= 0 and s < n_chars as satisfiable, case when s >= 0 and s < n_chars then s end as start_byte, case when s >= 0 and s < n_chars then least(e, n_chars - 1) end as end_byte
from (select *, s + (doc_id * 17) % 3000 as e from (select *, (doc_id * 131) % 6000 - 200 as s from documents))
"""


def fetch_block_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("b", (F.col("doc_id") * 7) % 12 - 1).withColumn("size", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("n_chars")))
    return d.select("doc_id", GRID.block_window(F.col("b"), F.col("size")).alias("w")).select("doc_id", "w.status", F.col("w.start").alias("start_byte"), F.col("w.end").alias("end_byte"))


WINDOW = """
select doc_id, case when b < 0 then 'out_of_range' when size > 0 and b * 1024 >= size then 'past_end' else 'ok' end as status,
  case when b >= 0 and not (size > 0 and b * 1024 >= size) then b * 1024 end as start_byte,
  case when b >= 0 and not (size > 0 and b * 1024 >= size) then case when size > 0 then least(b * 1024 + 1023, size - 1) else b * 1024 + 1023 end end as end_byte
from (select doc_id, (doc_id * 7) % 12 - 1 as b, case when doc_id % 10 = 0 then 0 else n_chars end as size from documents)
"""


def block_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open parts of each block that a request in the middle of a document wants."""
    d = table(spark, sf_dir, "documents").where("n_chars > 20").select("doc_id", F.lit(10).cast("bigint").alias("s"), (F.col("n_chars") - 5).alias("e"))
    x = GRID.explode_segments(d, "s", "e")
    return x.select("doc_id", "block", GRID.slice_of_block(F.col("block"), F.col("s"), F.col("e")).alias("w")).select("doc_id", "block", "w.lo", "w.hi")


SLICES = """
select doc_id, b as block, greatest(10 - b * 1024, 0) as lo, least(n_chars - 5 - b * 1024 + 1, 1024) as hi
from (select doc_id, n_chars, unnest(range(0, (n_chars - 5) // 1024 + 1)) as b from documents where n_chars > 20)
"""


def relay_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relay requests declined by their hop count or an index that can't be represented."""
    e = table(spark, sf_dir, "events")
    # The product of any two BIGINTs fits DECIMAL(38,0), the remainder DECIMAL(20,0).
    block = (F.col("event_id").cast("decimal(19,0)") * F.lit("9007199254740993").cast("decimal(19,0)")).cast("decimal(38,0)") % F.lit("18446744073709551615").cast("decimal(20,0)")
    hop = (F.col("event_id") % 70).cast("int")
    ok = relayable(block, GRID)
    return e.select("event_id", F.when(~ok, "bad_index").when(hop >= 64, "hop_bound").otherwise("relay").alias("verdict"))


RELAY = """
select event_id, case when (event_id::HUGEINT * 9007199254740993) % 18446744073709551615 > 9007199254740990 then 'bad_index' when event_id % 70 >= 64 then 'hop_bound' else 'relay' end as verdict from events
"""

_HEADERS = "case l_linenumber % 8 when 0 then '' when 1 then 'bytes=' || l_partkey || '-' || (l_partkey + l_suppkey) when 2 then 'bytes=' || l_partkey || '-' when 3 then 'bytes=-' || l_suppkey when 4 then 'bytes=9-3' when 5 then 'bytes=0-1,4-5' when 6 then 'items=1-2' else 'bytes= ' || l_suppkey || ' - 99999 ' end"


def range_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("h", F.expr(_HEADERS)).withColumn("size", F.col("l_orderkey") % 700)
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), I.parse_range(F.col("h"), F.col("size")).alias("r")).select("l_orderkey", "l_linenumber", F.col("r.start").alias("start_byte"), F.col("r.end").alias("end_byte"), "r.is_range", "r.ok")


RANGE = f"""
with t as (select l_orderkey, l_linenumber::BIGINT as l_linenumber, {_HEADERS} as h, l_orderkey % 700 as size from lineitem),
p as (select *, trim(substr(h, 7)) as spec, starts_with(h, 'bytes=') and not contains(trim(substr(h, 7)), ',') and contains(trim(substr(h, 7)), '-') as shaped from t),
q as (select *, try_cast(nullif(trim(split_part(spec, '-', 1)), '') as BIGINT) as a, try_cast(nullif(trim(split_part(spec, '-', 2)), '') as BIGINT) as b,
        trim(split_part(spec, '-', 1)) = '' as suffix, trim(split_part(spec, '-', 2)) = '' as opened from p),
r as (select *, case when h = '' then size <> 0 when not shaped then false when suffix then coalesce(b > 0 and size > 0, false) when opened then coalesce(a >= 0 and a < size, false)
        else coalesce(a >= 0 and b >= a and a < size, false) end as ok from q)
select l_orderkey, l_linenumber, case when not ok then 0 when h = '' then 0 when suffix then size - least(b, size) else a end as start_byte,
  case when not ok then 0 when h = '' or suffix or opened then size - 1 else least(b, size - 1) end as end_byte, shaped and h <> '' as is_range, ok from r
"""

_CR = "case o_orderkey % 6 when 0 then 'bytes 0-' || (o_orderkey % 900) || '/5000' when 1 then 'bytes 10-99/100' when 2 then 'bytes 4-9/*' when 3 then 'bytes 0-99' when 4 then ' bytes 0-99/100 ' else 'units 1-2/3' end"


def content_range_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("h", F.expr(_CR)).withColumn("n", F.when(F.col("o_orderkey") % 2 == 0, F.lit(100)).otherwise(90).cast("bigint"))
    c = I.content_range(F.col("h"))
    s, e = F.when(F.col("o_orderkey") % 6 == 1, 10).otherwise(0).cast("bigint"), F.when(F.col("o_orderkey") % 6 == 1, 120).otherwise(99).cast("bigint")
    return o.select("o_orderkey", c["start"].alias("cr_start"), c["end"].alias("cr_end"), c["total"].alias("cr_total"), I.partial_verdict(F.col("h"), s, e, F.col("n")).alias("verdict"))


CONTENT = f"""
with t as (select o_orderkey, {_CR} as h, case when o_orderkey % 2 = 0 then 100 else 90 end as n, case when o_orderkey % 6 = 1 then 10 else 0 end as s, case when o_orderkey % 6 = 1 then 120 else 99 end as e from orders),
c as (select *, regexp_extract(trim(h), '^bytes ([^/]*)/', 1) as rest,
  coalesce(try_cast(nullif(trim(regexp_extract(h, '/([^/]*)$', 1)), '') as BIGINT), -1) as tot from t),
p as (select *, try_cast(nullif(trim(regexp_extract(rest, '^([^-]*)-', 1)), '') as BIGINT) as cs, try_cast(nullif(trim(regexp_extract(rest, '^[^-]*-(.*)$', 1)), '') as BIGINT) as ce from c)
select o_orderkey, cs as cr_start, ce as cr_end, tot as cr_total,
  case when n <> e - s + 1 and not coalesce(tot > 0 and cs = s and ce = tot - 1 and ce < e and n = ce - cs + 1, false) then 'bad_length'
       when coalesce(cs <> s, false) then 'bad_start' when n <> e - s + 1 then 'clamped' else 'ok' end as verdict from p
"""


def ignored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("s", F.col("doc_id") % 900 * 3)
    return d.select("doc_id", I.ignored_range(F.col("n_chars"), F.col("s"), F.col("s") + 255).alias("r")).select("doc_id", "r.ok", "r.length")


IGNORED = """
select doc_id, (n_chars = 0 and s = 0) or s < n_chars as ok, case when n_chars = 0 and s = 0 then 0 when s < n_chars then least(s + 255, n_chars - 1) - s + 1 end as length
from (select *, doc_id % 900 * 3 as s from documents)
"""

# Pages carry no digests: a third of the urls gets one as a segment, a third the content store's layout.
_URLS = "case page_id % 3 when 0 then replace(url, '/en/', '/SHA256:' || sha256(cast(page_id as varchar)) || '/') when 1 then 'HTTPS://User:pw@Cdn.Example.com:8443/v2/blobs/SHA256/' || upper(substr(sha256(cast(page_id as varchar)), 1, 2)) || '/' || sha256(cast(page_id as varchar)) || '?sig=1' else url end"
_URLS_SPARK = "case page_id % 3 when 0 then replace(url, '/en/', '/sha256:' || upper(sha2(cast(page_id as string), 256)) || '/') when 1 then 'HTTPS://User:pw@Cdn.Example.com:8443/v2/blobs/SHA256/' || upper(substr(sha2(cast(page_id as string), 256), 1, 2)) || '/' || sha2(cast(page_id as string), 256) || '?sig=1' else url end"
_URLS_SQL = _URLS.replace("'/SHA256:' || sha256(cast(page_id as varchar))", "'/sha256:' || upper(sha256(cast(page_id as varchar)))")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("u", F.expr(_URLS_SPARK))


def object_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", I.object_id(F.col("u")).alias("o")).select("page_id", F.col("o.id").alias("object_id"), "o.content_addressed")


OBJECT = rf"""
with t as (select page_id, {_URLS_SQL} as u from pages),
p as (select page_id, u, regexp_extract(u, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', ['scheme', 'auth', 'path']) as m from t),
d as (select page_id, lower(list_filter(string_split(m.path, '/'), lambda s: regexp_full_match(s, '[a-z0-9]+:[0-9A-Fa-f]{{32,}}'))[1]) as dig,
  regexp_extract(lower(m.path) || '/', '/blobs/sha256/([0-9a-f][0-9a-f])/([0-9a-f]{{64}})/', ['pre', 'hex']) as b,
  lower(m.scheme) || '://' || lower(regexp_replace(m.auth, '^.*@', '')) || m.path as endpoint from p)
select page_id, coalesce(dig, case when b.hex <> '' and substr(b.hex, 1, 2) = b.pre then 'sha256:' || b.hex end, endpoint) as object_id,
  dig is not null or (b.hex <> '' and substr(b.hex, 1, 2) = b.pre) as content_addressed from d
"""


def digest_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether urls are content-addressed with the content store's layout switched on, and without."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", I.object_id(F.col("u"))["content_addressed"].alias("with_layout"), I.object_id(F.col("u"), False)["content_addressed"].alias("plain"))


LAYOUT = OBJECT.replace("select page_id, coalesce(dig,", "select page_id, dig is not null as plain, coalesce(dig,")
LAYOUT = f"select page_id, content_addressed as with_layout, plain from ({LAYOUT})"


def origin_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", I.origin_key(F.col("u")).alias("origin_key"))


ORIGIN = rf"""
with t as (select page_id, {_URLS_SQL} as u from pages),
p as (select page_id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', ['scheme', 'auth', 'path']) as m from t)
select page_id, lower(m.scheme) || '://' || lower(regexp_replace(m.auth, '^.*@', '')) || m.path as origin_key from p
"""


def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", I.redact(F.col("u")).alias("redacted"))


REDACT = rf"select page_id, regexp_replace(regexp_replace({_URLS_SQL}, '^([A-Za-z]+://)[^/?#@]*@', '\1'), '\?.*$', '?<redacted>') as redacted from pages"

_SIZES = "case p_partkey % 9 when 0 then cast(p_size as {s}) when 1 then p_size || 'KiB' when 2 then p_size || '.5 MB' when 3 then p_size || 'g' when 4 then ' ' || p_size || ' TiB ' when 5 then '-' || p_size when 6 then p_size || 'XB' when 7 then 'KB' else p_size || '.25b' end"


def byte_size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", I.parse_byte_size(F.expr(_SIZES.format(s="string"))).alias("bytes"))


SIZES = """
select p_partkey, case p_partkey % 9 when 0 then p_size::BIGINT when 1 then p_size::BIGINT * 1024 when 2 then ((p_size + 0.5) * 1000000)::BIGINT when 3 then p_size::BIGINT * 1000000000
  when 4 then p_size::BIGINT * 1099511627776 when 8 then p_size::BIGINT end as bytes from part
"""

_PATHS = "case p_partkey % 6 when 0 then '/v2/lib/blobs/x/blobs/sha256:' || repeat('ab', 32) when 1 then '/v2/a/manifests/latest' when 2 then '/v2/a/tags/list' when 3 then '/v2/a/referrers/b/manifests/c' when 4 then '/v1/a/blobs/sha256:00' else '/v2/a/b/blobs/short:00' end"


def registry_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("p", F.expr(_PATHS))
    return p.select("p_partkey", I.blob_digest(F.col("p")).alias("digest"), I.scope_for(F.col("p")).alias("scope"), I.route(F.col("p")).alias("route"), I.upstream_url(F.lit("https://up.example.com/"), F.col("p")).alias("upstream"))


REGISTRY = f"""
select p_partkey, case when p_partkey % 6 = 0 then 'sha256:' || repeat('ab', 32) end as digest,
  case p_partkey % 6 when 0 then 'repository:lib/blobs/x:pull' when 1 then 'repository:a:pull' when 2 then 'repository:a:pull' when 3 then 'repository:a/referrers/b:pull' when 5 then 'repository:a/b:pull' end as scope,
  case when p_partkey % 6 = 4 then 'prefix' else 'registry' end as route, 'https://up.example.com' || {_PATHS} as upstream from part
"""


_CHALLENGES = """case s_suppkey % 5 when 0 then 'Bearer realm="https://auth.example.com/t",service="s' || s_suppkey || '",scope="repository:a:pull,push"' when 1 then 'bearer  scope = "x,y" , Realm=plain' || s_suppkey
  when 2 then 'Basic realm="only"' when 3 then ' Bearer service="a",service="b' || s_suppkey || '",junk' else 'Negotiate' end"""


def challenge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.challenge(F.expr(_CHALLENGES))
    return table(spark, sf_dir, "supplier").select("s_suppkey", c["scheme"].alias("scheme"), c["realm"].alias("realm"), c["service"].alias("service"), c["scope"].alias("scope"))


CHALLENGE = f"""
with t as (select s_suppkey, trim({_CHALLENGES}) as h from supplier),
p as (select s_suppkey, h, regexp_extract_all(regexp_extract(h, '^\\S+ (.*)$', 1), '((?:"[^"]*(?:"|$)|[^,"])+)') as parts from t),
v as (select s_suppkey, h, list_transform(list_filter(parts, lambda x: contains(x, '=')), lambda x: {{'k': lower(trim(split_part(x, '=', 1))), 'v': trim(trim(substr(x, strpos(x, '=') + 1)), '"')}}) as kv from p),
w as (select s_suppkey, split_part(h, ' ', 1) as scheme, list_last(list_filter(kv, lambda x: x.k = 'realm')).v as realm, list_last(list_filter(kv, lambda x: x.k = 'service')).v as service, list_last(list_filter(kv, lambda x: x.k = 'scope')).v as scope from v)
select s_suppkey, scheme, coalesce(realm, '') as realm, coalesce(service, '') as service, coalesce(scope, '') as scope from w
"""


def block_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of blocks and back; the chunk key is negative as a BIGINT for half of them."""
    p = table(spark, sf_dir, "part").withColumn("chunk", F.when(F.col("p_partkey") % 2 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey"))).withColumn("path", I.block_path(F.col("chunk"), F.col("p_partkey") * 3))
    back = I.parse_block_path(F.col("path"))
    return p.select("p_partkey", "path", back["chunk"].cast("string").alias("chunk_u"), back["block"].cast("string").alias("block_u"))


BLOCK_PATHS = """
select p_partkey, '/peer/v2/block/' || lower(lpad(hex(u), 16, '0')) || '/' || (p_partkey * 3) as path, u::VARCHAR as chunk_u, (p_partkey * 3)::VARCHAR as block_u
from (select p_partkey, ((case when p_partkey % 2 = 0 then 18446744073709551616::HUGEINT - p_partkey else p_partkey::HUGEINT end) % 18446744073709551616::HUGEINT)::UBIGINT as u from part)
"""


_PEERS = "'n' || s_suppkey || '@h1:80, m@h2:81#root-only,k@h' || s_suppkey || ':82#non-root,,x@h4:83#ordinary' || case when s_suppkey % 2 = 0 then ',bad' else '' end"


def peers_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(I.parse_peers(F.expr(_PEERS))).alias("p")).select("s_suppkey", "p.id", "p.addr", F.col("p.role").cast("bigint").alias("role"))


PEERS = f"""
select s_suppkey, case when shaped then split_part(x, '@', 1) end as id, case when shaped then split_part(split_part(x, '@', 2), '#', 1) end as addr,
  case when not shaped or not contains(x, '#') then 0 else case split_part(x, '#', 2) when 'ordinary' then 0 when 'root-only' then 1 when 'non-root' then 2 end end::BIGINT as role
from (select s_suppkey, x, contains(x, '@') as shaped from (select s_suppkey, trim(unnest(string_split({_PEERS}, ','))) as x from supplier) where x <> '')
"""

_ADDRS = "case s_suppkey % 7 when 0 then '0.0.0.0:80' when 1 then '[::]:80' when 2 then '10.0.0.1:80' when 3 then '[fe80::1%eth0]:80' when 4 then ':80' when 5 then '[0:0::0%eth0]:80' else 'node-a:' || s_suppkey end"
_MEMBER = "case when s_suppkey % 2 = 0 then s_name else s_name || ' x' end"
_METRIC = "case when s_suppkey % 3 = 0 then 'a_b' || s_suppkey when s_suppkey % 3 = 1 then 'a:b' else s_suppkey || 'a' end"
_LABEL = "'a\"\\' || s_suppkey"
_HOP = "case s_suppkey % 4 when 0 then '' when 1 then '' || s_suppkey when 2 then '-1' else '1x' end"
_SEEDS = "case s_suppkey % 8 when 0 then 'dns:peers.example:' || (s_suppkey * 1000) when 1 then 'static:a:1, b:2,' when 2 then 'c:3,d:' || s_suppkey when 3 then 'dns:peers.example' when 4 then 'a,b' when 5 then ' ' when 6 then 'dns::80' else 'static:[::1]:90' end"
_SPECS = "case s_suppkey % 4 when 0 then 'ns/svc' || s_suppkey when 1 then 'ns/svc/80' when 2 then 'ns//80' else 'ns' end"
_ESCAPED = "'s' || chr(31) || s_suppkey || '%x'"


def names_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that may be advertised, member ids, metric names, label escapes, hop headers, seeders, endpoint specs, escaped separators."""
    s = table(spark, sf_dir, "supplier")
    backslash = _LABEL.replace("\\", "\\\\")
    seeder, end = I.parse_seeder(F.expr(_SEEDS)), I.parse_endpoint_spec(F.expr(_SPECS))
    return s.select(
        "s_suppkey", I.advertised_ok(F.expr(_ADDRS)).alias("advertised"), I.valid_member_id(F.expr(_MEMBER)).alias("member_ok"), I.valid_metric_name(F.expr(_METRIC)).alias("metric_ok"),
        I.escape_label(F.expr(backslash)).alias("label"), I.parse_hop(F.expr(_HOP)).cast("bigint").alias("hop"), seeder["kind"].alias("seed_kind"), seeder["target"].alias("seed_target"), F.size(seeder["addrs"]).cast("bigint").alias("seeds"),
        end["service"].alias("service"), end["port"].alias("port"), I.escape_unit_separator(F.expr(_ESCAPED)).alias("escaped"),
    )


NAMES = rf"""
with t as (select s_suppkey, {_ADDRS} as addr, {_MEMBER} as member, {_METRIC} as metric, {_LABEL} as label, {_HOP} as hop, trim({_SEEDS}) as seed, {_SPECS} as spec, {_ESCAPED} as sep from supplier),
h as (select *, regexp_replace(trim(regexp_extract(addr, '^(.*):[^:]*$', 1), '[]'), '%.*$', '') as host, starts_with(seed, 'dns:') as dns, case when starts_with(seed, 'dns:') then substr(seed, 5) when starts_with(seed, 'static:') then substr(seed, 8) else seed end as rest from t),
g as (select *, list_filter(list_transform(string_split(rest, ','), lambda x: trim(x)), lambda x: x <> '') as items, try_cast(regexp_extract(rest, ':([0-9]+)$', 1) as BIGINT) as port_no, string_split(spec, '/') as sp from h),
k as (select *, case when dns then coalesce(port_no between 1 and 65535, false) and length(regexp_extract(rest, '^(.*):[0-9]+$', 1)) > 0 else len(items) > 0 and len(list_filter(items, lambda x: not regexp_full_match(x, '(\[[^\[\]]*\]|[^\[\]:]*):[^:\[\]]*'))) = 0 end as seed_ok from g)
select s_suppkey, host <> '' and not regexp_full_match(host, '[0:.]+') as advertised, regexp_full_match(member, '[!-~]+') as member_ok, regexp_full_match(metric, '[a-zA-Z_][a-zA-Z0-9_]*') as metric_ok,
  replace(replace(label, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') as label, case when hop = '' then 0 else try_cast(regexp_extract(hop, '^[0-9]+$') as BIGINT) end as hop,
  case when seed_ok then case when dns then 'dns' else 'static' end end as seed_kind, case when seed_ok then case when dns then rest else array_to_string(items, ',') end end as seed_target,
  case when seed_ok then case when dns then 1 else len(items) end end::BIGINT as seeds,
  case when len(sp) in (2, 3) and sp[2] <> '' then sp[2] end as service, case when len(sp) in (2, 3) and sp[2] <> '' then coalesce(nullif(sp[3], ''), 'peer') end as port,
  replace(replace(sep, '%', '%25'), chr(31), '%1F') as escaped from k
"""

_URIS = "case s_suppkey % 6 when 0 then '/v2' when 1 then '/v2/a/blobs/sha256:00' when 2 then '/get/https://h.example/' || s_suppkey when 3 then '/get/ftp://h.example/x' when 4 then '/v2x/https://h.example' else '/get/http://h.example//a' end"
_LISTENS = "case s_suppkey % 4 when 0 then ':' || s_suppkey when 1 then '10.1.1.1:80' when 2 then '[::]:81' else 'nonsense' end"
_TOLD = "case s_suppkey % 5 when 0 then 'me.example:90' when 1 then '0.0.0.0:90' else '' end"


def front_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which front end serves a request and from where, and the address that a node tells others."""
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", I.route(F.expr(_URIS)).alias("front"), I.resolve(F.expr(_URIS), "/get/").alias("upstream"), I.advertised_addr(F.expr(_TOLD), F.expr(_LISTENS), F.lit("fd00::7")).alias("addr"))


FRONTS = rf"""
with t as (select s_suppkey, {_URIS} as u, {_TOLD} as told, {_LISTENS} as listen from supplier)
select s_suppkey, case when u = '/v2' or u[1:4] = '/v2/' then 'registry' else 'prefix' end as front, case when regexp_matches(u, '^/get/https?://') then substr(u, 6) end as upstream,
  case when told <> '' then case when not regexp_matches(told, '^[0.]+:') then told end when not contains(listen, ':') then null when regexp_matches(listen, '^([0:.]|\[[0:]*\])*:[0-9]+$') then '[fd00::7]:' || string_split(listen, ':')[-1] else listen end as addr from t
"""

_STATUS = "case o_orderkey % 5 when 0 then 206 when 1 then 200 when 2 then 416 when 3 then 206 else 503 end"
_TOTALS = "case o_orderkey % 5 when 0 then 'bytes 0-0/' || o_custkey when 3 then 'bytes 0-0/*' else '' end"


def size_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of objects by the answers to a request for their first byte."""
    o = table(spark, sf_dir, "orders")
    length = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
    return o.select("o_orderkey", I.size_probe(F.expr(_STATUS), F.expr(_TOTALS), length).alias("p")).select("o_orderkey", "p.ok", "p.size", "p.no_range")


PROBE = f"""
with t as (select o_orderkey, {_STATUS} as status, try_cast(regexp_extract({_TOTALS}, '/([0-9]+)$', 1) as BIGINT) as total, case when o_orderkey % 2 = 0 then o_custkey else -1 end as length from orders),
k as (select *, status in (200, 416) or (status = 206 and total is not null) as ok from t)
select o_orderkey, ok, case when ok then case status when 416 then 0 when 206 then total else length end end::BIGINT as size, ok and status = 200 as no_range from k
"""


def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of origins that ignore ranges, handed on as they are."""
    p = table(spark, sf_dir, "pages")
    n = F.length(F.coalesce("html", F.lit(""))).cast("bigint")
    headers = F.create_map(F.lit("ETag"), F.concat(F.lit("e"), F.col("page_id").cast("string")), F.lit("Server"), F.lit("x"), F.lit("content-length"), n.cast("string"))
    r = I.passthrough(F.when(F.col("page_id") % 4 == 0, "HEAD").otherwise("GET"), F.lit(200), headers, n)
    return p.select("page_id", r.alias("r")).select("page_id", "r.status", F.array_join(F.transform(F.array_sort(F.map_entries("r.headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"), "r.bytes")


PASSED = "select page_id, 200 as status, 'ETag=e' || page_id || ';content-length=' || length(coalesce(html, '')) as headers, case when page_id % 4 = 0 then 0 else length(coalesce(html, '')) end as bytes from pages"


def credential_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent to each page's host first: the client's own authorization, a token for the host and scope, or nothing."""
    p = table(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("/v2/r"), (F.col("page_id") % 3).cast("string"), F.lit("/blobs/x"))).withColumn("client_auth", F.when(F.col("page_id") % 7 == 0, "Basic abc"))
    hosts = p.select(I._host(F.col("url")).alias("host")).where("host like '%.com'").distinct()
    tokens = hosts.crossJoin(spark.createDataFrame([("repository:r0:pull",), ("repository:r1:pull",)], "scope string")).withColumn("token", F.concat("host", F.lit("-"), "scope"))
    return R.with_credentials(p.select("page_id", "url", "path", "client_auth"), hosts, tokens).select("page_id", "authorization", "may_exchange")


CREDENTIALS = """
with p as (select page_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) as host, 'repository:r' || (page_id % 3) || ':pull' as scope, case when page_id % 7 = 0 then 'Basic abc' end as client from pages)
select page_id, coalesce(client, case when ends_with(host, '.com') and scope <> 'repository:r2:pull' then 'Bearer ' || host || '-' || scope end) as authorization, ends_with(host, '.com') as may_exchange from p
"""


def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the first chunks of each document, and of the document itself."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("oid"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("chunk"))
    return d.select("doc_id", "chunk", u64.chunk_key(NAMESPACE, F.col("oid"), F.col("chunk")).alias("chunk_key"), u64.file_key(NAMESPACE, F.col("oid")).alias("file_key"))


CHUNK_KEYS = f"""
select doc_id, chunk, {Q.signed('ck')} as chunk_key, {Q.signed('fk')} as file_key from (
  select doc_id, chunk, {Q.chunk_key(NAMESPACE, 'oid', 'chunk')} as ck, {Q.chunk_key(NAMESPACE, 'oid', '-1')} as fk
  from (select doc_id, 'doc-' || doc_id as oid, unnest(range(0, 2)) as chunk from documents))
"""


def relay_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relay requests whose key is that of their object and chunk; every fifth claims a neighbour's."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("oid"))
    claimed = u64.chunk_key(NAMESPACE, F.col("oid"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    own = u64.chunk_key(NAMESPACE, F.col("oid"), F.lit(0))
    return d.select("doc_id", own.alias("own"), claimed.alias("claimed")).select("doc_id", "own", "claimed", (F.col("own") == F.col("claimed")).alias("relayable"))


RELAY_KEY = f"""
select doc_id, {Q.signed('a')} as own, {Q.signed('b')} as claimed, a = b as relayable from (select doc_id, {Q.chunk_key(NAMESPACE, 'oid', '0')} as a, {Q.chunk_key(NAMESPACE, 'oid', 'idx')} as b
  from (select doc_id, 'doc-' || doc_id as oid, case when doc_id % 5 = 0 then 1 else 0 end as idx from documents))
"""


def cache_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native finaliser over block keys."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("b"))
    return li.select("l_orderkey", "l_linenumber", u64.block_key_hash(F.col("c"), F.col("b")).alias("key_hash"))


KEY_HASH = f"""
select l_orderkey, l_linenumber, {Q.signed('h')} as key_hash from (select l_orderkey, l_linenumber::BIGINT as l_linenumber,
  {Q.fmix('xor(l_partkey::UBIGINT, ' + Q.mul('l_suppkey', 0x9E3779B97F4A7C15) + ')')} as h from lineitem)
"""

def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which requests share a transfer, and whether a body fits a buffer of 2000 bytes."""
    p = _pages(spark, sf_dir)
    b = I.read_bounded(F.length("html").cast("bigint"), F.lit(2000).cast("bigint"))
    return p.select("page_id", F.replace(I.coalescing_key(F.col("u"), F.lit(0), F.lit(1023)), F.lit("\0"), F.lit("|")).alias("key"), b["ok"].alias("fits"), b["taken"].alias("taken"))


REQUEST_KEYS = f"with o as ({OBJECT}) select page_id, object_id || '|0:1023' as key, length(html) <= 2000 as fits, least(length(html), 2000) as taken from o join pages using (page_id)"

QUERIES = {
    "grid_sizes": grid_sizes, "request_keys": request_keys, "segments_explode": segments_explode, "block_index_math": block_index_math, "tail_block_len": tail_block_len, "serve_clamp": serve_clamp, "fetch_block_window": fetch_block_window, "block_slices": block_slices,
    "relay_gate": relay_gate, "range_header_parse": range_header_parse, "content_range_validate": content_range_validate, "ignored_range": ignored_range, "object_identity": object_identity, "digest_layout": digest_layout,
    "origin_key": origin_key, "redact_url": redact_url, "byte_size_parse": byte_size_parse, "registry_paths": registry_paths, "challenge_parse": challenge_parse, "block_paths": block_paths, "peers_parse": peers_parse,
    "names_checked": names_checked, "front_ends": front_ends, "size_probe": size_probe, "passthrough": passthrough, "credential_join": credential_join, "chunk_keys": chunk_keys, "relay_key_check": relay_key_check, "cache_key_hash": cache_key_hash,
}
ORACLE_SQL = {
    "grid_sizes": SIZED, "request_keys": REQUEST_KEYS, "segments_explode": SEGMENTS, "block_index_math": BLOCK_MATH, "tail_block_len": TAIL, "serve_clamp": CLAMP, "fetch_block_window": WINDOW, "block_slices": SLICES,
    "relay_gate": RELAY, "range_header_parse": RANGE, "content_range_validate": CONTENT, "ignored_range": IGNORED, "object_identity": OBJECT, "digest_layout": LAYOUT,
    "origin_key": ORIGIN, "redact_url": REDACT, "byte_size_parse": SIZES, "registry_paths": REGISTRY, "challenge_parse": CHALLENGE, "block_paths": BLOCK_PATHS, "peers_parse": PEERS,
    "names_checked": NAMES, "front_ends": FRONTS, "size_probe": PROBE, "passthrough": PASSED, "credential_join": CREDENTIALS, "chunk_keys": CHUNK_KEYS, "relay_key_check": RELAY_KEY, "cache_key_hash": KEY_HASH,
}
