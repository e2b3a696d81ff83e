"""Names and headers: object identity, endpoint identity, ranges, registry paths, sizes.

All are expressions over string columns, in generated code, by regular expressions: url functions of
the engine reject inputs for which a fallback is defined here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
DIGEST = r"^[a-z0-9]+:[0-9A-Fa-f]{32,}$"
#: Hex digits of a digest by algorithm.
HEX_LENGTH = {"sha256": 64, "sha512": 128}


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, URL, i)


def _host(url: Column) -> Column:
    """Host with port, lower-cased, without user information."""
    return F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))


def is_digest(s: Column) -> Column:
    return s.rlike(DIGEST)


def object_id(url: Column, distribution_layout: bool = True) -> Column:
    """Struct ``(id, content_addressed)`` of a url.

    A digest in any path segment (split before percent-decoding) names the content, in lower case; next the
    layout ``blobs/<algorithm>/<2 hex>/<hex>``; else scheme, host and escaped path name it. Without either,
    the url up to its query or fragment does.
    """
    segments = F.transform(F.split(_part(url, 3), "/"), lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))
    digest = F.get(F.filter(segments, is_digest), F.lit(0))
    found = F.lower(digest)
    if distribution_layout:
        joined = F.lower(F.concat(F.lit("/"), F.array_join(segments, "/"), F.lit("/")))
        for algorithm, n in HEX_LENGTH.items():
            hit = F.regexp_extract(joined, rf"/blobs/{algorithm}/([0-9a-f]{{2}})/(\1[0-9a-f]{{{n - 2}}})(?=/)", 2)
            # The directory name is matched in its own case.
            there = F.array_contains(segments, "blobs")
            found = F.coalesce(found, F.when((hit != "") & there, F.concat(F.lit(f"{algorithm}:"), hit)))
    scheme, host = F.lower(_part(url, 1)), _host(url)
    endpoint = F.when((scheme != "") | (host != ""), F.concat(scheme, F.lit("://"), host, _part(url, 3))).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))
    return F.struct(F.coalesce(found, endpoint).alias("id"), found.isNotNull().alias("content_addressed"))


def escape_unit_separator(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("%"), F.lit("%25")), F.lit("\x1f"), F.lit("%1F"))


def origin_key(url: Column) -> Column:
    """Endpoint identity: lower-case scheme and host, no user, query or fragment."""
    scheme, authority = _part(url, 1), F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//)", 1)
    return F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), authority, _host(url), _part(url, 3))


def drop_user(url: Column) -> Column:
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#@]*@", "$1")


def redact(url: Column) -> Column:
    """Without user information, and the query hidden."""
    return F.regexp_replace(drop_user(url), r"(?s)\?.*$", "?<redacted>")


def try_long(s: Column) -> Column:
    """Decimal integer with an optional sign, null otherwise or beyond 64 bits."""
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def parse_range(header: Column, size: Column) -> Column:
    """Struct ``(start, end, is_range, ok)`` of a Range header against an object's size.

    An empty header asks for all. One range of ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n`` is understood.
    """
    size = size.cast("bigint")
    spec = F.trim(F.substr(header, F.lit(7)))
    lo, hi = F.trim(F.regexp_extract(spec, "^([^-]*)-", 1)), F.trim(F.regexp_extract(spec, "^[^-]*-(.*)$", 1))
    a, b = try_long(lo), try_long(hi)
    shaped = F.startswith(header, F.lit("bytes=")) & ~F.contains(spec, F.lit(",")) & F.contains(spec, F.lit("-"))
    suffix, opened = lo == "", hi == ""
    ok_suffix = F.coalesce((b > 0) & (size > 0), F.lit(False))
    ok_open = F.coalesce((a >= 0) & (a < size), F.lit(False))
    ok_both = F.coalesce((a >= 0) & (b >= a) & (a < size), F.lit(False))
    ok = F.when(header == "", size != 0).when(~shaped, F.lit(False)).when(suffix, ok_suffix).when(opened, ok_open).otherwise(ok_both)
    start = F.when(header == "", F.lit(0)).when(suffix, size - F.least(b, size)).otherwise(a)
    end = F.when((header == "") | suffix | opened, size - 1).otherwise(F.least(b, size - 1))
    zero = F.lit(0).cast("bigint")
    return F.struct(F.when(ok, start).otherwise(zero).cast("bigint").alias("start"), F.when(ok, end).otherwise(zero).cast("bigint").alias("end"), (shaped & (header != "")).alias("is_range"), ok.alias("ok"))


def content_range(v: Column) -> Column:
    """Struct ``(start, end, total)`` of ``bytes s-e/t``; parts that can't be read are null, an unknown total is -1."""
    rest = F.regexp_extract(F.trim(v), r"^bytes ([^/]*)/", 1)
    total = F.coalesce(try_long(F.trim(F.regexp_extract(v, r"/([^/]*)$", 1))), F.lit(-1).cast("bigint"))
    return F.struct(try_long(F.trim(F.regexp_extract(rest, "^([^-]*)-", 1))).alias("start"), try_long(F.trim(F.regexp_extract(rest, "^[^-]*-(.*)$", 1))).alias("end"), total.alias("total"))


def partial_verdict(header: Column, start: Column, end: Column, length: Column) -> Column:
    """"ok", "clamped", "bad_length" or "bad_start" for a partial answer of ``length`` bytes to a request."""
    c = content_range(header)
    whole = length == end - start + 1
    tail = F.coalesce((c["total"] > 0) & (c["start"] == start) & (c["end"] == c["total"] - 1) & (c["end"] < end) & (length == c["end"] - c["start"] + 1), F.lit(False))
    moved = F.coalesce(c["start"] != start, F.lit(False))
    return F.when(~whole & ~tail, "bad_length").when(moved, "bad_start").when(~whole, "clamped").otherwise("ok")


def ignored_range(total: Column, start: Column, end: Column) -> Column:
    """Struct ``(ok, length)``: the window taken from a full body of ``total`` bytes that ignored the range."""
    empty = (total == 0) & (start == 0)
    ok = empty | (start < total)
    return F.struct(ok.alias("ok"), F.when(empty, F.lit(0)).when(ok, F.least(end, total - 1) - start + 1).cast("bigint").alias("length"))


def parse_byte_size(s: Column) -> Column:
    """Bytes of "1.5GiB", "10 MB" or "4096"; null where it can't be read, is negative or exceeds 2**62."""
    t = F.trim(s)
    number = F.regexp_extract(t, r"^([0-9.+\-]*)", 1)
    unit = F.lower(F.trim(F.regexp_extract(t, r"^[0-9.+\-]*(.*)$", 1)))
    plain = (unit == "") & ~F.contains(number, F.lit("."))
    base = F.regexp_replace(unit, "b$", "")
    factor = F.when(base == "", F.lit(1.0))
    for i, u in enumerate("kmgt", 1):
        factor = factor.when(base == f"{u}i", F.lit(float(1 << (10 * i)))).when(base == u, F.lit(float(1000**i)))
    value = F.when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), number.try_cast("double"))
    size = value * factor
    return F.when(plain, F.when(try_long(number) >= 0, try_long(number))).when((value >= 0) & (size <= float(1 << 62)), F.floor(size)).cast("bigint")


def blob_digest(path: Column) -> Column:
    """The digest of ``/v2/<name>/blobs/<digest>``, behind the last ``/blobs/``; null otherwise."""
    d = F.regexp_extract(path, r"^/v2/(.+)/blobs/([^/]+)$", 2)
    return F.when(is_digest(d), d)


def scope_for(path: Column) -> Column:
    """``repository:<name>:pull`` for a registry path; separators are tried in order, each at its last place."""
    found = [F.regexp_extract(path, rf"^/v2/(.+)/{kind}/", 1) for kind in ("blobs", "manifests", "tags", "referrers")]
    name = F.coalesce(*[F.nullif(f, F.lit("")) for f in found])
    return F.concat(F.lit("repository:"), name, F.lit(":pull"))


def challenge(header: Column) -> Column:
    """Struct ``(scheme, realm, service, scope)`` of a WWW-Authenticate header; the empty string where absent.

    Parameters are separated by commas outside quotes; of one that repeats the last counts. Values may be unquoted.
    """
    h = F.trim(header)
    parts = F.regexp_extract_all(F.regexp_extract(h, r"(?s)^\S+ (.*)$", 1), F.lit(r'((?:"[^"]*(?:"|$)|[^,"])+)'), F.lit(1))
    split = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, "(?s)^([^=]*)=", 1))).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)), '^"+|"+$', "").alias("v")))
    value = lambda k: F.coalesce(F.try_element_at(F.filter(split, lambda x: x["k"] == k), F.lit(-1))["v"], F.lit(""))
    return F.struct(F.regexp_extract(h, r"^(\S*)", 1).alias("scheme"), value("realm").alias("realm"), value("service").alias("service"), value("scope").alias("scope"))


def parse_block_path(path: Column) -> Column:
    """Struct ``(chunk, block)``, unsigned, of ``/peer/v2/block/<16 hex>/<decimal>``."""
    h, b = F.regexp_extract(path, r"^/peer/v2/block/([0-9a-fA-F]{1,16})/([0-9]{1,20})$", 1), F.regexp_extract(path, r"^/peer/v2/block/([0-9a-fA-F]{1,16})/([0-9]{1,20})$", 2)
    return F.when(h != "", F.struct(F.conv(h, 16, 10).cast("decimal(20,0)").alias("chunk"), b.cast("decimal(20,0)").alias("block")))


def block_path(chunk: Column, block: Column) -> Column:
    """The path of a block; ``chunk`` holds two's-complement bits."""
    return F.concat(F.lit("/peer/v2/block/"), F.lower(F.lpad(F.hex(chunk), 16, "0")), F.lit("/"), block.cast("string"))


def parse_hop(value: Column) -> Column:
    """Hops so far: 0 where absent, null where negative or malformed."""
    return F.when(value.isNull() | (value == ""), F.lit(0)).when(value.rlike("^[0-9]+$"), value.try_cast("int"))


def parse_peers(spec: Column) -> Column:
    """Array of ``(id, addr, role)`` from ``id@host:port[#role],...``; role names are ordinary, root-only and non-root."""
    role = lambda r: F.when(r == "root-only", 1).when(r == "non-root", 2).when((r == "") | (r == "ordinary"), 0)
    at = lambda s, i: F.regexp_extract(s, r"^([^@#]+)@([^#]+)(?:#(.*))?$", i)
    items = F.filter(F.transform(F.split(spec, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(items, lambda s: F.struct(F.nullif(at(s, 1), F.lit("")).alias("id"), F.nullif(at(s, 2), F.lit("")).alias("addr"), role(at(s, 3)).alias("role")))


HOST_PORT = r"^(?:\[[^\[\]]*\]|[^\[\]:]*):[^:\[\]]*$"


def parse_seeder(spec: Column) -> Column:
    """Struct ``(kind, target, addrs)``: ``dns:<name>:<port>``, ``static:<list>`` or a bare list of host:port; null where it can't be read.

    A list may have empty entries, but no other than host:port; a port of a name is from 1 to 65535.
    """
    s = F.trim(spec)
    rest = F.regexp_replace(s, "^(dns|static):", "")
    dns = F.startswith(s, F.lit("dns:"))
    port = try_long(F.regexp_extract(rest, "^(.*):([^:]*)$", 2))
    name = F.regexp_replace(F.regexp_extract(rest, "^(.*):([^:]*)$", 1), r"^\[|\]$", "")
    items = F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != "")
    ok = F.when(dns, rest.rlike(HOST_PORT) & (name != "") & port.between(1, 65535)).otherwise((F.size(items) > 0) & F.forall(items, lambda x: x.rlike(HOST_PORT)))
    made = F.struct(F.when(dns, "dns").otherwise("static").alias("kind"), F.when(dns, rest).otherwise(F.array_join(items, ",")).alias("target"), F.when(dns, F.array(rest)).otherwise(items).alias("addrs"))
    return F.when(F.coalesce(ok, F.lit(False)), made)


def parse_role(name: Column) -> Column:
    """0, 1 or 2 for ordinary, root-only and non-root; null for any other name."""
    return F.when(name == "ordinary", 0).when(name == "root-only", 1).when(name == "non-root", 2)


def role_name(role: Column) -> Column:
    return F.when(role == 1, "root-only").when(role == 2, "non-root").otherwise("ordinary")


def parse_endpoint_spec(spec: Column) -> Column:
    """Struct ``(namespace, service, port)`` of ``<namespace>/<service>[/<port>]``; the port defaults to "peer"."""
    p = F.split(spec, "/")
    ok = F.size(p).isin(2, 3) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != "")
    return F.when(ok, F.struct(p[0].alias("namespace"), p[1].alias("service"), F.coalesce(F.nullif(F.get(p, F.lit(2)), F.lit("")), F.lit("peer")).alias("port")))


def valid_member_id(s: Column) -> Column:
    return s.rlike("^[!-~]+$")


def advertised_ok(addr: Column) -> Column:
    """Whether ``host:port`` names a host that others can reach: not empty and no spelling of the unspecified address."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(addr, r"^(.*):[0-9]+$", 1), r"^\[|\]$", ""), "%.*$", "")
    wild = host.rlike(r"^(0+(\.0+){0,3}|0*:[0:]*|::ffff:0+(\.0+){3})$")
    return (host != "") & ~wild


def advertised_addr(explicit: Column, listen: Column, own_host: Column) -> Column:
    """The address that others are told: the explicit one, or the listening one with ``own_host`` in place of an unspecified host.

    Null where an explicit address is unspecified or no host:port, or where no host is known.
    """
    bare = F.regexp_replace(F.regexp_extract(listen, r"^(.*):([^:]*)$", 1), r"^\[|\]$", "")
    port = F.regexp_extract(listen, r"^(.*):([^:]*)$", 2)
    host = F.when(advertised_ok(listen), bare).otherwise(F.nullif(own_host, F.lit("")))
    told = F.concat(F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.lit(":"), port)
    return F.when(F.coalesce(explicit, F.lit("")) != "", F.when(explicit.rlike(HOST_PORT) & advertised_ok(explicit), explicit)).when(listen.rlike(HOST_PORT), told)


def route(uri: Column) -> Column:
    """"registry" for /v2 and paths under it, else "prefix"."""
    return F.when(F.startswith(uri, F.lit("/v2/")) | (uri == "/v2"), "registry").otherwise("prefix")


def resolve(uri: Column, prefix: str, origin: str = "") -> Column:
    """The upstream url of a request: the fixed origin, or what follows ``/<prefix>/`` if it has a scheme; else null."""
    if origin:
        return F.lit(origin)
    p = "/" + prefix.strip("/") + "/"
    rest = F.substr(uri, F.lit(len(p) + 1))
    return F.when(F.startswith(uri, F.lit(p)) & (F.startswith(rest, F.lit("http://")) | F.startswith(rest, F.lit("https://"))), rest)


def size_probe(status: Column, header: Column, length: Column) -> Column:
    """Struct ``(ok, size, no_range)`` of the answer to a request for the first byte.

    206 tells the size in its Content-Range, and is no answer without it; 416 means an empty object; 200 that ranges are ignored, with a
    size of -1 where the length is unknown.
    """
    total = content_range(header)["total"]
    ok = (status == 416) | (status == 200) | ((status == 206) & (total >= 0))
    size = F.when(status == 416, F.lit(0)).when(status == 206, total).otherwise(F.coalesce(length, F.lit(-1))).cast("bigint")
    return F.struct(ok.alias("ok"), F.when(ok, size).alias("size"), (ok & (status == 200)).alias("no_range"))


#: Headers of an origin's answer that are handed on.
HANDED_ON = ["content-type", "content-length", "content-range", "content-encoding", "etag", "last-modified", "cache-control", "accept-ranges"]


def passthrough(method: Column, status: Column, headers: Column, body_bytes: Column) -> Column:
    """Struct ``(status, headers, bytes)`` of a request that is handed to its origin: nothing is cached, only headers of the entity
    go on, and a HEAD gets no body."""
    kept = F.map_filter(headers, lambda k, _: F.lower(k).isin(HANDED_ON))
    return F.struct(status.alias("status"), kept.alias("headers"), F.when(method == "HEAD", F.lit(0)).otherwise(body_bytes).cast("bigint").alias("bytes"))


def upstream_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), path)


def valid_metric_name(s: Column) -> Column:
    return s.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$")


def escape_label(s: Column) -> Column:
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(s, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def escape_help(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def request_outcome(caller_gone: Column, error: Column) -> Column:
    """"neutral", "answered", "hard_fail" or "soft_fail"; ``error`` is null, "refused", "dial" or anything else."""
    return F.when(caller_gone, "neutral").when(error.isNull() | (error == "refused"), "answered").when(error == "dial", "hard_fail").otherwise("soft_fail")


def coalescing_key(url: Column, start: Column, end: Column) -> Column:
    """Calls with the same key share one transfer: content identity and range."""
    return F.concat(object_id(url)["id"], F.lit("\0"), start.cast("string"), F.lit(":"), end.cast("string"))


def read_bounded(length: Column, capacity: Column) -> Column:
    """Struct ``(ok, taken)``: a body fits its buffer, or has a byte too many."""
    return F.struct((length <= capacity).alias("ok"), F.least(length, capacity).alias("taken"))
