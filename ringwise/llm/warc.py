"""WARC archives: writing, reading, and assembling request, response and metadata records.

Archives are written by Spark's own text writer, one record a row and the record separator of the
format as the line separator, so they can go to any store that Spark reaches; each is bounded in
size. They are read as binary files and parsed by ``Content-Length``. Records of one capture are
joined through their ``WARC-Concurrent-To`` identifiers into one nested row.

Equal payloads are found by digest: the least page of each is combined before the shuffle. Only rows of repeated digests are
joined, hot digests apart from the others, and joins carry no payload unless there are too many revisits to send
to all tasks. Captures that a revisit refers to are joined with the revisits alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bounded, join_counted, materialise, pick, shared_dir, table

CRLF = "\r\n"
#: Bytes an archive holds at about, before compression; one archive is one read.
ARCHIVE_BYTES = 32 << 20
#: Payload bytes up to which pages share an archive with smaller ones.
SIZES = (16 << 10, 1 << 20)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FIELDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, content_type string, payload_digest string, block_length bigint, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


@F.pandas_udf(StringType())
def _base32(digests: pd.Series) -> pd.Series:
    return digests.map(lambda d: None if d is None else base64.b32encode(bytes(d)).decode())


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int, most: int = 32 << 20) -> DataFrame:
    """``(_row, _id, _url, _html, digest, bytes, first_row)``: ``first_row`` is the row that a revisit refers to."""
    rows = pick(pages, _id=id_col, _url=url_col, _html=html_col).withColumn("_html", F.coalesce("_html", F.lit(""))).withColumn("_row", F.monotonically_increasing_id())
    payload = F.col("_html").cast("binary")
    rows = materialise(rows.withColumn("digest", _base32(F.unhex(F.sha1(payload)))).withColumn("bytes", F.octet_length("_html").cast("bigint")), "payloads")
    # Rows without an id come last; of rows with the same id and payload the first written one is the response.
    order = F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")
    able = rows.where(F.col("bytes") >= min_bytes)
    least = able.groupBy("digest").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("copies"))
    repeated = materialise(least.where("copies > 1").select("digest", F.col("least._row").alias("first_row"), "copies"), "repeated")
    of = join_counted(able.select("_row", "digest"), repeated, "digest", "copies", 24, most)
    revisits = materialise(of.where("_row != first_row").select("_row", "first_row"), "revisits")
    return rows.join(bounded(revisits, 32, most), "_row", "left")


def record_id(kind: str, row: str) -> object:
    """A stable urn for a record of a row."""
    h = F.sha2(F.concat(F.lit(f"{kind}:"), F.col(row).cast("string")), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _record(headers: list[tuple[str, object]], block: object) -> object:
    """Text of a record; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF))
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], length, F.lit(CRLF), block)


def write_archives(planned: DataFrame, path: str) -> None:
    """Three records a page: request, response or revisit, and metadata with the page's id.

    Line breaks and blanks in a url are percent-encoded; a null url is left out. Each task writes its own rows, so no payload is
    shuffled. Pages of up to each of ``SIZES`` bytes are written apart, as many to an archive as hold ``ARCHIVE_BYTES`` if all
    were as large as that, so one long page doesn't make an archive long.
    """
    escaped = F.replace(F.replace(F.replace(F.col("_url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    parts = r"(?s)^[^:]*://([^/?#]*)([^#]*)"
    planned = planned.withColumn("_uri", escaped).withColumn("_host", F.coalesce(F.regexp_extract("_uri", parts, 1), F.lit(""))).withColumn("_target", F.coalesce(F.regexp_extract("_uri", parts, 2), F.lit("")))
    uri, host, target = F.col("_uri"), F.col("_host"), F.col("_target")
    asks = F.concat(F.lit("GET "), F.when(F.startswith(target, F.lit("/")), "").otherwise("/"), target, F.lit(" HTTP/1.1" + CRLF), F.when(host != "", F.concat(F.lit("Host: "), host, F.lit(CRLF))).otherwise(""), F.lit(CRLF))
    main, req, meta = record_id("response", "_row"), record_id("request", "_row"), record_id("metadata", "_row")
    revisit = F.col("first_row").isNotNull()
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)]
    head = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF)
    response = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", main), *common,
            ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.when(revisit, record_id("response", "first_row"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.col("_html"))),
    )
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", req), *common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))], asks)
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", meta), *common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], about)
    texts = planned.withColumn("value", F.explode(F.array(request, response, metadata)))
    stored = F.when(revisit, 0).otherwise(F.col("bytes"))
    held = {r["c"] for r in planned.groupBy(_size_class(stored).alias("c")).count().collect()}  # a row a class
    for c in sorted(held) or [0]:
        most = SIZES[c] if c < len(SIZES) else ARCHIVE_BYTES
        records = 3 * max(1, ARCHIVE_BYTES // (1500 + most))
        texts.where(_size_class(stored) == c).select("value").write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _size_class(stored: Column) -> Column:
    """The number of the first of ``SIZES`` that a payload doesn't exceed; their count for a larger one."""
    return F.lit(len(SIZES)) - sum((stored <= s).cast("int") for s in SIZES)


def parse(data: bytes) -> Iterator[tuple]:
    """Records of an archive; the length in each header says where its block ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        h = dict(x.split(": ", 1) for x in lines[1:])
        n = int(h["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError(f"record at byte {at} is cut off")
        yield (h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Concurrent-To"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("Content-Type"), h.get("WARC-Payload-Digest"), n, block)
        at = end + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record before byte {at} has no end")
        at += 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``FIELDS`` for each record of all archives in ``path``, gzipped or plain."""
    names = FIELDS.replace(",", "").split()[::2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                part, size = [], 0
                for r in parse(data):
                    part.append(r)
                    size += r[8]
                    if size > 4 << 20:  # blocks leave in small batches
                        yield pd.DataFrame(part, columns=names)
                        part, size = [], 0
                if part:
                    yield pd.DataFrame(part, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture, by the identifier that its records are concurrent to.

    ``capture_id, response, request, metadata``: structs of ``FIELDS`` (null where absent). A record
    without a concurrent-to identifier that isn't a response or revisit is a capture of its own,
    as is one whose response isn't there. Of several records of one kind the least id stays.
    Blocks of responses are not shuffled twice: all records of a capture are aggregated at once.
    """
    key = F.coalesce("concurrent_to", "record_id")
    whole = F.struct(*records.columns)
    kinds = {"response": ["response", "revisit"], "request": ["request"], "metadata": ["metadata"]}
    picks = [F.min_by(F.when(F.col("type").isin(t), whole), F.when(F.col("type").isin(t), F.col("record_id"))).alias(k) for k, t in kinds.items()]
    return records.groupBy(key.alias("capture_id")).agg(*picks)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None, most: int = 32 << 20) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back, and return a row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Of pages with equal payloads
    of at least ``min_bytes`` bytes the one with the smallest id is a response and the others revisit it; a
    null html is an empty payload. A null id comes after all others; rows that repeat count as
    pages of their own. An empty table gives an empty result. Everything returned is read from the archives;
    a payload's size and digest are taken from the stored bytes, a revisit's from its response. A payload of any length is stored
    whole; other columns are not read, whatever they are called. ``most``: bytes of a side of a join that are sent to all tasks.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    kind = dict(pages.dtypes)[id_col]
    write_archives(plan_records(pages, id_col, url_col, html_col, min_bytes, most), path)

    @F.pandas_udf("digest string, bytes bigint")
    def measured(blocks: pd.Series) -> pd.DataFrame:
        payloads = [None if b is None else bytes(b).partition(b"\r\n\r\n")[2] for b in blocks]
        return pd.DataFrame({"digest": [None if p is None else base32_sha1(p) for p in payloads], "bytes": pd.Series([None if p is None else len(p) for p in payloads], dtype="Int64")})

    records = read_archives(spark, path)
    # The payload is measured where it is read; only its size and digest travel on.
    is_response = F.col("type") == "response"
    slim = records.withColumn("own", measured(F.when(is_response, F.col("block")))).withColumn("block", F.when(F.col("type") == "metadata", F.col("block")))
    nested = materialise(assemble(slim), "captures")
    page = F.regexp_extract(F.col("metadata.block").cast("string"), r"page-id: ([^\r\n]*)", 1)
    rows = nested.select(
        F.col("response.record_id").alias("rid"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"),
        F.regexp_replace("response.payload_digest", "^sha1:", "").alias("claimed"), F.col("response.own.digest").alias("digest"), F.col("response.own.bytes").alias("bytes"), F.nullif(page, F.lit("")).cast(kind).alias("page"),
    )
    again = rows.where("record_type = 'revisit'").drop("digest", "bytes")
    asked = again.groupBy("target").agg(F.count(F.lit(1)).alias("copies"))
    targets = rows.where("record_type != 'revisit'").select(F.col("rid").alias("target"), "digest", "bytes", F.col("page").alias("t_page")).join(bounded(asked, 24, most), "target")
    met = join_counted(again, materialise(targets, "targets"), "target", "copies", 100, most)
    out = rows.where("record_type != 'revisit'").withColumn("t_page", F.lit(None).cast(kind)).unionByName(met.select(*rows.columns, "t_page"))
    return out.select(
        F.col("page").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.col("t_page").alias("refers_to"), (F.col("digest") == F.col("claimed")).alias("digest_ok"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(table(spark, sf_dir, "pages"))


OP7_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
b as (select page_id, h, octet_length(encode(h)) as n, min(page_id) over (partition by h) as first,
  array_to_string(list_transform(string_split(sha1(h), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1)::INTEGER + 1, 4)), '') as bits from p)
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_reduce(list_transform(range(1, 6), lambda j: substr(bits, (5 * i + j)::INTEGER, 1)::INTEGER * (32 >> j::INTEGER)), lambda x, y: x + y)]), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, true as digest_ok from b
"""
