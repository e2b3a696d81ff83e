"""Sources and sinks of the control plane: JSON rosters, lease events, peer lists, byte-range objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.identity import parse_peers, parse_seeder
from ..functions.sizing import small
from ..operators.membership import decode_rosters, endpoint_addresses

LEASE_EVENTS = "file string, node string, ttlMs bigint, op string, at timestamp, seq bigint"


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    """``(epoch, members, valid)`` of a folder of JSON lines, one roster a line."""
    return decode_rosters(spark.read.text(path), "value").drop("value")


#: Fixed value: bytes of a request's body that a tracker reads at most.
BODY_BYTES = 1 << 16


def lease_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Join and leave events of a folder of JSON lines, as ``(file, at, seq, node, op, ttl_us)``; ``at`` in microseconds.

    A line that is longer than ``BODY_BYTES``, no JSON, or without a file or a node is refused, and left out.
    """
    lines = (spark.readStream if stream else spark.read).text(path)
    e = lines.where(F.octet_length("value") <= BODY_BYTES).select(F.from_json("value", LEASE_EVENTS).alias("e")).select("e.*").where("file != '' and node != ''")
    return e.select("file", F.unix_micros("at").alias("at"), "seq", "node", "op", (F.coalesce("ttlMs", F.lit(0)) * 1000).alias("ttl_us"))


def static_members(spark: SparkSession, spec: str) -> DataFrame:
    """``(id, addr, role)`` of a peer list; entries that can't be read have null ids."""
    return spark.range(1).select(F.explode(parse_peers(F.lit(spec))).alias("p")).select("p.*")


def endpoint_slices(spark: SparkSession, path: str) -> DataFrame:
    """``(addr)`` of the ready endpoints in a folder of JSON lines, one slice a line: ``{"port": 80, "endpoints": [{"addresses": [..], "ready": true}]}``."""
    shape = "port int, endpoints array<struct<addresses:array<string>,ready:boolean>>"
    return endpoint_addresses(spark.read.schema(shape).json(path))


def seed_addresses(seeds: DataFrame, answers: DataFrame, spec: str = "spec") -> DataFrame:
    """``(spec, addr)`` of each seed spec: the addresses of a list, or those that ``answers(name, ip)`` has for a DNS name, with its port.

    Specs that can't be read and names without an answer give none.
    """
    read = seeds.select(F.col(spec).alias("spec"), parse_seeder(F.col(spec)).alias("s"))
    listed = read.where("s.kind = 'static'").select("spec", F.explode("s.addrs").alias("addr"))
    named = read.where("s.kind = 'dns'").select("spec", F.regexp_extract("s.target", r"^(.*):([0-9]+)$", 1).alias("name"), F.regexp_extract("s.target", r"^(.*):([0-9]+)$", 2).alias("port"))
    found = named.join(small(answers.select("name", "ip").distinct()), "name")
    host = F.when(F.contains("ip", F.lit(":")), F.concat(F.lit("["), "ip", F.lit("]"))).otherwise(F.col("ip"))
    return listed.unionByName(found.select("spec", F.concat(host, F.lit(":"), "port").alias("addr")))


class _Block(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _open(path: str) -> tuple:
    """The file system of a path or url, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("blocksize", 4 << 20))
        if "size" in options:
            self.size = int(options["size"])
        else:
            store, path = _open(self.path)
            self.size = store.get_file_info(path).size

    def partitions(self) -> list[_Block]:
        return [_Block(self.path, s, min(s + self.block, self.size) - 1) for s in range(0, self.size, self.block)]

    def read(self, partition: _Block):
        store, path = _open(partition.path)
        with store.open_input_file(path) as f:
            data = f.read_at(partition.end - partition.start + 1, partition.start)
        yield (partition.start // self.block, partition.start, partition.end, data)


class BlockSource(DataSource):
    """Blocks of one object: ``spark.read.format("blocks").load(url)``.

    The url is one that all executors can open: of an object store, a distributed file system or a mounted folder. Its size is asked
    for once unless the option ``size`` gives it. A block is a partition and reads its own byte window only.
    """

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "block bigint, start bigint, end bigint, data binary"

    def reader(self, schema) -> _BlockReader:
        return _BlockReader(self.options)
