"""Arithmetic of chunks and blocks over byte ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INT64 = (1 << 63) - 1


def valid_sizes(chunk: Column, block: Column) -> Column:
    """Whether chunks and blocks may have these sizes."""
    return F.coalesce((chunk > 0) & (block > 0) & (F.try_mod(chunk, block) == 0), F.lit(False))


@dataclass(frozen=True)
class Grid:
    """Sizes in bytes; a chunk is a whole number of blocks."""

    chunk: int = 256 << 20
    block: int = 4 << 20

    def __post_init__(self) -> None:
        if self.chunk <= 0 or self.block <= 0 or self.chunk % self.block:
            raise ValueError("chunk and block sizes must be positive, and the chunk a multiple of the block")

    @property
    def blocks_per_chunk(self) -> int:
        return self.chunk // self.block

    @property
    def max_block(self) -> int:
        """The largest block index whose last byte still has a signed 64-bit offset."""
        return (MAX_INT64 - self.block + 1) // self.block

    def _div(self, a: Column, b: int) -> Column:
        return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))

    def chunk_index(self, offset: Column) -> Column:
        return self._div(offset, self.chunk)

    def block_index(self, offset: Column) -> Column:
        return self._div(offset, self.block)

    def chunk_of_block(self, block: Column) -> Column:
        return self._div(block, self.blocks_per_chunk)

    def block_start(self, block: Column) -> Column:
        return block.cast("bigint") * F.lit(self.block).cast("bigint")

    def block_len(self, size: Column, block: Column) -> Column:
        """Bytes of a block of an object: a whole one, or what is left for the last."""
        return F.least(size - self.block_start(block), F.lit(self.block).cast("bigint"))

    def segments(self, start: Column, end: Column) -> Column:
        """Array of ``(chunk, block, from, to)`` that cover the inclusive range; empty where start < 0 or end < start."""
        def part(b: Column) -> Column:
            at = self.block_start(b)
            return F.struct(self.chunk_of_block(b).alias("chunk"), b.alias("block"), F.greatest(start.cast("bigint"), at).alias("from"), F.least(end.cast("bigint"), at + (self.block - 1)).alias("to"))

        return F.when((start >= 0) & (end >= start), F.transform(F.sequence(self.block_index(start), self.block_index(end)), part))

    def explode_segments(self, df: DataFrame, start: str, end: str) -> DataFrame:
        """A row per segment. Blocks come from a generator within the row's task, not from a range join."""
        names = df.columns
        return df.select(*names, F.explode(self.segments(F.col(start), F.col(end))).alias("_s")).select(*names, "_s.*")

    def block_window(self, block: Column, size: Column) -> Column:
        """Struct ``(status, start, end)``: bytes to ask for. A size of zero or less is unknown and clamps nothing."""
        at = self.block_start(F.when((block >= 0) & (block <= F.lit(self.max_block)), block))
        bad = (block < 0) | (block > F.lit(self.max_block))
        past = (size > 0) & (at >= size)
        end = F.when(size > 0, F.least(at + (self.block - 1), size - 1)).otherwise(at + (self.block - 1))
        ok = ~bad & ~past
        return F.struct(F.when(bad, "out_of_range").when(past, "past_end").otherwise("ok").alias("status"), F.when(ok, at).alias("start"), F.when(ok, end).alias("end"))

    def slice_of_block(self, block: Column, start: Column, end: Column) -> Column:
        """Struct ``(lo, hi)``: the half-open part of a block that a request from start to end wants."""
        at = self.block_start(block)
        lo, hi = F.greatest(start - at, F.lit(0)), F.least(end - at + 1, F.lit(self.block))
        return F.when(hi > lo, F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")))


def clamp(start: Column, end: Column, size: Column) -> Column:
    """Struct ``(satisfiable, start, end)`` of a request against an object's size."""
    ok = (start >= 0) & (start < size)
    return F.struct(ok.alias("satisfiable"), F.when(ok, start).alias("start"), F.when(ok, F.least(end, size - 1)).alias("end"))


def relayable(block: Column, grid: Grid) -> Column:
    """Whether an unsigned block index, as DECIMAL(20,0), can be represented."""
    return (block >= 0) & (block <= F.lit(str(grid.max_block)).cast("decimal(20,0)"))
