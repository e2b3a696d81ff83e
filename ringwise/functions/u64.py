"""Unsigned 64-bit arithmetic on BIGINT columns that hold two's-complement bits.

Scalar columns stay in generated code: products are built from 16- and 32-bit limbs, as ANSI mode
raises on overflow. Byte-wise hashes of strings run as Arrow-batched numpy, where uint64 wraps and one
array operation serves one byte position of the whole batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# FNV-1a offset and prime, murmur3 finaliser multipliers, the golden-ratio increment, unit separator.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
GOLDEN = 0x9E3779B97F4A7C15
UNIT_SEP = 0x1F

MASK32 = 0xFFFFFFFF


def signed(x: int) -> int:
    """The BIGINT with the bits of an unsigned value."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def mul(a: Column, k: int) -> Column:
    """``a * k`` modulo 2**64 for a constant k; no intermediate leaves 2**50."""
    kl, kh = k & MASK32, (k >> 32) & MASK32
    low, high = a.bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned(a, 32)

    def low32(x: Column, m: int) -> Column:
        top = (F.shiftright(x, 16) * F.lit(m)).bitwiseAND(F.lit(0xFFFF))
        return (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(m) + F.shiftleft(top, 16)).bitwiseAND(F.lit(MASK32))

    p0, p1 = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(kl), F.shiftright(low, 16) * F.lit(kl)
    tail = p0.bitwiseAND(F.lit(MASK32)) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    head = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(tail, 32) + low32(high, kl) + low32(low, kh)
    return F.shiftleft(head.bitwiseAND(F.lit(MASK32)), 32).bitwiseOR(tail.bitwiseAND(F.lit(MASK32)))


def fmix64(z: Column) -> Column:
    """The murmur3 finaliser, through let-bindings so that no step is written out twice."""
    steps = F.array(z)
    once = lambda f: lambda xs: F.transform(xs, f)
    shift = lambda x: xor(x, F.shiftrightunsigned(x, 33))
    for f in (shift, lambda x: mul(x, MIX_1), shift, lambda x: mul(x, MIX_2), shift):
        steps = once(f)(steps)
    return F.element_at(steps, 1)


def block_key_hash(chunk: Column, block: Column) -> Column:
    """Hash of a cache key: the finaliser of chunk xor block times the golden-ratio increment."""
    product = F.element_at(F.transform(F.array(block.cast("bigint")), lambda b: mul(b, GOLDEN)), 1)
    return fmix64(xor(chunk.cast("bigint"), product))


def as_unsigned(x: Column) -> Column:
    """The unsigned value as DECIMAL(20,0), for comparison and print."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


# Arrow-batched numpy ----------------------------------------------------------------------------


def np_fmix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(33))


def np_fnv(h: np.ndarray, data: list[bytes]) -> np.ndarray:
    """FNV-1a of one byte string a row, starting from ``h``."""
    if not data:
        return h
    n = np.array([len(x) for x in data])
    wide = int(n.max())
    padded = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in data), np.uint8).reshape(len(data), wide).astype(np.uint64)
    h = h.copy()
    for i in range(wide):
        on = n > i
        h[on] = (h[on] ^ padded[on, i]) * np.uint64(FNV_PRIME)
    return h


def np_fnv_int(h: np.ndarray, value: np.ndarray, order: str) -> np.ndarray:
    """FNV-1a of the eight bytes of each value, "big" or "little" endian first."""
    for i in range(8):
        shift = np.uint64(8 * (7 - i if order == "big" else i))
        h = (h ^ ((value >> shift) & np.uint64(255))) * np.uint64(FNV_PRIME)
    return h


def np_chunk_key(namespace: list[bytes], object_id: list[bytes], index: np.ndarray) -> np.ndarray:
    h = np.full(len(index), FNV_OFFSET, np.uint64)
    h = np_fnv(h, namespace)
    h = (h ^ np.uint64(UNIT_SEP)) * np.uint64(FNV_PRIME)
    h = np_fnv(h, object_id)
    h = (h ^ np.uint64(UNIT_SEP)) * np.uint64(FNV_PRIME)
    return np_fmix64(np_fnv_int(h, index, "big"))


def np_node_hash(key: np.ndarray, node: list[bytes]) -> np.ndarray:
    h = np_fnv_int(np.full(len(key), FNV_OFFSET, np.uint64), key, "little")
    return np_fmix64(np_fnv(h, node))


def _u64(s: pd.Series) -> np.ndarray:
    return s.fillna(0).to_numpy(np.int64).view(np.uint64)


def _bytes(s: pd.Series) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in s]


@F.pandas_udf(LongType())
def _chunk_key(namespace: pd.Series, object_id: pd.Series, index: pd.Series) -> pd.Series:
    return pd.Series(np_chunk_key(_bytes(namespace), _bytes(object_id), _u64(index)).view(np.int64))


@F.pandas_udf(LongType())
def _node_hash(key: pd.Series, node: pd.Series) -> pd.Series:
    return pd.Series(np_node_hash(_u64(key), _bytes(node)).view(np.int64))


def chunk_key(namespace: str | Column, object_id: Column, index: Column) -> Column:
    """64-bit key of a chunk of an object; null where the object or the index is null."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.when(object_id.isNotNull() & index.isNotNull(), _chunk_key(ns, object_id, index.cast("bigint")))


def file_key(namespace: str | Column, object_id: Column) -> Column:
    """The key of the object itself: the chunk key of index -1."""
    return chunk_key(namespace, object_id, F.lit(-1).cast("bigint"))


def node_hash(key: Column, node: Column) -> Column:
    """64-bit hash of a key and a node id, the base of the placement score."""
    return F.when(key.isNotNull() & node.isNotNull(), _node_hash(key.cast("bigint"), node))
