"""Pieces of DuckDB SQL for hashes, spelled out for the comparison queries."""

from __future__ import annotations

FNV_OFFSET = "14695981039346656037::UBIGINT"
TWO64 = "18446744073709551616::UHUGEINT"


def mul(a: str, k: int) -> str:
    return f"((({a})::UHUGEINT * {k}::UHUGEINT) % {TWO64})::UBIGINT"


def fnv(start: str, items: str) -> str:
    """FNV-1a fold of a list of byte values (UBIGINT) from a start value."""
    return f"list_reduce(list_prepend({start}, {items}), lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211::UHUGEINT) % {TWO64})::UBIGINT)"


def chars(s: str) -> str:
    """Bytes of an ASCII string."""
    return f"list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::UBIGINT)"


def int_bytes(v: str, order: str) -> str:
    shift = "56 - 8 * i" if order == "big" else "8 * i"
    return f"list_transform(range(0, 8), lambda i: ((({v})::BIGINT::HUGEINT >> ({shift})::INTEGER) & 255)::UBIGINT)"


def fmix(z: str) -> str:
    """The finaliser, as nested single-element transforms so that nothing is written out twice."""
    x = f"[{z}]"
    for f in ("xor(x, x >> 33)", mul("x", 0xFF51AFD7ED558CCD), "xor(x, x >> 33)", mul("x", 0xC4CEB9FE1A85EC53), "xor(x, x >> 33)"):
        x = f"list_transform({x}, lambda x: {f})"
    return f"({x})[1]"


def signed(z: str) -> str:
    """Two's-complement BIGINT of a UBIGINT."""
    return f"(case when ({z}) >= 9223372036854775808::UBIGINT then (({z})::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT else ({z})::BIGINT end)"


def chunk_key(namespace: str, object_id: str, index: str) -> str:
    body = f"list_concat({chars(repr(namespace))}, [31::UBIGINT], {chars(object_id)}, [31::UBIGINT], {int_bytes(index, 'big')})"
    return fmix(fnv(FNV_OFFSET, body))


def node_hash(key: str, node: str) -> str:
    return fmix(fnv(FNV_OFFSET, f"list_concat({int_bytes(key, 'little')}, {chars(node)})"))
