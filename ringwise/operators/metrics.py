"""Counters, gauges, histograms, ratios and their text exposition."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.identity import escape_help, escape_label

#: Bucket bounds in seconds, and of reader counts.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0]
READER_BOUNDS = [0.0] + [float(1 << i) for i in range(11)]


def counter(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(*by, total)``: monotone sum; negative and null increments are ignored."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(value) > 0, F.col(value))), F.lit(0)).alias("total"))


def gauge_last(df: DataFrame, by: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """``(*by, value)``: the last value set."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


def normalise_bounds(bounds: Column) -> Column:
    return F.array_sort(F.array_distinct(bounds))


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """``(*by, le, n, sum, total)``: cumulative counts with inclusive bounds, "+Inf" last.

    One pass of conditional counts, combined before the shuffle; values aren't exploded by bucket.
    """
    bounds = sorted(set(bounds))
    v = F.col(value)
    agg = df.groupBy(*by).agg(*[F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)], F.count(v).alias("total"), F.sum(v).alias("sum"))
    buckets = F.array(*[F.struct(F.lit(number_text(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return agg.select(*by, F.explode(buckets).alias("_x"), "sum", "total").select(*by, "_x.le", "_x.n", "sum", "total")


def number_text(x: float) -> str:
    """Shortest text of a number, with an exponent below 1e-4 and from 1e6 on, as in the exposition format."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    sign, digits, exponent = Decimal(repr(float(x))).as_tuple()
    d = "".join(map(str, digits)).rstrip("0") or "0"
    e = len(digits) + exponent - 1 if d != "0" else 0
    if e < -4 or e >= 6:
        out = d[0] + ("." + d[1:] if d[1:] else "") + f"e{'-' if e < 0 else '+'}{abs(e):02}"
    elif e < 0:
        out = "0." + "0" * (-e - 1) + d
    else:
        out = d.ljust(e + 1, "0")
        out = out[: e + 1] + ("." + out[e + 1 :] if out[e + 1 :] else "")
    return "-" * sign + out


def number_column(x: Column) -> Column:
    """``number_text`` of a column of doubles."""
    s = F.abs(x).cast("string")
    science = F.contains(s, F.lit("E"))
    mantissa, power = F.split_part(s, F.lit("E"), F.lit(1)), F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    digits = F.regexp_replace(F.concat(whole, part), "^0+|0+$", "")
    e = F.when(science, power).when(whole != "0", F.length(whole) - 1).otherwise(-1 - F.length(F.regexp_extract(part, "^(0*)", 1)))
    d, e = F.when(digits == "", "0").otherwise(digits), F.when(digits == "", 0).otherwise(e)
    rest = lambda t: F.when(t != "", F.concat(F.lit("."), t)).otherwise("")
    cut = lambda t, at: F.substr(t, at)
    sign = F.when(e < 0, "-").otherwise("+")
    long = F.concat(F.substring(d, 1, 1), rest(cut(d, F.lit(2))), F.lit("e"), sign, F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), d)
    padded = F.concat(d, F.repeat(F.lit("0"), F.greatest(e + 1 - F.length(d), F.lit(0))))
    plain = F.concat(F.substr(padded, F.lit(1), F.greatest(e + 1, F.lit(1))), rest(cut(padded, e + 2)))
    text = F.when((e < -4) | (e >= 6), long).when(e < 0, small).otherwise(plain)
    signed = F.concat(F.when(x < 0, "-").otherwise(""), text)
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").otherwise(signed)


def exposition(metrics: DataFrame) -> DataFrame:
    """``(seq, line)``: text exposition of ``metrics(seq, name, help, kind, labels map, value)``.

    HELP and TYPE come before the first sample of a name, HELP only where there is one; samples keep their order ``seq``, names
    that of their first sample. Backslashes and line feeds of a help text are escaped, in labels quotes as well. Values of a type of
    whole numbers are written in full, those of other types as ``number_text`` has them.
    """
    first = metrics.groupBy("name").agg(F.min("seq").alias("at"), F.min_by("help", "seq").alias("help"), F.min_by("kind", "seq").alias("kind"))
    head = first.select(F.struct(F.col("at"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("s")).alias("seq"), F.explode(F.array_compact(F.array(F.when(F.col("help") != "", F.concat(F.lit("# HELP "), "name", F.lit(" "), escape_help(F.col("help")))), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind")))).alias("line"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    # Counters are whole numbers.
    gauge = F.col("value").cast("string") if isinstance(metrics.schema["value"].dataType, IntegralType) else number_column(F.col("value").cast("double"))
    shown = F.when(F.col("kind") == "counter", F.floor("value").cast("bigint").cast("string")).otherwise(gauge)
    body = metrics.join(first.select("name", "at"), "name").select(F.struct(F.col("at"), F.lit(1).alias("k"), F.col("seq").cast("bigint").alias("s")).alias("seq"), F.concat("name", labels, F.lit(" "), shown).alias("line"))
    return head.unionByName(body)


def write_exposition(metrics: DataFrame, path: str) -> None:
    """Write the lines in order as one text file; an exposition is small."""
    exposition(metrics).orderBy("seq", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


def source_counts(df: DataFrame, source: str) -> DataFrame:
    """``(source, reads)``."""
    return df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("reads"))


def hit_ratio(df: DataFrame, source: str) -> DataFrame:
    """One row: share of reads from the cache, share that stayed in the cluster; null without reads."""
    s, n = F.col(source), F.count(F.lit(1))
    ratio = lambda c: F.try_divide(F.count_if(c), n)
    return df.agg(ratio(s == "cache").alias("hit_ratio"), ratio(s.isin("cache", "peer")).alias("in_cluster_ratio"))


def share(df: DataFrame, by: list[str], wanted: Column, name: str) -> DataFrame:
    """``(*by, name)``: share of the rows for which ``wanted`` holds; null without rows."""
    return df.groupBy(*by).agg(F.try_divide(F.count_if(wanted), F.count(F.lit(1))).alias(name))


def sampled(snapshot: DataFrame, names: dict[str, tuple[str, str, str]], labels: list[str]) -> DataFrame:
    """``(seq, name, help, kind, labels, value)`` for ``exposition``: columns of a snapshot as metrics that are read when they are asked for.

    ``names``: column -> (metric, kind, help); ``labels``: columns that become labels. Rows with a null value are left out.
    """
    given = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.col(x).cast("string") for x in labels])) if labels else F.create_map().cast("map<string,string>")
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(h).alias("help"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for i, (c, (n, k, h)) in enumerate(names.items())])
    row = F.monotonically_increasing_id()
    out = snapshot.select(row.alias("_r"), given.alias("labels"), F.explode(each).alias("x")).where("x.value is not null")
    return out.select((F.col("x.i").cast("bigint") * (1 << 40) + F.col("_r")).alias("seq"), "x.name", "x.help", "x.kind", "labels", "x.value")


def ingress_bytes(df: DataFrame, source: str, size: str, coalesced: str) -> DataFrame:
    """``(source, bytes)``: each completed transfer counts once, followers of it not at all."""
    return df.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.when(~F.col(coalesced), F.col(size))), F.lit(0)).alias("bytes"))
