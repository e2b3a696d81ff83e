"""Every query that SQL can express, against DuckDB; the others against invariants."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from ringwise import catalog
from ringwise.operators import cachesim as C

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA:
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number)) and not isinstance(x, bool):
        return "null" if x != x else str(int(x)) if float(x).is_integer() else f"{float(x):.9g}"
    return str(x)


def rows_of(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = rows_of(catalog.QUERIES[name](spark, DATA).toPandas()), rows_of(duck.sql(catalog.ORACLE_SQL[name]).df())
    assert got == want and got[1]


def test_names():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_cache_invariants(spark):
    for name in ("tiered_trace", "hybrid_trace"):
        df = catalog.QUERIES[name](spark, DATA).toPandas()
        assert len(df) and (df.owned_len <= 19).all() and (df.borrowed_len <= 5).all() and (df.memory_only <= 6).all()
        assert df.sort_values("seq").groupby("cache").rejected.apply(lambda s: s.is_monotonic_increasing).all()
        assert df[df.hit].admitted.isna().all()


def test_contents_round_trip(spark, tmp_path):
    held = catalog.QUERIES["cache_contents"](spark, DATA)
    C.write_contents(held, str(tmp_path / "held"))
    again = spark.read.parquet(str(tmp_path / "held")).select(*held.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, held.collect()))
