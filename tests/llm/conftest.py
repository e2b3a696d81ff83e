from __future__ import annotations

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd_rows():
    """Nulls, empties, ties, repeats, long texts, and columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "s", 1), (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "s", 2), (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "s", 3),
        (2, "another text under the same id", "en", None, 4), (3, None, None, None, None), (4, "", "de", "s", 5), (5, "   \t\n ", None, "s", 6), (None, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 7),
        (None, None, "en", "s", 8), (6, long, "en", "s", 9), (7, long + " end", "en", "s", 10), (8, "12 34 !! ??", "en", "s", 11), (9, "Ä ä ÉÉ ß ẞ İ", "de", "s", 12), (10, "a b", "en", "s", 13),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    extra = [(*r, "x", r[0], "y", 1.5, "z") for r in rows]
    return rows, extra, schema, schema + ", _id string, node bigint, digest string, score double, kept string"
