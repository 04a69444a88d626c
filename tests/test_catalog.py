"""Every query that has an equivalent against DuckDB on the smallest tables."""

import math

import pytest

from tests.conftest import DATA
from vellum import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 6) if isinstance(x, float) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - {"book_issues"}))
def test_equals_duckdb(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_repairs_restore_what_was_damaged(spark):
    from pyspark.sql import functions as F

    for name in ("ligature_repair", "mojibake_repair", "soft_hyphen", "caret_noise", "whitespace_collapse", "nfkc_normalize"):
        out = catalog.QUERIES[name](spark, f"{DATA}/sf0.001").agg(F.count_if("damaged").alias("d"), F.count_if(F.col("damaged") & F.col("restored")).alias("r")).first()
        assert out["d"] > 20 and out["r"] > 0.9 * out["d"], name
