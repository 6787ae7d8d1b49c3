"""Every query of the catalogue runs; those with an oracle equal it on the smallest tables."""

import math

import duckdb
import pytest

from formloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ["orders", "lineitem", "events", "documents", "pages", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(frame):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("<NA>", "NaT"):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(value(v) for v in row) for row in zip(*(frame[c].tolist() for c in columns), strict=True))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got.columns)
    if name in catalog.ORACLES:
        assert canonical(got) == canonical(duck.sql(catalog.ORACLES[name]).df())


def test_all_tiers_appear(spark):
    assert {r["status"] for r in catalog.flagship(spark, FOLDER).select("status").distinct().collect()} == {"green", "yellow", "red"}
