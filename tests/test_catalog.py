"""Every registered domain query against its SQL in an independent engine, on the smallest tables."""

import math
import os

import duckdb
import pytest

from glimmer.plans import catalog, catalog_more, catalog_scans  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [list(rel.columns).index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or isinstance(a, float) and abs(a - b) <= 2e-6 * max(1, abs(b)), (g, w)


def test_render_gaussian_uses_all_rows(spark):
    """Every localization adds 1, or less where its Gaussian leaves the field."""
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    total = sum(r.value for r in catalog.QUERIES["render_gaussian_local"](spark, SF).collect())
    assert 0.95 * n < total <= n + 0.01


def test_additive_blend_uses_all_rows(spark):
    """Blue counts the localizations in the field; no pixel of the smallest table clips."""
    n = catalog.QUERIES["render_histogram"](spark, SF).groupBy().sum("value").first()[0]
    out = catalog.QUERIES["additive_blend"](spark, SF).collect()
    assert max(r.b for r in out) < 255 and sum(r.b for r in out) == n
