"""The contract of the entry file, and every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from foliospark.plans import catalog, oracles

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(oracles.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(oracles.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(columns).collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_wordpiece_and_page_sections_by_plain_loops(spark):
    """The queries that have no SQL against the same rules run over collected rows."""
    from foliospark.sources import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = {(p.page_id, n, s["title"], s["level"], s["text"]) for p in pages for n, s in enumerate(html.sections(html.tree(p.html)))}
    assert {tuple(r) for r in catalog.html_sections(spark, DATA).collect()} == want
