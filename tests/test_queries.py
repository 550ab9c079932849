"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from inkmill.plans.registry import ORACLES, QUERIES, flagship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else x
        return x

    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    first = flagship(spark, DATA)
    assert first.columns == ["doc_id", "author", "key", "label", "count", "rate", "allowed", "why", "place"]
    assert first.count() > 0


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["word_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_rarity_reads_texts_once(spark):
    plan = QUERIES["word_rarity"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan
