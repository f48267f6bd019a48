"""Every registered query of the listing engine against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from hearthlake.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 6)
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in ORACLE:
        names = [d[0] for d in duck.execute(ORACLE[name]).description]
        assert sorted(names) == sorted(df.columns)
        want = duck.execute(ORACLE[name]).fetchall()
        order = [df.columns.index(c) for c in names]
        assert plain([[r[i] for i in order] for r in rows]) == plain(want)
    else:
        assert rows


@pytest.mark.parametrize("name", ["posting_details", "feed_posts", "unit_listings", "unit_details", "result_cards", "polygon_bounds"])
def test_small_tables_are_dealt_before_costly_steps(spark, name):
    """Otherwise one task reads the file and parses all that is made of it."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_families_are_dealt_first_and_make_each_key_once(spark, monkeypatch):
    """A filter that asks for keys before they are exploded would make them a second time, in the tasks that read the file."""
    from hearthlake.operators import duplicates

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df)

    materialize = duplicates.materialize
    monkeypatch.setattr(duplicates, "materialize", seen)
    QUERIES["duplicate_families"](spark, DATA)
    assert "RepartitionByExpression" in plans[0] and plans[0].count("same_canonical_url") == 1
