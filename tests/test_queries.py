"""Every engine query against its SQL, and the filter language's errors."""

import os

import duckdb
import pytest

from flowspark.plans import queries
from flowspark.plans.where import QueryError, compile_where

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    rel = db.execute(queries.SQL[name])
    columns = [d[0] for d in rel.description]
    want = sorted(map(str, rel.fetchall()))
    have = sorted(str(tuple(r)) for r in got.select(*columns).collect())
    assert sorted(got.columns) == sorted(columns) and have == want and want


def test_lifecycle(spark):
    rows = queries.table(spark, SF, "events").orderBy("event_id").collect()
    want = {}
    for r in rows:
        s = want.get(r.user_id, "new")
        want[r.user_id] = "reset" if r.event_type == "error" else queries._STATES.get((s, r.event_type), s)
    assert {r.user_id: r.state for r in queries.QUERIES["event_lifecycle"](spark, SF).collect()} == want


@pytest.mark.parametrize("text, at", [("proto ==", 8), ("(a", 1), ("packets > x", 10), ("packets >", 9), ("a)", 1), ("/(?=a)/", 1)])
def test_errors_carry_positions(spark, text, at):
    with pytest.raises(QueryError) as e:
        compile_where(text)
    assert e.value.at == at
