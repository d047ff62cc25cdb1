"""Each catalogue query gives the rows of its SQL on the test tables."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quarry.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_whole_tables_enter(spark, duck):
    ids = duck.execute("select doc_id from documents union select doc_id from labels").fetchall()
    assert QUERIES["merge_upsert_whole"](spark, SF_DIR).count() == len(ids)
    assert QUERIES["cache_orphans_whole"](spark, SF_DIR).count() > 0
