"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, DATA)
    names = sorted(df.columns)
    relation = con.sql(ORACLES[key])
    assert sorted(relation.columns) == names
    expected = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert sorted([plain(r[n]) for n in names] for r in df.collect()) == sorted([plain(r[n]) for n in names] for r in expected)


@pytest.mark.parametrize("key", ["unwind_all", "unwind_index_all"])
def test_unwind_whole_table(spark, con, key):
    """$unwind is checked over every row of the table, not a range of ids."""
    assert QUERIES[key](spark, DATA).count() == con.sql("SELECT sum(len(embedding)) FROM embeddings").fetchall()[0][0]
