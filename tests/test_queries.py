"""Every query of the library beside its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from vellum.plans import browse, library, match, media, sequence, shelves, summary, work, writes

DATA = "/root/testdata/sf0.001"
QUERIES = {**browse.QUERIES, **summary.QUERIES, **sequence.QUERIES, **library.QUERIES, **work.QUERIES, **match.QUERIES, **media.QUERIES, **shelves.QUERIES, **writes.QUERIES}
SQL = {**browse.ORACLE_SQL, **summary.ORACLE_SQL, **sequence.ORACLE_SQL, **library.ORACLE_SQL, **work.ORACLE_SQL, **match.ORACLE_SQL, **media.ORACLE_SQL, **shelves.ORACLE_SQL, **writes.ORACLE_SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return "" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    if name not in SQL:
        assert got.count() > 0
        return
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
