"""Every query against its SQL, in DuckDB on the same tables, rows compared without order."""

import datetime
import decimal
import math

import duckdb
import pytest

from recordloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    expected = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    assert table(df.columns, df.collect()) == table(columns, expected.fetchall())


#: Queries without SQL, each with the test that holds it against plain Python.
ELSEWHERE = {
    "soft_coverage": "test_flagship", "align_score": "test_flagship", "nms": "test_flagship", "monotone_path": "test_flagship", "align": "test_flagship", "review_queue": "test_flagship", "diagnostics": "test_flagship",
    "finalize_session": "test_jobs", "reference_match": "test_jobs", "fragment_merge": "test_jobs", "parse_document": "test_jobs",
}


def test_every_query_has_sql_or_a_test():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == set(ELSEWHERE)
