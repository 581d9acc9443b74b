"""Every registered query of the engine against its SQL twin, over whole tables."""

import os

import duckdb
import pytest

from quillvec.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    return round(float(x), 9) if isinstance(x, float) or hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)) else x


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = sql.sql(catalog.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == expected


def test_the_rest_runs(spark):
    rest = set(catalog.queries()) - set(NAMES)
    assert rest == {"chunk_documents"} and catalog.queries()["chunk_documents"](spark, SF).count() > 200
