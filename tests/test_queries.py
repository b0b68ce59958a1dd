"""Every registered query of the engine against its SQL on the smallest data."""

import os

import duckdb
import pytest

from sextant import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    mine = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    other = tables.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in other.description]
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in other.fetchall()), key=str)
    assert sorted(df.columns) == sorted(names)
    assert mine == theirs
    assert mine, "an empty comparison shows nothing"


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_have_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count()


def test_declarations_come_from_every_line(spark):
    lines = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(size(split(text, '\\n', -1))) AS n").first()["n"]
    assert catalog.queries()["declarations"](spark, SF).where("role = 'def'").count() == lines
