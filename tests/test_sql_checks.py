"""Every registered query against its SQL form, on whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

from codeaudit.plans.registry import QUERIES
from conftest import DATA
from sqlcheck.queries import SQL

SF = f"{DATA}/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def test_every_library_query_has_a_check():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    types = dict(zip(rel.columns, (TYPES.get(str(t)) for t in rel.types)))
    assert {c: types[c] for c in cols} == {c: t for c, t in df.dtypes}
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in rel.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
