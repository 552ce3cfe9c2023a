"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from jobframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


catalog.load_all()


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "sink_id" in df.columns


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR",
                 "DoubleType()": "DOUBLE", "BooleanType()": "BOOLEAN", "TimestampNTZType()": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    types = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    rel_types = dict(zip(con.sql(E.oracle_sql()[name]).columns, map(str, con.sql(E.oracle_sql()[name]).types)))
    assert types == rel_types
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(E.oracle_sql()[name])
    ocols = rel.columns
    assert sorted(ocols) == cols
    order = sorted(range(len(ocols)), key=lambda i: ocols[i])
    want = Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    assert got == want
