"""Registered queries against their SQL, and their names."""

import duckdb
import pytest

import __spark_entry__ as E
from jobframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(E.queries()) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, rel.select(*cols).fetchall()))
