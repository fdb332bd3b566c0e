"""The registered queries on the driver's smallest tables: SQL where there is some, else rows."""

import os

import duckdb
import pytest

from tickloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    assert set(want.columns) <= set(got.columns)
    cols = sorted(want.columns)
    assert sorted((tuple(r[x] for x in cols) for r in got.collect()), key=repr) == sorted(want.project(", ".join(cols)).fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_has_a_row_for_each_of_its_table(spark, name):
    table = "pages" if name.startswith("op3") else "documents"
    n, rows = queries.queries()[name](spark, SF).count(), spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert n > 0 and (n == rows or name in ("op9_packing", "pipeline"))
