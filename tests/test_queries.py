"""Every query with SQL against DuckDB on the driver's smallest tables, and the others against their rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tickloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        if hasattr(x, "isoformat"):
            return str(x)[:10]
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") else x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


#: The same queries with 200,000 paths a scenario take over a minute each; their SQL is held against that of the others.
FULL = {"ruin_paths_full", "ruin_paths_full_reference", "ruin_summary_full", "ruin_summary_full_reference"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql().keys() - FULL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("accounting", ["", "_reference"])
def test_first_of_all_paths_are_those_of_the_recursion(duck, accounting):
    few, every = registry.oracle_sql()["ruin_paths" + accounting], registry.oracle_sql()["ruin_paths_full" + accounting]
    assert rows(duck.sql(few).df()) == rows(duck.sql(every.replace("range(0, 200000)", "range(0, 2000)")).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["swing_rollup"])
def test_reports_have_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    q = registry.queries()
    order = ["symbol", "n", "i"]
    a, b = (q[n](spark, SF).toPandas().sort_values(order, ignore_index=True) for n in ("paper_trader_batch", "paper_trader_stream"))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_streamed_bars_are_those_of_the_batch(spark, duck):
    got = registry.queries()["stream_bars"](spark, SF).toPandas()
    want = duck.sql("SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts) AS start, count(*) AS volume, max(value) AS high FROM events GROUP BY ALL").df()
    both = got.merge(want, on=["symbol", "start"])
    assert 0 < len(got) == len(both) <= len(want)
    assert (both.volume_x == both.volume_y).all() and (both.high_x == both.high_y).all()
