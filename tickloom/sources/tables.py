"""The engine's long tables over the driver's parquet tables, and the same definitions as SQL.

``ticks``: one row a tick, ``i`` its place within its symbol. ``bars``: daily open, high, low, close
and volume. ``cot``: weekly long and short positions of an asset. Prices of ``ticks`` are shifted by
100 so that their logarithms are finite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str, order: list[str], bucket: str, out: str = "i") -> DataFrame:
    """``out``: each row's place (from 0) within ``key`` by ``order``.

    ``bucket`` must not decrease along ``order``. Rows are numbered within their bucket, and the
    sizes of earlier buckets are added, so one long key is spread over as many tasks as it has buckets.
    """
    sizes = df.groupBy(key, bucket).agg(F.count("*").alias("_n"))
    before = sizes.select(key, bucket, (F.sum("_n").over(Window.partitionBy(key).orderBy(bucket)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order)) - 1
    return df.withColumn("_in", inside).join(before, [key, bucket]).withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before")


def tick_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, price: for what does not depend on the order, a scan and no more."""
    rows = table(spark, sf_dir, "events").where("event_type is not null and ts is not null")
    return rows.select(F.col("event_type").alias("symbol"), (F.col("value") + 100).alias("price"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, i, epoch, price."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", (F.col("value") + 100).alias("price")).where("symbol is not null and ts is not null")
    placed = numbered(events.withColumn("day", F.to_date("ts")), "symbol", ["ts", "event_id"], "day")
    return placed.select("symbol", "i", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"), "price")


TICKS = """ticks AS (
  SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
         CAST(floor(epoch(ts)) AS BIGINT) AS epoch, value + 100 AS price
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL)"""


def bars_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq (order of arrival), date, price: one row an order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("double").alias("price"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume, i."""
    rows = bars_raw(spark, sf_dir).where("symbol is not null and date is not null")
    days = rows.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return numbered(days.withColumn("_year", F.year("date")), "symbol", ["date"], "_year").drop("_year")


def bar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date of every bar."""
    return bars_raw(spark, sf_dir).select("symbol", "date").dropna().distinct()


BARS = """bars_raw AS (
  SELECT o_orderpriority AS symbol, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DOUBLE) AS price FROM orders),
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM (
    SELECT symbol, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM bars_raw WHERE symbol IS NOT NULL AND date IS NOT NULL GROUP BY symbol, date))"""


def cot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, date (the Tuesday of the report), long_all, short_all, net."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("double").alias("price"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("asset"))
    where = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "asset")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(where, customer["c_nationkey"] == where["n_nationkey"])
    week = F.date_add(F.to_date(F.date_trunc("week", F.col("day"))), 1)
    side = lambda status: F.round(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == status, F.col("price"))), F.lit(0.0)), 2)
    return rows.groupBy("asset", week.alias("date")).agg(side("O").alias("long_all"), side("F").alias("short_all")).withColumn("net", F.round(F.col("long_all") - F.col("short_all"), 2))


COT = """cot AS (
  SELECT *, round(long_all - short_all, 2) AS net FROM (
    SELECT r_name AS asset, CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) + 1 AS date,
           round(coalesce(sum(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderstatus = 'O'), 0), 2) AS long_all,
           round(coalesce(sum(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderstatus = 'F'), 0), 2) AS short_all
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ALL))"""

# Each bars symbol stands for a pair of two assets (places in the sorted list of assets).
PAIR_PLACES = [("1-URGENT", 0, 1), ("2-HIGH", 1, 2), ("3-MEDIUM", 2, 3), ("4-NOT SPECIFIED", 3, 4), ("5-LOW", 4, 0)]
ASSETS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def pairs(spark: SparkSession) -> DataFrame:
    """pair, base, quote."""
    return spark.createDataFrame([(p, ASSETS[b], ASSETS[q]) for p, b, q in PAIR_PLACES], "pair string, base string, quote string")


PAIRS = "pairs(pair, base, quote) AS (VALUES " + ", ".join(f"('{p}', '{ASSETS[b]}', '{ASSETS[q]}')" for p, b, q in PAIR_PLACES) + ")"


def chunked(df: DataFrame, key: str, before: int, after: int, size: int = 1_000_000) -> DataFrame:
    """Rows in chunks of ``size`` places of ``i``, with copies of the ``before`` and ``after`` rows around each.

    Window functions whose frames reach no further can then partition by ``key, _chunk``; copies
    (``_copy`` true) are to be dropped afterwards. So a long key's windows run in many tasks.
    """
    c = lambda x: F.floor(x / size).cast("long")
    i = F.col("i")
    homes = F.sequence(F.greatest(c(i - after), F.lit(0).cast("long")), c(i + before))
    return df.withColumn("_chunk", F.explode(homes)).withColumn("_copy", F.col("_chunk") != c(i))


def by_chunk(key: str = "symbol") -> Window:
    return Window.partitionBy(key, "_chunk").orderBy("i")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_copy")).drop("_chunk", "_copy")


def carried(df: DataFrame, keys: list[str], running: dict[str, tuple[Callable, Column | str]], size: int = 1_000_000) -> DataFrame:
    """``df`` with running sums and maxima of the rows before each in its key, by ``i``; null where there are none.

    ``running`` names an aggregate (``F.sum`` or ``F.max``) and its column. Each is taken within
    chunks of ``size`` places and added to what all earlier chunks come to, so a long key is many tasks.
    """
    rows = df.withColumn("_chunk", F.floor(F.col("i") / size).cast("long"))
    parts = rows.groupBy(*keys, "_chunk").agg(*[f(c).alias(f"_all_{name}") for name, (f, c) in running.items()])
    ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*keys, "_chunk", *[f(f"_all_{name}").over(ahead).alias(f"_past_{name}") for name, (f, _) in running.items()])
    inside = Window.partitionBy(*keys, "_chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_here_{name}": f(c).over(inside) for name, (f, c) in running.items()}).join(before, [*keys, "_chunk"])
    for name, (f, _) in running.items():
        past, here = F.col(f"_past_{name}"), F.col(f"_here_{name}")
        # greatest passes over nulls; a sum does not.
        out = out.withColumn(name, F.greatest(past, here) if f is F.max else F.coalesce(past + here, past, here)).drop(f"_past_{name}", f"_here_{name}")
    return out.drop("_chunk")
