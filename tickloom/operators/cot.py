"""Weekly positioning: indexes, pair bias, and look-ahead-safe alignment to daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import clip

#: Days from a report's date to its publication.
LAG_DAYS = 3
WINDOW, HIGH, LOW = 26, 0.65, 0.35


def as_of_each(left: DataFrame, key: str, left_time: str, sides: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``left`` with a column for each of ``sides`` (right, right_time, value, out): the ``value`` of the latest right
    row of its key at or before its time.

    A right row matches by its time alone: its value counts even if it is null. All are put in one table
    and the last right rows are carried on, within a year of a key and then from the years before, so one
    shuffle does for all sides and no pairs are made. ``out`` is null where nothing matches.
    """
    columns = [c for c in left.columns if c not in (key, left_time)]
    kinds = {f"_v{n}": f"struct<v:{dict(right.dtypes)[value]}>" for n, (right, _, value, _) in enumerate(sides)}
    none = {v: F.lit(None).cast(kind) for v, kind in kinds.items()}
    both = left.select(F.col(key).alias("_k"), F.col(left_time).cast("date").alias("_t"), F.lit(1).alias("_side"), *[c.alias(v) for v, c in none.items()], (F.struct(*columns) if columns else F.lit(None)).alias("_l"))
    empty = F.lit(None).cast(both.schema["_l"].dataType).alias("_l")
    for n, (right, time, value, _) in enumerate(sides):
        mine = none | {f"_v{n}": F.struct(F.col(value).alias("v")).cast(kinds[f"_v{n}"])}
        both = both.unionByName(right.select(F.col(key).alias("_k"), F.col(time).cast("date").alias("_t"), F.lit(0).alias("_side"), *[c.alias(v) for v, c in mine.items()], empty))
    both = both.withColumn("_y", F.year("_t"))
    ends = both.groupBy("_k", "_y").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_t"))).alias(f"_end{v}") for v in kinds])
    past = Window.partitionBy("_k").orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_k", "_y", *[F.last(f"_end{v}", ignorenulls=True).over(past).alias(f"_carry{v}") for v in kinds])
    inside = Window.partitionBy("_k", "_y").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({f"_hit{v}": F.last(v, ignorenulls=True).over(inside) for v in kinds}).where("_side = 1").join(carried, ["_k", "_y"])
    keep = [F.col(f"_l.{c}").alias(c) for c in columns]
    return found.select(F.col("_k").alias(key), F.col("_t").alias(left_time), *keep, *[F.coalesce(f"_hit_v{n}", f"_carry_v{n}")["v"].alias(out) for n, (*_, out) in enumerate(sides)])


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """``as_of_each`` of one right side."""
    return as_of_each(left, key, left_time, [(right, right_time, value, out)])


def index(s: str, w: Window, n: int = WINDOW) -> Column:
    """Where s stands between the least and the most of its last n rows; null without n rows or range."""
    frame = w.rowsBetween(1 - n, 0)
    low, high = F.min(s).over(frame), F.max(s).over(frame)
    return F.when(F.count(s).over(frame) >= n, F.try_divide(F.col(s) - low, high - low))


def asset_index(cot: DataFrame, n: int = WINDOW) -> DataFrame:
    """asset, date, idx (held in 0 to 1)."""
    w = Window.partitionBy("asset").orderBy("date")
    return cot.select("asset", "date", clip(index("net", w, n), 0.0, 1.0).alias("idx"))


def pair_series(cot: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, date, base, quote: both legs' net positions on the dates that both have."""
    b = cot.select(F.col("asset").alias("base_asset"), "date", F.col("net").alias("base"))
    q = cot.select(F.col("asset").alias("quote_asset"), "date", F.col("net").alias("quote"))
    legs = pairs.select("pair", F.col("base").alias("base_asset"), F.col("quote").alias("quote_asset"))
    return legs.join(b, "base_asset").join(q, ["quote_asset", "date"]).select("pair", "date", "base", "quote").dropna()


def _against(b: Column, q: Column) -> Column:
    return F.when((b > 0) & (q < 0), 1).when((b < 0) & (q > 0), -1).otherwise(0)


def bias_user(series: DataFrame) -> DataFrame:
    """pair, date, bias: 1 if the base is net long and the quote net short, -1 the other way, else 0."""
    return series.select("pair", "date", _against(F.col("base"), F.col("quote")).alias("bias"))


def bias_index(series: DataFrame, n: int = WINDOW, high: float = HIGH, low: float = LOW) -> DataFrame:
    """pair, date, bias from the legs' indexes over the dates that both have."""
    w = Window.partitionBy("pair").orderBy("date")
    level = lambda s: F.when(index(s, w, n) > high, 1).when(index(s, w, n) < low, -1).otherwise(0)
    return series.select("pair", "date", level("base").alias("_b"), level("quote").alias("_q")).select("pair", "date", _against(F.col("_b"), F.col("_q")).alias("bias"))


def aligned_each(daily: DataFrame, weekly: list[tuple[DataFrame, str, str]], lag_days: int = LAG_DAYS, missing: float | None = 0.0) -> DataFrame:
    """``daily`` (pair, date) with the values of several weekly series (series, value, out) published by then; null or none becomes ``missing``."""
    sides = [(series.select("pair", F.date_add("date", lag_days).alias("_pub"), value), "_pub", value, out) for series, value, out in weekly]
    found = as_of_each(daily, "pair", "date", sides)
    return found if missing is None else found.withColumns({out: F.coalesce(F.col(out).cast("double"), F.lit(missing)) for _, _, out in weekly})


def aligned(daily: DataFrame, weekly: DataFrame, value: str, out: str, lag_days: int = LAG_DAYS, missing: float | None = 0.0) -> DataFrame:
    return aligned_each(daily, [(weekly, value, out)], lag_days, missing)


def features(daily: DataFrame, cot: DataFrame, pairs: DataFrame, missing: float | None = 0.0) -> DataFrame:
    """pair, date, cot_base_idx, cot_quote_idx, cot_bias as known each day. ``missing=None`` leaves unknown ones null."""
    idx = asset_index(cot)
    leg = lambda side: pairs.select("pair", F.col(side).alias("asset")).join(idx, "asset").select("pair", "date", "idx")
    return aligned_each(daily, [(leg("base"), "idx", "cot_base_idx"), (leg("quote"), "idx", "cot_quote_idx"), (bias_index(pair_series(cot, pairs)), "bias", "cot_bias")], missing=missing)
