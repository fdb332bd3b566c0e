"""Daily bars: cleaning, window indicators, and the indicators that each bar hands on to the next.

All are column windows over chunks of a symbol's bars; ``recursive`` has those that each bar hands on
to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import to_number
from tickloom.sources.tables import by_chunk, carried, chunked, own_rows


def clean(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """symbol, date, open, high, low, close, volume from text rows (symbol, seq, time, open, high, low, close[, volume]).

    Rows without a time or a price go, then of equal times all but the last to arrive, then rows
    with a price not above 0 or a high below the low, then of each day all but the last row.
    """
    numbers = {c: to_number(F.col(c).cast("string")) for c in ("open", "high", "low", "close")}
    numbers["volume"] = F.coalesce(to_number(F.col("volume").cast("string")), F.lit(0.0)) if "volume" in raw.columns else F.lit(0.0)
    rows = raw.select("symbol", "seq", F.col("time").cast("string").try_cast("timestamp_ntz").alias("time"), *[c.alias(n) for n, c in numbers.items()]).dropna(subset=["time", "open", "high", "low", "close"])
    value = F.struct("open", "high", "low", "close", "volume")
    once = rows.groupBy("symbol", "time").agg(F.max_by(value, "seq").alias("v")).select("symbol", "time", "v.*")
    good = once.where((F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.col("low")))
    days = good.groupBy("symbol", F.to_date("time").alias("date")).agg(F.max_by(value, "time").alias("v")).select("symbol", "date", "v.*")
    if start is not None:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.where(F.col("date") <= F.lit(end).cast("date"))
    return days


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last by ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _full(w: Window, n: int, x: str, value: Column) -> Column:
    """``value`` where the frame holds n values of x, else null."""
    return F.when(F.count(x).over(w) >= n, value)


def near(bars: DataFrame, before: int, after: int = 0) -> DataFrame:
    return chunked(bars, "symbol", before, after)


def sma(bars: DataFrame, n: int, x: str = "close") -> DataFrame:
    w = by_chunk().rowsBetween(1 - n, 0)
    return own_rows(near(bars, n).withColumn("sma", _full(w, n, x, F.avg(x).over(w))))


def true_range(bars: DataFrame) -> DataFrame:
    """``tr``: the largest of high - low and both distances from the close before."""
    before = F.lag("close").over(by_chunk())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return own_rows(near(bars, 1).withColumn("tr", tr))


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    """``don_hi``, ``don_lo``: the extremes of the n bars before; null until there are n."""
    w = by_chunk().rowsBetween(-n, -1)
    return own_rows(near(bars, n).withColumns({"don_hi": _full(w, n, "high", F.max("high").over(w)), "don_lo": _full(w, n, "low", F.min("low").over(w))}))


def pivots(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """``pivot_high``, ``pivot_low``: bars that are the first extreme of [i - left, i + right]; false near the ends."""
    w = by_chunk()
    around, prior = w.rowsBetween(-left, right), w.rowsBetween(-left, -1)
    whole = F.count("close").over(around) == left + right + 1
    high = whole & (F.col("high") == F.max("high").over(around)) & (F.col("high") > F.max("high").over(prior))
    low = whole & (F.col("low") == F.min("low").over(around)) & (F.col("low") < F.min("low").over(prior))
    f = lambda c: F.coalesce(c, F.lit(False))
    return own_rows(near(bars, left, right).withColumns({"pivot_high": f(high), "pivot_low": f(low)}))


def confirmed_level(bars: DataFrame, flag: str, price: str, right: int = 3, size: int = 1_000_000) -> DataFrame:
    """``level``: the price at the bar that last confirmed a pivot (``right`` bars after it), carried on.

    The last one is looked for within a chunk of ``size`` bars, and else taken from the chunks before.
    """
    confirmed = F.lag(flag, right).over(by_chunk())
    marked = own_rows(near(bars, right).withColumn("_m", F.when(confirmed, F.col(price))))
    mark = F.when(F.col("_m").isNotNull(), F.struct("i", "_m"))
    placed = carried(marked, ["symbol"], {"_before": (F.max, mark)}, size)
    return placed.withColumn("level", F.coalesce("_m", F.col("_before._m"))).drop("_m", "_before")


def rolling_rank(df: DataFrame, x: str, n: int, out: str, partial: float | None = None) -> DataFrame:
    """``out``: the share of the last n values that do not exceed this one. Null until there are n; with ``partial``
    shorter windows count too, and that value stands where there is none."""
    w = by_chunk().rowsBetween(1 - n, 0)
    values = F.collect_list(x).over(w)
    share = F.size(F.filter(values, lambda v: v <= F.col(x))) / F.size(values)
    rank = F.when(F.col(x).isNotNull(), share) if partial is not None else F.when(F.count(x).over(w) >= n, share)
    return own_rows(near(df, n).withColumn(out, F.coalesce(rank, F.lit(partial)) if partial is not None else rank))
