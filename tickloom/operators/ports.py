"""Rules of the live expert and the chart indicators, as plans over bars, equity and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import rolling_rank
from tickloom.operators.recursive import recursive
from tickloom.operators.signals import gate, no
from tickloom.sources.tables import by_chunk, chunked, own_rows


def daily_breaker(equity: DataFrame, limit_pct: float = 5.0) -> DataFrame:
    """(symbol, ts, equity) with ``day_start``, ``drawdown_pct`` and ``halted``: true from the first time a day has lost
    ``limit_pct`` of its start until the day ends. It blocks entries only."""
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts", "seq")
    so_far = day.rowsBetween(Window.unboundedPreceding, 0)
    out = equity.withColumn("day_start", F.first("equity").over(so_far))
    out = out.withColumn("drawdown_pct", (F.col("day_start") - F.col("equity")) / F.col("day_start") * 100)
    return out.withColumn("halted", F.max(F.col("drawdown_pct") >= limit_pct).over(so_far))


def higher_frame(bars: DataFrame, unit: str = "week", ema: int = 50) -> DataFrame:
    """symbol, date, htf_dir: where the close of the last *closed* higher bar stands against its mean (1, -1, 0).

    A bar belongs to its unit and sees the unit before, so nothing of the running one is known.
    """
    units = bars.groupBy("symbol", F.date_trunc(unit, "date").alias("_u")).agg(F.max_by("close", "date").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("open", "date").alias("open"), F.sum("volume").alias("volume"))
    w = Window.partitionBy("symbol").orderBy("_u")
    numbered = units.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "date": F.to_date("_u")}).drop("_u")
    seen = recursive(numbered)
    state = F.when(F.col("close") > F.col("ema_trend"), 1).when(F.col("close") < F.col("ema_trend"), -1).otherwise(0)
    shown = seen.select("symbol", F.lead("date").over(Window.partitionBy("symbol").orderBy("date")).alias("_u"), state.alias("htf_dir")).where("_u is not null")
    return bars.withColumn("_u", F.to_date(F.date_trunc(unit, "date"))).join(shown, ["symbol", "_u"], "left").select("symbol", "date", F.coalesce("htf_dir", F.lit(0)).alias("htf_dir"))


def expert_signals(frame: DataFrame, higher: DataFrame, bias: DataFrame, session: Column, positions: int = 0, most: int = 1, allow_uncertain: bool = True, tight: Column | None = None, halted: DataFrame | None = None) -> DataFrame:
    """symbol, date, order (1, -1, 0): signals that the higher frame, the bias, the session and the open positions allow,
    and if given, that the spread (``tight``) and the breaker (``halted``: symbol and date of halted days) allow."""
    rows = frame.join(higher, ["symbol", "date"], "left").join(bias, ["symbol", "date"], "left")
    htf = F.coalesce("htf_dir", F.lit(0))
    want = F.when(F.col("long_signal") & (htf >= 0), 1).when(F.col("short_signal") & (htf <= 0), -1).otherwise(0)
    allowed = gate(want, F.coalesce("bias", F.lit(0.0)).cast("int"), allow_uncertain)
    free = F.lit(positions < most) & no(F.lit(True) if tight is None else tight)
    if halted is not None:
        rows = rows.join(halted.select("symbol", "date", F.lit(True).alias("_halted")).distinct(), ["symbol", "date"], "left")
        free = free & F.col("_halted").isNull()
    return rows.select("symbol", "date", F.when(no(session) & free, allowed).otherwise(0).alias("order"))


def managed_stops(frame: DataFrame, stop_atr: float = 2.0, breakeven_r: float = 1.0, trail_atr: float = 3.0, time_bars: int = 40) -> DataFrame:
    """symbol, opened, side, step, price, stop, exit of every position opened at the bar after a signal, price by price.

    A stop only tightens: to the entry once the price is ``breakeven_r`` times the *current* risk away, and to the
    current price less the trail, both by the ATR of the last closed bar. So it is a running maximum. A price at the
    stop of before ends the position, and so does its last bar; later prices are not shown.
    """
    w = by_chunk()
    rows = chunked(frame, "symbol", 1, time_bars + 1).withColumn("_atr", F.lag("atr").over(w))
    rows = rows.withColumns({"_path": F.collect_list(F.struct("close", "_atr")).over(w.rowsBetween(1, time_bars)), "_entry": F.lead("open").over(w)})
    side = F.when(F.col("long_signal"), 1).when(F.col("short_signal"), -1)
    taken = own_rows(rows).withColumn("side", side).where(F.col("side").isNotNull() & F.col("_entry").isNotNull())
    first = F.col("side") * F.col("_entry") - stop_atr * F.col("atr")
    steps = taken.select("symbol", F.col("i").alias("opened"), "side", F.col("_entry").alias("entry"), first.alias("_first"), F.posexplode("_path").alias("step", "_p"))
    price, atr = F.col("side") * F.col("_p.close"), F.col("_p._atr")
    even = F.when(price >= F.col("side") * F.col("entry") + breakeven_r * stop_atr * atr, F.col("side") * F.col("entry"))
    one = Window.partitionBy("symbol", "opened").orderBy("step")
    steps = steps.withColumns({"_price": price, "_stop": F.greatest("_first", F.max(F.greatest(even, price - trail_atr * atr)).over(one.rowsBetween(Window.unboundedPreceding, 0)))})
    before = F.coalesce(F.lag("_stop").over(one), F.col("_first"))
    steps = steps.withColumn("exit", F.when(F.col("_price") <= before, "stop").when(F.col("step") == time_bars - 1, "time").otherwise("open"))
    gone = F.coalesce(F.max((F.col("exit") != "open").cast("int")).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = steps.withColumn("_gone", gone).where("_gone = 0")
    return out.select("symbol", "opened", "side", "step", (F.col("side") * F.col("_price")).alias("price"), (F.col("side") * F.col("_stop")).alias("stop"), "exit")


def order_plan(frame: DataFrame, balance: float, risk_pct: float = 0.5, stop_atr: float = 2.0, take_r: float = 2.5, money_per_point: float = 0.01) -> DataFrame:
    """symbol, date, side, stop_distance, take_distance, lots of each signal: the stop widened to the broker's least
    distance (the target is not), lots down to the step within the broker's bounds."""
    from tickloom.functions.scalars import lots, widened_stop

    side = F.when(F.col("long_signal"), 1).when(F.col("short_signal"), -1)
    wide = stop_atr * F.col("atr")
    rows = frame.where(side.isNotNull()).withColumns({"side": side, "stop_distance": widened_stop(wide, F.lit(50_000.0)), "take_distance": take_r * wide})
    size = lots(F.lit(balance * risk_pct / 100), F.col("stop_distance") * money_per_point, F.lit(0.01), F.lit(0.01), F.lit(100.0), F.lit(5.0))
    return rows.select("symbol", "date", "side", "stop_distance", "take_distance", size.alias("lots"))


def chart_signals(frame: DataFrame, lookback: int = 6, arrow: float = 0.3) -> DataFrame:
    """symbol, date, side, arrow: closed bars' signals and where their arrow stands, under a low or over a high by 0.3 ATR."""
    last = frame.groupBy("symbol").agg(F.max("i").alias("_last"))
    rows = frame.join(last, "symbol").where("i < _last and (long_signal or short_signal)")
    up = F.col("long_signal")
    return rows.select("symbol", "date", F.when(up, 1).otherwise(-1).alias("side"), F.when(up, F.col("low") - arrow * F.col("atr")).otherwise(F.col("high") + arrow * F.col("atr")).alias("arrow"))


def script_variant(frame: DataFrame, lookback: int = 6, window: int = 100) -> DataFrame:
    """symbol, date, dip, rank100: the chart script's reading. The lowest low of ``lookback`` bars is held against the
    *current* mean, and the ATR's rank (0 to 100) is taken among the bars before it."""
    w = by_chunk()
    rows = chunked(frame, "symbol", window + 1, 0)
    recent, before = w.rowsBetween(1 - lookback, 0), w.rowsBetween(-window, -1)
    values = F.collect_list("atr").over(before)
    rank = F.when(F.size(values) >= window, F.size(F.filter(values, lambda v: v <= F.col("atr"))) / F.size(values) * 100)
    dip = F.min("low").over(recent) <= F.col("ema_pullback")
    return own_rows(rows.withColumns({"dip": no(dip), "rank100": rank})).select("symbol", "date", "dip", "rank100")


def dashboard(frame: DataFrame) -> DataFrame:
    """Each symbol's latest row: regime, trend, ADX, ATR and its rank."""
    return frame.groupBy("symbol").agg(F.max_by(F.struct("date", "regime", "st_dir", "adx", "atr", "atr_pct"), "i").alias("v")).select("symbol", "v.*")


def closed_bars(bars: DataFrame) -> DataFrame:
    """All bars but each symbol's newest, which may still change."""
    newest = bars.groupBy("symbol").agg(F.max("date").alias("_newest"))
    return bars.join(newest, "symbol").where("date < _newest").drop("_newest")


def open_positions(orders: DataFrame) -> DataFrame:
    """symbol, positions: how many orders of ours (by magic number) are open."""
    return orders.groupBy("symbol").agg(F.count_if(F.col("ours") & F.col("open")).alias("positions"))


def mql_rank(frame: DataFrame, window: int = 100) -> DataFrame:
    """The expert's ATR rank: as ``rolling_rank`` with partial windows, 0.5 where there is none."""
    return rolling_rank(frame, "atr", window, "mql_rank", partial=0.5)
