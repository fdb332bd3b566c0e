"""The swing simulator: entries at the next open, stops, targets, trails, costs and compounding equity.

One grouped map over a symbol's signal frame; a row of the result is a closed trade or a bar's
equity. Reports are windows over these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.signals import SwingRules

# Pip size and typical spread (in price units) by symbol.
PIPS = [
    ("EURUSD", 0.0001, 0.00008), ("GBPUSD", 0.0001, 0.00012), ("AUDUSD", 0.0001, 0.0001), ("NZDUSD", 0.0001, 0.00015), ("USDCAD", 0.0001, 0.00013), ("USDCHF", 0.0001, 0.00013), ("EURGBP", 0.0001, 0.00012),
    ("USDJPY", 0.01, 0.01), ("EURJPY", 0.01, 0.013), ("GBPJPY", 0.01, 0.018), ("AUDJPY", 0.01, 0.012), ("XAUUSD", 0.1, 0.25), ("XAGUSD", 0.01, 0.02),
]
DEFAULT_PIP = 0.0001


@dataclass(frozen=True)
class Costs:
    """spread: between bid and ask; slippage: a side; commission: a round turn and unit."""

    spread: float
    slippage: float
    commission: float

    @property
    def side(self) -> float:
        return self.spread / 2 + self.slippage


def pips(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PIPS, "symbol string, pip double, spread double")


def cost_model(symbols: DataFrame, pips: DataFrame) -> DataFrame:
    """symbol, pip, spread, slippage, commission; unknown symbols have the default pip and a spread of two."""
    known = pips.select(F.upper("symbol").alias("_s"), F.col("pip").alias("_p"), F.col("spread").alias("_w"))
    rows = symbols.join(known, F.upper("symbol") == F.col("_s"), "left").withColumn("pip", F.coalesce("_p", F.lit(DEFAULT_PIP)))
    return rows.select("symbol", "pip", F.coalesce("_w", 2 * F.col("pip")).alias("spread"), (0.5 * F.col("pip")).alias("slippage"), (0.2 * F.col("pip")).alias("commission"))


@dataclass
class Position:
    """An open trade; ``stop`` moves, ``best`` is the furthest price in its favour."""

    side: int
    since: int
    date: object
    entry: float
    stop: float
    take: float
    units: float
    risk: float
    best: float
    even: bool = False

    def tighten(self, price: float) -> None:
        self.stop = max(self.stop, price) if self.side > 0 else min(self.stop, price)

    def broken(self, price: float) -> bool:
        """Whether a price is at the stop or worse."""
        return self.side * price <= self.side * self.stop

    def reached(self, price: float, level: float) -> bool:
        """Whether a price is at or beyond a level in the trade's favour."""
        return self.side * price >= self.side * level


class Account:
    """One symbol's simulation under fixed rules and costs."""

    def __init__(self, rules: SwingRules, costs: Costs, equity: float, risk: float, leverage: float):
        self.rules, self.costs, self.equity, self.risk, self.leverage = rules, costs, equity, risk, leverage
        self.open: Position | None = None

    def manage(self, i: int, bar) -> tuple[float, str] | None:
        """Move the stop with this bar, then test it against this bar; the exit price and reason, if any."""
        p, r = self.open, self.rules
        good, bad = (bar.high, bar.low) if p.side > 0 else (bar.low, bar.high)
        p.best = max(p.best, good) if p.side > 0 else min(p.best, good)
        # The distance to break even shrinks as the stop comes nearer.
        distance = abs(p.entry - p.stop)
        if r.breakeven_r > 0 and not p.even and p.reached(good, p.entry + p.side * r.breakeven_r * distance):
            p.tighten(p.entry)
            p.even = True
        if r.trail_atr > 0 and not math.isnan(bar.atr):
            p.tighten(p.best - p.side * r.trail_atr * bar.atr)
        if p.broken(bar.open):
            return bar.open, "gap_stop"
        if p.broken(bad):
            return p.stop, "stop"
        if p.take > 0 and p.reached(good, p.take):
            return p.take, "target"
        if r.time_bars > 0 and i - p.since >= r.time_bars:
            return bar.close, "time"
        if bar.regime == -p.side:
            return bar.close, "flip"
        return None

    def leave(self, i: int, date, price: float, reason: str) -> dict:
        p = self.open
        fill = price - p.side * self.costs.side
        pnl = p.side * (fill - p.entry) * p.units - p.units * self.costs.commission
        self.equity += pnl
        self.open = None
        r = pnl / (p.risk * p.units) if p.risk > 0 else 0.0
        return {"direction": p.side, "entry_date": p.date, "entry": p.entry, "stop": p.stop, "take": p.take, "units": p.units, "init_risk": p.risk, "exit_date": date, "exit": fill, "reason": reason, "pnl": pnl, "r_multiple": r, "bars_held": i - p.since, "equity_after": self.equity}

    def wants(self, bar) -> int:
        want = 1 if bar.long_signal and bar.regime == 1 else -1 if bar.short_signal and bar.regime == -1 else 0
        if want and self.rules.use_cot and (bar.bias == -want or bar.bias == 0 and not self.rules.allow_uncertain):
            return 0
        return want

    def enter(self, side: int, i: int, bar, nxt) -> None:
        """At the next bar's open, sized by the stop's distance and held by the leverage."""
        if math.isnan(bar.atr) or bar.atr <= 0:
            return
        entry = nxt.open + side * self.costs.side
        stop = entry - side * self.rules.stop_atr * bar.atr
        distance = abs(entry - stop)
        if distance <= 0:
            return
        units = min(self.equity * self.risk / distance, self.equity * self.leverage / max(entry, 1e-9))
        take = entry + side * self.rules.take_r * distance if self.rules.take_r > 0 else 0.0
        self.open = Position(side, i + 1, nxt.date, entry, stop, take, units, distance, nxt.high if side > 0 else nxt.low)

    def marked(self, close: float) -> float:
        p = self.open
        return self.equity if p is None else self.equity + p.side * (close - p.entry) * p.units


def simulate(bars: list, account: Account) -> tuple[list[dict], list[float]]:
    """The closed trades and each bar's equity. A trade that is filled at the next open is already marked at this close."""
    trades, marks = [], []
    for i, bar in enumerate(bars):
        if account.open is not None:
            out = account.manage(i, bar)
            if out is not None:
                trades.append(account.leave(i, bar.date, *out))
        if account.open is None and i + 1 < len(bars):
            side = account.wants(bar)
            if side:
                account.enter(side, i, bar, bars[i + 1])
        marks.append(account.marked(bar.close))
    return trades, marks


LEDGER = "symbol string, variant string, direction int, entry_date date, entry double, stop double, take double, units double, init_risk double, exit_date date, exit double, reason string, pnl double, r_multiple double, bars_held int, equity_after double, date date, equity double"


def backtest(frame: DataFrame, rules: SwingRules = SwingRules(), equity: float = 10_000.0, risk: float = 0.01, leverage: float = 50.0) -> DataFrame:
    """Trades (``reason`` not null) and bar equities (``equity`` not null) of each symbol and variant.

    ``frame``: a signal frame with symbol, variant, bias and the columns of ``cost_model``; rows of
    variant "cot" obey the bias.
    """
    names = [f.split(" ")[0] for f in LEDGER.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        first = pdf.iloc[0]
        obeyed = SwingRules(**{**rules.__dict__, "use_cot": rules.use_cot or first["variant"] != "base"})
        account = Account(obeyed, Costs(first["spread"], first["slippage"], first["commission"]), equity, risk, leverage)
        trades, marks = simulate(list(pdf.itertuples(index=False)), account)
        out = pd.concat([pd.DataFrame(trades), pd.DataFrame({"date": pdf["date"], "equity": marks})], ignore_index=True)
        out["symbol"], out["variant"] = first["symbol"], first["variant"]
        out = out.reindex(columns=names)
        for c in ("direction", "bars_held"):
            out[c] = out[c].astype("Int32")
        for c in ("reason", "entry_date", "exit_date", "date"):
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        return out

    return frame.groupBy("symbol", "variant").applyInPandas(run, LEDGER)


def ledger(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").drop("date", "equity")


def equities(rows: DataFrame) -> DataFrame:
    return rows.where("equity is not null").select("symbol", "variant", "date", "equity")


def metrics(rows: DataFrame, start: float = 10_000.0) -> DataFrame:
    """One row a symbol and variant; zeros where nothing was traded; profit_factor null where nothing was lost."""
    keys = ["symbol", "variant"]
    w = Window.partitionBy(*keys).orderBy("date")
    e = equities(rows).withColumns({"_ret": F.coalesce(F.col("equity") / F.lag("equity").over(w) - 1, F.lit(0.0)), "_peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    curve = e.groupBy(*keys).agg(
        F.max_by("equity", "date").alias("last"), F.datediff(F.max("date"), F.min("date")).alias("_days"), (F.avg("_ret") / F.when(F.stddev_samp("_ret") > 0, F.stddev_samp("_ret")) * math.sqrt(252)).alias("_sharpe"), F.min((F.col("equity") - F.col("_peak")) / F.col("_peak")).alias("_dd")
    )
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.abs(F.sum(F.when(F.col("pnl") <= 0, F.col("pnl"))))
    t = ledger(rows).groupBy(*keys).agg(F.count("*").alias("trades"), (F.avg((F.col("pnl") > 0).cast("double")) * 100).alias("win_rate"), (F.coalesce(won, F.lit(0.0)) / F.when(lost > 0, lost)).alias("profit_factor"), F.avg("r_multiple").alias("expectancy_r"), F.avg("bars_held").alias("avg_bars"))
    years = F.greatest(F.col("_days") / 365.25, F.lit(1e-9))
    cagr = F.when(F.col("last") > 0, F.pow(F.col("last") / start, 1 / years) - 1).otherwise(-1.0)
    some = F.col("trades").isNotNull()
    zero = lambda c: F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return curve.join(t, keys, "left").select(
        *keys, F.coalesce("trades", F.lit(0)).alias("trades"), zero(F.col("last") - start).alias("net"), zero((F.col("last") / start - 1) * 100).alias("ret_pct"), zero(cagr * 100).alias("cagr"), zero(F.col("_sharpe")).alias("sharpe"),
        zero(F.col("_dd") * 100).alias("max_dd"), zero(F.col("win_rate")).alias("win_rate"), F.when(some, F.col("profit_factor")).otherwise(0.0).alias("profit_factor"), zero(F.col("expectancy_r")).alias("expectancy_r"), zero(F.col("avg_bars")).alias("avg_bars"),
    )


def rollup(m: DataFrame) -> DataFrame:
    """Over symbols, for each variant: mean and median return, how many made money, of how many."""
    return m.groupBy("variant").agg(F.avg("ret_pct").alias("mean_return"), F.percentile("ret_pct", 0.5).alias("median_return"), F.count_if(F.col("ret_pct") > 0).alias("profitable"), F.count("*").alias("symbols"))


def split(bars: DataFrame, share: float = 0.6) -> DataFrame:
    """Bars with ``part`` 'is' and 'oos' at ``share`` of each symbol's rows; the bar at the cut is in both."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("_n"))
    cut = F.floor(F.col("_n") * share)
    parts = F.array_compact(F.array(F.when(F.col("i") <= cut, F.lit("is")), F.when(F.col("i") >= cut, F.lit("oos"))))
    return bars.join(n, "symbol").withColumn("part", F.explode(parts)).drop("_n")


def portfolio(rows: DataFrame, start: float = 10_000.0) -> DataFrame:
    """variant, date, value, drawdown: the mean over started symbols of equity by start, each carried on to all dates."""
    e = equities(rows).withColumn("v", F.col("equity") / start)
    calendar = e.select("variant", "date").distinct().join(e.select("variant", "symbol").distinct(), "variant")
    w = Window.partitionBy("variant", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = calendar.join(e, ["variant", "symbol", "date"], "left").withColumn("v", F.last("v", ignorenulls=True).over(w))
    days = filled.groupBy("variant", "date").agg(F.avg("v").alias("value"))
    past = Window.partitionBy("variant").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("drawdown", F.col("value") / F.max("value").over(past) - 1)


def portfolio_sharpe(days: DataFrame, year: int = 252) -> DataFrame:
    """variant, days, sharpe, of the portfolio's daily changes (the first day's is 0), a year's worth; 0 where nothing changes."""
    w = Window.partitionBy("variant").orderBy("date")
    change = F.coalesce(F.col("value") / F.lag("value").over(w) - 1, F.lit(0.0))
    moved = days.withColumn("_c", change).groupBy("variant").agg(F.count("*").alias("days"), F.avg("_c").alias("_m"), F.stddev_samp("_c").alias("_s"))
    return moved.select("variant", "days", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * year**0.5).otherwise(0.0).alias("sharpe"))
