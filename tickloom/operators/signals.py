"""Trend regime and entries on daily bars: the signal frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.bars import donchian, near, rolling_rank
from tickloom.operators.recursive import Periods, recursive
from tickloom.sources.tables import by_chunk, own_rows


@dataclass(frozen=True)
class SwingRules:
    """Everything that decides a swing trade; distances are in ATRs."""

    periods: Periods = Periods()
    adx_min: float = 18.0
    rank_window: int = 100
    rank_min: float = 0.05
    rank_max: float = 0.97
    entry: str = "either"
    pullback_bars: int = 6
    channel: int = 20
    stop_atr: float = 2.0
    take_r: float = 2.5
    trail_atr: float = 3.0
    breakeven_r: float = 1.0
    time_bars: int = 40
    use_cot: bool = False
    allow_uncertain: bool = True

    @property
    def warm_up(self) -> int:
        return max(self.periods.ema_trend, self.channel, self.rank_window, self.periods.adx) + 2


def no(c: Column) -> Column:
    """Null counts as no."""
    return F.coalesce(c, F.lit(False))


def regime(rules: SwingRules) -> Column:
    """1, -1 or 0: SuperTrend, close against the trend mean, ADX and the rank of the ATR agree."""
    calm = (F.col("atr_pct") >= rules.rank_min) & (F.col("atr_pct") <= rules.rank_max)
    strong = F.col("adx") >= rules.adx_min
    up = (F.col("st_dir") == 1) & (F.col("close") > F.col("ema_trend")) & strong & calm
    down = (F.col("st_dir") == -1) & (F.col("close") < F.col("ema_trend")) & strong & calm
    return F.when(no(up), 1).when(no(down), -1).otherwise(0)


def frame(bars: DataFrame, rules: SwingRules = SwingRules()) -> DataFrame:
    """Bars with indicators, regime, the four entries and long_signal, short_signal (false during warm-up)."""
    rows = rolling_rank(donchian(recursive(bars, rules.periods), rules.channel), "atr", rules.rank_window, "atr_pct")
    n = rules.pullback_bars
    w = by_chunk()
    last = w.rowsBetween(1 - n, 0)
    any_of = lambda c: F.when(F.count("i").over(last) >= n, F.max(c.cast("int")).over(last) == 1)
    rows = near(rows, n).withColumns({"_c1": F.lag("close").over(w), "_dip": any_of(F.col("low") <= F.col("ema_pullback")), "_pop": any_of(F.col("high") >= F.col("ema_pullback"))})
    rows = own_rows(rows).withColumn("regime", regime(rules))
    up, down = F.col("regime") == 1, F.col("regime") == -1
    close = F.col("close")
    bull, bear = (close > F.col("open")) & (close > F.col("_c1")), (close < F.col("open")) & (close < F.col("_c1"))
    rows = rows.withColumns(
        {
            "long_pullback": no(up & F.col("_dip") & bull & (close >= F.col("ema_pullback"))),
            "short_pullback": no(down & F.col("_pop") & bear & (close <= F.col("ema_pullback"))),
            "long_breakout": no(up & (close > F.col("don_hi")) & bull),
            "short_breakout": no(down & (close < F.col("don_lo")) & bear),
        }
    )
    kinds = {"pullback": ["pullback"], "breakout": ["breakout"]}.get(rules.entry, ["pullback", "breakout"])
    warm = F.col("i") >= rules.warm_up
    either = lambda side: warm & (F.col(f"{side}_{kinds[0]}") | F.col(f"{side}_{kinds[-1]}"))
    return rows.withColumns({"long_signal": either("long"), "short_signal": either("short")}).drop("_c1", "_dip", "_pop")


def gate(want: Column, bias: Column, allow_uncertain: bool = True) -> Column:
    """The wanted direction, or 0 where the bias is against it (or says nothing, if that blocks)."""
    blocked = bias == -want
    if not allow_uncertain:
        blocked = blocked | (bias == 0)
    return F.when((want != 0) & no(blocked), 0).otherwise(want)


def wanted(df_regime: Column = None) -> Column:
    """1, -1 or 0: the entry that signal and regime agree on."""
    return F.when(F.col("long_signal") & (F.col("regime") == 1), 1).when(F.col("short_signal") & (F.col("regime") == -1), -1).otherwise(0)
