"""Bars from a stream of ticks, and what to do with each closed bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def tick_bars(ticks: DataFrame, width: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """symbol, start, open, high, low, close, volume of tumbling windows over (symbol, ts, seq, price).

    Ticks later than ``late`` behind the newest are dropped; a window's bar comes when it is closed for good.
    """
    timed = ticks.withWatermark("ts", late)
    at = F.struct("ts", "seq")
    return timed.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume")).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def alerts(signals: DataFrame, send: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each batch's rows with a long or short signal to ``send``."""
    return signals.where("long_signal or short_signal").writeStream.foreachBatch(send)
