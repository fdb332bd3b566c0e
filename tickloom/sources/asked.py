"""Quotes asked for: each job of a grid is a call to a client, with pauses where the service limits calls.

``client`` is "module:function"; the function takes (symbol, contract, barrier, duration) and returns
a payout, or raises ``RateLimited`` or another error.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import break_even, expected_value, true_win_probability


class RateLimited(RuntimeError):
    """The service wants fewer calls; the same call may be tried again."""


def patient(call: Callable[[], float], attempts: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> tuple[float | None, str | None, int]:
    """(payout, error, tries): up to ``attempts`` tries, with ``pause`` longer after each that hit a limit; another error ends it."""
    for tries in range(1, attempts + 1):
        try:
            return float(call()), None, tries
        except RateLimited as e:
            error = str(e) or "rate limit"
            if tries < attempts:
                sleep(pause * tries)
        except (OSError, RuntimeError, ValueError) as e:
            return None, str(e) or type(e).__name__, tries
    return None, error, attempts


def ask_quotes(jobs: DataFrame, client: str, attempts: int = 6, pause: float = 2.5, apart: float = 0.0, tasks: int = 1) -> DataFrame:
    """``jobs`` (symbol, contract, barrier, duration) with payout, error, tries, true_p, breakeven_p, ev and house_edge.

    A job that fails is a row with its error and no payout. Calls of one task are ``apart`` seconds apart or
    more; ``tasks`` is how many tasks ask at once, so together they bound the calls a second. Within a
    task jobs come one by one, so the number of jobs has no bound.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = client.partition(":")
        call, last = getattr(importlib.import_module(module), name), float("-inf")
        for batch in batches:
            out = []
            for symbol, contract, barrier, duration in batch[["symbol", "contract", "barrier", "duration"]].itertuples(index=False):
                time.sleep(max(0.0, last + apart - time.monotonic()))
                last = time.monotonic()
                out.append(patient(lambda: call(symbol, contract, None if pd.isna(barrier) else int(barrier), int(duration)), attempts, pause))
            yield batch.assign(payout=[o[0] for o in out], error=[o[1] for o in out], tries=[o[2] for o in out])

    rows = jobs.select("symbol", "contract", F.col("barrier").cast("int").alias("barrier"), F.col("duration").cast("int").alias("duration"))
    found = rows.repartition(tasks, "symbol").mapInPandas(asked, "symbol string, contract string, barrier int, duration int, payout double, error string, tries int")
    p = true_win_probability(F.col("contract"), F.col("barrier"))
    ev = expected_value(p, F.col("payout"))
    return found.withColumns({"true_p": p, "breakeven_p": break_even(F.col("payout")), "ev": ev, "house_edge": -ev})


def quote_records(quotes: DataFrame) -> DataFrame:
    """Asked quotes in the layout of a quote file: what ``files.read_quotes`` reads."""
    params = F.struct(F.col("barrier").cast("string").alias("barrier"), "duration", F.lit("t").alias("duration_unit"))
    return quotes.select("symbol", "contract", params.alias("params"), "true_p", "payout", "breakeven_p", F.col("ev").alias("ev_per_$1"), "house_edge", "error")
