"""The paper trader with live quotes: ticks and quotes are one keyed stream, and quotes live for a time.

A quote holds for its symbol, contract and barrier from its place on; a later one replaces it for
contracts decided afterwards. A quote that failed (no payout) counts as 1, as does none, and one that
is older than the time to live. State is the trader and a map of payouts, kept by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.paper import LEDGER, Trader, as_ledger

#: What a contract without a live quote pays: a win without profit.
UNKNOWN = 1.0


class Payouts:
    """The state's payouts under the trader's names: "contract" or "contract:barrier"."""

    def __init__(self, state):
        self.state = state

    def get(self, name: str, default: float = UNKNOWN) -> float:
        contract, _, barrier = name.partition(":")
        key = (contract, int(barrier) if barrier not in ("", "None") else -1)
        return self.state.getValue(key)[0] if self.state.containsKey(key) else default

    def put(self, contract: str, barrier: int | None, payout: float | None) -> None:
        self.state.updateValue((contract, -1 if barrier is None or pd.isna(barrier) else int(barrier)), (UNKNOWN if payout is None or pd.isna(payout) else float(payout),))


class QuotedTrader(StatefulProcessor):
    def __init__(self, settings: dict, ttl_ms: int | None):
        self.settings, self.ttl_ms = settings, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trader = handle.getValueState("trader", "json string")
        self.payouts = Payouts(handle.getMapState("payouts", "contract string, barrier int", "payout double", self.ttl_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trader = Trader(**json.loads(self.trader.get()[0])) if self.trader.exists() else Trader(**self.settings)
        out = []
        # A quote comes before the tick of its place.
        for row in pd.concat(list(rows)).sort_values(["i", "is_tick"]).itertuples(index=False):
            if not row.is_tick:
                self.payouts.put(row.contract, row.barrier, row.payout)
            elif (found := trader.tick(int(row.i), float(row.price), self.payouts)) is not None:
                out.append({"symbol": key[0], **found})
        self.trader.update((json.dumps(asdict(trader)),))
        yield as_ledger(out)

    def close(self) -> None:
        pass


def quoted_stream(ticks: DataFrame, quotes: DataFrame, ttl_ms: int | None = None, **settings) -> DataFrame:
    """The ledger over streams of ticks (symbol, i, price) and quotes (symbol, i, contract, barrier, payout).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Micro-batches must follow each other in time.
    """
    none = lambda kind: F.lit(None).cast(kind)
    a = ticks.select("symbol", "i", F.lit(True).alias("is_tick"), F.col("price").cast("double").alias("price"), none("string").alias("contract"), none("int").alias("barrier"), none("double").alias("payout"))
    b = quotes.select("symbol", F.col("i").cast("long").alias("i"), F.lit(False).alias("is_tick"), none("double").alias("price"), "contract", F.col("barrier").cast("int").alias("barrier"), F.col("payout").cast("double").alias("payout"))
    return a.unionByName(b).groupBy("symbol").transformWithStateInPandas(QuotedTrader(settings, ttl_ms), LEDGER, "Append", "None" if ttl_ms is None else "ProcessingTime")
