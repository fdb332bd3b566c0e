"""A data source over paged histories: one partition a symbol, pages walked backwards in time.

``spark.dataSource.register(PagedTicks)``, then ``spark.read.format("paged_ticks")`` with the options
``symbols`` (comma-separated), ``client`` ("module:function" that takes (symbol, end, count) and
returns pages of [epoch, price] no newer than ``end``), ``target`` and ``page``.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SymbolPartition(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)
        self.symbol = symbol


def walk_back(fetch: Callable[[str, int | None, int], list], symbol: str, target: int, page: int, attempts: int = 3, pause: float = 0.0) -> list[tuple[int, float]]:
    """Up to ``target`` ticks, oldest first. Each page ends before the oldest tick known; two pages without news, or an empty one, end the walk."""
    known: dict[int, float] = {}
    end, stale = None, 0
    while len(known) < target and stale < 2:
        for attempt in range(attempts):
            try:
                got = fetch(symbol, end, page)
                break
            except (OSError, RuntimeError):
                if attempt + 1 == attempts:
                    raise
                time.sleep(pause * (attempt + 1))
        if not got:
            break
        oldest = min(known, default=None)
        fresh = {int(t): float(p) for t, p in got if oldest is None or int(t) < oldest}
        stale = 0 if fresh else stale + 1
        known |= fresh
        end = min(known) - 1 if known else None
    return sorted(known.items())[-target:]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [SymbolPartition(s.strip()) for s in self.options["symbols"].split(",") if s.strip()]

    def read(self, partition: SymbolPartition) -> Iterator[tuple]:
        module, _, name = self.options["client"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        rows = walk_back(fetch, partition.symbol, int(self.options.get("target", 80_000)), int(self.options.get("page", 5_000)), pause=float(self.options.get("pause", 2.0)))
        for i, (epoch, price) in enumerate(rows):
            yield partition.symbol, i, epoch, price


class PagedTicks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_ticks"

    def schema(self) -> str:
        return "symbol string, i long, epoch long, price double"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
