"""A streaming source of live ticks, replayable by position, and a feed of recorded messages that stands in for a socket.

``spark.dataSource.register(LiveTicks)``, then ``spark.readStream.format("live_ticks")`` with the options
``symbols`` (comma-separated), ``client`` ("module:function" that takes the options and returns an
object with ``latest(symbol)`` and ``messages(symbol, start, end)``) and ``batch`` (the most messages of
a symbol in a micro-batch). A position counts a symbol's messages; a message is the JSON text that
the service sends, of which ticks alone are passed on. One partition a symbol.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    """Messages of one symbol from ``start`` to before ``end``."""

    def __init__(self, symbol: str, start: int, end: int):
        super().__init__((symbol, start, end))
        self.symbol, self.start, self.end = symbol, start, end


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.symbols = [s.strip() for s in options["symbols"].split(",") if s.strip()]
        self.most = int(options.get("batch", 100_000))
        self.seen: dict[str, int] = {}

    def client(self):
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def initialOffset(self) -> dict[str, int]:
        return {s: 0 for s in self.symbols}

    def latestOffset(self) -> dict[str, int]:
        """The newest positions, ``batch`` messages further than those last asked for at most."""
        client = self.client()
        self.seen = {s: min(client.latest(s), self.seen[s] + self.most if s in self.seen else client.latest(s)) for s in self.symbols}
        return self.seen

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        """Spans of ``batch`` messages at most, so that a long way to catch up is many tasks."""
        cuts = lambda a, b: [(k, min(k + self.most, b)) for k in range(a, b, self.most)]
        return [Span(s, a, b) for s in self.symbols for a, b in cuts(int(start.get(s, 0)), int(end[s]))] or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.start == partition.end:
            return
        for i, text in enumerate(self.client().messages(partition.symbol, partition.start, partition.end), partition.start):
            message = json.loads(text)
            if message.get("msg_type") == "tick" and isinstance(message.get("tick"), dict):
                tick = message["tick"]
                epoch = tick.get("epoch")
                yield partition.symbol, i, None if epoch is None else int(epoch), float(tick["quote"])


class LiveTicks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_ticks"

    def schema(self) -> str:
        return "symbol string, i long, epoch long, price double"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LiveReader(self.options)


class RecordedFeed:
    """Messages from the folder of the option ``feed``: for each symbol, files ``symbol=NAME/*`` of one message a line, in order of their names.

    The option ``upto`` makes only so many of a symbol's messages known yet, as a socket would.
    """

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        folder = options["feed"]
        self.fs, self.root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.upto = int(options.get("upto", 1 << 62))

    def _lines(self, symbol: str) -> Iterator[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/symbol={symbol}", allow_not_found=True))
        for path in sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", "."))):
            with self.fs.open_input_stream(path) as stream:
                rest = b""
                while chunk := stream.read(1 << 20):
                    *whole, rest = (rest + chunk).split(b"\n")
                    yield from (w.decode() for w in whole)
                if rest:
                    yield rest.decode()

    def latest(self, symbol: str) -> int:
        return min(self.upto, sum(1 for _ in self._lines(symbol)))

    def messages(self, symbol: str, start: int, end: int) -> Iterator[str]:
        for k, line in enumerate(self._lines(symbol)):
            if k >= end:
                return
            if k >= start:
                yield line


def recorded(options: dict[str, str]) -> RecordedFeed:
    return RecordedFeed(options)
