"""Weekly positioning from a paged service: filters reach the client, a partition is a page range, pages are kept.

``spark.dataSource.register(WeeklyPositions)``, then ``spark.read.format("weekly_positions")`` with the
options ``client`` ("module:function" that takes the options and returns an object with
``count(code, since, until)`` and ``page(code, since, until, offset, limit)``, the latter a list of the
service's records in order of their dates), ``page`` (records a request), ``pages`` (requests a partition)
and ``cache`` (a shared folder; pages in it are not asked for again, unless ``refresh`` is "true").
Filters on asset (=, in) and date (=, <, <=, >, >=) need ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from collections.abc import Iterable, Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# The service's code of each asset.
CODES = {
    "GOLD": "088691",
    "SILVER": "084691",
    "AUD": "232741",
    "GBP": "096742",
    "CAD": "090741",
    "EUR": "099741",
    "JPY": "097741",
    "CHF": "092741",
    "DXY": "098662",
    "NZD": "112741",
    "MXN": "095741",
    "BRL": "102741",
}

# Pair, base asset and its field, quote asset and its field.
PAIRS = [
    ("EURUSD", "EUR", "noncomm_net", "DXY", "noncomm_net"),
    ("GBPUSD", "GBP", "noncomm_net", "DXY", "noncomm_net"),
    ("AUDUSD", "AUD", "noncomm_net", "DXY", "noncomm_net"),
    ("NZDUSD", "NZD", "noncomm_net", "DXY", "noncomm_net"),
    ("USDCAD", "DXY", "noncomm_net", "CAD", "noncomm_net"),
    ("USDCHF", "DXY", "noncomm_net", "CHF", "noncomm_net"),
    ("USDJPY", "DXY", "noncomm_net", "JPY", "noncomm_net"),
    ("EURJPY", "EUR", "noncomm_net", "JPY", "noncomm_net"),
    ("GBPJPY", "GBP", "noncomm_net", "JPY", "noncomm_net"),
    ("EURGBP", "EUR", "noncomm_net", "GBP", "noncomm_net"),
    ("XAUUSD", "GOLD", "comm_net", "DXY", "noncomm_net"),
    ("XAGUSD", "SILVER", "comm_net", "DXY", "noncomm_net"),
]
PAIR_SCHEMA = "pair string, base_asset string, base_field string, quote_asset string, quote_field string"

# Fields of the service's records.
DATE = "report_date_as_yyyy_mm_dd"
LONG_SHORT = ["comm_positions_long_all", "comm_positions_short_all", "noncomm_positions_long_all", "noncomm_positions_short_all"]
INTEREST = "open_interest_all"

SCHEMA = "asset string, date date, comm_net double, noncomm_net double, open_interest double, " + ", ".join(f"{c} double" for c in LONG_SHORT)


class PageRange(InputPartition):
    def __init__(self, asset: str, since: str | None, until: str | None, first: int, last: int):
        super().__init__((asset, since, until, first, last))
        self.asset, self.since, self.until, self.first, self.last = asset, since, until, first, last


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


class WeeklyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.assets, self.since, self.until = list(CODES), None, None
        self.size = int(options.get("page", 50_000))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters that the client answers are taken; the others are left to Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("asset",) and isinstance(f, EqualTo | In):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.assets = [a for a in self.assets if a in asked]
            elif name == ("date",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                day = f.value if isinstance(f.value, date) else date.fromisoformat(str(f.value)[:10])
                if not isinstance(f, LessThan | LessThanOrEqual):
                    low = day + timedelta(isinstance(f, GreaterThan))
                    self.since = max(self.since or low, low)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    high = day - timedelta(isinstance(f, LessThan))
                    self.until = min(self.until or high, high)
            else:
                yield f

    def client(self):
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def partitions(self) -> list[InputPartition]:
        client, each = self.client(), int(self.options.get("pages", 4))
        since, until = (d and d.isoformat() for d in (self.since, self.until))
        out = []
        for asset in self.assets:
            pages = -(-client.count(CODES[asset], since, until) // self.size)
            out += [PageRange(asset, since, until, k, min(k + each, pages)) for k in range(0, pages, each)]
        return out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        client = self.client()
        for k in range(partition.first, partition.last):
            for r in self._page(client, partition, k):
                long_short = [_number(r.get(c)) for c in LONG_SHORT]
                net = [None if a is None or b is None else a - b for a, b in (long_short[:2], long_short[2:])]
                yield partition.asset, date.fromisoformat(r[DATE][:10]), *net, _number(r.get(INTEREST)), *long_short

    def _page(self, client, p: PageRange, k: int) -> list[dict]:
        """One page, from the cache if it is there, else asked for and kept under its final name once it is whole."""
        ask = lambda: client.page(CODES[p.asset], p.since, p.until, k * self.size, self.size)
        folder = self.options.get("cache")
        if not folder:
            return ask()
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        name = hashlib.sha256(repr((p.asset, p.since, p.until, k, self.size)).encode()).hexdigest()[:16]
        path = f"{root}/{p.asset}-{name}.json"
        if self.options.get("refresh") != "true" and store.get_file_info(path).is_file:
            with store.open_input_stream(path) as f:
                return json.loads(f.read())
        records = ask()
        store.create_dir(root, recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(json.dumps(records).encode())
        store.move(part, path)
        return records


class WeeklyPositions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weekly_positions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WeeklyReader(self.options)
