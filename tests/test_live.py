"""Live sources, quotes with a time to live, paging and report sinks, each with a client that stands in for the service."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.sources.live import LiveTicks
from tickloom.streaming import paper, quoted

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prices(n, seed=3):
    import random

    rnd = random.Random(seed)
    return [100 + rnd.randrange(1000) / 100 for _ in range(n)]


def record(folder, symbol, values, noise=True):
    (folder / f"symbol={symbol}").mkdir(parents=True)
    lines = []
    for k, p in enumerate(values):
        lines.append(json.dumps({"msg_type": "tick", "tick": {"quote": p, "epoch": 1000 + k}}))
        if noise and k % 5 == 0:
            lines.append(json.dumps({"msg_type": "ping"}))
    for k in range(0, len(lines), 40):
        (folder / f"symbol={symbol}" / f"part-{k:05}").write_text("\n".join(lines[k : k + 40]) + "\n")


def drain(df, out, log, mode="append"):
    df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log)).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def test_a_restart_in_the_middle_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(LiveTicks)
    for s in ("A", "B"):
        record(tmp_path / "feed", s, prices(150, ord(s)))
    source = lambda upto: spark.readStream.format("live_ticks").options(symbols="A,B", client="tickloom.sources.live:recorded", feed=str(tmp_path / "feed"), upto=str(upto), batch="50").load()
    for upto in (70, 10_000):
        drain(source(upto), tmp_path / "out", tmp_path / "log")
        drain(paper.paper_stream(source(upto), {"DIGITEVEN": 1.95}, strategy="even"), tmp_path / "ledger", tmp_path / "log2")
    got = spark.read.parquet(str(tmp_path / "out"))
    for s in ("A", "B"):
        assert [r.price for r in got.where(F.col("symbol") == s).orderBy("i").collect()] == prices(150, ord(s))
    want = paper.paper_batch(got.select("symbol", "i", "price"), {"DIGITEVEN": 1.95}, strategy="even").orderBy("symbol", "n", "i").toPandas()
    ledger = spark.read.parquet(str(tmp_path / "ledger")).orderBy("symbol", "n", "i").toPandas()
    assert len(ledger) > 20
    pd.testing.assert_frame_equal(ledger, want, check_dtype=False)


def test_a_new_quote_changes_later_payouts_only(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        ticks = spark.createDataFrame([("A", i, p) for i, p in enumerate(prices(60))], "symbol string, i long, price double")
        asked = "symbol string, i long, contract string, barrier int, payout double"
        quotes = spark.createDataFrame([("A", 0, "DIGITEVEN", None, 1.9), ("A", 20, "DIGITEVEN", None, 1.5), ("A", 41, "DIGITEVEN", None, None), ("B", 0, "DIGITEVEN", None, 9.0)], asked)
        for a, b in ((0, 15), (15, 30), (30, 60)):
            ticks.where(F.col("i").between(a, b - 1)).write.mode("append").parquet(str(tmp_path / "ticks"))
            quotes.where(F.col("i").between(a, b - 1)).write.mode("append").parquet(str(tmp_path / "quotes"))
            stream = quoted.quoted_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")), spark.readStream.schema(asked).parquet(str(tmp_path / "quotes")), strategy="even")
            drain(stream, tmp_path / "out", tmp_path / "log")
        got = {r.i: r.payout for r in spark.read.parquet(str(tmp_path / "out")).where("symbol = 'A'").collect()}
        assert len(got) > 20
        # A contract that settles at i was decided at i - 2.
        assert got == {i: 1.9 if i - 2 < 20 else 1.5 if i - 2 < 41 else 1.0 for i in got}
        assert set(got.values()) == {1.9, 1.5, 1.0}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def settled_up_to(spark, out):
    """The last place that the ledger in ``out`` holds."""
    try:
        return spark.read.parquet(str(out)).agg(F.max("i")).first()[0] or 0
    except Exception:  # nothing written yet
        return 0


def test_quotes_grow_old(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        ticks = spark.createDataFrame([("A", i, p) for i, p in enumerate(prices(30))], "symbol string, i long, price double")
        asked = "symbol string, i long, contract string, barrier int, payout double"
        spark.createDataFrame([("A", 0, "DIGITEVEN", None, 1.9)], asked).write.parquet(str(tmp_path / "quotes"))
        ticks.where("i < 15").write.parquet(str(tmp_path / "ticks"))
        stream = quoted.quoted_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")), spark.readStream.schema(asked).parquet(str(tmp_path / "quotes")), ttl_ms=3000, strategy="even")
        # Time goes on without data, so this query does not end by itself.
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="1 second").start()
        waited = time.monotonic()
        for part in ("i < 15", "i >= 15"):
            if part != "i < 15":
                time.sleep(5)
                ticks.where(part).write.mode("append").parquet(str(tmp_path / "ticks"))
            while time.monotonic() - waited < 60 and settled_up_to(spark, tmp_path / "out") < (13 if part == "i < 15" else 27):
                time.sleep(1)
        query.stop()
        got = {r.i: r.payout for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert {p for i, p in got.items() if i - 2 >= 16} == {1.0} and {p for i, p in got.items() if i < 15} == {1.9}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


# ---- weekly positions by pages

ASKED = "asked.log"


class Weekly:
    """Ten years of weeks for three assets; every request is written down."""

    def __init__(self, options):
        self.log = options["log"]

    def _rows(self, code, since, until):
        from datetime import date, timedelta

        start = date(2010, 1, 5)
        rows = [{"report_date_as_yyyy_mm_dd": f"{start + timedelta(7 * k)}T00:00:00.000", "comm_positions_long_all": str(k), "comm_positions_short_all": "2", "noncomm_positions_long_all": str(int(code) % 1000), "noncomm_positions_short_all": "n/a" if k == 3 else str(k), "open_interest_all": str(10 * k)} for k in range(520)]
        return [r for r in rows if (since or "") <= r["report_date_as_yyyy_mm_dd"][:10] <= (until or "9")]

    def count(self, code, since, until):
        return len(self._rows(code, since, until)) if code in ("088691", "099741", "098662") else 0

    def page(self, code, since, until, offset, limit):
        with open(self.log, "a") as f:
            f.write(f"{code} {since} {until} {offset}\n")
        return self._rows(code, since, until)[offset : offset + limit]


def weekly_client(options):
    return Weekly(options)


def test_weekly_pages_filters_and_cache(spark, tmp_path):
    from tickloom.sources.weekly import CODES, PAIR_SCHEMA, PAIRS, WeeklyPositions

    spark.dataSource.register(WeeklyPositions)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    log = tmp_path / "asked.log"
    read = lambda **more: spark.read.format("weekly_positions").options(client="tests.test_live:weekly_client", log=str(log), page="100", pages="2", cache=str(tmp_path / "cache"), **more).load()
    asked = lambda: log.read_text().splitlines() if log.exists() else []
    whole = read()
    assert whole.groupBy("asset").count().orderBy("asset").collect() == [("DXY", 520), ("EUR", 520), ("GOLD", 520)]
    assert len(asked()) == 3 * 6 and whole.rdd.getNumPartitions() == 3 * 3
    assert whole.where("open_interest = 30").select("comm_net", "noncomm_net").distinct().collect() == [(1.0, None)]
    before = len(asked())
    assert read().count() == 3 * 520 and len(asked()) == before  # every page was kept
    some = read().where("asset in ('EUR', 'JPY') and date >= '2019-01-01' and date < '2019-03-01' and comm_net > 0")
    assert some.count() == 9
    new = asked()[before:]
    assert {n.split(" ")[0] for n in new} == {CODES["EUR"]} and {tuple(n.split(" ")[1:3]) for n in new} == {("2019-01-01", "2019-02-28")}
    assert read(refresh="true").where("asset = 'GOLD'").count() == 520 and len(asked()) > before + len(new)
    assert spark.createDataFrame(PAIRS, PAIR_SCHEMA).count() == 12 == len(CODES)


# ---- quotes with pauses


def moody(symbol, contract, barrier, duration):
    from tickloom.sources.asked import RateLimited

    if symbol == "LIMITED":
        raise RateLimited("rate limit reached")
    if contract == "PUT":
        raise ValueError("not offered")
    return 1.9 + (barrier or 0) / 10


def test_asked_quotes(spark, tmp_path):
    from tickloom.sources import files
    from tickloom.sources.asked import RateLimited, ask_quotes, patient, quote_records
    from tickloom.sources.reports import ReportFile

    jobs = spark.createDataFrame([("A", "DIGITOVER", 3, 1), ("A", "CALL", None, 5), ("A", "PUT", None, 1), ("LIMITED", "CALL", None, 1)], "symbol string, contract string, barrier int, duration int")
    got = {(r.symbol, r.contract): r for r in ask_quotes(jobs, "tests.test_live:moody", pause=0.0, tasks=2).collect()}
    assert got["A", "DIGITOVER"].payout == pytest.approx(2.2) and got["A", "DIGITOVER"].true_p == 0.6 and got["A", "DIGITOVER"].ev == pytest.approx(0.32)
    assert got["A", "CALL"].tries == 1 and got["A", "CALL"].true_p is None
    assert (got["A", "PUT"].payout, got["A", "PUT"].error, got["A", "PUT"].tries) == (None, "not offered", 1)
    assert (got["LIMITED", "CALL"].payout, got["LIMITED", "CALL"].tries) == (None, 6) and "rate limit" in got["LIMITED", "CALL"].error
    pauses, left = [], [2]

    def twice():
        left[0] -= 1
        if left[0] >= 0:
            raise RateLimited()
        return 1.5

    assert patient(twice, 6, 2.5, pauses.append) == (1.5, None, 3) and pauses == [2.5, 5.0]
    # What is asked can be written as one array and read again.
    spark.dataSource.register(ReportFile)
    path = tmp_path / "quotes.json"
    quote_records(ask_quotes(jobs, "tests.test_live:moody", pause=0.0)).write.format("report_file").mode("overwrite").options(path=str(path), kind="json").save()
    assert len(json.loads(path.read_text())) == 4
    read = files.read_quotes(spark, str(path)).collect()
    assert sorted((r.contract, r.barrier, r.duration, r.payout) for r in read) == [("CALL", None, 5, 1.9), ("DIGITOVER", 3, 1, pytest.approx(2.2))]


# ---- reports


def test_a_report_is_whole_or_not_there(spark, tmp_path):
    from tickloom.sources.reports import ReportFile

    spark.dataSource.register(ReportFile)
    rows = spark.range(20).selectExpr("id", "if(id = 3, 'a|b', null) name", "id / 4 x").repartitionByRange(4, "id").sortWithinPartitions("id")
    table, array = tmp_path / "r.md", tmp_path / "r.json"
    rows.write.format("report_file").mode("overwrite").options(path=str(table), kind="markdown", title="Edges").save()
    lines = table.read_text().splitlines()
    assert lines[:4] == ["# Edges", "", "| id | name | x |", "|---|---|---|"] and lines[7] == "| 3 | a\\|b | 0.75 |" and len(lines) == 24
    rows.write.format("report_file").mode("overwrite").options(path=str(array), kind="json").save()
    assert [r["id"] for r in json.loads(array.read_text())] == list(range(20))
    rows.where("id < 0").write.format("report_file").mode("overwrite").options(path=str(tmp_path / "e.json"), kind="json").save()
    assert json.loads((tmp_path / "e.json").read_text()) == []
    before = table.read_text()
    bad = rows.selectExpr("if(id = 17, cast(raise_error('broken') as long), id) id", "name", "x")
    with pytest.raises(Exception, match="broken"):
        bad.write.format("report_file").mode("overwrite").options(path=str(table), kind="markdown").save()
    assert table.read_text() == before and sorted(p.name for p in tmp_path.iterdir()) == ["e.json", "r.json", "r.md"]
    with pytest.raises(Exception, match="there already"):
        rows.write.format("report_file").mode("append").options(path=str(table), kind="markdown").save()


# ---- alerts, text reports, cached files, every strategy


def test_alerts_send_signals_only(spark, tmp_path):
    from tickloom.streaming.bars import alerts

    rows = spark.createDataFrame([("A", True, False), ("B", False, False), ("C", False, True)], "symbol string, long_signal boolean, short_signal boolean")
    rows.write.parquet(str(tmp_path / "feed"))
    sent = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "feed"))
    alerts(stream, lambda df, batch: sent.extend(r.symbol for r in df.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(sent) == ["A", "C"]


def test_text_reports_and_cached_weeks(spark, tmp_path):
    from tickloom.sources import files

    rows = spark.createDataFrame([("A", 3, 0.5)], "symbol string, n int, share double")
    files.write_report(rows, "%s: %d of them, %.1f", ["symbol", "n", "share"], str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["A: 3 of them, 0.5"]
    (tmp_path / "GOLD.csv").write_text("date,comm_net,noncomm_net,open_interest\n2024-01-02,5,-3.5,100\nx,1,n/a,2\n")
    got = files.read_cot(spark, str(tmp_path / "GOLD.csv")).orderBy("open_interest").collect()
    assert [(r.asset, str(r.date), r.comm_net, r.noncomm_net) for r in got] == [("GOLD", "None", 1.0, None), ("GOLD", "2024-01-02", 5.0, -3.5)]


def test_each_bar_file_has_its_own_separator(spark, tmp_path):
    from tickloom.operators.bars import clean
    from tickloom.sources import files

    (tmp_path / "aaa.csv").write_text("Date;Open;High;Low;Close;Volume\n2024-01-02;1;2;0.5;1.5;7\n2024-01-02;1;3;0.5;1.6;8\n")
    (tmp_path / "bbb.csv").write_text("close,<LOW>,time,open,high\n5,4,2024-01-03 10:00,4.5,6\n")
    (tmp_path / "ccc.csv").write_text("Date;Open;High;Low;Close;Volume\n2024-01-04;1;1;1;1;1\n")
    assert {files.line_separator(h) for h in files.by_header(spark, str(tmp_path))} == {",", ";"}
    got = clean(files.read_bars(spark, str(tmp_path))).orderBy("symbol").collect()
    assert [(r.symbol, str(r.date), r.high, r.close, r.volume) for r in got] == [("AAA", "2024-01-02", 3.0, 1.6, 8.0), ("BBB", "2024-01-03", 6.0, 5.0, 0.0), ("CCC", "2024-01-04", 1.0, 1.0, 1.0)]
    (tmp_path / "ddd.csv").write_text("date,open,high,low\n")
    with pytest.raises(ValueError, match="no column close"):
        files.read_bars(spark, str(tmp_path))


def by_hand(strategy, values, k=3):
    """What each decided contract is and whether it won, tick by tick, with two decimals until there are fifty."""
    digit = [round(p * 100) % 10 for p in values]
    out, at = [], k + 2
    while at + 2 < len(values):
        moves = [b - a for a, b in zip(values[at - k : at], values[at - k + 1 : at + 1])]
        asked = {"differs": ("DIGITDIFF", digit[at]), "even": ("DIGITEVEN", None), "over0": ("DIGITOVER", 0), "gambler_low": ("DIGITOVER", 3) if digit[at] <= 2 else None, "gambler_match": ("DIGITDIFF", digit[at]) if digit[at] == digit[at - 1] else None, "momentum": ("CALL", None) if min(moves) > 0 else None, "meanrev": ("CALL", None) if max(moves) < 0 else None}[strategy]
        if asked is None:
            at += 1
            continue
        d = digit[at + 2]
        won = {"DIGITDIFF": d != asked[1], "DIGITEVEN": d % 2 == 0, "DIGITOVER": asked[1] is not None and d > asked[1], "CALL": values[at + 2] > values[at]}[asked[0]]
        out.append((*asked, won))
        at += 2
    return out


@pytest.mark.parametrize("strategy", ["differs", "even", "over0", "gambler_low", "gambler_match", "momentum", "meanrev"])
def test_every_strategy_of_the_paper_trader(strategy):
    values = prices(120, 11)
    trader = paper.Trader(strategy=strategy, bankroll=1000.0)
    rows = [r for i, p in enumerate(values) if (r := trader.tick(i, p, {}))]
    assert [(r["contract"], r["barrier"], r["won"]) for r in rows] == by_hand(strategy, values) and rows
