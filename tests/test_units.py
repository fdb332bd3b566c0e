"""Operators on small hand-made rows."""

import gzip
import json
import math
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as X
from tickloom.functions.tails import chi2_tail, normal_two_sided, t_two_sided
from tickloom.operators import bars as B
from tickloom.operators import contracts as C
from tickloom.operators import cot as K
from tickloom.operators import labels as L
from tickloom.operators import recursive as RC
from tickloom.operators import ruin as R
from tickloom.operators import signals as S
from tickloom.operators import swing as W
from tickloom.operators import ticks as T
from tickloom.sources import files
from tickloom.sources.paged import PagedTicks, walk_back
from tickloom.sources.tables import chunked, numbered, own_rows
from tickloom.streaming.paper import Trader

# ---- functions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def area(density, start, end=400.0, n=400_001):
    """The integral of a density by Simpson's rule."""
    x = np.linspace(start, end, n)
    w = np.where(np.arange(n) % 2, 4.0, 2.0)
    w[[0, -1]] = 1
    return float((w * density(x)).sum() * (end - start) / (n - 1) / 3)


def test_tails_equal_integrals_of_the_densities(spark):
    chi2 = lambda df: lambda x: np.exp((df / 2 - 1) * np.log(x) - x / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
    t = lambda df: lambda x: np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df))
    points = [(x, df) for df in (1, 2, 9, 81, 150) for x in (0.5, 3.0, 8.5, 67.4, 120.0)]
    got = spark.createDataFrame([(i, x, df) for i, (x, df) in enumerate(points)], "i int, x double, df int").select("i", chi2_tail(F.col("x"), F.col("df")).alias("c"), t_two_sided(F.col("x"), F.col("df")).alias("t")).orderBy("i").collect()
    for (x, df), row in zip(points, got):
        assert row.c == pytest.approx(area(chi2(df), x, 900.0), abs=1e-9)
        assert row.t == pytest.approx(1 - 2 * area(t(df), 0.0, x), abs=1e-9)


def test_tails_at_their_edges(spark):
    assert round(one(spark, normal_two_sided(F.lit(-1.959964))), 6) == 0.05
    assert one(spark, chi2_tail(F.lit(None), F.lit(9))) is None and one(spark, chi2_tail(F.lit(3.0), F.lit(0))) is None
    assert one(spark, chi2_tail(F.lit(0.0), F.lit(3))) == 1 and one(spark, t_two_sided(F.lit(0.0), F.lit(5))) == 1
    assert one(spark, chi2_tail(F.lit(5000.0), F.lit(9))) == 0
    # With many degrees of freedom t is as the normal.
    assert one(spark, t_two_sided(F.lit(2.0), F.lit(10**9))) == pytest.approx(math.erfc(math.sqrt(2)), abs=1e-8)


def test_last_digit_rounds_half_to_even(spark):
    assert [one(spark, X.last_digit(F.lit(p), 0)) for p in (0.5, 1.5, 2.5, 13.0)] == [0, 2, 2, 3]


def test_settlement_loses_ties_and_rejects_unknown(spark):
    won = lambda c, b, e, x, d: one(spark, X.settles(F.lit(c), F.lit(b), F.lit(e), F.lit(x), F.lit(d)))
    assert won("CALL", None, 1.0, 1.0, 0) is False and won("PUT", None, 1.0, 1.0, 0) is False
    assert won("DIGITUNDER", 5, 1.0, 1.0, 4) is True and won("DIGITMATCH", 5, 1.0, 1.0, 4) is False
    with pytest.raises(Exception, match="no such contract"):
        won("NONE", None, 1.0, 1.0, 0)


def test_casts_and_clips(spark):
    assert one(spark, X.to_number(F.lit("NaN"))) is None and one(spark, X.to_number(F.lit("x"))) is None
    assert one(spark, X.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None and one(spark, X.clip(F.lit(2.0), 0.0, 1.0)) == 1.0


def test_lots(spark):
    lots = lambda risk, loss: one(spark, X.lots(F.lit(risk), F.lit(loss), F.lit(0.01), F.lit(0.01), F.lit(100.0), F.lit(5.0)))
    assert lots(50.0, 0.0) == 0.0 and lots(50.0, 1.0) == 5.0 and lots(0.001, 1.0) == 0.01


# ---- series


def test_numbered_is_a_row_number(spark):
    rows = [("a", d, k) for k, d in enumerate([3, 1, 1, 2, 3])] + [("b", 9, 9)]
    got = numbered(spark.createDataFrame(rows, "s string, d int, k int"), "s", ["d", "k"], "d").collect()
    assert sorted((r.s, r.d, r.k, r.i) for r in got) == [("a", 1, 1, 0), ("a", 1, 2, 1), ("a", 2, 3, 2), ("a", 3, 0, 3), ("a", 3, 4, 4), ("b", 9, 9, 0)]


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_chunks_do_not_show(spark, size):
    rows = [("a", i, float((i * 7) % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, i long, price double")
    from tickloom.sources.tables import by_chunk

    got = own_rows(chunked(df, "symbol", 2, 1, size).withColumns({"b": F.lag("price", 2).over(by_chunk()), "n": F.lead("price").over(by_chunk())})).orderBy("i").collect()
    assert [r.b for r in got] == [None, None, *[x for *_, x in rows[:-2]]] and [r.n for r in got] == [*[x for *_, x in rows[1:]], None]


def test_waits_across_chunks(spark):
    rows = [("a", i, -1.0 if i in (2, 9) else 1.0, 0.0) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "symbol string, i long, dp double, ret double")
    for size in (3, 1000):
        got = {r.place: r.since for r in T.waits(df, size).where("side = 'down'").collect()}
        assert got == {p: p - (-1 if p <= 1 else 1 if p <= 8 else 8) for p in range(12)}


def test_autocorrelation_by_hand(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0]
    m = sum(x) / 5
    want = sum((a - m) * (b - m) for a, b in zip(x, x[2:])) / sum((a - m) ** 2 for a in x)
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "symbol string, i long, v double")
    assert T.autocorrelation(df, F.col("v"), [2]).first()["r"] == pytest.approx(want)


# ---- contracts


def greedy(mask):
    out, i = [], 1
    while i < len(mask) - 3:
        if mask[i]:
            out.append(i)
            i += 2
        else:
            i += 1
    return out


def test_selection_is_greedy(spark):
    rnd = random.Random(5)
    masks = [[rnd.random() < 0.6 for _ in range(30)] for _ in range(20)]
    rows = [(str(s), "r", i, 30) for s, m in enumerate(masks) for i, x in enumerate(m) if x]
    got = {}
    for r in C.selected(spark.createDataFrame(rows, "symbol string, rule string, i long, ticks long")).collect():
        got.setdefault(r.symbol, []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {str(s): greedy(m) for s, m in enumerate(masks) if greedy(m)}


@pytest.mark.parametrize("step", [2, 5])
@pytest.mark.parametrize("size", [7, 10, 1_000_000])
def test_spacing_in_chunks_and_small_batches(spark, step, size):
    """Runs over several chunks, chunks without a row, several keys in a batch and several batches in a chunk."""
    rnd = random.Random(step)
    masks = {(s, r): [rnd.random() < share for _ in range(60)] for s in "abc" for r, share in (("x", 0.2), ("y", 0.8), ("z", 1.0))}
    rows = spark.createDataFrame([(s, i, r, 60) for (s, r), m in masks.items() for i, x in enumerate(m) if x], "symbol string, i long, rule string, ticks long").cache()
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = C.selected(rows, duration=step - 1, size=size)
        assert found.columns == rows.columns
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
    for (s, r), mask in masks.items():
        want, free = [], 1
        for i in range(min(57, 60 - step)):
            if mask[i] and i >= free:
                want.append(i)
                free = i + step
        assert sorted(x.i for x in got if (x.symbol, x.rule) == (s, r)) == want


def test_long_symbols_are_selected_without_python(spark):
    """Contracts of one tick take every other row of a run: windows alone, as no worker should hold a chunk."""
    rows = spark.createDataFrame([("a", "r", i, 50) for i in range(50)], "symbol string, rule string, i long, ticks long")
    plan = C.selected(rows, size=8)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


def test_rows_of_long_symbols_pass_in_batches(spark):
    """What chooses the rows sees batches, not a symbol's whole chunk."""
    rows = spark.createDataFrame([("a", "r", i, 50) for i in range(50)], "symbol string, rule string, i long, ticks long")
    plan = C.selected(rows, duration=5, size=8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("FlatMapGroupsInPandas") == 1


def test_backtest_against_a_loop(spark):
    rnd = random.Random(3)
    prices = [100 + rnd.randint(0, 999) / 100 for _ in range(300)]
    digits = [int(round(p * 100)) % 10 for p in prices]
    ticks = spark.createDataFrame([("a", i, p) for i, p in enumerate(prices)], "symbol string, i long, price double")
    taken = C.selected(C.signals(C.with_context(T.with_digit(ticks)), list(C.RULES)))
    none = spark.createDataFrame([], "symbol string, contract string, barrier int, payout double")
    got = {r.combo: r for r in C.summary(C.trades(C.look_up(taken, none, C.fallback(spark)))).collect()}
    for name, stake_of in {"even_flat": lambda k: 0.35, "even_martingale": lambda k: 0.35 * 2**k}.items():
        bank, losses, n, i, stop = 10.0, 0, 0, 1, "end"
        while i < len(prices) - 3:
            stake = stake_of(losses)
            if stake > round(bank, 8):
                stop = "unfunded"
                break
            won = digits[i + 2] % 2 == 0
            bank += stake * 0.95 if won else -stake
            losses, n, i = (0 if won else losses + 1), n + 1, i + 2
            if round(bank, 8) < 0.35:
                stop = "ruined"
                break
        assert (got[name].trades, got[name].stop) == (n, stop) and got[name].end == pytest.approx(bank, abs=1e-5)


def test_the_last_quote_counts_and_duration_can_be_a_key(spark):
    q = spark.createDataFrame([("a", "CALL", None, 1, 1.9, 1), ("a", "CALL", None, 5, 1.8, 2)], "symbol string, contract string, barrier int, duration int, payout double, seq int")
    assert C.last_quotes(q, "seq", with_duration=False).first()["payout"] == 1.8
    assert C.last_quotes(q, "seq").count() == 2


# ---- bars


def test_mean_with_gaps():
    m = RC.Ewm(1 / 14)
    got = [m.step(x) for x in (None, 1.0, None, None, 4.0, 2.0)]
    assert got[:4] == [None, 1.0, 1.0, 1.0] and got[4:] == pytest.approx([1.2457166736, 1.2995940541])


def bars_of(spark, rows):
    full = [("a", f"2024-01-{i + 1:02d}", o, h, low, c, 1.0, i) for i, (o, h, low, c) in enumerate(rows)]
    return spark.createDataFrame(full, "symbol string, date string, open double, high double, low double, close double, volume double, i long").withColumn("date", F.to_date("date"))


def test_constant_series(spark):
    r = RC.recursive(bars_of(spark, [(5.0, 5.0, 5.0, 5.0)] * 10)).orderBy("i").collect()
    assert {x.rsi for x in r} == {50.0} and {x.adx for x in r} == {0.0}
    # Bands that meet count as the lower one.
    assert [x.st_dir for x in r] == [-1] + [1] * 9


@pytest.mark.parametrize("size", [1, 7, 64])
def test_chunks_hand_on_what_one_pass_has(spark, size):
    rnd, rows = random.Random(size), []
    for s in ("a", "b"):
        close, flat = 100.0, 0
        for i in range(200 if s == "a" else 64):
            flat = flat - 1 if flat else rnd.choice([0] * 30 + [5])
            close = close if flat else round(close + rnd.choice([-3, -1, 0, 0.5, 1, 4]), 1)
            high, low = (close, close) if flat else (close + rnd.randint(0, 2), close - rnd.randint(0, 2))
            rows.append((s, f"2024-01-01 00:00:{i % 60:02d}", close, high, low, close, 1.0, i))
    df = spark.createDataFrame(rows, "symbol string, date string, open double, high double, low double, close double, volume double, i long").withColumn("date", F.to_timestamp("date"))
    whole, parts = (RC.recursive(df, size=n).orderBy("symbol", "i").toPandas() for n in (1000, size))
    pd.testing.assert_frame_equal(whole, parts, rtol=1e-9)
    assert set(whole.st_dir) == {-1, 1} and len(whole) == 264


def test_a_band_is_kept_or_replaced_as_step_by_step():
    rnd = random.Random(1)
    for _ in range(300):
        bars = [(rnd.randint(0, 9) / 2, rnd.randint(0, 9) / 2 - 2) for _ in range(rnd.randint(1, 8))]
        m = RC.BandMap()
        for band, close in bars:
            m.step(band, close)
        for start in [x / 4 for x in range(-12, 24)] + [math.inf]:
            now = start
            for band, close in bars:
                now = band if now > band or now < close else now
            assert RC.after_band(m.numbers(), start) == now, (bars, start)


def test_supertrend_flips_up():
    s = RC.SuperTrend(1.0)
    got = [s.step(c + 1, c - 1, c, 2.0)[1] for c in (10.0, 10.0, 20.0, 21.0, 5.0)]
    assert got == [-1, -1, 1, 1, -1]


def test_clean_keeps_the_last_good_row_of_a_day(spark):
    rows = [("a", 1, "2024-01-02 09:00:00", "1", "2", "1", "2"), ("a", 2, "2024-01-02 17:00:00", "1", "0.5", "1", "2"), ("a", 3, "2024-01-03", "1", "3", "1", "2"), ("a", 4, "2024-01-03", "2", "3", "1", "2"), ("a", 5, "x", "2", "3", "1", "2"), ("a", 6, "2024-01-04", "-1", "3", "1", "2")]
    got = B.clean(spark.createDataFrame(rows, "symbol string, seq int, time string, open string, high string, low string, close string")).orderBy("date").collect()
    assert [(str(r.date), r.open, r.volume) for r in got] == [("2024-01-02", 1.0, 0.0), ("2024-01-03", 2.0, 0.0)]


def test_signals_do_not_look_ahead(spark):
    rnd = random.Random(2)
    price, rows = 100.0, []
    for i in range(160):
        o, price = price, price + rnd.gauss(0.2, 1)
        rows.append(("a", i, o, max(o, price) + 0.5, min(o, price) - 0.5, price, 1.0))
    schema = "symbol string, i long, open double, high double, low double, close double, volume double"
    df = spark.createDataFrame(rows, schema).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i").cast("int")))
    cols = ["i", "regime", "long_signal", "short_signal", "st_dir"]
    whole = [tuple(r) for r in S.frame(df).where("i < 130").select(*cols).orderBy("i").collect()]
    part = [tuple(r) for r in S.frame(df.where("i < 130")).select(*cols).orderBy("i").collect()]
    assert whole == part


# ---- as-of and positions


def test_as_of_matches_null_values(spark):
    left = spark.createDataFrame([("p", f"2024-01-0{d}") for d in (1, 2, 3)], "pair string, date string").withColumn("date", F.to_date("date"))
    right = spark.createDataFrame([("p", "2024-01-01", 5.0), ("p", "2024-01-02", None)], "pair string, pub string, v double").withColumn("pub", F.to_date("pub"))
    got = K.as_of(left, right, "pair", "date", "pub", "v", "out").orderBy("date").collect()
    assert [r.out for r in got] == [5.0, None, None]


def test_as_of_across_years_and_before_the_first(spark):
    left = spark.createDataFrame([("p", "2023-12-30"), ("p", "2026-01-02")], "pair string, date string").withColumn("date", F.to_date("date"))
    right = spark.createDataFrame([("p", "2023-12-31", 7.0)], "pair string, pub string, v double").withColumn("pub", F.to_date("pub"))
    assert [r.out for r in K.as_of(left, right, "pair", "date", "pub", "v", "out").orderBy("date").collect()] == [None, 7.0]


# ---- the swing simulator


def bar(date, o, h, low, c, atr=1.0, regime=1, long_signal=False, short_signal=False, bias=0.0):
    return SimpleNamespace(date=date, open=o, high=h, low=low, close=c, atr=atr, regime=regime, long_signal=long_signal, short_signal=short_signal, bias=bias)


def run(bars, **rules):
    account = W.Account(S.SwingRules(**{"trail_atr": 0.0, "breakeven_r": 0.0, **rules}), W.Costs(0.0, 0.0, 0.0), 10_000.0, 0.01, 50.0)
    return W.simulate(bars, account)


START = [bar(0, 100, 101, 99, 100, long_signal=True), bar(1, 100, 101, 99.5, 100)]


@pytest.mark.parametrize(
    "reason, price, last, rules",
    [
        ("gap_stop", 97.0, bar(2, 97, 98, 96, 97), {}),
        ("stop", 98.0, bar(2, 100, 106, 98, 100), {}),
        ("target", 105.0, bar(2, 100, 105, 99, 100), {}),
        ("time", 100.5, bar(2, 100, 101, 99, 100.5), {"time_bars": 1}),
        ("flip", 100.5, bar(2, 100, 101, 99, 100.5, regime=-1), {}),
    ],
)
def test_exits(reason, price, last, rules):
    (trade,), _ = run([*START, last, bar(3, 100, 101, 99, 100)], **rules)
    assert (trade["reason"], trade["exit"], trade["entry_date"]) == (reason, price, 1)


def test_breakeven_distance_shrinks_with_the_stop():
    """The trail lifts the stop to 98.9, so 1.1 points of gain are one distance and the stop goes to the entry."""
    bars = [*START, bar(2, 100.5, 101.9, 100.2, 101.5), bar(3, 101, 101.5, 99.9, 100)]
    (trade,), _ = run(bars, trail_atr=3.0, breakeven_r=1.0)
    assert trade["reason"] == "stop" and trade["exit"] == 100.0


def test_an_open_trade_is_marked_a_bar_early():
    _, marks = run([bar(0, 100, 101, 99, 102, long_signal=True), bar(1, 100, 101, 99.5, 100)])
    assert marks[0] > 10_000.0


def test_short_side_and_bias():
    bars = [bar(0, 100, 101, 99, 100, regime=-1, short_signal=True, bias=1.0), bar(1, 100, 100.5, 99, 100, regime=-1), bar(2, 100, 100, 95, 96, regime=-1)]
    (trade,), _ = run(bars)
    assert (trade["direction"], trade["reason"], trade["exit"]) == (-1, "target", 95.0)
    assert run(bars, use_cot=True)[0] == []


def test_split_shares_the_cut_bar(spark):
    got = W.split(bars_of(spark, [(1.0, 1.0, 1.0, 1.0)] * 10)).groupBy("part").agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert sorted((r.part, r.n, r.a, r.b) for r in got) == [("is", 7, 0, 6), ("oos", 4, 6, 9)]


# ---- labels


def test_fold_sizes(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20)], "symbol string, i int").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")))
    got = L.folds(rows, 5, 1, 3).groupBy("fold").agg(F.count("*").alias("n"), F.min("train_end").alias("e")).orderBy("fold").collect()
    assert [r.n for r in got] == [4, 4, 3, 3, 3, 3] and [r.e for r in got] == [None, 3, 7, 10, 13, 16]


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "p double, win int")
    assert L.auc(rows).first()["auc"] == pytest.approx(3.5 / 4)


# ---- ruin


@pytest.mark.parametrize("kind", ["", "_reference"])
def test_the_full_ruin_queries_have_every_path_of_the_reference(spark, kind):
    from tickloom.plans.research_queries import QUERIES

    got = QUERIES["ruin_paths_full" + kind](spark, "")
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {c[0]: 200_000 for c in R.SCENARIOS}
    # Those that SQL checks are among them.
    few = QUERIES["ruin_paths" + kind](spark, "").where("path < 20")
    assert sorted(map(tuple, got.where("path < 20").collect())) == sorted(map(tuple, few.collect()))


def test_day_odds(spark):
    got = {r.label: round(r.p_win, 4) for r in R.day_odds(R.scenarios(spark)).collect()}
    assert got == {"even_week": 0.875, "even_month": 0.875, "rise_month": 0.865, "differs_month": 0.9, "even_month_50": 0.9688}


def test_ruin_in_a_week_against_its_odds(spark):
    n = 20_000
    got = R.summary(R.paths(R.scenarios(spark, R.SCENARIOS[:1]), n)).first()
    want = 1 - 0.875**7
    assert abs(got.p_ruin_week - want) < 4 * math.sqrt(want * (1 - want) / n)
    # Losses taken twice ruin more.
    assert R.summary(R.paths(R.scenarios(spark, R.SCENARIOS[:1]), n, "reference")).first().p_ruin_week >= got.p_ruin_week


# ---- the trader and the sources


def test_trader_settles_two_ticks_later():
    t = Trader(strategy="even", k=1)
    rows = [t.tick(i, 1.0 + i / 100, {"DIGITEVEN": 1.95}) for i in range(8)]
    assert [r["i"] for r in rows if r] == [5, 7] and t.pending["exit"] == 10


def test_trader_stops_when_unfunded():
    t = Trader(strategy="even", k=0, bankroll=1.0, martingale=True)
    rows = [r for i in range(12) if (r := t.tick(i, 1.01, {}))]
    assert [r["status"] for r in rows] == ["unfunded"] and t.tick(99, 1.01, {}) is None


def test_tick_files(spark, tmp_path):
    with gzip.open(tmp_path / "AB.json.gz", "wt") as f:
        json.dump([[10, 1.5], [11, 1.6], [11, 1.7]], f)
    got = files.read_ticks(spark, str(tmp_path)).orderBy("i").collect()
    assert [tuple(r) for r in got] == [("AB", 0, 10, 1.5), ("AB", 1, 11, 1.6), ("AB", 2, 11, 1.7)]
    kept = files.drop_repeated(files.read_ticks(spark, str(tmp_path)))
    files.write_ticks(kept, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).orderBy("epoch").select("epoch", "price").collect() == [(10, 1.5), (11, 1.6)]


def test_quote_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"symbol": "A", "contract": "DIGITOVER", "params": {"barrier": "3", "duration": 1, "duration_unit": "t"}, "true_p": 0.6, "payout": 1.6, "ev_per_$1": 0.1}, {"symbol": "A", "contract": "CALL", "params": {"duration": 5}, "error": "x"}]))
    got = files.read_quotes(spark, str(tmp_path / "q.json")).collect()
    assert [(r.contract, r.barrier, r.duration, r.payout) for r in got] == [("DIGITOVER", 3, 1, 1.6)]


def test_bar_files(spark, tmp_path):
    (tmp_path / "eurusd.csv").write_text("<DATE>;<OPEN>;<HIGH>;<LOW>;<CLOSE>;<TICKVOL>\n2024-01-02;1.1;1.2;1.0;1.15;7\n")
    assert files.separator(spark, str(tmp_path)) == ";"
    (row,) = B.clean(files.read_bars(spark, str(tmp_path))).collect()
    assert (row.symbol, str(row.date), row.close, row.volume) == ("EURUSD", "2024-01-02", 1.15, 7.0)
    assert [r.symbol for r in files.symbols(spark, str(tmp_path)).collect()] == ["eurusd"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("date,open\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="high, low, close"):
        files.read_bars(spark, str(tmp_path / "bad"))


def pages(symbol, end, count):
    newest = 100 if end is None else end
    return [[t, float(t)] for t in range(max(1, newest - count + 1), newest + 1)]


def test_paging():
    assert [t for t, _ in walk_back(pages, "A", 25, 10)] == list(range(76, 101))
    assert walk_back(lambda *a: [], "A", 5, 5) == []
    assert [t for t, _ in walk_back(lambda s, e, c: [[7, 1.0]], "A", 5, 5)] == [7]


def test_paged_source(spark):
    spark.dataSource.register(PagedTicks)
    df = spark.read.format("paged_ticks").options(symbols="A,B", client="tests.test_units:pages", target="12", page="5", pause="0").load()
    assert df.groupBy("symbol").count().orderBy("symbol").collect() == [("A", 12), ("B", 12)]


# ---- backtests of any duration, in chunks, and trade by trade


def backtest_by_hand(prices, digits, rule, stake_of, payout, bankroll=10.0, base=0.35, duration=1, cooldown=0, stop_at_ruin=True):
    """One tick after another: (i, won, stake, bankroll after) of every trade."""
    money, losses, wins, last, out, i = bankroll, 0, 0, -(10**9), [], 1
    while i < len(prices) - 3:
        if i - last <= cooldown or not rule(i):
            i += 1
            continue
        stake = max(base, stake_of(money, losses, wins, base))
        if stake > money:
            if stop_at_ruin:
                break
            stake = money
        end = i + 1 + duration
        if end >= len(prices):
            break
        won = digits[end] % 2 == 0
        money = round(money + (stake * (payout - 1) if won else -stake), 8)
        losses, wins = (0, wins + 1) if won else (losses + 1, 0)
        out.append((i, won, stake, money))
        last = i
        if money < base and stop_at_ruin:
            break
        i = end
    return out


@pytest.mark.parametrize("duration, cooldown, size", [(1, 0, 1_000_000), (1, 0, 13), (5, 0, 11), (1, 7, 16)])
@pytest.mark.parametrize("stake", ["flat", "martingale", "anti_martingale"])
def test_backtests_in_chunks_against_a_loop(spark, duration, cooldown, size, stake):
    rnd = random.Random(duration * 100 + cooldown)
    prices = [100 + rnd.randrange(1000) / 100 for _ in range(160)]
    ticks = spark.createDataFrame([("a", i, p, int(round(p * 100)) % 10) for i, p in enumerate(prices)], "symbol string, i long, price double, digit int")
    digits = [int(round(p * 100)) % 10 for p in prices]
    for rule, fires in (("even", lambda i: True), ("gambler_even", lambda i: digits[i] <= 2)):
        found = C.signals(C.with_context(ticks, duration=duration), ["even"]).where(F.lit(True) if rule == "even" else F.col("i").isin([i for i in range(160) if digits[i] <= 2]))
        taken = C.selected(found, duration, cooldown, size).withColumn("payout", F.lit(1.95))
        got = C.equity(C.trades(taken, [("x", "even", stake)], size=size)).orderBy("k").collect()
        want = backtest_by_hand(prices, digits, fires, C.LIVE_STAKES[stake], 1.95, duration=duration, cooldown=cooldown)
        assert [(r.i, r.won, r.stake, r.after) for r in got] == want
        assert [r.peak for r in got] == np.maximum.accumulate([10.0, *(w[3] for w in want)])[1:].tolist()
        turn = C.trades_in_turn(taken, [("x", "even", stake)]).where("not _cut").orderBy("k").collect()
        assert [(r.i, r.won, r.stake, r.after) for r in turn] == want


def test_an_account_that_goes_on(spark):
    rnd = random.Random(5)
    prices = [100 + rnd.randrange(1000) / 100 for _ in range(300)]
    digits = [int(round(p * 100)) % 10 for p in prices]
    ticks = spark.createDataFrame([("a", i, p, d) for i, (p, d) in enumerate(zip(prices, digits))], "symbol string, i long, price double, digit int")
    taken = C.selected(C.signals(C.with_context(ticks), ["even"])).withColumn("payout", F.lit(1.95))
    for stake in ("martingale", "tenth"):
        got = C.trades_in_turn(taken, [("x", "even", stake)], stop_at_ruin=False).orderBy("k").collect()
        want = backtest_by_hand(prices, digits, lambda i: True, C.LIVE_STAKES[stake], 1.95, stop_at_ruin=False)
        assert [(r.i, r.won) for r in got] == [w[:2] for w in want]
        # The operator rounds each gain to 1e-8 as well as the account.
        assert np.allclose([(r.stake, r.after) for r in got], [w[2:] for w in want], atol=1e-5)


def test_the_stake_that_never_grows(spark):
    """The zero-edge stake is the base, whatever came before."""
    rows = spark.createDataFrame([(3, 0), (0, 2)], "losses_before int, wins_before int")
    assert {r.s for r in rows.select(C.STAKES["kelly_zero"](0.35).alias("s")).collect()} == {0.35}


def test_verdict_against_pandas(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["XAUUSD", "B"]), round(rnd.random(), 2), rnd.gauss(0, 1)) for _ in range(200)]
    pdf = pd.DataFrame(rows, columns=["symbol", "p", "r"])
    pdf["win"] = (pdf.r > 0).astype(int)
    got = L.verdict(spark.createDataFrame(pdf)).first()
    w, l = pdf[pdf.win == 1].p.to_numpy(), pdf[pdf.win == 0].p.to_numpy()
    auc = ((w[:, None] > l).sum() + (w[:, None] == l).sum() / 2) / (len(w) * len(l))
    top = pdf[pdf.p >= np.percentile(pdf.p, 70)].r.mean() - pdf.r.mean()
    gold = pdf[pdf.symbol == "XAUUSD"]
    gain = gold[gold.p >= np.percentile(gold.p, 50)].r.mean() - gold.r.mean()
    assert (got.n, got.gold_n) == (200, len(gold)) and got.skilled == (auc >= 0.52 and top > 0.02)
    assert np.allclose([got.auc, got.top30_gain, got.gold_gain], [auc, top, gain])
    few = L.verdict(spark.createDataFrame(pdf.assign(symbol="B"))).first()
    assert few.gold_n == 0 and few.gold_gain is None


def test_confirmed_level_is_carried_over_chunks(spark):
    flags, prices = {2, 11, 12, 30}, [float(p) for p in np.random.default_rng(5).integers(1, 99, 40)]
    rows = [("a", i, i in flags, prices[i]) for i in range(40)] + [("b", i, False, prices[i]) for i in range(9)]
    frame = spark.createDataFrame(rows, "symbol string, i long, flag boolean, price double")
    last, want = None, []
    for i, price in enumerate(prices):
        last = price if i - 3 in flags else last
        want.append(last)
    for size in (4, 7, 1000):
        got = B.confirmed_level(frame, "flag", "price", 3, size).orderBy("symbol", "i").collect()
        assert [r.level for r in got if r.symbol == "a"] == want
        assert [r.level for r in got if r.symbol == "b"] == [None] * 9
