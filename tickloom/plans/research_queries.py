"""Queries over positioning, the swing simulator, labels and risk of ruin, and the SQL that checks them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tickloom.operators import cot as K
from tickloom.operators import labels as L
from tickloom.operators import ruin as R
from tickloom.operators import signals as S
from tickloom.operators import swing as W
from tickloom.plans.bar_queries import FRAME
from tickloom.sources.shared import stash
from tickloom.sources.tables import BARS, COT, PAIRS, bar_days, bars, cot, pairs

#: Wide gates: noise rarely passes the usual ones, and labels need signals.
OPEN = S.SwingRules(adx_min=5.0, rank_min=0.0, rank_max=1.0)


def _r(n, *names):
    return [F.round(c, n).alias(c) for c in names]


def cot_net(spark, d):
    return cot(spark, d)


def cot_index(spark, d):
    return K.asset_index(cot(spark, d)).where("idx is not null").select("asset", "date", *_r(6, "idx"))


def _series(spark, d):
    return K.pair_series(cot(spark, d), pairs(spark))


def _daily(spark, d):
    return bar_days(spark, d).withColumnRenamed("symbol", "pair")


def asof_align(spark, d):
    return K.aligned(_daily(spark, d), K.bias_index(_series(spark, d)), "bias", "cot_bias").select("pair", "date", "cot_bias")


def cot_features(spark, d):
    return K.features(_daily(spark, d), cot(spark, d), pairs(spark)).select("pair", "date", *_r(6, "cot_base_idx", "cot_quote_idx"), "cot_bias")


def bias_counts(spark, d):
    return K.bias_user(_series(spark, d)).groupBy("pair", "bias").agg(F.count("*").alias("n"))


def cost_model(spark, d):
    symbols = W.pips(spark).select("symbol").unionByName(bars(spark, d).select("symbol").distinct())
    return W.cost_model(symbols, W.pips(spark)).select("symbol", *_r(9, "pip", "spread", "slippage", "commission"))


def _bias(spark, d):
    return asof_align(spark, d).select(F.col("pair").alias("symbol"), "date", F.col("cot_bias").alias("bias"))


def _variants(spark, d):
    """The whole period without and with the bias, and both parts with it; parts warm up afresh.

    Parts are keyed as symbols of their own, so that one plan makes the signals of all.
    """
    whole = bars(spark, d)
    parts = whole.withColumn("part", F.lit("whole")).unionByName(W.split(whole))
    start = parts.groupBy("symbol", "part").agg(F.min("i").alias("_i"))
    keyed = parts.join(start, ["symbol", "part"]).withColumns({"i": F.col("i") - F.col("_i"), "symbol": F.concat_ws("|", "symbol", "part")}).drop("_i", "part")
    part = F.substring_index("symbol", "|", -1)
    runs = F.when(part == "whole", F.array(F.lit("base"), F.lit("cot"))).otherwise(F.array(part))
    rows = S.frame(keyed, OPEN).withColumn("variant", F.explode(runs)).withColumn("symbol", F.substring_index("symbol", "|", 1))
    rows = rows.join(_bias(spark, d), ["symbol", "date"], "left").withColumn("bias", F.when(F.col("variant") == "base", 0.0).otherwise(F.coalesce("bias", F.lit(0.0))))
    costs = W.cost_model(whole.select("symbol").distinct(), W.pips(spark)).drop("pip")
    # Reports read the trades and the equity: the simulation runs once for both.
    return W.backtest(rows.join(costs, "symbol"), OPEN).persist()


def swing_trades(spark, d):
    rows = W.ledger(_variants(spark, d))
    return rows.select("symbol", "variant", "direction", "entry_date", *_r(3, "entry", "stop", "take"), *_r(9, "units"), *_r(3, "init_risk"), "exit_date", *_r(3, "exit"), "reason", *_r(5, "pnl", "r_multiple"), "bars_held", *_r(4, "equity_after"))


def swing_equity(spark, d):
    return W.equities(_variants(spark, d)).select("symbol", "variant", "date", *_r(4, "equity"))


def swing_metrics(spark, d):
    rows = W.metrics(_variants(spark, d)).withColumn("profit_factor", F.coalesce("profit_factor", F.lit(-1.0)))
    return rows.select("symbol", "variant", "trades", *_r(5, "net", "ret_pct", "cagr", "sharpe", "max_dd", "win_rate", "profit_factor", "expectancy_r", "avg_bars"))


def swing_rollup(spark, d):
    return W.rollup(W.metrics(_variants(spark, d))).select("variant", *_r(5, "mean_return", "median_return"), "profitable", "symbols")


def is_oos_split(spark, d):
    return W.split(bars(spark, d)).groupBy("symbol", "part").agg(F.count("*").alias("bars"), F.min("date").alias("first"), F.max("date").alias("last"))


def portfolio(spark, d):
    return W.portfolio(_variants(spark, d)).select("variant", "date", *_r(8, "value", "drawdown"))


def portfolio_sharpe(spark, d):
    return W.portfolio_sharpe(W.portfolio(_variants(spark, d))).select("variant", "days", *_r(5, "sharpe"))


def _labelled(spark, d):
    return L.triple_barrier(S.frame(bars(spark, d), OPEN), OPEN)


def entry_modes(spark, d):
    """The signals of each entry mode, with wide gates."""
    of = lambda mode: S.frame(bars(spark, d), replace(OPEN, entry=mode)).where("long_signal or short_signal").select(F.lit(mode).alias("mode"), "symbol", "date", "long_signal", "short_signal")
    return of("either").unionByName(of("pullback")).unionByName(of("breakout"))


def triple_barrier(spark, d):
    return _labelled(spark, d).select("symbol", "date", "direction", *_r(6, "r"), "win")


def label_features(spark, d):
    """What a learner sees of each signal besides the positioning."""
    return _labelled(spark, d).select("symbol", "date", "direction", *_r(6, "adx", "rsi", "trend_ext", "pull_ext", "ret5", "ret20"), F.col("dow").cast("long").alias("dow"), "is_metal")


def _folded(spark, d):
    """The samples with all features in their folds; written once, as folds and learners read them several times."""
    known = K.features(_daily(spark, d), cot(spark, d), pairs(spark)).withColumnsRenamed({"pair": "symbol", "date": "signal_date"})
    joined = stash(_labelled(spark, d).join(known, ["symbol", "signal_date"]).dropna(subset=L.FEATURES), "samples")
    return L.folds(joined)


def walkforward_folds(spark, d):
    rows = _folded(spark, d)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.coalesce(F.min("train_end"), F.lit(-1)).alias("train_end"))


def _scored(spark, d):
    return _labelled(spark, d).withColumn("p", F.round("atr_pct", 4))


def selectivity(spark, d):
    return L.selectivity(_scored(spark, d)).select("top", "trades", *_r(6, "win_pct", "mean_r", "gain"))


def roc_auc(spark, d):
    return L.auc(_scored(spark, d)).select("n", *_r(6, "auc"))


def model_verdict(spark, d):
    """The verdict on the volatility rank as a score; the third symbol stands for gold."""
    return L.verdict(_scored(spark, d), gold="3-MEDIUM").select("n", *_r(6, "auc", "top30_gain"), "skilled", "gold_n", *_r(6, "gold_gain"))


def _learnt(spark, d):
    """The tested samples with the learned filter's p; written once, as reports read them several times."""
    return stash(L.walk_forward(stash(_folded(spark, d), "folds")), "learnt")


def gbt_walkforward(spark, d):
    return _learnt(spark, d)


def gbt_selectivity(spark, d):
    return L.selectivity(_learnt(spark, d)).select("top", "trades", *_r(6, "win_pct", "mean_r", "gain"))


def gbt_verdict(spark, d):
    """The verdict on the learned filter; the third symbol stands for gold."""
    return L.verdict(_learnt(spark, d), gold="3-MEDIUM").select("n", *_r(6, "auc", "top30_gain"), "skilled", "gold_n", *_r(6, "gold_gain"))


def ruin_day_prob(spark, d):
    return R.day_odds(R.scenarios(spark)).select("label", "losses", *_r(6, "p_lose", "p_win"))


#: Paths of a scenario in the reference; the queries that recursive SQL checks have the first 2000 of them.
ALL_PATHS, SQL_PATHS = 200_000, 2000


def _paths(accounting, n=SQL_PATHS):
    return lambda s, d: R.paths(R.scenarios(s), n, accounting).select("label", "path", *_r(6, "bank"), "ruin_day", "days_won")


def _summary(accounting, n=SQL_PATHS):
    return lambda s, d: R.summary(R.paths(R.scenarios(s), n, accounting)).select("label", "paths", *_r(6, "p_ruin_week", "p_ruin", "median_final", "mean_final", "expected_pl"))


QUERIES = {
    "cot_net": cot_net,
    "cot_index": cot_index,
    "cot_bias_user": lambda s, d: K.bias_user(_series(s, d)),
    "cot_bias_index": lambda s, d: K.bias_index(_series(s, d)),
    "bias_counts": bias_counts,
    "asof_align": asof_align,
    "cot_features": cot_features,
    "cost_model": cost_model,
    "swing_trades": swing_trades,
    "swing_equity": swing_equity,
    "swing_metrics": swing_metrics,
    "swing_rollup": swing_rollup,
    "is_oos_split": is_oos_split,
    "portfolio": portfolio,
    "portfolio_sharpe": portfolio_sharpe,
    "model_verdict": model_verdict,
    "entry_modes": entry_modes,
    "triple_barrier": triple_barrier,
    "label_features": label_features,
    "walkforward_folds": walkforward_folds,
    "selectivity": selectivity,
    "roc_auc": roc_auc,
    "gbt_walkforward": gbt_walkforward,
    "gbt_selectivity": gbt_selectivity,
    "gbt_verdict": gbt_verdict,
    "ruin_day_prob": ruin_day_prob,
    "ruin_paths": _paths("correct"),
    "ruin_paths_reference": _paths("reference"),
    "ruin_summary": _summary("correct"),
    "ruin_summary_reference": _summary("reference"),
    "ruin_paths_full": _paths("correct", ALL_PATHS),
    "ruin_paths_full_reference": _paths("reference", ALL_PATHS),
    "ruin_summary_full": _summary("correct", ALL_PATHS),
    "ruin_summary_full_reference": _summary("reference", ALL_PATHS),
    "ruin_curves": lambda s, d: R.curves(R.scenarios(s)).select("label", "path", "day", *_r(6, "bank")),
}

_IDX = "CASE WHEN count({s}) OVER w = 26 AND max({s}) OVER w > min({s}) OVER w THEN ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END"
WEEKS = f"""{COT}, {PAIRS}, ai AS (SELECT asset, date, {_IDX.format(s="net")} AS idx FROM cot WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 25 PRECEDING)),
ps AS (SELECT pair, b.date, b.net AS base, q.net AS quote FROM pairs JOIN cot b ON b.asset = pairs.base JOIN cot q ON q.asset = pairs.quote AND q.date = b.date),
pi AS (SELECT pair, date, {_IDX.format(s="base")} AS bi, {_IDX.format(s="quote")} AS qi FROM ps WINDOW w AS (PARTITION BY pair ORDER BY date ROWS 25 PRECEDING)),
bu AS (SELECT pair, date, CASE WHEN base > 0 AND quote < 0 THEN 1 WHEN base < 0 AND quote > 0 THEN -1 ELSE 0 END AS bias FROM ps),
bx AS (SELECT pair, date, CASE WHEN bi > 0.65 AND qi < 0.35 THEN 1 WHEN bi < 0.35 AND qi > 0.65 THEN -1 ELSE 0 END AS bias FROM pi),
al AS (SELECT d.symbol AS pair, d.date, coalesce(CAST(x.bias AS DOUBLE), 0) AS cot_bias FROM bars d ASOF LEFT JOIN (SELECT pair, date + 3 AS pub, bias FROM bx) x ON x.pair = d.symbol AND d.date >= x.pub),
cf AS (SELECT al.pair, al.date, al.cot_bias, coalesce(b.idx, 0) AS cot_base_idx FROM al ASOF LEFT JOIN (SELECT pair, date + 3 AS pub, idx FROM pairs JOIN ai ON ai.asset = pairs.base) b ON b.pair = al.pair AND al.date >= b.pub),
cg AS (SELECT cf.*, coalesce(q.idx, 0) AS cot_quote_idx FROM cf ASOF LEFT JOIN (SELECT pair, date + 3 AS pub, idx FROM pairs JOIN ai ON ai.asset = pairs.quote) q ON q.pair = cf.pair AND cf.date >= q.pub)"""
_OPEN_FRAME = FRAME.replace("adx >= 18 AND atr_pct >= 0.05 AND atr_pct <= 0.97", "adx >= 5 AND atr_pct >= 0 AND atr_pct <= 1")
LABELS = f"""{_OPEN_FRAME},
sz AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol),
sg AS (SELECT fr.*, lead(open) OVER w AS entry, lead(date) OVER w AS on_date, n, CASE WHEN long_signal AND regime = 1 THEN 1 WHEN short_signal AND regime = -1 THEN -1 ELSE 0 END AS direction FROM fr JOIN sz USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY i)),
sh AS (SELECT *, 2.0::DOUBLE * atr AS risk, entry - direction * (2.0::DOUBLE * atr) AS stop, entry + direction * 2.5::DOUBLE * (2.0::DOUBLE * atr) AS take FROM sg WHERE direction <> 0 AND i BETWEEN 60 AND n - 3 AND atr > 0),
hit AS (SELECT s.symbol, s.i, min(b.i) FILTER (CASE WHEN direction = 1 THEN b.low <= stop ELSE b.high >= stop END) AS si, min(b.i) FILTER (CASE WHEN direction = 1 THEN b.high >= take ELSE b.low <= take END) AS ti, arg_max(b.close, b.i) AS last
  FROM sh s JOIN bars b ON b.symbol = s.symbol AND b.i BETWEEN s.i + 1 AND s.i + 40 GROUP BY s.symbol, s.i),
lab AS (SELECT symbol, on_date AS date, i, direction, atr_pct, CASE WHEN si IS NOT NULL AND si <= coalesce(ti, si) THEN -1::DOUBLE WHEN ti IS NOT NULL THEN 2.5::DOUBLE ELSE direction * (last - entry) / risk END AS r FROM sh JOIN hit USING (symbol, i)),
lb AS (SELECT *, CAST(r > 0 AS INT) AS win, round(atr_pct, 4) AS p FROM lab)"""
_CASES = ", ".join(f"('{a}', {p}::DOUBLE, {q}::DOUBLE, {s}::DOUBLE, {t}::DOUBLE, {n})" for a, p, q, s, t, n in R.SCENARIOS)
_PLAN = f"""WITH RECURSIVE sc(label, p, payout, start, target, days) AS (VALUES {_CASES}),
pl AS (SELECT label, 0 AS k, greatest(target / (payout - 1), 0.35::DOUBLE) AS stake, 0::DOUBLE AS lost FROM sc
  UNION ALL SELECT pl.label, k + 1, greatest((lost + stake + target) / (payout - 1), 0.35::DOUBLE), lost + stake FROM pl JOIN sc USING (label) WHERE k < 59)"""


def _walk(factor: int, n: int) -> str:
    return f"""{_PLAN}, dr AS (SELECT label, path, day, floor(ln((('0x' || substr(md5(label || ':' || path || ':' || day), 1, 8))::BIGINT + 0.5) / 4294967296.0) / ln(1 - p))::BIGINT AS losses FROM sc, range(0, {n}) a(path), range(0, 30) b(day) WHERE day < days),
wk AS (SELECT label, path, -1::BIGINT AS day, start AS bank, -1::BIGINT AS ruin_day, 0 AS days_won FROM sc, range(0, {n}) a(path)
  UNION ALL SELECT label, path, day, CASE WHEN ruin_day0 >= 0 THEN bank0 WHEN funded THEN bank0 + gain ELSE 0 END, CASE WHEN ruin_day0 < 0 AND NOT funded THEN day ELSE ruin_day0 END, days_won + CAST(ruin_day0 < 0 AND funded AS INT)
  FROM (SELECT wk.label, wk.path, dr.day, wk.bank AS bank0, wk.ruin_day AS ruin_day0, wk.days_won, dr.losses < 60 AND pl.stake <= wk.bank - pl.lost + 1e-9 AS funded, pl.stake * (sc.payout - 1) - pl.lost * {factor} AS gain
    FROM wk JOIN sc USING (label) JOIN dr ON dr.label = wk.label AND dr.path = wk.path AND dr.day = wk.day + 1 JOIN pl ON pl.label = wk.label AND pl.k = least(dr.losses, 59))),
fin AS (SELECT wk.* FROM wk JOIN sc USING (label) WHERE day = days - 1)"""


def _walk_by_fold(factor: int, n: int) -> str:
    """All paths, each as one fold over its days; the list's elements have the type of the state."""
    return f"""{_PLAN}, pa AS (SELECT label, list({{'stake': stake, 'lost': lost}} ORDER BY k) AS plan FROM pl GROUP BY label),
fin AS (SELECT label, path, s.bank AS bank, s.ruin_day AS ruin_day, s.won AS days_won FROM (SELECT label, path, list_reduce(
    list_transform(range(0, days), lambda d: {{'bank': 0::DOUBLE, 'ruin_day': d, 'won': floor(ln((('0x' || substr(md5(label || ':' || path || ':' || d), 1, 8))::BIGINT + 0.5) / 4294967296.0) / ln(1 - p))::BIGINT}}),
    lambda a, x: CASE WHEN a.ruin_day >= 0 THEN a
      WHEN x.won < 60 AND plan[least(x.won, 59) + 1].stake <= a.bank - plan[least(x.won, 59) + 1].lost + 1e-9
        THEN {{'bank': a.bank + (plan[least(x.won, 59) + 1].stake * (payout - 1) - plan[least(x.won, 59) + 1].lost * {factor}), 'ruin_day': a.ruin_day, 'won': a.won + 1}}
      ELSE {{'bank': 0::DOUBLE, 'ruin_day': x.ruin_day, 'won': a.won}} END,
    {{'bank': start, 'ruin_day': -1::BIGINT, 'won': 0::BIGINT}}) AS s FROM sc JOIN pa USING (label), range(0, {n}) a(path)))"""


def _paths_sql(walk: str) -> str:
    return f"{walk} SELECT label, path, round(bank, 6) AS bank, CAST(ruin_day AS INT) AS ruin_day, CAST(days_won AS INT) AS days_won FROM fin"


def _sum_sql(walk: str) -> str:
    return f"""{walk} SELECT label, count(*) AS paths, round(avg(CAST(ruin_day >= 0 AND ruin_day < 7 AS INT)), 6) AS p_ruin_week, round(avg(CAST(ruin_day >= 0 AS INT)), 6) AS p_ruin, round(quantile_cont(bank, 0.5), 6) AS median_final,
        round(avg(bank), 6) AS mean_final, round(avg(bank - start), 6) AS expected_pl FROM fin JOIN sc USING (label) GROUP BY label"""


# The simulator bar by bar: a bar's row has the state after it and, if one closed, the trade.
def _simulated(variant: str) -> str:
    """One variant's run: (symbol, i, date, mark) and, where a trade closed, its columns."""
    frame = _OPEN_FRAME
    if variant in ("is", "oos"):
        keep = "i <= floor(n * 0.6)" if variant == "is" else "i >= floor(n * 0.6)"
        frame = frame.replace("\nbars AS (", "\nwhole AS (", 1).replace("\nb AS (SELECT *, lag(close)", f"""
bars AS (SELECT symbol, date, open, high, low, close, volume, i - min(i) OVER (PARTITION BY symbol) AS i FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM whole) WHERE {keep}),
b AS (SELECT *, lag(close)""", 1)
    # The bias is that of the whole series of bars.
    bias = WEEKS.replace("FROM bars d ASOF", "FROM whole d ASOF" if variant in ("is", "oos") else "FROM bars d ASOF")
    obeyed = "false" if variant == "base" else "bias = -want"
    side = "(0.0002::DOUBLE / 2 + 0.5::DOUBLE * 0.0001)"
    return f"""{frame}, {bias},
z AS (SELECT fr.symbol, i, fr.date, open, high, low, close, atr, regime, CASE WHEN long_signal AND regime = 1 THEN 1 WHEN short_signal AND regime = -1 THEN -1 ELSE 0 END AS want, al.cot_bias AS bias,
    lead(open) OVER w AS next_open, lead(high) OVER w AS next_high, lead(low) OVER w AS next_low, lead(fr.date) OVER w AS next_date FROM fr JOIN al ON al.pair = fr.symbol AND al.date = fr.date WINDOW w AS (PARTITION BY fr.symbol ORDER BY i)),
sim AS (
  SELECT symbol, -1::BIGINT AS i, NULL::DATE AS date, 0 AS d, -1::BIGINT AS since, NULL::DATE AS entry_date, 0::DOUBLE AS entry, 0::DOUBLE AS stop, 0::DOUBLE AS take, 0::DOUBLE AS units, 0::DOUBLE AS risk, 0::DOUBLE AS best, false AS even, 10000::DOUBLE AS equity, 10000::DOUBLE AS mark,
    NULL::INT AS t_d, NULL::DATE AS t_date, 0::DOUBLE AS t_entry, 0::DOUBLE AS t_stop, 0::DOUBLE AS t_take, 0::DOUBLE AS t_units, 0::DOUBLE AS t_risk, 0::DOUBLE AS t_exit, NULL::VARCHAR AS t_reason, 0::DOUBLE AS t_pnl, -1::BIGINT AS t_bars FROM (SELECT DISTINCT symbol FROM z)
  UNION ALL
  SELECT symbol, i, date, CASE WHEN opened THEN go WHEN shut THEN 0 ELSE d END, CASE WHEN opened THEN i + 1 ELSE since END, CASE WHEN opened THEN next_date ELSE entry_date END, CASE WHEN opened THEN fill ELSE entry END, CASE WHEN opened THEN fill - go * 2.0::DOUBLE * atr ELSE stop END,
    CASE WHEN opened THEN fill + go * 2.5::DOUBLE * gap ELSE take END, CASE WHEN opened THEN size ELSE units END, CASE WHEN opened THEN gap ELSE risk END, CASE WHEN NOT opened THEN best WHEN go = 1 THEN next_high ELSE next_low END, CASE WHEN opened THEN false ELSE even END, eq,
    CASE WHEN opened THEN eq + go * (close - fill) * size WHEN d <> 0 AND NOT shut THEN eq + d * (close - entry) * units ELSE eq END,
    CASE WHEN shut THEN d END, entry_date, entry, stop, take, units, risk, out, CASE WHEN shut THEN reason END, pnl, i - since
  FROM (SELECT *, go <> 0 AND gap > 0 AS opened, least(eq * 0.01 / gap, eq * 50 / greatest(fill, 1e-9)) AS size FROM (SELECT *, next_open + go * {side} AS fill, abs((next_open + go * {side}) - ((next_open + go * {side}) - go * 2.0::DOUBLE * atr)) AS gap FROM (
    SELECT *, equity + CASE WHEN shut THEN pnl ELSE 0 END AS eq, CASE WHEN (d = 0 OR shut) AND next_open IS NOT NULL AND atr > 0 AND NOT ({obeyed}) THEN want ELSE 0 END AS go FROM (
      SELECT *, reason IS NOT NULL AS shut, px - d * {side} AS out, d * ((px - d * {side}) - entry) * units - units * (0.2::DOUBLE * 0.0001) AS pnl FROM (
        SELECT *, CASE WHEN d = 0 THEN NULL WHEN d * open <= d * stop THEN 'gap_stop' WHEN d * bad <= d * stop THEN 'stop' WHEN take > 0 AND d * good >= d * take THEN 'target' WHEN i - since >= 40 THEN 'time' WHEN regime = -d THEN 'flip' END AS reason,
          CASE WHEN d * open <= d * stop THEN open WHEN d * bad <= d * stop THEN stop WHEN take > 0 AND d * good >= d * take THEN take ELSE close END AS px FROM (
          SELECT * REPLACE (CASE WHEN d = 1 THEN greatest(s1, best - 3.0::DOUBLE * atr) WHEN d = -1 THEN least(s1, best + 3.0::DOUBLE * atr) ELSE stop END AS stop) FROM (
            SELECT *, CASE WHEN hit AND d = 1 THEN greatest(stop, entry) WHEN hit THEN least(stop, entry) ELSE stop END AS s1 FROM (
              SELECT * REPLACE (even OR hit AS even) FROM (
                SELECT *, d <> 0 AND NOT even AND d * good >= d * (entry + d * 1.0::DOUBLE * abs(entry - stop)) AS hit FROM (
                  SELECT z.*, sim.d, sim.since, sim.entry_date, sim.entry, sim.stop, sim.take, sim.units, sim.risk, sim.even, sim.equity, CASE WHEN sim.d = 1 THEN greatest(sim.best, z.high) ELSE least(sim.best, z.low) END AS best,
                    CASE WHEN sim.d = 1 THEN z.high ELSE z.low END AS good, CASE WHEN sim.d = 1 THEN z.low ELSE z.high END AS bad
                  FROM sim JOIN z ON z.symbol = sim.symbol AND z.i = sim.i + 1)))))))))))
SELECT '{variant}' AS variant, * FROM sim WHERE i >= 0"""


RUNS = "WITH run AS (" + " UNION ALL ".join(f"SELECT * FROM ({_simulated(v)})" for v in ("base", "cot", "is", "oos")) + ")"
EQUITY = f"{RUNS}, e AS (SELECT symbol, variant, date, mark AS equity, coalesce(mark / lag(mark) OVER w - 1, 0) AS ret, max(mark) OVER w AS peak FROM run WINDOW w AS (PARTITION BY symbol, variant ORDER BY date))"
METRICS = f"""{EQUITY}, c AS (SELECT symbol, variant, arg_max(equity, date) AS last, date_diff('day', min(date), max(date)) AS days, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe, min((equity - peak) / peak) AS dd FROM e GROUP BY ALL),
t AS (SELECT symbol, variant, count(*) AS trades, avg(CAST(t_pnl > 0 AS INT)) * 100 AS win_rate, coalesce(sum(t_pnl) FILTER (t_pnl > 0), 0) / nullif(abs(sum(t_pnl) FILTER (t_pnl <= 0)), 0) AS profit_factor, avg(CASE WHEN t_risk > 0 THEN t_pnl / (t_risk * t_units) ELSE 0 END) AS expectancy_r, avg(t_bars) AS avg_bars FROM run WHERE t_reason IS NOT NULL GROUP BY ALL),
m AS (SELECT symbol, variant, coalesce(trades, 0) AS trades, CASE WHEN trades IS NULL THEN 0 ELSE last - 10000 END AS net, CASE WHEN trades IS NULL THEN 0 ELSE (last / 10000 - 1) * 100 END AS ret_pct, CASE WHEN trades IS NULL THEN 0 ELSE (pow(last / 10000, 1 / greatest(days / 365.25, 1e-9)) - 1) * 100 END AS cagr,
  CASE WHEN trades IS NULL THEN 0 ELSE coalesce(sharpe, 0) END AS sharpe, CASE WHEN trades IS NULL THEN 0 ELSE dd * 100 END AS max_dd, coalesce(win_rate, 0) AS win_rate, CASE WHEN trades IS NULL THEN 0 ELSE coalesce(profit_factor, -1) END AS profit_factor, coalesce(expectancy_r, 0) AS expectancy_r, coalesce(avg_bars, 0) AS avg_bars FROM c LEFT JOIN t USING (symbol, variant))"""

ORACLE = {
    "swing_trades": f"""{RUNS} SELECT symbol, variant, t_d AS direction, t_date AS entry_date, round(t_entry, 3) AS entry, round(t_stop, 3) AS stop, round(t_take, 3) AS take, round(t_units, 9) AS units, round(t_risk, 3) AS init_risk, date AS exit_date, round(t_exit, 3) AS exit, t_reason AS reason,
        round(t_pnl, 5) AS pnl, round(CASE WHEN t_risk > 0 THEN t_pnl / (t_risk * t_units) ELSE 0 END, 5) AS r_multiple, CAST(t_bars AS INT) AS bars_held, round(equity, 4) AS equity_after FROM run WHERE t_reason IS NOT NULL""",
    "swing_equity": f"{RUNS} SELECT symbol, variant, date, round(mark, 4) AS equity FROM run",
    "swing_metrics": f"{METRICS} SELECT symbol, variant, trades, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("net", "ret_pct", "cagr", "sharpe", "max_dd", "win_rate", "profit_factor", "expectancy_r", "avg_bars")) + " FROM m",
    "swing_rollup": f"{METRICS} SELECT variant, round(avg(ret_pct), 5) AS mean_return, round(quantile_cont(ret_pct, 0.5), 5) AS median_return, count(*) FILTER (ret_pct > 0) AS profitable, count(*) AS symbols FROM m GROUP BY variant",
    "portfolio": f"""{EQUITY}, k AS (SELECT DISTINCT variant, date FROM e), y AS (SELECT DISTINCT variant, symbol FROM e), g AS (SELECT k.variant, k.date, y.symbol, last_value(e.equity / 10000 IGNORE NULLS) OVER (PARTITION BY k.variant, y.symbol ORDER BY k.date) AS v
        FROM k JOIN y USING (variant) LEFT JOIN e ON e.variant = k.variant AND e.symbol = y.symbol AND e.date = k.date), dd AS (SELECT variant, date, avg(v) AS value FROM g GROUP BY ALL)
        SELECT variant, date, round(value, 8) AS value, round(value / max(value) OVER (PARTITION BY variant ORDER BY date) - 1, 8) AS drawdown FROM dd""",
    "cot_net": f"WITH {COT} SELECT * FROM cot",
    "cot_index": f"WITH {BARS}, {WEEKS} SELECT asset, date, round(idx, 6) AS idx FROM ai WHERE idx IS NOT NULL",
    "cot_bias_user": f"WITH {BARS}, {WEEKS} SELECT pair, date, bias FROM bu",
    "cot_bias_index": f"WITH {BARS}, {WEEKS} SELECT pair, date, bias FROM bx",
    "bias_counts": f"WITH {BARS}, {WEEKS} SELECT pair, bias, count(*) AS n FROM bu GROUP BY ALL",
    "asof_align": f"WITH {BARS}, {WEEKS} SELECT * FROM al",
    "cot_features": f"WITH {BARS}, {WEEKS} SELECT pair, date, round(cot_base_idx, 6) AS cot_base_idx, round(cot_quote_idx, 6) AS cot_quote_idx, cot_bias FROM cg",
    "cost_model": f"""WITH {BARS}, k(symbol, pip, spread) AS (VALUES {", ".join(f"('{s}', {p}::DOUBLE, {w}::DOUBLE)" for s, p, w in W.PIPS)}), a AS (SELECT symbol FROM k UNION ALL SELECT DISTINCT symbol FROM bars)
        SELECT a.symbol, round(coalesce(pip, 0.0001), 9) AS pip, round(coalesce(spread, 0.0002), 9) AS spread, round(0.5 * coalesce(pip, 0.0001), 9) AS slippage, round(0.2 * coalesce(pip, 0.0001), 9) AS commission FROM a LEFT JOIN k USING (symbol)""",
    "is_oos_split": f"""WITH {BARS}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), s AS (SELECT symbol, date, v.part FROM bars JOIN n USING (symbol), (VALUES ('is'), ('oos')) v(part) WHERE CASE v.part WHEN 'is' THEN i <= floor(n * 0.6) ELSE i >= floor(n * 0.6) END)
        SELECT symbol, part, count(*) AS bars, min(date) AS first, max(date) AS last FROM s GROUP BY ALL""",
    "triple_barrier": f"{LABELS} SELECT symbol, date, direction, round(r, 6) AS r, win FROM lb",
    "walkforward_folds": f"""{LABELS}, o AS (SELECT row_number() OVER (ORDER BY date, symbol) - 1 AS place, ntile(6) OVER (ORDER BY date, symbol) - 1 AS fold FROM lb), f AS (SELECT fold, count(*) AS n, min(place) AS first, max(place) AS last FROM o GROUP BY fold)
        SELECT CAST(fold AS INT) AS fold, n, first, last, CASE WHEN fold > 0 AND first - 10 >= 50 THEN first - 10 ELSE -1 END AS train_end FROM f""",
    "selectivity": f"""{LABELS}, c(top, cut) AS ({" UNION ALL ".join(f"SELECT {t}, " + ("-1e300" if t == 100 else f"(SELECT quantile_cont(p, {(100 - t) / 100}) FROM lb)") for t in (100, 70, 50, 30, 20))})
        SELECT top, count(*) AS trades, round(avg(win) * 100, 6) AS win_pct, round(avg(r), 6) AS mean_r, round(avg(r) - (SELECT avg(r) FROM lb), 6) AS gain FROM lb JOIN c ON p >= cut GROUP BY top""",
    "roc_auc": f"""{LABELS}, k AS (SELECT win, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM lb)
        SELECT count(*) AS n, round((sum(rk) FILTER (win = 1) - sum(win) * (sum(win) + 1) / 2) / (sum(win) * (count(*) - sum(win))), 6) AS auc FROM k""",
    "ruin_day_prob": f"{_PLAN}, k AS (SELECT label, count(*) FILTER (stake <= start - lost + 1e-9) AS losses FROM pl JOIN sc USING (label) GROUP BY label) SELECT label, CAST(losses AS INT) AS losses, round(pow(1 - p, losses), 6) AS p_lose, round(1 - pow(1 - p, losses), 6) AS p_win FROM k JOIN sc USING (label)",
    "ruin_paths": _paths_sql(_walk(1, SQL_PATHS)),
    "ruin_paths_reference": _paths_sql(_walk(2, SQL_PATHS)),
    "ruin_summary": _sum_sql(_walk(1, SQL_PATHS)),
    "ruin_summary_reference": _sum_sql(_walk(2, SQL_PATHS)),
    "ruin_paths_full": _paths_sql(_walk_by_fold(1, ALL_PATHS)),
    "ruin_paths_full_reference": _paths_sql(_walk_by_fold(2, ALL_PATHS)),
    "ruin_summary_full": _sum_sql(_walk_by_fold(1, ALL_PATHS)),
    "ruin_summary_full_reference": _sum_sql(_walk_by_fold(2, ALL_PATHS)),
    "ruin_curves": f"{_walk(1, 40)} SELECT label, path, CAST(day AS INT) AS day, round(bank, 6) AS bank FROM wk WHERE day >= 0",
}
ORACLE["portfolio_sharpe"] = f"""SELECT variant, count(*) AS days, round(CASE WHEN stddev_samp(c) > 0 THEN avg(c) / stddev_samp(c) * sqrt(252) ELSE 0 END, 5) AS sharpe FROM (
    SELECT variant, coalesce(value / lag(value) OVER (PARTITION BY variant ORDER BY date) - 1, 0) AS c FROM ({ORACLE["portfolio"].replace("round(value, 8) AS value", "value")})) GROUP BY variant"""
ORACLE["model_verdict"] = f"""WITH a AS ({ORACLE["roc_auc"]}), s AS ({ORACLE["selectivity"]}), g AS ({LABELS} SELECT p, r FROM lb WHERE symbol = '3-MEDIUM')
    SELECT a.n, a.auc, s.gain AS top30_gain, a.auc >= 0.52 AND s.gain > 0.02 AS skilled, (SELECT count(*) FROM g) AS gold_n,
      (SELECT CASE WHEN count(*) > 10 THEN round(avg(r) FILTER (p >= (SELECT quantile_cont(p, 0.5) FROM g)) - avg(r), 6) END FROM g) AS gold_gain FROM a, s WHERE s.top = 30"""
_MODES = "(VALUES ('either', true, true), ('pullback', true, false), ('breakout', false, true)) m(mode, pull, break_)"
ORACLE["entry_modes"] = f"""{_OPEN_FRAME}, e AS (SELECT mode, symbol, date, i >= 102 AND (pull AND long_pullback OR break_ AND long_breakout) AS long_signal, i >= 102 AND (pull AND short_pullback OR break_ AND short_breakout) AS short_signal FROM fr, {_MODES})
  SELECT * FROM e WHERE long_signal OR short_signal"""
ORACLE["label_features"] = f"""{LABELS}, lg AS (SELECT symbol, i, lag(close, 5) OVER w AS c5, lag(close, 20) OVER w AS c20 FROM fr WINDOW w AS (PARTITION BY symbol ORDER BY i))
  SELECT sh.symbol, on_date AS date, direction, round(adx, 6) AS adx, round(rsi, 6) AS rsi, round((close - ema_trend) / atr, 6) AS trend_ext, round((close - ema_pullback) / atr, 6) AS pull_ext, round(close / c5 - 1, 6) AS ret5, round(close / c20 - 1, 6) AS ret20,
    isodow(on_date) - 1 AS dow, CAST(sh.symbol IN ('XAUUSD', 'XAGUSD') AS INT) AS is_metal FROM sh JOIN lg USING (symbol, i)"""
