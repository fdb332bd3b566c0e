"""Queries over daily bars, indicators and signals, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import signals as S
from tickloom.operators.recursive import recursive
from tickloom.sources.tables import BARS, bars, bars_raw


def _r(*names, n=4):
    return [F.round(c, n).alias(c) for c in names]


def _raw_text(spark, d):
    """Orders as rows of a price file: text, with bad rows, two times a day and one arrival after another."""
    rows = bars_raw(spark, d).where("symbol is not null")
    p, k = F.col("price"), F.col("seq")
    time = F.concat(F.date_format("date", "yyyy-MM-dd"), F.when(k % 3 == 0, F.lit(" 09:00:00")).otherwise(F.lit(" 17:00:00")))
    high = F.when(k % 11 == 0, p - 1).otherwise(p + k % 5)
    text = lambda c: c.cast("string")
    return rows.select("symbol", "seq", F.when(k % 17 == 0, F.lit("no time")).otherwise(time).alias("time"), F.when(k % 13 == 0, F.lit("n/a")).otherwise(text(p)).alias("open"), text(high).alias("high"), text(p - k % 3).alias("low"), F.when(k % 19 == 0, F.lit("-1")).otherwise(text(p)).alias("close"), F.lit("1").alias("volume"))


def ohlc_clean(spark, d):
    return B.clean(_raw_text(spark, d), "1992-03-01", "1998-06-30").select("symbol", "date", *_r("open", "high", "low", "close", "volume"))


def dedupe_keep_last(spark, d):
    return B.keep_last(bars_raw(spark, d), ["symbol", "date"], ["seq"]).select("symbol", "date", "seq", "price")


def _frame(spark, d):
    return S.frame(bars(spark, d))


def pivots(spark, d):
    return B.pivots(bars(spark, d)).select("symbol", "date", "pivot_high", "pivot_low").where("pivot_high or pivot_low")


def confirmed_level(spark, d):
    rows = B.confirmed_level(B.pivots(bars(spark, d)), "pivot_high", "high")
    return rows.select("symbol", "date", F.coalesce("level", F.lit(-1.0)).alias("level"))


def _some(*names):
    return lambda s, d: recursive(bars(s, d)).select("symbol", "date", *_r(*names))


def signal_frame(spark, d):
    cols = [F.round(F.coalesce(c, F.lit(-1.0)), 4).alias(c) for c in ("atr", "adx", "rsi", "ema_trend", "ema_pullback", "atr_pct")]
    return _frame(spark, d).select("symbol", "date", "regime", "long_signal", "short_signal", "st_dir", *cols)


QUERIES = {
    "bars_scan": lambda s, d: bars(s, d).select("symbol", "date", "i", *_r("open", "high", "low", "close", "volume")),
    "ohlc_clean": ohlc_clean,
    "dedupe_keep_last": dedupe_keep_last,
    "sma": lambda s, d: B.sma(bars(s, d), 20).where("sma is not null").select("symbol", "date", *_r("sma")),
    "true_range": lambda s, d: B.true_range(bars(s, d)).select("symbol", "date", *_r("tr")),
    "donchian": lambda s, d: B.donchian(bars(s, d)).where("don_hi is not null").select("symbol", "date", *_r("don_hi", "don_lo")),
    "pivots": pivots,
    "confirmed_level": confirmed_level,
    "ema": _some("ema_trend", "ema_pullback"),
    "atr": _some("atr"),
    "rsi": _some("rsi"),
    "adx": _some("adx"),
    "supertrend": lambda s, d: recursive(bars(s, d)).select("symbol", "date", *_r("st_line"), "st_dir"),
    "rolling_percentile": lambda s, d: B.rolling_rank(bars(s, d), "close", 100, "rank").where("rank is not null").select("symbol", "date", *_r("rank")),
    "rolling_percentile_partial": lambda s, d: B.rolling_rank(bars(s, d), "close", 100, "rank", partial=0.5).select("symbol", "date", *_r("rank")),
    "regime": lambda s, d: _frame(s, d).select("symbol", "date", "regime"),
    "entries_pullback": lambda s, d: _frame(s, d).where("long_pullback or short_pullback").select("symbol", "date", "long_pullback", "short_pullback"),
    "entries_breakout": lambda s, d: _frame(s, d).where("long_breakout or short_breakout").select("symbol", "date", "long_breakout", "short_breakout"),
    "signal_frame": signal_frame,
}

#: All recursive indicators in one pass over the bars.
RECURSION = f"""WITH RECURSIVE {BARS},
b AS (SELECT *, lag(close) OVER w AS c0, lag(high) OVER w AS h0, lag(low) OVER w AS l0 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)),
m AS (SELECT *, greatest(high - low, coalesce(abs(high - c0), 0), coalesce(abs(low - c0), 0)) AS tr, greatest(close - c0, 0) AS gain, greatest(c0 - close, 0) AS loss,
  CASE WHEN high - h0 > l0 - low AND high - h0 > 0 THEN high - h0 ELSE 0::DOUBLE END AS pdm, CASE WHEN l0 - low > high - h0 AND l0 - low > 0 THEN l0 - low ELSE 0::DOUBLE END AS mdm, (high + low) / 2.0::DOUBLE AS mid FROM b),
r AS (
  SELECT symbol, i, close, close AS et, close AS ep, tr AS a14, tr AS a10, NULL::DOUBLE AS g, NULL::DOUBLE AS l, pdm AS p, mdm AS n, NULL::DOUBLE AS dxr, 0 AS gap, mid + 3 * tr AS fu, mid - 3 * tr AS fl, true AS below, -1 AS dir,
    CASE WHEN tr <> 0 AND pdm + mdm <> 0 THEN 1 END AS dx FROM m WHERE i = 0
  UNION ALL
  SELECT symbol, i, close, et, ep, a14, a10, g, l, p, n,
    CASE WHEN dx IS NULL THEN dxr0 WHEN dxr0 IS NULL THEN dx WHEN gap0 = 0 THEN dxr0 + (1::DOUBLE / 14) * (dx - dxr0)
      ELSE (pow(1 - 1::DOUBLE / 14, gap0 + 1) * dxr0 + (1::DOUBLE / 14) * dx) / (pow(1 - 1::DOUBLE / 14, gap0 + 1) + 1::DOUBLE / 14) END,
    CASE WHEN dx IS NOT NULL THEN 0 WHEN dxr0 IS NULL THEN 0 ELSE gap0 + 1 END, fu, fl, below, CASE WHEN NOT below OR fu = fl THEN 1 ELSE -1 END, dx
  FROM (SELECT *, CASE WHEN was_below THEN close <= fu ELSE close < fl END AS below,
      CASE WHEN a14 <> 0 AND 100 * p / a14 + 100 * n / a14 <> 0 THEN 100 * abs(100 * p / a14 - 100 * n / a14) / (100 * p / a14 + 100 * n / a14) END AS dx
    FROM (SELECT m.symbol, m.i, m.close, r.et + (2::DOUBLE / 51) * (m.close - r.et) AS et, r.ep + (2::DOUBLE / 21) * (m.close - r.ep) AS ep, r.a14 + (1::DOUBLE / 14) * (m.tr - r.a14) AS a14,
        r.a10 + (1::DOUBLE / 10) * (m.tr - r.a10) AS a10, CASE WHEN r.g IS NULL THEN m.gain ELSE r.g + (1::DOUBLE / 14) * (m.gain - r.g) END AS g, CASE WHEN r.l IS NULL THEN m.loss ELSE r.l + (1::DOUBLE / 14) * (m.loss - r.l) END AS l,
        r.p + (1::DOUBLE / 14) * (m.pdm - r.p) AS p, r.n + (1::DOUBLE / 14) * (m.mdm - r.n) AS n, r.dxr AS dxr0, r.gap AS gap0, r.below OR r.fu = r.fl AS was_below,
        CASE WHEN m.mid + 3 * (r.a10 + (1::DOUBLE / 10) * (m.tr - r.a10)) < r.fu OR r.close > r.fu THEN m.mid + 3 * (r.a10 + (1::DOUBLE / 10) * (m.tr - r.a10)) ELSE r.fu END AS fu,
        CASE WHEN m.mid - 3 * (r.a10 + (1::DOUBLE / 10) * (m.tr - r.a10)) > r.fl OR r.close < r.fl THEN m.mid - 3 * (r.a10 + (1::DOUBLE / 10) * (m.tr - r.a10)) ELSE r.fl END AS fl
      FROM r JOIN m ON m.symbol = r.symbol AND m.i = r.i + 1))),
ind AS (SELECT bars.*, r.et AS ema_trend, r.ep AS ema_pullback, r.a14 AS atr, CASE WHEN r.l IS NULL OR r.l = 0 THEN 50 ELSE 100 - 100 / (1 + r.g / r.l) END AS rsi, coalesce(r.dxr, 0) AS adx,
  CASE WHEN r.below THEN r.fu ELSE r.fl END AS st_line, r.dir AS st_dir FROM bars JOIN r USING (symbol, i))"""
FRAME = f"""{RECURSION},
x1 AS (SELECT *, CASE WHEN count(*) OVER w20 = 20 THEN max(high) OVER w20 END AS don_hi, CASE WHEN count(*) OVER w20 = 20 THEN min(low) OVER w20 END AS don_lo, lag(close) OVER w AS c1,
    CASE WHEN count(*) OVER w6 = 6 THEN bool_or(low <= ema_pullback) OVER w6 END AS dip, CASE WHEN count(*) OVER w6 = 6 THEN bool_or(high >= ema_pullback) OVER w6 END AS pop,
    CASE WHEN count(*) OVER w100 = 100 THEN len([v FOR v IN list(atr) OVER w100 IF v <= atr]) / 100 END AS atr_pct
  FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY i), w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w6 AS (PARTITION BY symbol ORDER BY i ROWS 5 PRECEDING), w100 AS (PARTITION BY symbol ORDER BY i ROWS 99 PRECEDING)),
x2 AS (SELECT *, CASE WHEN adx >= 18 AND atr_pct >= 0.05 AND atr_pct <= 0.97 THEN CASE WHEN st_dir = 1 AND close > ema_trend THEN 1 WHEN st_dir = -1 AND close < ema_trend THEN -1 ELSE 0 END ELSE 0 END AS regime FROM x1),
x3 AS (SELECT *, coalesce(regime = 1 AND dip AND close > open AND close > c1 AND close >= ema_pullback, false) AS long_pullback, coalesce(regime = -1 AND pop AND close < open AND close < c1 AND close <= ema_pullback, false) AS short_pullback,
    coalesce(regime = 1 AND close > don_hi AND close > open AND close > c1, false) AS long_breakout, coalesce(regime = -1 AND close < don_lo AND close < open AND close < c1, false) AS short_breakout FROM x2),
fr AS (SELECT *, i >= 102 AND (long_pullback OR long_breakout) AS long_signal, i >= 102 AND (short_pullback OR short_breakout) AS short_signal FROM x3)"""
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY i), around AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), prior AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
PIVOTS = f"""WITH {BARS}, pv AS (SELECT *, coalesce(count(*) OVER around = 7 AND high = max(high) OVER around AND high > max(high) OVER prior, false) AS pivot_high,
  coalesce(count(*) OVER around = 7 AND low = min(low) OVER around AND low < min(low) OVER prior, false) AS pivot_low FROM bars {_W})"""


def _ind(*cols):
    return f"{RECURSION} SELECT symbol, date, " + ", ".join(f"round({c}, 4) AS {c}" for c in cols) + " FROM ind"


ORACLE = {
    "bars_scan": f"WITH {BARS} SELECT symbol, date, i, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume FROM bars",
    "ohlc_clean": f"""WITH {BARS}, q AS (SELECT symbol, seq, CASE WHEN seq % 17 <> 0 THEN CAST(date AS TIMESTAMP) + CASE WHEN seq % 3 = 0 THEN INTERVAL 9 HOUR ELSE INTERVAL 17 HOUR END END AS t, CASE WHEN seq % 13 <> 0 THEN price END AS o,
          CASE WHEN seq % 11 = 0 THEN price - 1 ELSE price + seq % 5 END AS h, price - seq % 3 AS l, CASE WHEN seq % 19 = 0 THEN -1 ELSE price END AS c FROM bars_raw WHERE symbol IS NOT NULL),
        u AS (SELECT * FROM q WHERE t IS NOT NULL AND o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY seq DESC) = 1),
        v AS (SELECT * FROM u WHERE least(o, h, l, c) > 0 AND h >= l QUALIFY row_number() OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t DESC) = 1)
        SELECT symbol, CAST(t AS DATE) AS date, round(o, 4) AS open, round(h, 4) AS high, round(l, 4) AS low, round(c, 4) AS close, 1.0::DOUBLE AS volume FROM v WHERE CAST(t AS DATE) BETWEEN DATE '1992-03-01' AND DATE '1998-06-30'""",
    "dedupe_keep_last": f"WITH {BARS} SELECT symbol, date, seq, price FROM bars_raw QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) = 1",
    "sma": f"WITH {BARS}, s AS (SELECT symbol, date, avg(close) OVER w AS sma, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING)) SELECT symbol, date, round(sma, 4) AS sma FROM s WHERE n = 20",
    "true_range": f"WITH {BARS}, s AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY i) AS c FROM bars) SELECT symbol, date, round(greatest(high - low, coalesce(abs(high - c), 0), coalesce(abs(low - c), 0)), 4) AS tr FROM s",
    "donchian": f"WITH {BARS}, s AS (SELECT symbol, date, max(high) OVER w AS h, min(low) OVER w AS l, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT symbol, date, round(h, 4) AS don_hi, round(l, 4) AS don_lo FROM s WHERE n = 20",
    "pivots": f"{PIVOTS} SELECT symbol, date, pivot_high, pivot_low FROM pv WHERE pivot_high OR pivot_low",
    "confirmed_level": f"{PIVOTS}, k AS (SELECT symbol, date, i, CASE WHEN lag(pivot_high, 3) OVER (PARTITION BY symbol ORDER BY i) THEN high END AS m FROM pv) SELECT symbol, date, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i), -1) AS level FROM k",
    "ema": _ind("ema_trend", "ema_pullback"),
    "atr": _ind("atr"),
    "rsi": _ind("rsi"),
    "adx": _ind("adx"),
    "supertrend": f"{RECURSION} SELECT symbol, date, round(st_line, 4) AS st_line, st_dir FROM ind",
    "rolling_percentile": f"WITH {BARS}, s AS (SELECT symbol, date, close, list(close) OVER w AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 99 PRECEDING)) SELECT symbol, date, round(len([x FOR x IN v IF x <= close]) / 100, 4) AS rank FROM s WHERE len(v) = 100",
    "rolling_percentile_partial": f"WITH {BARS}, s AS (SELECT symbol, date, close, list(close) OVER w AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 99 PRECEDING)) SELECT symbol, date, round(len([x FOR x IN v IF x <= close]) / len(v), 4) AS rank FROM s",
    "regime": f"{FRAME} SELECT symbol, date, regime FROM fr",
    "entries_pullback": f"{FRAME} SELECT symbol, date, long_pullback, short_pullback FROM fr WHERE long_pullback OR short_pullback",
    "entries_breakout": f"{FRAME} SELECT symbol, date, long_breakout, short_breakout FROM fr WHERE long_breakout OR short_breakout",
    "signal_frame": f"{FRAME} SELECT symbol, date, regime, long_signal, short_signal, st_dir, " + ", ".join(f"round(coalesce({c}, -1), 4) AS {c}" for c in ("atr", "adx", "rsi", "ema_trend", "ema_pullback", "atr_pct")) + " FROM fr",
}
