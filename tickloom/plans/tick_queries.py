"""Queries over ticks and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.scalars import sign3
from tickloom.functions.tails import chi2_tail, normal_two_sided, t_two_sided
from tickloom.operators import ticks as T
from tickloom.sources.tables import TICKS, carried, tick_values, ticks

#: Moves of this size or more are rare enough for waits of several ticks.
LARGE = 60.0
PARITY = [1, 2, 3, 5, 10, 20, 50, 100]


def _digits(spark, d):
    return T.with_digit(ticks(spark, d))


def _unordered(spark, d):
    return T.with_digit(tick_values(spark, d))


def _moves(spark, d):
    return T.increments(ticks(spark, d))


def _acf(spark, d):
    out = T.autocorrelation(_digits(spark, d), F.col("digit") % 2, PARITY)
    return out.select("symbol", "lag", F.round("r", 6).alias("r"), F.round(1.96 / F.sqrt("n"), 6).alias("band"))


def _return_acf(spark, d):
    out = T.autocorrelation(_moves(spark, d), F.col("ret"), [1, 2, 3, 5, 10])
    return out.select("symbol", "lag", F.round("r", 6).alias("r"), (F.abs("r") > 1.96 / F.sqrt("n")).alias("flagged"))


def _sign_acf(spark, d):
    moved = _moves(spark, d).where("dp <> 0")
    placed = carried(moved, ["symbol"], {"_before": (F.sum, F.lit(1))}).withColumn("i", F.coalesce("_before", F.lit(0)) + 1).drop("_before")
    return T.autocorrelation(placed, sign3(F.col("dp")), [1]).select("symbol", F.round("r", 6).alias("r"))


def _chi2_p(x: str, df: str | int) -> Column:
    return F.round(chi2_tail(F.col(x), F.col(df) if isinstance(df, str) else F.lit(df)), 6)


def battery_digits(spark, d):
    """The digit report with p-values, rounded to six places."""
    digits = _digits(spark, d)
    u = T.uniformity(digits)
    m = T.independence(T.transitions(digits), ["symbol"], "digit", "next").withColumnsRenamed({"chi2": "markov_chi2", "df": "markov_df"})
    lb = T.ljung_box(digits, F.col("digit") % 2, [20]).select("symbol", F.col("q").alias("lb20"))
    r = T.runs_test(digits, F.col("digit") % 2).select("symbol", "z")
    rows = u.join(m, "symbol").join(lb, "symbol").join(r, "symbol")
    return rows.withColumns({"uniform_p": _chi2_p("chi2", 9), "markov_p": _chi2_p("markov_chi2", "markov_df"), "lb20_p": _chi2_p("lb20", 20), "runs_p": F.round(normal_two_sided(F.col("z")), 6)})


def battery_prices(spark, d):
    """The price report with p-values."""
    moves = _moves(spark, d)
    rows = T.t_statistic(moves, "ret").join(T.direction_shares(moves), "symbol").join(T.ljung_box(moves, F.col("ret"), [10]).drop("m"), "symbol")
    return rows.withColumns({"t_p": F.round(t_two_sided(F.col("t"), F.col("n") - 1), 6), "lb10_p": _chi2_p("q", 10)})


def spike_report(spark, d):
    """Spikes, gaps and the hazard test with its p-value."""
    moves = _moves(spark, d)
    test = T.hazard_chi2(moves).withColumn("p", _chi2_p("chi2", "df"))
    return T.spike_stats(moves).join(T.spike_gaps(moves), ["symbol", "side"], "left").join(test, ["symbol", "side"], "left")


QUERIES = {
    "tick_scan": lambda s, d: ticks(s, d),
    "last_digit": lambda s, d: _digits(s, d).select("symbol", "i", "digit"),
    "infer_decimals": lambda s, d: T.decimals(tick_values(s, d)),
    "digit_histogram": lambda s, d: T.histogram(_unordered(s, d)),
    "digit_uniformity": lambda s, d: T.uniformity(_unordered(s, d)),
    "digit_transitions": lambda s, d: T.transitions(_digits(s, d)),
    "markov_chi2": lambda s, d: T.independence(T.transitions(_digits(s, d)), ["symbol"], "digit", "next"),
    "parity_acf": _acf,
    "ljung_box": lambda s, d: T.ljung_box(_digits(s, d), F.col("digit") % 2, [10, 20, 50]),
    "runs_test": lambda s, d: T.runs_test(_digits(s, d), F.col("digit") % 2),
    "drift_ttest": lambda s, d: T.t_statistic(_moves(s, d), "ret"),
    "direction_shares": lambda s, d: T.direction_shares(_moves(s, d)),
    "best_conditional_cell": lambda s, d: T.best_cell(_digits(s, d)),
    "empirical_ev": lambda s, d: T.empirical_ev(_digits(s, d)),
    "return_acf": _return_acf,
    "sign_acf": _sign_acf,
    "cent_moments": lambda s, d: T.cent_moments(_moves(s, d)),
    "spike_stats": lambda s, d: T.spike_stats(_moves(s, d)),
    "spike_gaps": lambda s, d: T.spike_gaps(_moves(s, d)),
    "hazard_buckets": lambda s, d: T.hazard(_moves(s, d)),
    "hazard_chi2": lambda s, d: T.hazard_chi2(_moves(s, d)),
    "hazard_large": lambda s, d: T.hazard(_moves(s, d), LARGE),
    "hazard_chi2_large": lambda s, d: T.hazard_chi2(_moves(s, d), LARGE),
    "battery_digits": battery_digits,
    "battery_prices": battery_prices,
    "spike_report": spike_report,
    "hazard_test_large": lambda s, d: T.hazard_chi2(_moves(s, d), LARGE).withColumn("p", _chi2_p("chi2", "df")),
}

DIGITS = f"WITH {TICKS}, d AS (SELECT *, CAST(round_even(price * 100, 0) AS BIGINT) % 10 AS digit FROM ticks)"
MOVES = f"""WITH {TICKS}, m AS (SELECT * FROM (SELECT symbol, i, price - lag(price) OVER w AS dp, ln(price) - ln(lag(price) OVER w) AS ret
  FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY i)) WHERE dp IS NOT NULL)"""
CELLS = f"{DIGITS}, t AS (SELECT symbol, digit, next, count(*) AS n FROM (SELECT symbol, digit, lead(digit) OVER (PARTITION BY symbol ORDER BY i) AS next FROM d) WHERE next IS NOT NULL GROUP BY ALL)"
SPIKES = f"""{MOVES}, s AS (SELECT symbol, side, i - 1 AS place, dp, CASE side WHEN 'down' THEN dp < 0 ELSE dp > 0 END AS spike,
  CASE side WHEN 'down' THEN dp > 0 ELSE dp < 0 END AS small FROM m, (VALUES ('down'), ('up')) v(side)),
w AS (SELECT *, coalesce(max(CASE WHEN spike THEN place END) OVER (PARTITION BY symbol, side ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM s),
g AS (SELECT symbol, side, place - last AS gap FROM w WHERE spike AND last >= 0),
f AS (SELECT symbol, side, count(*) AS n, avg(gap) AS mean FROM g GROUP BY ALL HAVING count(*) > 30),
h AS (SELECT symbol, side, CASE WHEN place - last < floor(mean * 0.5) THEN 0 WHEN place - last < floor(mean) THEN 1 WHEN place - last < floor(mean * 1.5) THEN 2 WHEN place - last < floor(mean * 2) THEN 3 ELSE 4 END AS bucket,
  count(*) AS at_risk, count(*) FILTER (spike) AS fired FROM w JOIN f USING (symbol, side) GROUP BY ALL)"""


def _chi2(cells: str, keys: str, row: str, col: str) -> str:
    return f""", r AS (SELECT {keys}, {row}, sum(n) AS rn FROM {cells} GROUP BY ALL), c AS (SELECT {keys}, {col}, sum(n) AS cn FROM {cells} GROUP BY ALL),
  a AS (SELECT {keys}, sum(n) AS an FROM {cells} GROUP BY ALL)
SELECT {keys}, round(sum(pow(coalesce(x.n, 0) - rn * cn / an, 2) / (rn * cn / an)), 6) AS chi2, (count(DISTINCT {row}) - 1) * (count(DISTINCT {col}) - 1) AS df
FROM r JOIN c USING ({keys}) JOIN a USING ({keys}) LEFT JOIN {cells} x USING ({keys}, {row}, {col}) WHERE rn * cn > 0 GROUP BY {keys}"""


def _acf_sql(source: str, x: str, lags: list[int]) -> str:
    return f""", x AS (SELECT symbol, i, CAST({x} AS DOUBLE) AS x FROM {source}), c AS (SELECT symbol, i, x - avg(x) OVER (PARTITION BY symbol) AS c FROM x),
  l AS (SELECT symbol, lag, c, lag(c, lag) OVER (PARTITION BY symbol, lag ORDER BY i) AS b FROM c, (SELECT unnest({lags}) AS lag)),
  acf AS (SELECT symbol, lag, count(*) AS n, coalesce(sum(c * b) / sum(c * c), 0) AS r FROM l GROUP BY ALL)"""


ORACLE = {
    "tick_scan": f"WITH {TICKS} SELECT * FROM ticks",
    "last_digit": f"{DIGITS} SELECT symbol, i, digit FROM d",
    "infer_decimals": f"""WITH {TICKS}, e AS (SELECT symbol, p, max(abs(price * pow(10, p) - round_even(price * pow(10, p), 0))) AS e FROM ticks, range(0, 7) r(p) GROUP BY ALL)
        SELECT symbol, coalesce(min(p) FILTER (e < 1e-4), 6) AS decimals FROM e GROUP BY symbol""",
    "digit_histogram": f"""{DIGITS}, s AS (SELECT DISTINCT symbol FROM d) SELECT s.symbol, r.digit, count(d.digit) AS n FROM s CROSS JOIN range(0, 10) r(digit)
        LEFT JOIN d ON d.symbol = s.symbol AND d.digit = r.digit GROUP BY ALL""",
    "digit_uniformity": f"{DIGITS}, h AS (SELECT symbol, digit, count(*) AS n FROM d GROUP BY ALL) SELECT symbol, CAST(sum(n) AS BIGINT) AS n, round(sum(n * n) / (sum(n) / 10) - sum(n), 6) AS chi2 FROM h GROUP BY symbol",
    "digit_transitions": f"{CELLS} SELECT * FROM t",
    "markov_chi2": CELLS + _chi2("t", "symbol", "digit", "next"),
    "parity_acf": DIGITS + _acf_sql("d", "digit % 2", PARITY) + " SELECT symbol, lag, round(r, 6) AS r, round(1.96 / sqrt(n), 6) AS band FROM acf",
    "ljung_box": DIGITS + _acf_sql("d", "digit % 2", list(range(1, 51))) + " SELECT symbol, m, round(any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)), 6) AS q FROM acf, (SELECT unnest([10, 20, 50]) AS m) WHERE lag <= m AND n > lag GROUP BY symbol, m",
    "runs_test": f"""{DIGITS}, l AS (SELECT symbol, digit % 2 AS f, lag(digit % 2) OVER (PARTITION BY symbol ORDER BY i) AS b FROM d),
        s AS (SELECT symbol, count(*) AS n, sum(f) AS n1, count(*) FILTER (f <> b) + 1 AS runs FROM l GROUP BY symbol), e AS (SELECT *, 2.0 * n1 * (n - n1) / n + 1 AS mu FROM s)
        SELECT symbol, n, runs, round(mu, 6) AS expected, round((runs - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1)), 6) AS z FROM e""",
    "drift_ttest": f"{MOVES} SELECT symbol, count(*) AS n, round(avg(ret), 9) AS mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t FROM m GROUP BY symbol",
    "direction_shares": f"{MOVES} SELECT symbol, round(avg(CAST(dp > 0 AS INT)), 6) AS up, round(avg(CAST(dp < 0 AS INT)), 6) AS down, round(avg(CAST(dp = 0 AS INT)), 6) AS flat FROM m GROUP BY symbol",
    "best_conditional_cell": f"""{CELLS}, c AS (SELECT symbol, digit, sum(n) AS n, sum(n) FILTER (next <> digit) / sum(n) AS p FROM t GROUP BY ALL),
        w AS (SELECT symbol, digit, CAST(n AS BIGINT) AS n, round(p, 6) AS share, round((p + 2.576 * 2.576 / (2 * n) - 2.576 * sqrt((p * (1 - p) + 2.576 * 2.576 / (4 * n)) / n)) / (1 + 2.576 * 2.576 / n), 6) AS low FROM c)
        SELECT symbol, digit, n, share, low, low > 0.917 AS beats FROM w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY low DESC, digit) = 1""",
    "empirical_ev": f"""{DIGITS}, l AS (SELECT symbol, digit, lag(digit) OVER (PARTITION BY symbol ORDER BY i) AS b FROM d),
        k AS (SELECT symbol, contract, payout, CASE contract WHEN 'over0' THEN digit > 0 WHEN 'under9' THEN digit < 9 WHEN 'differs' THEN digit <> b WHEN 'even' THEN digit % 2 = 0 WHEN 'over4' THEN digit > 4 WHEN 'over7' THEN digit > 7 ELSE digit = b END AS win
        FROM l, (VALUES {", ".join(f"('{c}', {p}::DOUBLE)" for c, p in T.EMPIRICAL)}) v(contract, payout))
        SELECT symbol, contract, round(avg(CAST(win AS INT)), 6) AS win_rate, round(1 / any_value(payout), 6) AS break_even, round(avg(CAST(win AS INT)) * any_value(payout) - 1, 6) AS ev FROM k GROUP BY symbol, contract""",
    "return_acf": MOVES + _acf_sql("m", "ret", [1, 2, 3, 5, 10]) + " SELECT symbol, lag, round(r, 6) AS r, abs(r) > 1.96 / sqrt(n) AS flagged FROM acf",
    "sign_acf": MOVES + ", z AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY i) AS i, sign(dp) AS sg FROM m WHERE dp <> 0)" + _acf_sql("z", "sg", [1]) + " SELECT symbol, round(r, 6) AS r FROM acf",
    "cent_moments": f"{MOVES} SELECT symbol, round(avg(dp * 100), 6) AS mean, round(stddev_pop(dp * 100), 6) AS std, round(min(dp * 100), 6) AS least, round(max(dp * 100), 6) AS most FROM m GROUP BY symbol",
    "spike_stats": f"""{SPIKES}, o AS (SELECT symbol, side, count(*) AS n, count(*) FILTER (spike) AS spikes, round(avg(CAST(spike AS INT)), 6) AS rate, round(avg(abs(dp)) FILTER (small), 6) AS mean_small,
        round(avg(abs(dp)) FILTER (spike), 6) AS mean_spike, round(avg(abs(dp)) FILTER (spike) / avg(abs(dp)) FILTER (small), 6) AS ratio, round(sum(dp), 6) AS drift,
        round(coalesce(sum(abs(dp)) FILTER (small), 0), 6) AS favourable, round(coalesce(sum(abs(dp)) FILTER (spike), 0), 6) AS adverse FROM s GROUP BY symbol, side) SELECT *, round(favourable - adverse, 6) AS net FROM o""",
    "spike_gaps": f"{SPIKES} SELECT symbol, side, count(*) AS gaps, round(avg(gap), 6) AS mean, quantile_cont(gap, 0.5) AS median, max(gap) AS most, round(stddev_pop(gap), 6) AS std, round(stddev_pop(gap) / avg(gap), 6) AS std_by_mean FROM g GROUP BY symbol, side HAVING count(*) > 30",
    "hazard_buckets": f"{SPIKES} SELECT *, round(fired / at_risk, 6) AS hazard FROM h",
    "hazard_chi2": f"{SPIKES}, k AS (SELECT symbol, side, bucket, 1 AS hit, fired AS n FROM h WHERE bucket < 4 UNION ALL SELECT symbol, side, bucket, 0, at_risk - fired FROM h WHERE bucket < 4), t AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY symbol, side) = 8)"
    + _chi2("t", "symbol, side", "bucket", "hit"),
}
for _name in ("hazard_buckets", "hazard_chi2"):
    _large = ORACLE[_name].replace("THEN dp < 0 ELSE dp > 0 END AS spike", f"THEN dp <= -{LARGE} ELSE dp >= {LARGE} END AS spike")
    ORACLE["hazard_large" if _name == "hazard_buckets" else "hazard_chi2_large"] = _large


def _rising(x: str, top: str, bottom: str) -> str:
    """1 + x * top(1) / bottom(1) * (1 + x * top(2) / bottom(2) * (1 + ...)): a series of terms over 0, whose factors are in k."""
    return f"list_reduce(range(600, 0, -1), lambda s, k: 1 + ({x}) * ({top}) / ({bottom}) * s, 1::DOUBLE)"


def _chi2_sql(x: str, df: str) -> str:
    """1 minus the series of the lower incomplete gamma function."""
    a, y = f"(({df}) / 2::DOUBLE)", f"(({x}) / 2::DOUBLE)"
    return f"CASE WHEN {y} <= 0 THEN 1 WHEN {y} IS NOT NULL THEN round(1 - exp({a} * ln({y}) - {y} - lgamma({a} + 1)) * {_rising(y, '1', f'{a} + k')}, 6) END"


def _t_sql(t: str, df: str) -> str:
    """1 minus the series of the incomplete beta function, from the middle outwards."""
    a, y = f"(({df}) / 2::DOUBLE)", f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    front = f"exp(lgamma({a} + 0.5) - lgamma({a}) - lgamma(0.5) + 0.5 * ln({y}) + {a} * ln(1 - {y}))"
    return f"CASE WHEN {t} = 0 THEN 1 WHEN {t} IS NOT NULL THEN round(1 - 2 * {front} * {_rising(y, f'{a} + 0.5 + k - 1', '0.5 + k')}, 6) END"


ORACLE["battery_digits"] = f"""WITH u AS ({ORACLE["digit_uniformity"]}), m AS ({ORACLE["markov_chi2"]}), l AS ({ORACLE["ljung_box"]}), r AS ({ORACLE["runs_test"]})
    SELECT u.symbol, u.n, u.chi2, m.chi2 AS markov_chi2, m.df AS markov_df, l.q AS lb20, r.z, {_chi2_sql("u.chi2", "9")} AS uniform_p, {_chi2_sql("m.chi2", "m.df")} AS markov_p, {_chi2_sql("l.q", "20")} AS lb20_p, {_chi2_sql("r.z * r.z", "1")} AS runs_p
    FROM u JOIN m USING (symbol) JOIN l ON l.symbol = u.symbol AND l.m = 20 JOIN r ON r.symbol = u.symbol"""
_LB10 = MOVES + _acf_sql("m", "ret", list(range(1, 11))) + " SELECT symbol, round(any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)), 6) AS q FROM acf WHERE n > lag GROUP BY symbol"
ORACLE["battery_prices"] = f"""WITH t AS ({ORACLE["drift_ttest"]}), s AS ({ORACLE["direction_shares"]}), l AS ({_LB10})
    SELECT t.symbol, t.n, mean, t.t, up, down, flat, q, {_t_sql("t.t", "t.n - 1")} AS t_p, {_chi2_sql("q", "10")} AS lb10_p FROM t JOIN s USING (symbol) JOIN l USING (symbol)"""
ORACLE["hazard_test_large"] = f"WITH h AS ({ORACLE['hazard_chi2_large']}) SELECT *, {_chi2_sql('chi2', 'df')} AS p FROM h"
ORACLE["spike_report"] = f"""WITH s AS ({ORACLE["spike_stats"]}), g AS ({ORACLE["spike_gaps"]}), h AS ({ORACLE["hazard_chi2"]})
    SELECT *, {_chi2_sql("chi2", "df")} AS p FROM s LEFT JOIN g USING (symbol, side) LEFT JOIN h USING (symbol, side)"""
