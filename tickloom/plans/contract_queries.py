"""Queries over contracts and binary backtests, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.scalars import settles
from tickloom.operators import contracts as C
from tickloom.operators.ticks import with_digit
from tickloom.plans.tick_queries import DIGITS
from tickloom.sources.tables import ticks

EIGHT = [("DIGITDIFF", 5), ("DIGITMATCH", 5), ("DIGITEVEN", None), ("DIGITODD", None), ("DIGITOVER", 4), ("DIGITUNDER", 5), ("CALL", None), ("PUT", None)]


def _barrier():
    """A barrier in a result: -1 for none."""
    return F.coalesce("barrier", F.lit(-1)).alias("barrier")


def _context(spark, d, duration=1):
    return C.with_context(with_digit(ticks(spark, d)), duration=duration)


def _grid(spark, d):
    return C.job_grid(ticks(spark, d))


def job_grid(spark, d):
    return _grid(spark, d).select("symbol", "contract", _barrier(), "duration")


def house_edge(spark, d):
    out = C.house_edge(C.priced(_grid(spark, d), C.fallback(spark)))
    return out.select("symbol", "contract", _barrier(), "duration", "payout", F.round("true_p", 6).alias("true_p"), "break_even", "ev", "house_edge")


def edge_by_barrier(spark, d):
    """The plotted data of house edges by barrier."""
    return house_edge(spark, d).where("barrier >= 0 and ev is not null").select("symbol", "contract", "barrier", "house_edge").distinct()


def settle_contracts(spark, d):
    rows = _context(spark, d).where("exit_price is not null")
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("contract"), F.lit(b).cast("int").alias("barrier")) for c, b in EIGHT]))
    rows = rows.select("symbol", "i", "entry_price", "exit_price", "exit_digit", each)
    won = settles(F.col("contract"), F.col("barrier"), F.col("entry_price"), F.col("exit_price"), F.col("exit_digit"))
    return rows.withColumn("won", won).groupBy("symbol", "contract").agg(F.count("*").alias("n"), F.count_if("won").alias("wins"))


def _signals(rules):
    return lambda s, d: C.signals(_context(s, d), rules).select("symbol", "rule", "i", "contract", _barrier())


def _quotes(spark, d):
    """Quotes of each symbol's grid, as known from the fallback; symbols differ by a thousandth."""
    q = C.priced(_grid(spark, d), C.fallback(spark)).withColumn("payout", F.round(F.col("payout") + F.length("symbol") / 1000, 4))
    return C.last_quotes(q, "duration", with_duration=False)


def payout_lookup(spark, d):
    taken = C.selected(C.signals(_context(spark, d), list(C.RULES)))
    out = C.look_up(taken, _quotes(spark, d), C.fallback(spark))
    return out.groupBy("symbol", "rule", "contract", _barrier(), "payout").agg(F.count("*").alias("n"))


def _taken(spark, d, duration=1, cooldown=0):
    taken = C.selected(C.signals(_context(spark, d, duration), list(C.RULES)), duration, cooldown)
    return C.look_up(taken, _quotes(spark, d), C.fallback(spark))


def _trades(spark, d, duration=1, cooldown=0):
    return C.trades(_taken(spark, d, duration, cooldown))


#: Combos whose stakes see the bankroll; their account goes on with what is left.
LIVE = [("even_tenth", "even", "tenth"), ("differs_tenth", "differs", "tenth"), ("even_martingale_on", "even", "martingale")]


def bt_live_stakes(spark, d):
    return C.summary(C.trades_in_turn(_taken(spark, d), LIVE, stop_at_ruin=False))


def _equity(prefix):
    return lambda s, d: C.equity(_trades(s, d)).where(F.col("combo").endswith(prefix)).select("symbol", "combo", "k", "i", "won", F.round("stake", 6).alias("stake"), F.round("after", 6).alias("after"), F.round("drawdown", 6).alias("drawdown"))


QUERIES = {
    "job_grid": job_grid,
    "house_edge": house_edge,
    "edge_by_barrier": edge_by_barrier,
    "settle_contracts": settle_contracts,
    "signals_momentum": _signals(["momentum3"]),
    "signals_meanrev": _signals(["meanrev3"]),
    "signals_gambler": _signals(["gambler_low", "gambler_match"]),
    "signals_digits": _signals(["differs", "even", "over0"]),
    "payout_lookup": payout_lookup,
    "bt_flat": _equity("flat"),
    "bt_martingale": _equity("_martingale"),
    "bt_anti_martingale": _equity("anti_martingale"),
    "bt_equity_curve": lambda s, d: C.equity(_trades(s, d)).select("symbol", "combo", "k", F.round("after", 6).alias("after"), F.round("peak", 6).alias("peak")),
    "bt_summary": lambda s, d: C.summary(_trades(s, d)),
    "bt_duration5": lambda s, d: C.summary(_trades(s, d, duration=5)),
    "bt_cooldown": lambda s, d: C.summary(_trades(s, d, cooldown=7)),
    "bt_live_stakes": bt_live_stakes,
    "bt_report": lambda s, d: C.report_lines(C.summary(_trades(s, d))),
}

_FALL = ", ".join(f"('{c}', {'NULL' if b is None else b}::INT, {p}::DOUBLE)" for c, b, p in C.FALLBACK)
GRID = f"""{DIGITS}, y AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS p FROM (SELECT DISTINCT symbol FROM d)),
fb(contract, barrier, payout) AS (VALUES {_FALL}),
j AS (SELECT symbol, v.contract, v.barrier, 1 AS duration FROM y, (
    SELECT 'DIGITOVER' AS contract, CAST(x AS INT) AS barrier FROM range(0, 9) r(x) UNION ALL SELECT 'DIGITUNDER', CAST(x AS INT) FROM range(1, 10) r(x)
    UNION ALL VALUES ('DIGITDIFF', 5), ('DIGITMATCH', 5), ('DIGITEVEN', NULL), ('DIGITODD', NULL)) v WHERE p <= 4
  UNION ALL SELECT symbol, v.contract, NULL, v.duration FROM y, (VALUES ('CALL', 1), ('CALL', 5), ('PUT', 1), ('PUT', 5)) v(contract, duration)),
p AS (SELECT j.*, fb.payout FROM j LEFT JOIN fb ON fb.contract = j.contract AND (fb.barrier IS NULL OR fb.barrier = j.barrier)),
he AS (SELECT *, CASE contract WHEN 'DIGITOVER' THEN (9 - barrier) / 10 WHEN 'DIGITUNDER' THEN barrier / 10 WHEN 'DIGITDIFF' THEN 0.9::DOUBLE WHEN 'DIGITMATCH' THEN 0.1::DOUBLE WHEN 'DIGITEVEN' THEN 0.5::DOUBLE WHEN 'DIGITODD' THEN 0.5::DOUBLE END AS true_p FROM p),
q AS (SELECT symbol, contract, barrier, arg_max(round(payout + length(symbol) / 1000, 4), duration) AS payout FROM p WHERE payout IS NOT NULL GROUP BY ALL)"""
CONTEXT = f"""{GRID}, x AS (SELECT symbol, i, price, digit, count(*) OVER (PARTITION BY symbol) AS ticks, lag(digit) OVER w AS prev_digit,
    CAST(price > lag(price) OVER w AS INT) AS up, CAST(price < lag(price) OVER w AS INT) AS down, lead(price) OVER w AS entry_price, lead(price, 2) OVER w AS exit_price, lead(digit, 2) OVER w AS exit_digit
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY i)),
k3 AS (SELECT *, sum(up) OVER w AS ups, sum(down) OVER w AS downs FROM x WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING)),
sg AS (SELECT symbol, i, ticks, entry_price, exit_price, exit_digit, v.rule, v.contract, CAST(CASE v.b WHEN -1 THEN NULL WHEN -2 THEN digit ELSE v.b END AS INT) AS barrier
  FROM k3, (VALUES ('differs', 'DIGITDIFF', -2), ('even', 'DIGITEVEN', -1), ('over0', 'DIGITOVER', 0), ('gambler_low', 'DIGITOVER', 3), ('gambler_match', 'DIGITDIFF', -2), ('momentum3', 'CALL', -1), ('meanrev3', 'CALL', -1)) v(rule, contract, b)
  WHERE CASE v.rule WHEN 'gambler_low' THEN digit <= 2 WHEN 'gambler_match' THEN digit = prev_digit WHEN 'momentum3' THEN i >= 3 AND ups = 3 WHEN 'meanrev3' THEN i >= 3 AND downs = 3 ELSE true END)"""
TAKEN = f"""{CONTEXT}, r1 AS (SELECT *, i - row_number() OVER (PARTITION BY symbol, rule ORDER BY i) AS run FROM sg WHERE i >= 1 AND i < ticks - 3),
tk AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY symbol, rule, run ORDER BY i) % 2 = 1),
pl AS (SELECT tk.*, coalesce(q.payout, fb.payout) AS payout FROM tk LEFT JOIN q ON q.symbol = tk.symbol AND q.contract = tk.contract AND q.barrier IS NOT DISTINCT FROM tk.barrier
  LEFT JOIN fb ON fb.contract = tk.contract AND (fb.barrier IS NULL OR fb.barrier = tk.barrier))"""


def _spaced_sql(duration: int, cooldown: int) -> str:
    """TAKEN for other contracts: the next trade is the first signal at the wanted distance, followed by recursion."""
    context = CONTEXT.replace("WITH ", "WITH RECURSIVE ", 1).replace("lead(price, 2) OVER w AS exit_price, lead(digit, 2) OVER w AS exit_digit", f"lead(price, {1 + duration}) OVER w AS exit_price, lead(digit, {1 + duration}) OVER w AS exit_digit")
    return f"""{context}, ok AS (SELECT * FROM sg WHERE i >= 1 AND i < ticks - 3 AND i + 1 + {duration} < ticks),
nx AS (SELECT symbol, rule, i, min(i) OVER (PARTITION BY symbol, rule ORDER BY i RANGE BETWEEN {1 + max(duration, cooldown)} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ok),
walk AS (SELECT symbol, rule, min(i) AS i FROM ok GROUP BY ALL UNION ALL SELECT nx.symbol, nx.rule, nx.nxt FROM walk JOIN nx USING (symbol, rule, i) WHERE nx.nxt IS NOT NULL),
tk AS (SELECT ok.* FROM ok JOIN walk USING (symbol, rule, i)),"""


_COMBOS = ", ".join(f"('{n}', '{r}', '{s}')" for n, r, s in C.COMBOS)
_MONEY = f"""w1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, rule ORDER BY i) AS k,
    CASE contract WHEN 'DIGITDIFF' THEN exit_digit <> barrier WHEN 'DIGITEVEN' THEN exit_digit % 2 = 0 WHEN 'DIGITOVER' THEN exit_digit > barrier WHEN 'CALL' THEN exit_price > entry_price END AS won FROM pl),
w2 AS (SELECT *, k - 1 - coalesce(max(CASE WHEN won THEN k END) OVER w, 0) AS lb, k - 1 - coalesce(max(CASE WHEN NOT won THEN k END) OVER w, 0) AS wb
  FROM w1 WINDOW w AS (PARTITION BY symbol, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w3 AS (SELECT symbol, i, k, won, payout, c.combo, greatest(0.35::DOUBLE, CASE c.stake WHEN 'flat' THEN 0.35::DOUBLE WHEN 'martingale' THEN 0.35::DOUBLE * pow(2.0, lb) ELSE 0.35::DOUBLE * pow(2.0, least(wb, 4)) END) AS stake
  FROM w2 JOIN (VALUES {_COMBOS}) c(combo, rule, stake) USING (rule)),
w4 AS (SELECT *, round(CASE WHEN won THEN stake * (payout - 1) ELSE -stake END, 8) AS pnl FROM w3),
w5 AS (SELECT *, round(10 + sum(pnl) OVER (PARTITION BY symbol, combo ORDER BY k), 8) AS after FROM w4),
w6 AS (SELECT *, round(after - pnl, 8) AS before FROM w5),
w7 AS (SELECT *, max(CAST(stake > before AS INT)) OVER (PARTITION BY symbol, combo ORDER BY k) AS unfunded,
    coalesce(max(CAST(after < 0.35 AS INT)) OVER (PARTITION BY symbol, combo ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broke FROM w6),
eq AS (SELECT *, greatest(10::DOUBLE, max(after) OVER (PARTITION BY symbol, combo ORDER BY k)) AS peak FROM w7 WHERE unfunded = 0 AND broke = 0)"""
TRADES = f"{TAKEN}, {_MONEY}"
_PAID = TAKEN[TAKEN.index("pl AS (") :]


def _spaced_trades(duration: int = 1, cooldown: int = 0) -> str:
    return f"{_spaced_sql(duration, cooldown)} {_PAID}, {_MONEY}"


def _hair(x: str, digits: int = 6) -> str:
    """Rounded with a hair more than half, as the operator does."""
    return f"floor(({x}) * 1e{digits}::DOUBLE + 0.500001::DOUBLE) / 1e{digits}::DOUBLE"


_SUMMARY = f""", s1 AS (SELECT symbol, combo, count(*) AS trades, count(*) FILTER (won) AS wins, sum(stake) AS staked, arg_max(after, k) AS e, max(round(peak - after, 8)) AS dd FROM eq GROUP BY ALL),
        s2 AS (SELECT symbol, combo, max(CASE WHEN unfunded = 1 AND broke = 0 THEN 1 END) AS u FROM w7 GROUP BY ALL)
        SELECT symbol, combo, trades, wins, trades - wins AS losses, {_hair("wins / trades")} AS win_rate, {_hair("staked")} AS staked, {_hair("e - 10")} AS net, {_hair("(e - 10) / staked")} AS roi, {_hair("(e - 10) / trades")} AS ev_per_trade,
        {_hair("dd")} AS max_drawdown, {_hair("e")} AS "end", e < 0.35 AS ruined, CASE WHEN e < 0.35 THEN 'ruined' WHEN u = 1 THEN 'unfunded' ELSE 'end' END AS stop FROM s1 JOIN s2 USING (symbol, combo)"""


_LIVE_COMBOS = ", ".join(f"('{n}', '{r}', '{s}')" for n, r, s in LIVE)
#: Stakes that see the bankroll, trade by trade: what is wanted beyond the bankroll is cut to it.
_LIVE = f"""{TAKEN.replace("WITH ", "WITH RECURSIVE ", 1)}, {_MONEY[: _MONEY.index("w2 AS (")]}
lv AS (SELECT symbol, combo, kind, k, won, payout FROM w1 JOIN (VALUES {_LIVE_COMBOS}) c(combo, rule, kind) USING (rule)),
tr AS (SELECT DISTINCT symbol, combo, kind, 0::BIGINT AS k, false AS won, 0::DOUBLE AS stake, 10::DOUBLE AS after, 0 AS lost FROM lv
  UNION ALL SELECT symbol, combo, kind, k, won, stake, {_hair("money + " + _hair("CASE WHEN won THEN stake * (payout - 1) ELSE -stake END", 8), 8)}, CASE WHEN won THEN 0 ELSE lost + 1 END
  FROM (SELECT lv.*, tr.after AS money, tr.lost, least(tr.after, greatest(0.35::DOUBLE, CASE lv.kind WHEN 'tenth' THEN tr.after / 10 ELSE 0.35::DOUBLE * pow(2.0, least(tr.lost, 60)) END)) AS stake
    FROM tr JOIN lv ON lv.symbol = tr.symbol AND lv.combo = tr.combo AND lv.k = tr.k + 1)),
w7 AS (SELECT *, 0 AS unfunded, 0 AS broke FROM tr WHERE k > 0),
eq AS (SELECT *, greatest(10::DOUBLE, max(after) OVER (PARTITION BY symbol, combo ORDER BY k)) AS peak FROM w7)"""


def _eq_sql(pattern: str) -> str:
    return f"{TRADES} SELECT symbol, combo, k, i, won, round(stake, 6) AS stake, round(after, 6) AS after, round(round(peak - after, 8), 6) AS drawdown FROM eq WHERE combo LIKE '{pattern}'"


def _sg_sql(rules: str) -> str:
    return f"{CONTEXT} SELECT symbol, rule, i, contract, coalesce(barrier, -1)::INT AS barrier FROM sg WHERE rule IN ({rules})"


ORACLE = {
    "job_grid": f"{GRID} SELECT symbol, contract, coalesce(barrier, -1)::INT AS barrier, duration FROM j",
    "house_edge": f"{GRID} SELECT symbol, contract, coalesce(barrier, -1)::INT AS barrier, duration, payout, round(true_p, 6) AS true_p, round(1 / payout, 4) AS break_even, round(true_p * payout - 1, 4) AS ev, -round(true_p * payout - 1, 4) AS house_edge FROM he",
    "edge_by_barrier": f"{GRID} SELECT DISTINCT symbol, contract, barrier, -round(true_p * payout - 1, 4) AS house_edge FROM he WHERE barrier IS NOT NULL AND true_p * payout IS NOT NULL",
    "settle_contracts": f"""{CONTEXT}, v AS (SELECT symbol, c.contract, CASE c.contract WHEN 'DIGITDIFF' THEN exit_digit <> 5 WHEN 'DIGITMATCH' THEN exit_digit = 5 WHEN 'DIGITEVEN' THEN exit_digit % 2 = 0 WHEN 'DIGITODD' THEN exit_digit % 2 = 1
        WHEN 'DIGITOVER' THEN exit_digit > 4 WHEN 'DIGITUNDER' THEN exit_digit < 5 WHEN 'CALL' THEN exit_price > entry_price ELSE exit_price < entry_price END AS won
        FROM x, (VALUES ('DIGITDIFF'), ('DIGITMATCH'), ('DIGITEVEN'), ('DIGITODD'), ('DIGITOVER'), ('DIGITUNDER'), ('CALL'), ('PUT')) c(contract) WHERE exit_price IS NOT NULL)
        SELECT symbol, contract, count(*) AS n, count(*) FILTER (won) AS wins FROM v GROUP BY ALL""",
    "signals_momentum": _sg_sql("'momentum3'"),
    "signals_meanrev": _sg_sql("'meanrev3'"),
    "signals_gambler": _sg_sql("'gambler_low', 'gambler_match'"),
    "signals_digits": _sg_sql("'differs', 'even', 'over0'"),
    "payout_lookup": f"{TAKEN} SELECT symbol, rule, contract, coalesce(barrier, -1)::INT AS barrier, payout, count(*) AS n FROM pl GROUP BY ALL",
    "bt_flat": _eq_sql("%flat"),
    "bt_martingale": _eq_sql("%\\_martingale").replace("LIKE '%\\_martingale'", "LIKE '%\\_martingale' ESCAPE '\\'"),
    "bt_anti_martingale": _eq_sql("%anti_martingale"),
    "bt_equity_curve": f"{TRADES} SELECT symbol, combo, k, round(after, 6) AS after, round(peak, 6) AS peak FROM eq",
    "bt_summary": f"{TRADES}{_SUMMARY}",
    "bt_duration5": f"{_spaced_trades(duration=5)}{_SUMMARY}",
    "bt_cooldown": f"{_spaced_trades(cooldown=7)}{_SUMMARY}",
    "bt_live_stakes": f"{_LIVE}{_SUMMARY}",
    "bt_report": f"""WITH sm AS ({TRADES}{_SUMMARY}) SELECT symbol, combo || ': trades=' || trades || ' won=' || format('{{:.4f}}', win_rate * 100) || '% staked=' || format('{{:.6f}}', staked) || ' net=' || format('{{:.6f}}', net)
        || ' roi=' || format('{{:.4f}}', roi * 100) || '% drawdown=' || format('{{:.6f}}', max_drawdown) || ' end=' || format('{{:.6f}}', "end") || ' stop=' || stop AS line FROM sm""",
}
