"""Queries over the live rules, the paper trader, streams and file formats, and the SQL that checks them."""

from __future__ import annotations


from pyspark.sql import functions as F

from tickloom.functions import scalars as X
from tickloom.operators import contracts as C
from tickloom.operators import cot as K
from tickloom.operators import ports as P
from tickloom.operators import signals as S
from tickloom.plans.bar_queries import FRAME, RECURSION
from tickloom.plans.contract_queries import GRID
from tickloom.plans.research_queries import WEEKS, _bias, _series
from tickloom.sources import files
from tickloom.sources.asked import ask_quotes, quote_records
from tickloom.sources.live import LiveTicks
from tickloom.sources.reports import ReportFile
from tickloom.sources.shared import new_path
from tickloom.sources.tables import BARS, PAIR_PLACES, TICKS, bars, bars_raw, table, ticks
from tickloom.streaming import bars as stream_bars
from tickloom.streaming import paper

PAIR_NAMES = [p for p, _, _ in PAIR_PLACES]


def _r(n, *names):
    return [F.round(c, n).alias(c) for c in names]


def _frame(spark, d):
    return S.frame(bars(spark, d))


def daily_breaker(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), (F.col("value") + 1000).alias("equity"))
    return P.daily_breaker(e).select("symbol", "seq", *_r(6, "day_start", "drawdown_pct"), "halted")


def session_filter(spark, d):
    e = table(spark, d, "events")
    return e.where(X.in_session(F.col("ts"), 7, 20, monday=True, friday=False)).groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))


def symbol_normalize(spark, d):
    """Broker-like names: those of parts and nations, and some with a metal in them."""
    parts = table(spark, d, "part").select(F.col("p_name").alias("name"))
    nations = table(spark, d, "nation").select(F.explode(F.array(F.concat("n_name", F.lit(".m")), F.concat(F.lit("xau#"), F.lower("n_name")), F.concat(F.substring("n_name", 1, 2), F.lit("Silver_")))).alias("name"))
    return parts.unionByName(nations).distinct().select("name", X.symbol_of(F.col("name")).alias("symbol"))


def _payloads(spark, d):
    """Each week's bias of every pair as the service's JSON: the first three pairs as currencies, the others as metals."""
    rows = K.bias_user(_series(spark, d)).select("date", F.struct("pair", X.bias_label(F.col("bias")).alias("bias")).alias("e"), (F.col("pair") < "4").alias("currency"))
    of = lambda flag: F.array_sort(F.collect_list(F.when(F.col("currency") == flag, F.col("e"))))
    weeks = rows.groupBy("date").agg(of(True).alias("currencies"), of(False).alias("metals"))
    return weeks.select(F.to_json(F.struct("currencies", "metals", F.col("date").cast("string").alias("as_of"))).alias("value"))


def bias_json(spark, d):
    return files.biases(_payloads(spark, d)).select("pair", "bias", "as_of", X.bias_code(F.col("bias")).alias("code"), X.bias_label(X.bias_code(F.col("bias"))).alias("label"))


def effective_bias(spark, d):
    """What each customer's settings make of the last week's bias of a pair; every seventh asks for a pair that has none."""
    live = bias_json(spark, d)
    last = live.groupBy("pair").agg(F.max_by("code", "as_of").alias("code"))
    key = F.col("c_custkey")
    pair = F.when(key % 7 == 0, "NONE").otherwise(F.element_at(F.array(*map(F.lit, PAIR_NAMES)), (key % 5 + 1).cast("int")))
    asked = table(spark, d, "customer").select("c_custkey", pair.alias("pair"), (key % 3 != 0).alias("valid"), F.element_at(F.array(*map(F.lit, ["ALLOW", "BLOCK", "MANUAL"])), (key % 4 % 3 + 1).cast("int")).alias("fallback"), F.when(F.col("c_acctbal") < 0, -1).otherwise(1).alias("manual"))
    code = X.effective_bias(F.coalesce("code", F.lit(-99)), F.col("valid"), F.col("fallback"), F.col("manual"))
    return asked.join(last, "pair", "left").select("c_custkey", "pair", "valid", "fallback", code.alias("code"), X.bias_label(code).alias("label"))


def quoted_by_fallback(symbol, contract, barrier, duration):
    """A client of ``asked``: the fallback's payout."""
    return next(p for c, b, p in C.FALLBACK if c == contract and b in (None, barrier))


def asked_quotes(spark, d):
    """The grid of jobs asked of a client, written as one array of quotes, and read again."""
    spark.dataSource.register(ReportFile)
    asked = ask_quotes(C.job_grid(ticks(spark, d)), "tickloom.plans.port_queries:quoted_by_fallback")
    path = new_path(spark, "quotes") + ".json"
    quote_records(asked).write.format("report_file").mode("overwrite").options(path=path, kind="json").save()
    return files.read_quotes(spark, path).select("symbol", "contract", F.coalesce("barrier", F.lit(-1)).alias("barrier"), "duration", "payout", *_r(6, "true_p"))


def htf_confirm(spark, d):
    return P.higher_frame(bars(spark, d))


def expert_signals(spark, d):
    bias = _bias(spark, d)
    rows = P.expert_signals(_frame(spark, d), htf_confirm(spark, d), bias, F.weekday("date") < 5)
    return rows.where("order <> 0")


def expert_guarded(spark, d):
    """The expert's orders with a spread of a tenth of the bar's range, and no entries on days whose orders fell 60 % below the first."""
    equity = bars_raw(spark, d).where("symbol is not null and date is not null").select("symbol", F.col("date").cast("timestamp").alias("ts"), "seq", F.col("price").alias("equity"))
    halted = P.daily_breaker(equity, 60.0).where("halted").select("symbol", F.to_date("ts").alias("date"))
    tight = X.spread_ok(F.col("low") + 0.1 * (F.col("high") - F.col("low")), F.col("low"), F.col("atr"))
    return P.expert_signals(_frame(spark, d), htf_confirm(spark, d), _bias(spark, d), F.weekday("date") < 5, tight=tight, halted=halted).where("order <> 0")


def managed_stops(spark, d):
    return P.managed_stops(_frame(spark, d)).select("symbol", "opened", "side", "step", *_r(4, "price", "stop"), "exit")


def lot_size(spark, d):
    return P.order_plan(_frame(spark, d), 10_000.0).select("symbol", "date", "side", *_r(4, "stop_distance", "take_distance", "lots"))


def chart_signals(spark, d):
    return P.chart_signals(_frame(spark, d)).select("symbol", "date", "side", *_r(4, "arrow"))


def script_variant(spark, d):
    return P.script_variant(_frame(spark, d)).where("rank100 is not null").select("symbol", "date", "dip", *_r(4, "rank100"))


def dashboard(spark, d):
    return P.dashboard(_frame(spark, d)).select("symbol", "date", "regime", "st_dir", *_r(4, "adx", "atr", "atr_pct"))


def closed_bars(spark, d):
    return P.closed_bars(bars(spark, d)).select("symbol", "date", "close")


def open_positions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), (F.col("o_custkey") % 2 == 0).alias("ours"), (F.col("o_orderstatus") == "O").alias("open"))
    return P.open_positions(o)


def price_segment(spark, d):
    """The plotted data of a price segment: each symbol's first 6000 ticks."""
    return ticks(spark, d).where("i < 6000").select("symbol", "i", "price")


PAYOUTS = paper.payout_map(C.FALLBACK)


def _ledger(rows):
    """Rows without nulls: -1 for no barrier or payout, false for what was not won."""
    return rows.select("symbol", "n", "i", "contract", F.coalesce("barrier", F.lit(-1)).alias("barrier"), F.coalesce("won", F.lit(False)).alias("won"), *_r(6, "stake"), F.coalesce("payout", F.lit(-1.0)).alias("payout"), *_r(6, "bankroll", "drawdown"), "status")


def paper_trader_batch(spark, d):
    return _ledger(paper.paper_batch(ticks(spark, d).select("symbol", "i", "price"), PAYOUTS, strategy="even", martingale=True))


def paper_trader_summary(spark, d):
    rows = paper.summary(paper.paper_batch(ticks(spark, d).select("symbol", "i", "price"), PAYOUTS, strategy="momentum"))
    return rows.select("symbol", "trades", "wins", *_r(6, "staked", "net", "roi", "max_drawdown"), "status")


def _streamed(spark, feed, build, schema, mode="append"):
    """Run ``build`` over the files of ``feed`` as a stream to its end, all in one micro-batch; what its sink then holds."""
    source = spark.readStream.schema(schema).parquet(feed)
    sink, log = new_path(spark, "sink"), new_path(spark, "stream-log")
    built = build(source)
    query = built.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(built.schema).parquet(sink)


def paper_trader_stream(spark, d):
    """The paper trader over three parts of the ticks that follow each other, a micro-batch each; a part's symbols lie in files of their own."""
    rows, feed = ticks(spark, d).select("symbol", "i", "price"), new_path(spark, "feed")
    third = F.floor(F.col("i") * 3 / (rows.agg(F.max("i").alias("m")).first()["m"] + 1))
    sink, log = new_path(spark, "sink"), new_path(spark, "stream-log")
    for k in range(3):
        rows.where(third == k).repartition("symbol").write.mode("append").parquet(feed)
        # Each run takes what is new in the feed, with the state of the runs before.
        built = paper.paper_stream(spark.readStream.schema(rows.schema).parquet(feed), PAYOUTS, strategy="even", martingale=True)
        built.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _ledger(spark.read.schema(built.schema).parquet(sink))


def paper_trader_live(spark, d):
    """The paper trader on the live source: recorded messages of all ticks, known up to a half at first, then all."""
    spark.dataSource.register(LiveTicks)
    feed, sink, log = (new_path(spark, n) for n in ("feed", "sink", "stream-log"))
    rows = ticks(spark, d).select("symbol", "i", F.to_json(F.struct(F.lit("tick").alias("msg_type"), F.struct(F.col("price").alias("quote"), "epoch").alias("tick"))).alias("value"))
    # Files follow each other in order of their names; a symbol's file is in its order.
    rows.repartition("symbol").sortWithinPartitions("symbol", "i").drop("i").write.partitionBy("symbol").text(feed)
    symbols = [r.symbol for r in table(spark, d, "events").select(F.col("event_type").alias("symbol")).dropna().distinct().collect()]
    half = rows.groupBy("symbol").count().agg(F.max("count").alias("m")).first()["m"] // 2
    for upto in (half, 1 << 62):
        source = spark.readStream.format("live_ticks").options(symbols=",".join(symbols), client="tickloom.sources.live:recorded", feed=feed, upto=str(upto)).load()
        built = paper.paper_stream(source.select("symbol", "i", "price"), PAYOUTS, strategy="even", martingale=True)
        built.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _ledger(spark.read.schema(built.schema).parquet(sink))


def stream_bars_4h(spark, d):
    """Four-hour bars of the events as a stream; windows that the watermark has not passed are not there yet."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    feed = new_path(spark, "feed")
    rows.write.parquet(feed)
    return _streamed(spark, feed, stream_bars.tick_bars, rows.schema)


QUERIES = {
    "daily_breaker": daily_breaker,
    "session_filter": session_filter,
    "symbol_normalize": symbol_normalize,
    "bias_json": bias_json,
    "effective_bias": effective_bias,
    "htf_confirm": htf_confirm,
    "expert_signals": expert_signals,
    "expert_guarded": expert_guarded,
    "managed_stops": managed_stops,
    "lot_size": lot_size,
    "chart_signals": chart_signals,
    "script_variant": script_variant,
    "dashboard": dashboard,
    "closed_bars": closed_bars,
    "open_positions": open_positions,
    "price_segment": price_segment,
    "paper_trader_batch": paper_trader_batch,
    "paper_trader_summary": paper_trader_summary,
    "paper_trader_stream": paper_trader_stream,
    "paper_trader_live": paper_trader_live,
    "asked_quotes": asked_quotes,
    "stream_bars": stream_bars_4h,
}

_CODE = "CASE upper(bias) WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END"
_LABEL = "CASE code WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' WHEN 9 THEN 'BLOCK' ELSE 'UNCERTAIN' END"
#: The weekly mean, over the weeks of the bars.
_HTF = """wk AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS u, arg_max(close, date) AS close, row_number() OVER (PARTITION BY symbol ORDER BY CAST(date_trunc('week', date) AS DATE)) - 1 AS k FROM bars GROUP BY symbol, CAST(date_trunc('week', date) AS DATE)),
em AS (SELECT symbol, k, close, close AS e FROM wk WHERE k = 0 UNION ALL SELECT wk.symbol, wk.k, wk.close, em.e + (2::DOUBLE / 51) * (wk.close - em.e) FROM em JOIN wk ON wk.symbol = em.symbol AND wk.k = em.k + 1),
hd AS (SELECT w.symbol, w.u, CAST(sign(em.close - em.e) AS INT) AS dir FROM wk w JOIN em ON em.symbol = w.symbol AND em.k = w.k - 1),
hx AS (SELECT bars.symbol, bars.date, coalesce(hd.dir, 0) AS htf_dir FROM bars LEFT JOIN hd ON hd.symbol = bars.symbol AND hd.u = CAST(date_trunc('week', bars.date) AS DATE))"""

#: The trader with strategy "even" and doubled stakes, tick by tick: state after each tick, and its ledger row if there is one.
def _trader(hit: str, asks: str, doubled: int, payout: float) -> str:
    """The paper trader tick by tick: ``hit`` says whether a contract that ends here wins, ``asks`` whether the rule asks for one."""
    return f"""WITH RECURSIVE {TICKS}, dg AS (SELECT symbol, i, coalesce({hit}, false) AS hit, coalesce({asks}, false) AS asks FROM (SELECT *, CAST(round_even(price * 100, 0) AS BIGINT) % 10 AS digit, lag(price, 1) OVER w AS p1, lag(price, 2) OVER w AS p2, lag(price, 3) OVER w AS p3 FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY i))),
pt AS (
  SELECT symbol, -1::BIGINT AS i, 10::DOUBLE AS bank, 0 AS losses, 10::DOUBLE AS peak, 0::DOUBLE AS dd, -1::BIGINT AS exit_i, 0::DOUBLE AS staked, 0 AS n, '' AS done, false AS row, NULL::BOOLEAN AS won, 0::DOUBLE AS stake FROM (SELECT DISTINCT symbol FROM dg)
  UNION ALL
  SELECT symbol, i, bank, losses, peak, dd, CASE WHEN opens THEN i + 2 WHEN settled THEN -1 ELSE exit_i END, CASE WHEN opens THEN want ELSE staked END, n, CASE WHEN ended <> '' THEN ended WHEN decides AND want > bank THEN 'unfunded' ELSE '' END,
    (settled OR decides AND want > bank) AND was = '', CASE WHEN settled THEN hit END, CASE WHEN settled THEN staked ELSE want END
  FROM (SELECT *, decides AND want <= bank AS opens FROM (SELECT *, ended = '' AND (exit_i < 0 OR settled) AND i >= 5 AND asks AS decides, 0.35::DOUBLE * pow(2, {doubled} * losses) AS want FROM (
    SELECT *, CASE WHEN was <> '' THEN was WHEN settled AND bank < 0.35 THEN 'ruined' WHEN settled AND n >= 200 THEN 'finished' ELSE '' END AS ended FROM (
      SELECT * REPLACE (greatest(peak, bank) AS peak, CASE WHEN settled THEN greatest(dd, greatest(peak, bank) - bank) ELSE dd END AS dd) FROM (
        SELECT symbol, i, was, settled, hit, asks, exit_i, staked, peak, dd, CASE WHEN NOT settled THEN bank WHEN hit THEN bank + staked * ({payout}::DOUBLE - 1) ELSE bank - staked END AS bank, CASE WHEN NOT settled THEN losses WHEN hit THEN 0 ELSE losses + 1 END AS losses, n + CAST(settled AS INT) AS n FROM (
          SELECT dg.symbol, dg.i, dg.hit, dg.asks, pt.bank, pt.losses, pt.peak, pt.dd, pt.exit_i, pt.staked, pt.n, pt.done AS was, pt.done = '' AND pt.exit_i >= 0 AND dg.i >= pt.exit_i AS settled FROM pt JOIN dg ON dg.symbol = pt.symbol AND dg.i = pt.i + 1)))))))
,lg AS (SELECT symbol, n, i, won, round(stake, 6) AS stake, CASE WHEN won IS NOT NULL THEN {payout}::DOUBLE ELSE -1 END AS payout, round(bank, 6) AS bankroll, round(dd, 6) AS drawdown, CASE WHEN done = '' THEN 'open' ELSE done END AS status FROM pt WHERE row)"""


_PAPER = _trader("digit % 2 = 0", "true", 1, 1.95)

ORACLE = {
    "stream_bars": """SELECT * FROM (SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts) AS start, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, ROW(ts, event_id)) AS close, count(*) AS volume
        FROM events WHERE ts IS NOT NULL GROUP BY 1, 2) WHERE start + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "daily_breaker": """WITH e AS (SELECT event_type AS symbol, event_id AS seq, ts, value + 1000 AS equity FROM events), s AS (SELECT *, first_value(equity) OVER w AS day_start FROM e WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq)),
        r AS (SELECT *, (day_start - equity) / day_start * 100 AS dd FROM s) SELECT symbol, seq, round(day_start, 6) AS day_start, round(dd, 6) AS drawdown_pct, bool_or(dd >= 5) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq) AS halted FROM r""",
    "session_filter": "SELECT event_type AS symbol, count(*) AS n FROM events WHERE hour(ts) >= 7 AND hour(ts) < 20 AND isodow(ts) <> 5 GROUP BY event_type",
    "symbol_normalize": """WITH n AS (SELECT p_name AS name FROM part UNION SELECT n_name || '.m' FROM nation UNION SELECT 'xau#' || lower(n_name) FROM nation UNION SELECT left(n_name, 2) || 'Silver_' FROM nation),
        p AS (SELECT name, regexp_replace(upper(name), '[^A-Z]', '', 'g') AS s FROM n)
        SELECT name, CASE WHEN s LIKE '%XAU%' OR s LIKE '%GOLD%' THEN 'XAUUSD' WHEN s LIKE '%XAG%' OR s LIKE '%SILVER%' THEN 'XAGUSD' ELSE left(s, 6) END AS symbol FROM p""",
    "bias_json": f"WITH {BARS}, {WEEKS}, c AS (SELECT pair, CAST(date AS VARCHAR) AS as_of, bias AS code FROM bu) SELECT pair, {_LABEL} AS bias, as_of, code, {_LABEL} AS label FROM c",
    "effective_bias": f"""WITH {BARS}, {WEEKS}, l AS (SELECT pair, arg_max(bias, date) AS live FROM bu GROUP BY pair),
        m AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NONE' ELSE {PAIR_NAMES}[c_custkey % 5 + 1] END AS pair, c_custkey % 3 <> 0 AS valid, ['ALLOW', 'BLOCK', 'MANUAL'][c_custkey % 4 % 3 + 1] AS fallback, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS manual FROM customer),
        c AS (SELECT m.*, CASE WHEN valid AND live IS NOT NULL THEN live WHEN fallback = 'BLOCK' THEN 9 WHEN fallback = 'MANUAL' THEN manual ELSE 0 END AS code FROM m LEFT JOIN l USING (pair)) SELECT c_custkey, pair, valid, fallback, code, {_LABEL} AS label FROM c""",
    "asked_quotes": f"{GRID} SELECT symbol, contract, coalesce(barrier, -1)::INT AS barrier, duration, payout, round(true_p, 6) AS true_p FROM he WHERE payout IS NOT NULL",
    "paper_trader_live": f"""{_PAPER} SELECT symbol, n, i, 'DIGITEVEN' AS contract, -1 AS barrier, coalesce(won, false) AS won, stake, payout, bankroll, drawdown, status FROM lg""",
    "htf_confirm": f"WITH RECURSIVE {BARS}, {_HTF} SELECT * FROM hx",
    "expert_signals": f"""{FRAME}, {_HTF}, {WEEKS}, w1 AS (SELECT fr.symbol, fr.date, CASE WHEN long_signal AND htf_dir >= 0 THEN 1 WHEN short_signal AND htf_dir <= 0 THEN -1 ELSE 0 END AS want, cot_bias FROM fr
        JOIN hx ON hx.symbol = fr.symbol AND hx.date = fr.date JOIN al ON al.pair = fr.symbol AND al.date = fr.date)
        SELECT symbol, date, want AS "order" FROM w1 WHERE want <> 0 AND cot_bias <> -want AND isodow(date) < 6""",
    "expert_guarded": f"""{FRAME}, {_HTF}, {WEEKS}, eq AS (SELECT symbol, date, seq, price, first_value(price) OVER (PARTITION BY symbol, date ORDER BY seq) AS opening FROM bars_raw WHERE symbol IS NOT NULL AND date IS NOT NULL),
        hl AS (SELECT DISTINCT symbol, date FROM eq WHERE (opening - price) / opening * 100 >= 60),
        w1 AS (SELECT fr.symbol, fr.date, high, low, atr, CASE WHEN long_signal AND htf_dir >= 0 THEN 1 WHEN short_signal AND htf_dir <= 0 THEN -1 ELSE 0 END AS want, cot_bias FROM fr
        JOIN hx ON hx.symbol = fr.symbol AND hx.date = fr.date JOIN al ON al.pair = fr.symbol AND al.date = fr.date)
        SELECT symbol, date, want AS "order" FROM w1 WHERE want <> 0 AND cot_bias <> -want AND isodow(date) < 6 AND low + 0.1::DOUBLE * (high - low) - low <= 0.1::DOUBLE * atr AND (symbol, date) NOT IN (SELECT (symbol, date) FROM hl)""",
    "paper_trader_batch": f"""{_PAPER} SELECT symbol, n, i, 'DIGITEVEN' AS contract, -1 AS barrier, coalesce(won, false) AS won, stake, payout, bankroll, drawdown, status FROM lg""",
    "paper_trader_stream": f"""{_PAPER} SELECT symbol, n, i, 'DIGITEVEN' AS contract, -1 AS barrier, coalesce(won, false) AS won, stake, payout, bankroll, drawdown, status FROM lg""",
    "paper_trader_summary": f"""{_trader("price > p2", "price > p1 AND p1 > p2 AND p2 > p3", 0, PAYOUTS["CALL"])}, sm AS (SELECT symbol, count(won) AS trades, count(*) FILTER (won) AS wins, sum(stake) FILTER (won IS NOT NULL) AS staked, arg_max(bank, i) - 10 AS net, max(dd) AS dd, arg_max(CASE WHEN done = '' THEN 'open' ELSE done END, i) AS status FROM pt WHERE row GROUP BY symbol)
        SELECT symbol, trades, wins, round(staked, 6) AS staked, round(net, 6) AS net, round(net / staked, 6) AS roi, round(dd, 6) AS max_drawdown, status FROM sm""",
    "lot_size": f"""{FRAME}, g AS (SELECT symbol, date, CASE WHEN long_signal THEN 1 ELSE -1 END AS side, greatest(2 * atr, 50000) AS sd, 2.5 * (2 * atr) AS td FROM fr WHERE long_signal OR short_signal)
        SELECT symbol, date, side, round(sd, 4) AS stop_distance, round(td, 4) AS take_distance, round(least(greatest(floor(50 / (sd * 0.01) / 0.01::DOUBLE) * 0.01, 0.01), 5.0), 4)::DOUBLE AS lots FROM g""",
    "managed_stops": f"""{FRAME}, la AS (SELECT *, lag(atr) OVER w AS pa, lead(open) OVER w AS entry FROM fr WINDOW w AS (PARTITION BY symbol ORDER BY i)),
        po AS (SELECT symbol, i AS opened, CASE WHEN long_signal THEN 1 ELSE -1 END AS side, entry, atr FROM la WHERE (long_signal OR short_signal) AND entry IS NOT NULL),
        st AS (SELECT po.symbol, opened, side, CAST(b.i - opened - 1 AS INT) AS step, side * b.close AS p, side * po.entry - 2 * po.atr AS s0, CASE WHEN side * b.close >= side * po.entry + 2 * b.pa THEN side * po.entry END AS ev, side * b.close - 3 * b.pa AS tr
          FROM po JOIN la b ON b.symbol = po.symbol AND b.i BETWEEN opened + 1 AND opened + 40),
        sp AS (SELECT *, greatest(s0, max(greatest(ev, tr)) OVER w) AS stop FROM st WINDOW w AS (PARTITION BY symbol, opened ORDER BY step)),
        se AS (SELECT *, CASE WHEN p <= coalesce(lag(stop) OVER w, s0) THEN 'stop' WHEN step = 39 THEN 'time' ELSE 'open' END AS exit FROM sp WINDOW w AS (PARTITION BY symbol, opened ORDER BY step)),
        sg AS (SELECT *, coalesce(bool_or(exit <> 'open') OVER (PARTITION BY symbol, opened ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM se)
        SELECT symbol, opened, side, step, round(side * p, 4) AS price, round(side * stop, 4) AS stop, exit FROM sg WHERE NOT gone""",
    "chart_signals": f"""{FRAME} SELECT symbol, date, CASE WHEN long_signal THEN 1 ELSE -1 END AS side, round(CASE WHEN long_signal THEN low - 0.3 * atr ELSE high + 0.3 * atr END, 4) AS arrow
        FROM (SELECT *, max(i) OVER (PARTITION BY symbol) AS last FROM fr) WHERE i < last AND (long_signal OR short_signal)""",
    "script_variant": f"""{RECURSION}, v AS (SELECT symbol, date, atr, min(low) OVER (PARTITION BY symbol ORDER BY i ROWS 5 PRECEDING) <= ema_pullback AS dip, list(atr) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS b FROM ind)
        SELECT symbol, date, dip, round(len([x FOR x IN b IF x <= atr]) / 100 * 100, 4) AS rank100 FROM v WHERE len(b) = 100""",
    "dashboard": f"{FRAME} SELECT symbol, date, regime, st_dir, round(adx, 4) AS adx, round(atr, 4) AS atr, round(atr_pct, 4) AS atr_pct FROM fr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1",
    "closed_bars": f"WITH {BARS} SELECT symbol, date, close FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS m FROM bars) WHERE date < m",
    "open_positions": "SELECT o_orderpriority AS symbol, count(*) FILTER (o_custkey % 2 = 0 AND o_orderstatus = 'O') AS positions FROM orders GROUP BY o_orderpriority",
    "price_segment": f"WITH {TICKS} SELECT symbol, i, price FROM ticks WHERE i < 6000",
}
