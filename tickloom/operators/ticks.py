"""Statistics of tick series: digits, memory, drift, spikes. One row per symbol unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import decimals_of, last_digit
from tickloom.sources.tables import by_chunk, chunked, own_rows


def with_digit(ticks: DataFrame, decimals: int = 2) -> DataFrame:
    return ticks.withColumn("digit", last_digit(F.col("price"), decimals))


def lagged(df: DataFrame, column: str, lags: list[int]) -> DataFrame:
    """``df`` with ``lag_L``: the column L places of ``i`` earlier."""
    near = chunked(df, "symbol", max(lags), 0)
    return own_rows(near.withColumns({f"lag_{k}": F.lag(column, k).over(by_chunk()) for k in lags}))


def increments(ticks: DataFrame) -> DataFrame:
    """symbol, i, dp, ret: each tick's change of price and of its logarithm; a symbol's first tick has none."""
    rows = lagged(ticks, "price", [1]).where("lag_1 is not null")
    return rows.select("symbol", "i", (F.col("price") - F.col("lag_1")).alias("dp"), (F.log("price") - F.log("lag_1")).alias("ret"))


def decimals(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(decimals_of(F.col("price")).alias("decimals"))


def histogram(digits: DataFrame) -> DataFrame:
    """symbol, digit, n: every digit, also those that do not occur."""
    counts = digits.groupBy("symbol").agg(*[F.count_if(F.col("digit") == k).alias(f"_{k}") for k in range(10)])
    return counts.select("symbol", F.inline(F.array(*[F.struct(F.lit(k).alias("digit"), F.col(f"_{k}").alias("n")) for k in range(10)])))


def uniformity(digits: DataFrame) -> DataFrame:
    e = F.sum("n") / 10
    return histogram(digits).groupBy("symbol").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("n")) / e - F.sum("n"), 6).alias("chi2"))


def transitions(digits: DataFrame) -> DataFrame:
    """symbol, digit, next, n."""
    near = own_rows(chunked(digits, "symbol", 0, 1).withColumn("next", F.lead("digit").over(by_chunk())))
    return near.where("next is not null").groupBy("symbol", "digit", "next").agg(F.count("*").alias("n"))


def independence(cells: DataFrame, keys: list[str], row: str, col: str, n: str = "n") -> DataFrame:
    """chi2 and df of independence of ``row`` and ``col`` in a table of counts (absent cells are 0)."""
    rows = cells.groupBy(*keys, row).agg(F.sum(n).alias("_r"))
    cols = cells.groupBy(*keys, col).agg(F.sum(n).alias("_c"))
    total = cells.groupBy(*keys).agg(F.sum(n).alias("_n"))
    grid = rows.join(cols, keys).join(total, keys).join(cells, [*keys, row, col], "left").where("_n > 0")
    e = F.col("_r") * F.col("_c") / F.col("_n")
    part = F.pow(F.coalesce(F.col(n), F.lit(0)) - e, F.lit(2)) / e
    return grid.where(e > 0).groupBy(*keys).agg(F.round(F.sum(part), 6).alias("chi2"), ((F.countDistinct(row) - 1) * (F.countDistinct(col) - 1)).alias("df"))


def autocorrelation(df: DataFrame, x: Column, lags: list[int]) -> DataFrame:
    """symbol, lag, r, n: the lag product over all by the square, both about the mean of all."""
    rows = df.select("symbol", "i", x.cast("double").alias("_x"))
    mean = rows.groupBy("symbol").agg(F.avg("_x").alias("_m"))
    c = rows.join(mean, "symbol").select("symbol", "i", (F.col("_x") - F.col("_m")).alias("_c"))
    sums = lagged(c, "_c", lags).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s"), *[F.sum(F.col("_c") * F.col(f"lag_{k}")).alias(f"_p{k}") for k in lags])
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.try_divide(F.col(f"_p{k}"), F.col("_s")), F.lit(0.0)).alias("r")) for k in lags]))
    return sums.select("symbol", "n", pairs)


def ljung_box(df: DataFrame, x: Column, spans: list[int]) -> DataFrame:
    """symbol, m, q."""
    r = autocorrelation(df, x, list(range(1, max(spans) + 1)))
    m = r.withColumn("m", F.explode(F.array(*map(F.lit, spans)))).where("lag <= m and n > lag")
    return m.groupBy("symbol", "m").agg(F.round(F.first("n") * (F.first("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))), 6).alias("q"))


def runs_test(df: DataFrame, flag: Column) -> DataFrame:
    """symbol, n, runs, expected, z of the runs of a yes-no series."""
    rows = lagged(df.select("symbol", "i", flag.cast("int").alias("_f")), "_f", [1])
    s = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("_f").alias("_n1"), (F.count_if(F.col("_f") != F.col("lag_1")) + 1).alias("runs"))
    s = s.withColumn("_mu", 2.0 * F.col("_n1") * (F.col("n") - F.col("_n1")) / F.col("n") + 1)
    var = (F.col("_mu") - 1) * (F.col("_mu") - 2) / (F.col("n") - 1)
    return s.select("symbol", "n", "runs", F.round("_mu", 6).alias("expected"), F.round(F.try_divide(F.col("runs") - F.col("_mu"), F.sqrt(F.when(var > 0, var))), 6).alias("z"))


def t_statistic(df: DataFrame, x: str) -> DataFrame:
    """symbol, n, mean, t of the mean against 0."""
    t = F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))
    return df.groupBy("symbol").agg(F.count(x).alias("n"), F.round(F.avg(x), 9).alias("mean"), F.round(t, 6).alias("t"))


def direction_shares(moves: DataFrame) -> DataFrame:
    share = lambda p, name: F.round(F.avg(p.cast("double")), 6).alias(name)
    d = F.col("dp")
    return moves.groupBy("symbol").agg(share(d > 0, "up"), share(d < 0, "down"), share(d == 0, "flat"))


def best_cell(digits: DataFrame, z: float = 2.576, break_even: float = 0.917) -> DataFrame:
    """The entry digit whose chance that the next digit differs has the highest Wilson lower bound; the least of equals."""
    cells = transitions(digits).groupBy("symbol", "digit").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("next") != F.col("digit"), F.col("n")).otherwise(0)).alias("_w"))
    n, p = F.col("n"), F.col("_w") / F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    ranked = cells.withColumns({"share": F.round(p, 6), "low": F.round(low, 6)})
    best = ranked.groupBy("symbol").agg(F.max(F.struct("low", (-F.col("digit")).alias("_d"), "share", "n")).alias("b"))
    return best.select("symbol", (-F.col("b._d")).alias("digit"), F.col("b.n").alias("n"), F.col("b.share").alias("share"), F.col("b.low").alias("low"), (F.col("b.low") > break_even).alias("beats"))


# The payouts against which seven contracts are held.
EMPIRICAL = [("over0", 1.096), ("under9", 1.096), ("differs", 1.096), ("even", 1.953), ("over4", 1.953), ("over7", 4.717), ("matches", 8.929)]


def empirical_ev(digits: DataFrame) -> DataFrame:
    """symbol, contract, win_rate, break_even, ev; differs and matches compare with the digit before."""
    rows = lagged(digits, "digit", [1])
    d, before = F.col("digit"), F.col("lag_1")
    wins = {"over0": d > 0, "under9": d < 9, "differs": d != before, "even": d % 2 == 0, "over4": d > 4, "over7": d > 7, "matches": d == before}
    rates = rows.groupBy("symbol").agg(*[F.avg(w.cast("double")).alias(name) for name, w in wins.items()])
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("contract"), F.col(name).alias("win_rate"), F.lit(pay).alias("payout")) for name, pay in EMPIRICAL]))
    out = rates.select("symbol", each)
    return out.select("symbol", "contract", F.round("win_rate", 6).alias("win_rate"), F.round(1 / F.col("payout"), 6).alias("break_even"), F.round(F.col("win_rate") * F.col("payout") - 1, 6).alias("ev"))


def cent_moments(moves: DataFrame) -> DataFrame:
    c = F.col("dp") * 100
    return moves.groupBy("symbol").agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.round(F.min(c), 6).alias("least"), F.round(F.max(c), 6).alias("most"))


def spikes(moves: DataFrame, least: float = 0.0) -> DataFrame:
    """Moves in both readings: symbol, side ('down' or 'up': which moves are spikes), i, dp, spike, small. With ``least``, spikes have that size or more."""
    sides = F.explode(F.array(F.lit("down"), F.lit("up")))
    rows = moves.select("symbol", sides.alias("side"), "i", "dp")
    down = F.col("side") == "down"
    far = (lambda x: x >= least) if least else (lambda x: x > 0)
    return rows.withColumns({"spike": F.when(down, far(-F.col("dp"))).otherwise(far(F.col("dp"))), "small": F.when(down, F.col("dp") > 0).otherwise(F.col("dp") < 0)})


def spike_stats(moves: DataFrame) -> DataFrame:
    size = F.abs("dp")
    of = lambda flag: F.when(F.col(flag), size)
    return (
        spikes(moves)
        .groupBy("symbol", "side")
        .agg(
            F.count("*").alias("n"),
            F.count_if("spike").alias("spikes"),
            F.round(F.avg(F.col("spike").cast("double")), 6).alias("rate"),
            F.round(F.avg(of("small")), 6).alias("mean_small"),
            F.round(F.avg(of("spike")), 6).alias("mean_spike"),
            F.round(F.try_divide(F.avg(of("spike")), F.avg(of("small"))), 6).alias("ratio"),
            F.round(F.sum("dp"), 6).alias("drift"),
            F.round(F.coalesce(F.sum(of("small")), F.lit(0.0)), 6).alias("favourable"),
            F.round(F.coalesce(F.sum(of("spike")), F.lit(0.0)), 6).alias("adverse"),
        )
        .withColumn("net", F.round(F.col("favourable") - F.col("adverse"), 6))
    )


def waits(moves: DataFrame, size: int = 1_000_000, least: float = 0.0) -> DataFrame:
    """``spikes`` with ``place`` (from 0 among the moves) and ``since``: moves since the last spike before (from -1 on).

    The last spike is looked for within a chunk of places, and else taken from the chunks before.
    """
    rows = spikes(moves, least).withColumns({"place": F.col("i") - 1, "_chunk": F.floor((F.col("i") - 1) / size)})
    mark = F.when(F.col("spike"), F.col("place"))
    ends = rows.groupBy("symbol", "side", "_chunk").agg(F.max(mark).alias("_end"))
    carry = Window.partitionBy("symbol", "side").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "side", "_chunk", F.max("_end").over(carry).alias("_carry"))
    inside = Window.partitionBy("symbol", "side", "_chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.max(mark).over(inside)).join(ends, ["symbol", "side", "_chunk"])
    last = F.coalesce("_last", "_carry", F.lit(-1))
    return rows.withColumn("last", last).withColumn("since", F.col("place") - F.col("last")).drop("_chunk", "_last", "_carry")


def spike_gaps(moves: DataFrame, least: int = 30) -> DataFrame:
    """Gaps between spikes that follow each other, of series with more than ``least`` gaps."""
    gaps = waits(moves).where("spike and last >= 0")
    g = F.col("since")
    out = gaps.groupBy("symbol", "side").agg(F.count("*").alias("gaps"), F.avg(g).alias("_mean"), F.percentile(g, 0.5).alias("median"), F.max(g).alias("most"), F.stddev_pop(g).alias("_std"))
    return out.where(F.col("gaps") > least).select("symbol", "side", "gaps", F.round("_mean", 6).alias("mean"), "median", "most", F.round("_std", 6).alias("std"), F.round(F.try_divide(F.col("_std"), F.col("_mean")), 6).alias("std_by_mean"))


def hazard(moves: DataFrame, least: float = 0.0) -> DataFrame:
    """symbol, side, bucket (0 to 4 by half mean gaps waited), at_risk, fired, hazard."""
    rows = waits(moves, least=least)
    gaps = rows.where("spike and last >= 0").groupBy("symbol", "side").agg(F.count("*").alias("_g"), F.avg("since").alias("_mean")).where("_g > 30")
    edge = lambda x: F.floor(F.col("_mean") * x)
    bucket = F.when(F.col("since") < edge(0.5), 0).when(F.col("since") < edge(1.0), 1).when(F.col("since") < edge(1.5), 2).when(F.col("since") < edge(2.0), 3).otherwise(4)
    out = rows.join(gaps, ["symbol", "side"]).groupBy("symbol", "side", bucket.alias("bucket")).agg(F.count("*").alias("at_risk"), F.count_if("spike").alias("fired"))
    return out.withColumn("hazard", F.round(F.col("fired") / F.col("at_risk"), 6))


def hazard_chi2(moves: DataFrame, least: float = 0.0) -> DataFrame:
    """Independence of waiting bucket (the open last one left out) and spike; series with an empty bucket are left out."""
    rows = hazard(moves, least).where("bucket < 4")
    full = rows.groupBy("symbol", "side").agg(F.count("*").alias("_b")).where("_b = 4").drop("_b")
    cells = rows.join(full, ["symbol", "side"]).select("symbol", "side", "bucket", F.inline(F.array(F.struct(F.lit(1).alias("hit"), F.col("fired").alias("n")), F.struct(F.lit(0).alias("hit"), (F.col("at_risk") - F.col("fired")).alias("n")))))
    return independence(cells, ["symbol", "side"], "bucket", "hit")
