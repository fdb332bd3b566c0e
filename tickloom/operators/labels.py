"""Labels, folds and scores for a learned trade filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.boosting import Boosting, fit_folds, score_folds
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.signals import SwingRules, wanted
from tickloom.sources.tables import by_chunk, chunked, numbered, own_rows

FEATURES = ["direction", "adx", "atr_pct", "rsi", "trend_ext", "pull_ext", "ret5", "ret20", "cot_base_idx", "cot_quote_idx", "cot_bias", "dow", "is_metal"]


def triple_barrier(frame: DataFrame, rules: SwingRules = SwingRules(), first: int = 60) -> DataFrame:
    """One row a signal: symbol, date (of the entry bar), signal_date, i, direction, r and win, with features of the signal bar.

    Of the next ``time_bars`` bars the first to touch the stop (-1) or the target (+take_r) decides,
    the stop first within a bar; else the close of the last of them, in units of risk.
    """
    n = rules.time_bars
    w = by_chunk()
    ahead = F.collect_list(F.struct("i", "high", "low", "close")).over(w.rowsBetween(1, n))
    rows = chunked(frame, "symbol", 20, n + 1).withColumns({"_next": F.lead("open").over(w), "_on": F.lead("date").over(w), "_ahead": ahead, "_c5": F.lag("close", 5).over(w), "_c20": F.lag("close", 20).over(w)})
    size = frame.groupBy("symbol").agg(F.count("*").alias("_n"))
    rows = own_rows(rows).withColumn("direction", wanted()).join(size, "symbol").where(F.col("i").between(first, F.col("_n") - 3) & (F.col("direction") != 0) & (F.col("atr") > 0))
    side, risk = F.col("direction"), rules.stop_atr * F.col("atr")
    rows = rows.withColumns({"_risk": risk, "_stop": F.col("_next") - side * risk, "_take": F.col("_next") + side * rules.take_r * risk})
    hit_stop = lambda b: F.when(side == 1, b["low"] <= F.col("_stop")).otherwise(b["high"] >= F.col("_stop"))
    hit_take = lambda b: F.when(side == 1, b["high"] >= F.col("_take")).otherwise(b["low"] <= F.col("_take"))
    when = lambda hit: F.coalesce(F.try_element_at(F.filter("_ahead", hit), F.lit(1))["i"], F.lit(1 << 60))
    rows = rows.withColumns({"_s": when(hit_stop), "_t": when(hit_take), "_out": F.element_at("_ahead", -1)["close"]})
    r = F.when((F.col("_s") <= F.col("_t")) & (F.col("_s") < 1 << 60), -1.0).when(F.col("_t") < 1 << 60, rules.take_r).otherwise(side * (F.col("_out") - F.col("_next")) / F.col("_risk"))
    return rows.select(
        "symbol", F.col("_on").alias("date"), F.col("date").alias("signal_date"), "i", "direction", "adx", "atr_pct", "rsi", ((F.col("close") - F.col("ema_trend")) / F.col("atr")).alias("trend_ext"), ((F.col("close") - F.col("ema_pullback")) / F.col("atr")).alias("pull_ext"),
        (F.col("close") / F.col("_c5") - 1).alias("ret5"), (F.col("close") / F.col("_c20") - 1).alias("ret20"), F.weekday("_on").alias("dow"), F.col("symbol").isin("XAUUSD", "XAGUSD").cast("int").alias("is_metal"), r.alias("r"), (r > 0).cast("int").alias("win"),
    )


def folds(samples: DataFrame, n_folds: int = 5, embargo: int = 10, least_train: int = 50) -> DataFrame:
    """Samples in order of (date, symbol) with ``place``, ``fold`` (0 to n_folds, the first never tested) and ``train_end``:
    for a row's fold, the first place that is not trained on (null if too few would be)."""
    placed = numbered(samples.withColumns({"_all": F.lit(1), "_y": F.year("date")}), "_all", ["date", "symbol"], "_y", "place").drop("_all", "_y")
    total = placed.agg(F.count("*").alias("_n"))
    k = n_folds + 1
    # The first _n % k parts have one row more.
    base, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    in_long = F.col("place") < extra * (base + 1)
    fold = F.when(in_long, F.floor(F.col("place") / (base + 1))).otherwise(extra + F.floor((F.col("place") - extra * (base + 1)) / F.greatest(base, F.lit(1))))
    rows = placed.join(F.broadcast(total)).withColumn("fold", fold.cast("int"))
    start = F.col("fold") * base + F.least(F.col("fold"), extra)
    end = start - embargo
    return rows.withColumn("train_end", F.when((F.col("fold") > 0) & (end >= least_train), end)).drop("_n")


def auc(scored: DataFrame, p: str = "p", y: str = "win", buckets: int = 1000) -> DataFrame:
    """n, auc: the chance that a winner scores above a loser, ties half. Values are ranked within buckets of p."""
    v = scored.groupBy(F.col(p).alias("_p")).agg(F.sum(F.col(y)).alias("_w"), F.sum(1 - F.col(y)).alias("_l")).withColumn("_b", F.floor(F.col("_p") * buckets))
    sizes = v.groupBy("_b").agg(F.sum("_l").alias("_bl"))
    below = sizes.select("_b", (F.sum("_bl").over(Window.orderBy("_b")) - F.col("_bl")).alias("_before"))
    inside = F.sum("_l").over(Window.partitionBy("_b").orderBy("_p")) - F.col("_l")
    ranked = v.withColumn("_in", inside).join(below, "_b")
    wins = F.sum(F.col("_w") * (F.col("_before") + F.col("_in") + F.col("_l") / 2))
    return ranked.agg((F.sum("_w") + F.sum("_l")).alias("n"), F.try_divide(wins, F.sum("_w") * F.sum("_l")).alias("auc"))


def selectivity(scored: DataFrame, p: str = "p") -> DataFrame:
    """top (percent taken), trades, win_pct, mean_r, gain (over taking all); ties at the cut are taken."""
    tops = [100, 70, 50, 30, 20]
    cuts = exact_quantiles(scored, [], p, {f"_c{t}": (100 - t) / 100 for t in tops}).join(scored.agg(F.avg("r").alias("_all")))
    rows = scored.join(F.broadcast(cuts)).select(p, "r", "win", "_all", F.inline(F.array(*[F.struct(F.lit(t).alias("top"), (F.lit(float("-inf")) if t == 100 else F.col(f"_c{t}")).alias("_cut")) for t in tops])))
    kept = rows.where(F.col(p) >= F.col("_cut"))
    return kept.groupBy("top").agg(F.count("*").alias("trades"), (F.avg("win") * 100).alias("win_pct"), F.avg("r").alias("mean_r"), (F.avg("r") - F.first("_all")).alias("gain"))


def verdict(scored: DataFrame, p: str = "p", skill: float = 0.52, gain: float = 0.02, gold: str = "XAUUSD") -> DataFrame:
    """One row: n, auc, the gain in mean r of the best 30 % over all, whether these show skill, and what taking the better half gains for one symbol (null at ten samples or fewer)."""
    top = selectivity(scored, p).where("top = 30").select(F.col("gain").alias("top30_gain"))
    ours = scored.where(F.col("symbol") == gold)
    cut = ours.agg(F.avg("r").alias("_all"), F.count("*").alias("gold_n")).join(exact_quantiles(ours, [], p, {"_cut": 0.5}), how="left")
    half = ours.join(F.broadcast(cut)).agg(F.avg(F.when(F.col(p) >= F.col("_cut"), F.col("r"))).alias("_half"), F.first("_all").alias("_all"), F.count("*").alias("gold_n"))
    half = half.select("gold_n", F.when(F.col("gold_n") > 10, F.col("_half") - F.col("_all")).alias("gold_gain"))
    one = auc(scored, p).join(F.broadcast(half)).join(F.broadcast(top), how="left")
    return one.select("n", "auc", "top30_gain", F.coalesce((F.col("auc") >= skill) & (F.col("top30_gain") > gain), F.lit(False)).alias("skilled"), "gold_n", "gold_gain")


def walk_forward(folded: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """The tested samples (symbol, date, fold, p, r, win), each fold scored by boosted trees that learnt on the rows before its embargo.

    Folds without both classes to learn from, or under five rows, are left out. ``folded`` is read three times.
    """
    rows = folded.dropna(subset=FEATURES)
    plan = rows.where("train_end is not null").groupBy("fold").agg(F.min("train_end").alias("end"), F.count("*").alias("n")).where("n >= 5").collect()
    models = fit_folds(rows, {r["fold"]: r["end"] for r in plan}, FEATURES, "win", how) if plan else None
    keep = ["symbol", "date", "fold", "p", "r", "win"]
    if models is None:
        return rows.where("false").withColumn("p", F.lit(0.0)).select(*keep)
    return score_folds(rows.where("train_end is not null"), models, FEATURES, how.depth).select(*keep)
