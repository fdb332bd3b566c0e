"""Risk of ruin of a target martingale: analytic day odds and paths on Spark.

A day's stakes are fixed by its losses alone, so a path needs one draw a day: the losses before the
first win. Draws come from a hash of (scenario, path, day), so a path is the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_STAKE, STEPS = 0.35, 60
# Label, chance to win, payout, start, daily target, days.
SCENARIOS = [
    ("even_week", 0.5, 1.95, 10.0, 1.0, 7),
    ("even_month", 0.5, 1.95, 10.0, 1.0, 30),
    ("rise_month", 0.487, 1.92, 10.0, 1.0, 30),
    ("differs_month", 0.9, 1.09, 10.0, 0.5, 30),
    ("even_month_50", 0.5, 1.95, 50.0, 1.0, 30),
]


def stakes(payout: float, target: float, least: float = MIN_STAKE) -> list[tuple[float, float]]:
    """(stake, lost before it) of each step of a day."""
    out, lost = [], 0.0
    for _ in range(STEPS):
        need = max((lost + target) / (payout - 1), least)
        out.append((need, lost))
        lost += need
    return out


def scenarios(spark: SparkSession, rows: list[tuple] = SCENARIOS) -> DataFrame:
    """label, p, payout, start, target, days, plan: the day's steps as an array of (stake, lost)."""
    full = [(*r, [tuple(s) for s in stakes(r[2], r[4])]) for r in rows]
    return spark.createDataFrame(full, "label string, p double, payout double, start double, target double, days int, plan array<struct<stake:double,lost:double>>")


def affordable(bank: Column) -> Column:
    """How many steps of the plan in a row a bankroll can fund."""
    return F.size(F.filter("plan", lambda s: s["stake"] <= bank - s["lost"] + 1e-9))


def day_odds(cases: DataFrame) -> DataFrame:
    """label, losses (that end a day from the start), p_lose, p_win."""
    k = affordable(F.col("start"))
    return cases.select("label", k.alias("losses"), F.pow(1 - F.col("p"), k).alias("p_lose"), (1 - F.pow(1 - F.col("p"), k)).alias("p_win"))


def uniform(*parts: Column) -> Column:
    """A draw in (0, 1) from the first 32 bits of the MD5 of the parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def _day(state: Column, day: Column, correct: bool) -> Column:
    losses = F.floor(F.log(uniform(F.col("label"), F.col("path"), day)) / F.log(1 - F.col("p")))
    bank = state["bank"]
    step = F.try_element_at("plan", (F.least(losses, F.lit(STEPS - 1)) + 1).cast("int"))
    funded = (losses < STEPS) & (step["stake"] <= bank - step["lost"] + 1e-9)
    gain = step["stake"] * (F.col("payout") - 1) - step["lost"] * (1 if correct else 2)
    alive = state["ruin_day"] < 0
    after = F.when(~alive, bank).when(funded, bank + gain).otherwise(0.0)
    return F.struct(after.alias("bank"), F.when(alive & ~funded, day).otherwise(state["ruin_day"]).cast("int").alias("ruin_day"), (state["days_won"] + (alive & funded).cast("int")).alias("days_won"))


def paths(cases: DataFrame, n_paths: int, accounting: str = "correct", tasks: int = 200) -> DataFrame:
    """label, path, start, days, bank, ruin_day (-1: none), days_won.

    ``accounting="reference"`` takes a day's losses twice when it wins, as the published figures do.
    """
    spark = cases.sparkSession
    each = spark.range(n_paths).select(F.col("id").alias("path"))
    rows = each.join(F.broadcast(cases))
    first = F.struct(F.col("start").alias("bank"), F.lit(-1).alias("ruin_day"), F.lit(0).alias("days_won"))
    end = F.aggregate(F.sequence(F.lit(0), F.col("days") - 1), first, lambda s, d: _day(s, d, accounting == "correct"))
    return rows.select("label", "path", "start", "days", end.alias("_e")).select("label", "path", "start", "days", "_e.*")


def curves(cases: DataFrame, n_paths: int = 40) -> DataFrame:
    """label, path, day, bank: every day's end of a few paths; a ruined path stays at 0."""
    spark = cases.sparkSession
    rows = spark.range(n_paths).select(F.col("id").alias("path")).join(F.broadcast(cases))
    first = F.struct(F.col("start").alias("bank"), F.lit(-1).alias("ruin_day"), F.lit(0).alias("days_won"))
    at = lambda n: F.aggregate(F.sequence(F.lit(0), n), first, lambda s, d: _day(s, d, True))["bank"]
    return rows.select("label", "path", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("days") - 1), at)).alias("day", "bank"))


def summary(done: DataFrame) -> DataFrame:
    ruined = F.col("ruin_day") >= 0
    # A scenario has as many paths as its parameter says, so the median's task is bounded.
    return done.groupBy("label").agg(
        F.count("*").alias("paths"),
        F.avg((ruined & (F.col("ruin_day") < 7)).cast("double")).alias("p_ruin_week"),
        F.avg(ruined.cast("double")).alias("p_ruin"),
        F.percentile("bank", 0.5).alias("median_final"),
        F.avg("bank").alias("mean_final"),
        F.avg(F.col("bank") - F.col("start")).alias("expected_pl"),
    )
