"""Exact quantiles without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are cut into, by quantiles that need not be exact.
RANGES = 64


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """A row a group: ``keys`` and, for each of ``shares`` (name -> share), the quantile between the two nearest ranks; nulls are passed over.

    Equal values are counted, values are dealt to ranges, and the sizes of earlier ranges are added to
    what comes before a value in its own: a task has one range of one group, and the bounds only deal.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1))
    groups = [*keys, "_one"]
    each = rows.groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cuts = rows.groupBy(*groups).agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10 * ranges)).alias("_cuts"), F.count("*").alias("_total"))
    placed = each.join(cuts, groups).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sizes = placed.groupBy(*groups, "_range").agg(F.sum("_n").alias("_size"))
    before = sizes.select(*groups, "_range", (F.sum("_size").over(Window.partitionBy(*groups).orderBy("_range")) - F.col("_size")).alias("_before"))
    up_to = F.col("_before") + F.sum("_n").over(Window.partitionBy(*groups, "_range").orderBy("_v"))
    ranked = placed.join(before, [*groups, "_range"]).withColumn("_up_to", up_to)
    rank = lambda share: share * (F.col("_total") - 1)
    at = lambda place: F.min(F.when(F.col("_up_to") > place, F.col("_v")))
    found = ranked.groupBy(*groups).agg(F.first("_total").alias("_total"), *[at(f(rank(share))).alias(f"_{k}_{side}") for k, share in enumerate(shares.values()) for side, f in (("low", F.floor), ("high", F.ceil))])
    between = lambda k, share: F.col(f"_{k}_low") + (F.col(f"_{k}_high") - F.col(f"_{k}_low")) * (rank(share) - F.floor(rank(share)))
    return found.select(*keys, *[between(k, share).alias(name) for k, (name, share) in enumerate(shares.items())])
