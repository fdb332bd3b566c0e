"""Connected components of links, by alternating stars on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PLAIN

#: A node with this share of the edges is a hub; there are at most twice 1 / share.
HUB, HUB_LEAST = 1 / 4096, 64


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Each (u, v) with m, the least of u and all its v; a hub's least is sent to every task, so its edges stay where they are.

    Up to PLAIN edges no node has too many for one task, and nothing is sent: plans with fewer steps, which the driver has to hold.
    """
    if total <= PLAIN:
        return edges.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    bound = max(HUB_LEAST, total * HUB)
    held = edges.join(F.broadcast(least.where(F.col("n") >= bound).select("u", F.col("m").alias("_hub"))), "u", "left")
    rest = held.where("_hub is null").drop("_hub").join(least.where(F.col("n") < bound).select("u", "m"), "u")
    return held.where("_hub is not null").withColumnRenamed("_hub", "m").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in (u, v) links, root being the least node that links reach.

    Each round ties every node's neighbours to the least of them, first the larger ones, then the
    smaller, which halves distances; it ends when nothing changes. Edges never outnumber the links.
    Every round is written to the checkpoint folder, so a lost executor costs at most one round.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before, total = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pointed = _with_least(large, total)
        small = pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pointed.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before, total = now, now["n"]
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
