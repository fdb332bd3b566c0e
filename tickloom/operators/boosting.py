"""Boosted trees for a learned filter: every fold is fitted by one task on a bounded sample, all folds side by side.

A split compares a feature with one of at most BINS - 1 cuts (quantiles of the sample) and is the one
that lowers the squared residual most; a leaf's value is one Newton step. Rows of a tree are drawn by a
generator that the seed and the fold start, so a fit depends on its rows only, not on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit; ``most`` bounds the rows that one fold learns from."""

    iterations: int = 160
    depth: int = 3
    rate: float = 0.05
    subsample: float = 0.8
    seed: int = 7
    most: int = 200_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Ascending cuts of each feature: the middle between neighbouring values, or quantiles of those where there are many."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) >= BINS:
            middle = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf"))
            middle = middle[middle < values[-1]]
        out.append(middle)
    return out


def best_splits(node: np.ndarray, bins: np.ndarray, g: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node the feature and the last bin that goes left; feature -1 where no split lowers the squared residual."""
    n_features = bins.shape[1]
    at = ((node[:, None] * n_features + np.arange(n_features)) * BINS + bins).ravel()
    shape = (nodes, n_features, BINS)
    size = nodes * n_features * BINS
    count = np.bincount(at, minlength=size).reshape(shape).cumsum(axis=2)
    total = np.bincount(at, np.repeat(g, n_features), size).reshape(shape).cumsum(axis=2)
    n, s = count[:, :, -1:], total[:, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = total**2 / count + (s - total) ** 2 / (n - count) - s**2 / n
    gain = np.where((count > 0) & (count < n), gain, -np.inf).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    found = gain[np.arange(nodes), best] > 1e-12
    return np.where(found, best // BINS, -1), best % BINS


def fit(x: np.ndarray, y: np.ndarray, how: Boosting, fold: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The start, and of every tree the features and cuts of its 2^depth - 1 nodes and the values of its 2^depth leaves.

    A node that does not split sends all rows left (its cut is infinite).
    """
    rng = np.random.default_rng((how.seed, fold))
    cuts = cuts_of(x)
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, inner = np.full(len(y), start), 2**how.depth - 1
    features, edges, values = np.zeros((how.iterations, inner), np.int32), np.full((how.iterations, inner), np.inf), np.zeros((how.iterations, inner + 1))
    for t in range(how.iterations):
        p = sigmoid(score)
        g, h = y - p, p * (1 - p)
        drawn = rng.random(len(y)) < how.subsample
        node = np.zeros(len(y), np.int64)
        for d in range(how.depth):
            first, nodes = 2**d - 1, 2**d
            feature, last = best_splits(node[drawn], bins[drawn], g[drawn], nodes)
            for k in np.flatnonzero(feature >= 0):
                features[t, first + k], edges[t, first + k] = feature[k], cuts[feature[k]][last[k]]
            right = (feature[node] >= 0) & (bins[np.arange(len(y)), feature[node]] > last[node])
            node = 2 * node + right
        up, down = np.bincount(node[drawn], g[drawn], inner + 1), np.bincount(node[drawn], h[drawn], inner + 1)
        values[t] = how.rate * np.where(down > 1e-12, up / np.maximum(down, 1e-12), 0)
        score += values[t][node]
    return start, features, edges, values


def predicted(x: np.ndarray, start: float, features: np.ndarray, edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The chance of label 1 for each row of ``x``."""
    score, rows, inner = np.full(len(x), start), np.arange(len(x)), features.shape[1]
    for f, e, v in zip(features, edges, values):
        node = np.zeros(len(x), np.int64)
        while len(x) and node[0] < inner:
            node = 2 * node + 1 + (x[rows, f[node]] > e[node])
        score += v[node - inner]
    return sigmoid(score)


MODEL = "fold int, start double, features array<int>, edges array<double>, leaves array<double>"


def fit_folds(rows: DataFrame, ends: dict[int, int], features: list[str], label: str, how: Boosting) -> DataFrame:
    """One model (MODEL) a fold from the rows with a ``place`` before the fold's end; folds that have one class only have none.

    Where a fold has more than ``how.most`` rows, a share of them by hash is taken that comes to about as many.
    """
    each = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(end).cast("long").alias("end"), F.lit(min(1.0, how.most / max(1, end))).alias("share")) for k, end in ends.items()])
    drawn = F.pmod(F.xxhash64("place"), F.lit(1 << 20)) / (1 << 20)
    held = rows.select("place", F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"))
    learnt = held.withColumn("_e", F.explode(F.filter(each, lambda e: (F.col("place") < e["end"]) & (drawn < e["share"])))).select("_e.fold", "place", "x", "y")

    def of_fold(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        y = table.column("y").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        found = [fit(x, y, how, key[0].as_py())] if 0 < y.mean() < 1 else []
        flat = lambda k, kind: pa.array([m[k].ravel().tolist() for m in found], pa.list_(kind))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(found), pa.int32()), pa.array([m[0] for m in found], pa.float64()), flat(1, pa.int32()), flat(2, pa.float64()), flat(3, pa.float64())], ["fold", "start", "features", "edges", "leaves"])

    return learnt.groupBy("fold").applyInArrow(of_fold, MODEL)


def score_folds(rows: DataFrame, models: DataFrame, features: list[str], depth: int) -> DataFrame:
    """The rows whose ``fold`` has a model, with its ``p``. ``models`` has a row a fold and goes to every task."""
    inner = 2**depth - 1
    known = {
        m.fold: (m.start, np.array(m.features, np.int32).reshape(-1, inner), np.array(m.edges).reshape(-1, inner), np.array(m.leaves).reshape(-1, inner + 1))
        for m in models.collect()  # a few thousand numbers a fold
    }
    sent = rows.sparkSession.sparkContext.broadcast(known)
    held = rows.where(F.col("fold").isin(list(known))).withColumns({"_x": F.array(*[F.col(c).cast("double") for c in features]), "p": F.lit(0.0)})
    kind = held.drop("_x").schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "_x"]
            fold = batch.column("fold").to_numpy()
            x = batch.column("_x").flatten().to_numpy().reshape(len(fold), -1)
            p = np.zeros(len(fold))
            for k in np.unique(fold):
                p[fold == k] = predicted(x[fold == k], *sent.value[int(k)])
            yield pa.RecordBatch.from_arrays([pa.array(p) if n == "p" else batch.column(n) for n in names], names=names)

    return held.mapInArrow(scored, kind)
