"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of code points of the lower-cased text. Its value is
the log of how much likelier the n-gram is in toxic documents than in others; a logistic
regression on these values weighs them. Counts are made by Spark over the labelled sample;
the features that tell the classes apart most (a fixed number) are kept, so the regression is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, small_batches

ORDERS = (4, 5, 6)
BITS = 22


@dataclass
class Model:
    """slots: per hash its place among the kept features or -1; weight: what each adds to the log odds."""

    slots: np.ndarray
    weight: np.ndarray
    bias: float


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of every n-gram, one pair of arrays an order."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points])
    if not sizes.sum():
        return
    x, owner = np.concatenate(points), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(x))
    h = np.zeros(len(x), np.uint32)
    for n in range(1, ORDERS[-1] + 1):
        m = len(x) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + x[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            v = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(n)
            v = (v ^ v >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
            inside = left[:m] >= n
            yield owner[:m][inside], v[inside]


def present(texts: list[str], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the kept features that occur, each pair once."""
    found = []
    for owner, h in grams(texts):
        f = slots[h]
        hit = f >= 0
        found.append(owner[hit].astype(np.int64) << 32 | f[hit])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> 32, both & 0xFFFFFFFF


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each hash occurs, over the whole task."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for batch in pieces(batches, 1, 1 << 20):
        toxic = np.array(batch.column(0).to_pylist())
        every = [owner.astype(np.int64) << BITS | h for owner, h in grams([t or "" for t in batch.column(1).to_pylist()])]
        both = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
        label, h = toxic[both >> BITS], both & (1 << BITS) - 1
        for k in (0, 1):
            value, times = np.unique(h[label == k], return_counts=True)
            seen[k][value] += times.astype(np.int32)
    at = np.flatnonzero(seen[0] | seen[1])
    for k in range(0, len(at), 50_000):
        i = at[k : k + 50_000]
        yield pa.record_batch({"hash": pa.array(i), "others": pa.array(seen[0][i].astype(np.int64)), "toxic": pa.array(seen[1][i].astype(np.int64))})


def _regress(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated full gradient steps; column j has the value value[j] where present.

    Both classes weigh the same, so the odds are those of a text as likely toxic as not beforehand.
    """
    n, k = len(y), len(value)
    v = value.astype(np.float32)[cols]
    w, b = np.zeros(k), 0.0
    each = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    size = np.bincount(rows, v * v, n)
    rate = 4 / (size.max(initial=0) + 1 + 4 * penalty)
    # A row's curvature is at most a quarter of its squared length, so a mean of rows may take longer steps.
    rate *= max(1.0, size.max(initial=0) / max(size.mean() if n else 1, 1e-9) / 4)
    ahead_w, ahead_b, pw, pb = w.copy(), b, w.copy(), b
    for t in range(steps):
        z = np.bincount(rows, v * ahead_w[cols], n) + ahead_b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * each
        gw = np.bincount(cols, v * err[rows], k) / n + penalty * ahead_w
        w, b = ahead_w - rate * gw, ahead_b - rate * err.mean()
        pull = t / (t + 3)
        ahead_w, ahead_b = w + pull * (w - pw), b + pull * (b - pb)
        pw, pb = w, b
    return w, b


def fit(sample: DataFrame, keep: int = 4_000, least: int = 5, smooth: float = 1.0, penalty: float = 1e-3, steps: int = 250) -> Model:
    """A model from a bounded sample of (toxic int, text). Without both classes only the bias is learnt.

    ``keep`` n-grams at most, of those in ``least`` texts or more (in two, if the sample has under
    1000 texts), count. All settings, the orders included, were chosen by cross-validation among
    documents outside the held-out fold.
    """
    spark = sample.sparkSession
    small_batches(spark)
    counted = sample.mapInArrow(_counts, "hash long, others long, toxic long").groupBy("hash").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    least = least if n0 + n1 >= 1000 else 2
    slots = np.full(1 << BITS, -1, np.int16)
    if not n0 or not n1:
        return Model(slots, np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))))
    share = lambda c, n: (F.col(c) + smooth) / (n + 2 * smooth)
    ratio = F.log(share("toxic", n1) / share("others", n0))
    split = F.abs(share("toxic", n1) - share("others", n0)) * F.abs(ratio)
    best = counted.where(F.col("toxic") + F.col("others") >= least).select("hash", ratio.alias("ratio"), split.alias("split")).orderBy(F.desc("split"), "hash").limit(keep).collect()
    value = np.array([r["ratio"] for r in best])
    slots[[r["hash"] for r in best]] = np.arange(len(best))
    sent = spark.sparkContext.broadcast(slots)

    def of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            owner, f = present([t or "" for t in batch.column(1).to_pylist()], sent.value)
            each = np.split(f.astype("<u2"), np.cumsum(np.bincount(owner, minlength=batch.num_rows))[:-1])
            yield pa.record_batch({"toxic": batch.column(0), "features": pa.array([e.tobytes() for e in each], pa.binary())})

    rows = sample.mapInArrow(of_sample, "toxic int, features binary").toArrow()
    y = np.array([float(t) for t in rows.column(0).to_pylist()])
    sizes = [len(f) // 2 for f in rows.column(1).to_pylist()]
    cols = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").astype(np.int32)
    del rows
    w, b = _regress(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), cols, value, y, penalty, steps)
    return Model(slots, w * value, b)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic.

    * Null or empty text: the probability of a text without any kept n-gram.
    * Repeated rows and null ids: scored as they stand. Empty table: empty result.
    * Other columns pass through; one named as the result is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(out)
    sent = spark.sparkContext.broadcast(model)
    k = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in pieces(batches, k, 1 << 20):
            owner, f = present([t or "" for t in batch.column(k).to_pylist()], m.slots)
            z = np.bincount(owner, m.weight[f], batch.num_rows) + m.bias
            p = pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], [*batch.schema.names, out])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, fold: int, held_out: int, max_docs: int) -> DataFrame:
    """(toxic, text) of at most ``max_docs`` labelled documents outside the held-out fold.

    Those of the smallest hash of their id are taken, so the sample is the same on every run. A
    document with several labels has the larger one; null labels and ids are left out.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % fold != held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, held_out: int = 1, max_docs: int = 8_000) -> Model:
    return fit(labelled(docs, labels, fold, held_out, max_docs).coalesce(16))


def op6(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. Documents with a null id are scored and in no fold (held_out false)."""
    model = train(docs, labels)
    out = score(docs.select("doc_id", "text"), model).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
