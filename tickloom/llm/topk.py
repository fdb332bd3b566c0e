"""Exact top-k search by inner product over norm-sorted blocks.

Vectors are sorted by descending length and packed into blocks, a row each. Vectors and queries
are rotated into the basis of the singular vectors of all vectors, so a few first coordinates hold
most of every product. A query meets a block only if |q| * |longest of the block| can reach its
k-th best score so far (Cauchy-Schwarz). A candidate goes on from one partial sum to the next, over
the first 16, 64, 256, ... coordinates, as long as the sum plus |rest of q| * |rest of c| can. What is
left is multiplied exactly, in integers.

Queries are taken in blocks of bounded size, each sent to all tasks that hold candidate blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, new_path, parts_wanted, small_batches, stash

BLOCK, STRIDE, QUERY_BLOCK, STEP = 4096, 512, 16_384, 1 << 18
#: Where the partial sums end: each is HEADS times as long as the one before.
HEAD, HEADS = 16, 4
LEAST = np.iinfo(np.int64).min


#: A component of this size cannot be part of a 64-bit inner product: the cast to whole numbers would wrap.
LARGEST = 2.0**53


def quantised(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, int64 matrix) of the batch's usable vectors, one pair a dimension."""
    lists = batch.column(1)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), nan=0).astype(int)
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
    starts = np.cumsum(lengths) - lengths
    named = ~np.asarray(batch.column(0).is_null())
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == d) & named)
        x = values[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1)
        if (np.abs(x[fine]) >= LARGEST).any():
            raise ValueError("components are too large for a 64-bit inner product")
        if fine.any():
            yield batch.column(0).take(pa.array(rows[fine])).to_numpy(), np.floor(256 * x[fine]).astype(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in quantised(batch):
            x = x.astype(float)
            d = x.shape[1]
            sums[d] = sums.get(d, 0) + x.T @ x
    yield from _gram_rows(sums)


def _gram_rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.record_batch({"dim": pa.array(list(sums), pa.int32()), "gram": pa.array([g.tobytes() for g in sums.values()], pa.binary())})


def _gram_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[d] = sums.get(d, 0) + np.frombuffer(g).reshape(d, d)
    yield from _gram_rows(sums)


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The right singular vectors of all vectors of each dimension, largest first; the driver gets d by d sums only."""
    form = "dim int, gram binary"
    rows = vectors.mapInArrow(_grams, form).repartition(8).mapInArrow(_gram_sums, form).collect()
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums[r["dim"]] = sums.get(r["dim"], 0) + np.frombuffer(bytes(r["gram"])).reshape(r["dim"], r["dim"])
    return {d: np.linalg.eigh(g)[1][:, ::-1].copy() for d, g in sums.items()}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, norm, id, ints) of each usable vector."""
    for batch in batches:
        for ids, x in quantised(batch):
            norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
            yield pa.record_batch({"dim": pa.array(np.full(len(ids), x.shape[1], np.int32)), "norm": pa.array(norm), "id": pa.array(ids), "ints": pa.array([r.tobytes() for r in x], pa.binary())})


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks: dim, top (the longest length), ids, ints."""
    dim, held = None, []

    def block() -> pa.RecordBatch:
        ids = np.array([h[1] for h in held], np.int64)
        return pa.record_batch({"dim": pa.array([dim], pa.int32()), "top": pa.array([held[0][0]]), "ids": pa.array([ids.tobytes()]), "ints": pa.array([b"".join([h[2] for h in held])])})

    for batch in batches:
        for d, norm, i, ints in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held and (d != dim or len(held) >= size):
                yield block()
                held = []
            dim = d
            held.append((norm, i, ints))
    if held:
        yield block()


def blocks(vectors: DataFrame, size: int, what: str) -> DataFrame:
    rows = vectors.mapInArrow(_measured, "dim int, norm double, id long, ints binary")
    placed = rows.repartitionByRange(parts_wanted(vectors.sparkSession), "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")
    return stash(placed.mapInArrow(lambda b: _packed(b, size), "dim int, top double, ids binary, ints binary"), what)


class Search:
    """The k best of some queries (one dimension) among blocks met one after another."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, basis: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.queries, self.basis, self.k = ids, queries, basis, k
        self.turned = queries.astype(float) @ basis
        self.norm = np.sqrt((self.turned**2).sum(axis=1))
        self.ends = [HEAD]
        while self.ends[-1] * HEADS < basis.shape[1]:
            self.ends.append(self.ends[-1] * HEADS)
        self.rest = self._rests(self.turned)
        self.floor = floor.copy()  # no score below this is among a query's k best
        self.most = float(np.abs(queries).max(initial=0))
        self.best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 3  # query, score, id

    def _rests(self, turned: np.ndarray) -> list[np.ndarray]:
        """What each partial sum leaves out: the length of the coordinates from its end on."""
        return [np.sqrt((turned[:, h:] ** 2).sum(axis=1)) for h in self.ends]

    def meet(self, ids: np.ndarray, ints: np.ndarray) -> None:
        turned = ints.astype(float) @ self.basis
        norm = np.sqrt((turned**2).sum(axis=1))
        rest = self._rests(turned)
        if self.most * float(np.abs(ints).max(initial=0)) * ints.shape[1] >= 2**62:
            raise ValueError("components are too large for a 64-bit inner product")
        for a in range(0, len(ids), STRIDE):
            z = slice(a, a + STRIDE)
            slack = 1 + 1e-9 * self.norm * norm[a]
            live = np.flatnonzero(self.norm * norm[a] + slack >= self.floor)
            if not len(live):
                if (self.norm * norm[a] + slack < self.floor).all():
                    return  # the rest is no longer
                continue
            first = self.turned[live, :HEAD] @ turned[z, :HEAD].T
            reach = first + self.rest[0][live][:, None] * rest[0][z] + slack[live][:, None] >= self.floor[live][:, None]
            q, c = np.nonzero(reach)
            part, q, c = first[q, c], live[q], c + a
            keep = self.ids[q] != ids[c]
            part, q, c = part[keep], q[keep], c[keep]
            for k, (lo, hi) in enumerate(zip(self.ends, self.ends[1:]), 1):
                part = part + np.concatenate([np.einsum("ij,ij->i", self.turned[q[b : b + STEP], lo:hi], turned[c[b : b + STEP], lo:hi]) for b in range(0, len(q), STEP)] or [part])
                keep = part + self.rest[k][q] * rest[k][c] + slack[q] >= self.floor[q]
                part, q, c = part[keep], q[keep], c[keep]
            for b in range(0, len(q), STEP):
                y = slice(b, b + STEP)
                score = np.einsum("ij,ij->i", self.queries[q[y]], ints[c[y]])
                good = score >= self.floor[q[y]]
                self._keep(q[y][good], score[good], ids[c[y][good]])

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, score, ids = (np.concatenate([x, y]) for x, y in zip(self.best, (q, score, ids)))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], score[full])
        top = rank < self.k
        self.best = q[top], score[top], ids[top]


OUT = "query int, query_id long, vec_id long, score long"


def _searched(batches: Iterator[pa.RecordBatch], groups: dict, k: int) -> Iterator[pa.RecordBatch]:
    searches: dict[int, Search] = {}
    for batch in batches:
        for d, ids, ints in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
            if d in groups:
                if d not in searches:
                    searches[d] = Search(*groups[d][1:4], k, groups[d][4])
                x = np.frombuffer(ints, np.int64).reshape(-1, d)
                searches[d].meet(np.frombuffer(ids, np.int64), x)
    for d, s in searches.items():
        q, score, ids = s.best
        yield pa.record_batch({"query": pa.array(groups[d][0][q], pa.int32()), "query_id": pa.array(s.ids[q]), "vec_id": pa.array(ids), "score": pa.array(score)})


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products (fewer if there are fewer).

    Components count as floor(256 * x). Ties go to the smaller id; a row of the query's own id is
    no candidate. Vectors of different dimension do not meet.

    * Null ids, null or empty vectors, and those with a null or non-finite component take no part.
    * Rows that share an id are candidates each, and as queries each has its own ranks.
    * Empty tables: empty result. Other columns are not carried.
    * Products beyond 64 bits raise an error.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    basis = bases(pick(vectors))
    held = blocks(pick(vectors), BLOCK, "vector-blocks")
    asked = blocks(pick(queries), 1024, "query-blocks")
    longest = held.groupBy("dim").agg(F.max("top").alias("top"))
    out = new_path(spark, "top-k")
    batch: list = []

    def run(rows: list) -> None:
        """One block of queries against all candidate blocks, the longest vectors first."""
        groups, n = {}, 0
        for d in {r["dim"] for r in rows} & set(basis):
            mine = [r for r in rows if r["dim"] == d]
            ids = np.concatenate([np.frombuffer(bytes(r["ids"]), np.int64) for r in mine])
            x = np.concatenate([np.frombuffer(bytes(r["ints"]), np.int64).reshape(-1, d) for r in mine])
            groups[d] = (np.arange(n, n + len(ids), dtype=np.int32), ids, x, basis[d], np.full(len(ids), LEAST))
            n += len(ids)
        sent = spark.sparkContext.broadcast(groups)
        first = held.join(F.broadcast(longest), ["dim", "top"]).mapInArrow(lambda b: _searched(b, sent.value, k), OUT)
        floors = {r["query"]: r["score"] for r in _ranked(first, k).where(F.col("rank") == k).collect()}
        for numbers, *_, floor in groups.values():
            floor[:] = [floors.get(int(i), LEAST) for i in numbers]
        again = spark.sparkContext.broadcast(groups)
        # All blocks' results are one table, so the plan does not grow with their number.
        _ranked(held.mapInArrow(lambda b: _searched(b, again.value, k), OUT), k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        sent.unpersist()
        again.unpersist()

    count, blocks_done = 0, 0
    for row in asked.toLocalIterator():
        batch.append(row)
        count += len(row["ids"]) // 8
        if count >= QUERY_BLOCK:
            run(batch)
            batch, count, blocks_done = [], 0, blocks_done + 1
    if batch or not blocks_done:
        run(batch)
    discard(asked)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)


def op2(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH ints AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM ints q JOIN ints c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 5
"""
