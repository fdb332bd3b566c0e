"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Bins stand in order of what is left in them and carry two bitmaps: the sources and the duplicate
clusters of what they hold. A piece goes into the tightest bin that has room and shares no bit
with it: the search starts at the first bin with room and goes on to its successors until one is
compatible. Pieces come in descending length, those of a dominating source first.

Documents are dealt to shards of bounded size by a hash, so bins are filled on all machines; a
shard leaves only its last few bins short.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .shingles import words_of

#: A bin's number within its shard takes the low 24 bits of bin_id.
BIN_BITS = 24


class BestFit:
    """The bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (room, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; source and cluster are bitmaps of one bit, or 0."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, b = self.order[at]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if room > size:
            insort(self.order, (room - size, b))
        return b, self.capacity - room


def pack_shard(rows: list[tuple], capacity: int) -> list[tuple]:
    """Rows (id, length, source, cluster): (id, piece, start, length, bin, offset) of every piece."""
    sources: dict = {}
    met: set = set()
    twice: dict = {}
    for _, _, source, cluster in rows:
        if source is not None:
            sources.setdefault(source, 1 << len(sources))
        if cluster is not None:
            if cluster in met:
                twice.setdefault(cluster, 1 << len(twice))
            met.add(cluster)
    pieces = []
    for i, length, source, cluster in rows:
        marks = sources.get(source, 0), twice.get(cluster, 0)
        for k, start in enumerate(range(0, length, capacity)):
            pieces.append((min(capacity, length - start), i, k, start, *marks))
    # A source with more pieces than the lengths need bins decides how many bins there are, so it
    # opens them; the others then fill these from the longest piece down.
    least = sum(p[0] for p in pieces) / capacity
    bits = Counter(p[4] for p in pieces if p[4])
    wide = {b for b, n in bits.items() if 2 * n > least}
    pieces.sort(key=lambda p: (p[4] not in wide, -p[0], p[1] is None, p[1] or 0, p[2]))
    bins = BestFit(capacity)
    return [(i, k, start, size, *bins.put(size, s, c)) for size, i, k, start, s, c in pieces]


def best_fit_pack(docs: DataFrame, capacity: int = 2048, shard_rows: int = 4096, id_col: str = "doc_id", length_col: str = "length", source_col: str = "source", cluster_col: str = "cluster") -> DataFrame:
    """Every piece's place: doc_id, piece, start, length, bin_id, offset.

    No bin holds two pieces of one source or of one duplicate cluster, nor more than ``capacity``.
    A document longer than that is cut into pieces; nothing is dropped.

    * Null sources and null clusters conflict with nothing. Null ids are packed like others.
    * Lengths of null or under one take no place and give no row. Repeated rows are packed each.
    * Empty table: empty result. Other columns are not carried.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(length_col).cast("long").alias("length"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("long").alias("cluster")).where("length > 0")
    # Rows that are equal throughout are counted, so that they too are dealt to many shards.
    counted = rows.groupBy("doc_id", "length", "source", "cluster").agg(F.count("*").alias("n"))
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster") + F.col("copy"), F.lit(shards)))

    def of_shard(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("doc_id", "length", "source", "cluster")]
        found = list(zip(*pack_shard(list(zip(*columns)), capacity)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        out = [pa.array(c, kind) for c, kind in zip(found or [()] * len(kinds), kinds)]
        out[4] = pc.add(out[4], pa.scalar(key[0].as_py() << BIN_BITS, pa.int64()))
        return pa.Table.from_arrays(out, ["doc_id", "piece", "start", "length", "bin_id", "offset"])

    return each.groupBy("shard").applyInArrow(of_shard, "doc_id long, piece int, start long, length long, bin_id long, offset long")


def with_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, length (words and an end), source, cluster (of equal texts)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("cluster"), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(words_of(t)) + 1 for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n], ["doc_id", "source", "cluster", "length"])

    return rows.mapInArrow(counted, "doc_id long, source string, cluster long, length long")


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return best_fit_pack(with_lengths(docs))
