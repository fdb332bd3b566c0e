"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every triplet of bytes 0,1,2 / 0,1,3 / 0,2,3 of a sliding four-byte window is hashed into one of
256 buckets. A bucket's code (0 to 3) says in which quarter of this text's own bucket counts it
lies. The digest is a code of the length and the 256 codes, as hex. Two digests differ by the sum
of their buckets' steps (a step across three quarters counts six) and of their length codes, cut
off at the difference that unrelated digests have on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_wanted, range_cuts, range_part, small_batches

BUCKETS = 256
#: What a step between two quartile codes costs.
STEPS = np.array([0, 1, 2, 6])
#: The mean difference of two independent digests: 256 buckets at (6*1 + 4*2 + 2*6) / 16.
BOUND = 256 * 26 / 16
#: One step of the length code is a tenth more bytes; steps beyond this many count no more.
LENGTH_STEP, LENGTH_MOST = 1.1, 24


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """One row of 256 triplet counts a text."""
    sizes = np.array([len(t) for t in texts])
    x = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    base = np.repeat(np.arange(len(texts), dtype=np.int32) * BUCKETS, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(x))  # bytes from here to the end of the text
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for kind, (second, third) in enumerate(((1, 2), (1, 3), (2, 3)), 1):
        n = len(x) - third
        if n <= 0:
            continue
        v = x[:n] * np.uint32(0x9E3779B1) + x[second : second + n] * np.uint32(0x85EBCA77) + x[third:] * np.uint32(0xC2B2AE3D) + np.uint32(kind * 0x27D4EB2F & 0xFFFFFFFF)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        slots = base[:n] + (v >> np.uint32(24)).astype(np.int32)
        counts += np.bincount(slots[left[:n] > third], minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """One row a text: the length code (two bytes), then 64 bytes of bucket codes, four to a byte."""
    if not texts:
        return np.zeros((0, 66), np.uint8)
    counts = bucket_counts(texts)
    ranked = np.sort(counts, axis=1)
    codes = sum((counts > ranked[:, [BUCKETS * q // 4 - 1]]).astype(np.uint8) for q in (1, 2, 3))
    packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    size = np.floor(np.log1p([len(t) for t in texts]) / np.log(LENGTH_STEP)).astype(">u2").reshape(-1, 1).view(np.uint8)
    return np.concatenate([size, packed], axis=1)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The difference score of digests row by row, at most BOUND."""
    shifts = np.array([0, 2, 4, 6], np.uint8)
    codes = lambda d: (d[:, 2:, None] >> shifts & 3).astype(np.int8)
    size = lambda d: d[:, 0].astype(int) << 8 | d[:, 1]
    total = STEPS[np.abs(codes(a) - codes(b))].sum(axis=(1, 2)) + np.minimum(np.abs(size(a) - size(b)), LENGTH_MOST)
    return np.minimum(total, BOUND)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for those that differ as unrelated ones do or more."""
    return 1 - differences(a, b) / BOUND


def hexes(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def _edited(text: str, after: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all but the last text, which is only the one after."""
    raw = [t.encode() for t in texts]
    edited = [_edited(t, after).encode() for t, after in zip(texts, texts[1:])]
    own, changed = digests(raw), digests(edited)
    n = len(edited)
    columns = [ids[:n], [len(t) for t in texts[:n]], [hashlib.sha256(e).hexdigest() for e in edited], hexes(own[:n]), hexes(changed), likeness(own[:n], changed), likeness(own[:n], own[1:])]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, OUT)], schema=OUT)


def _with_next(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows come by part, a part's own rows in order, then the first row after them."""
    ids: list = []
    texts: list[str] = []
    part, held, closed = None, 0, True
    for batch in batches:
        for p, ahead, i, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if p != part:
                part, ids, texts, held, closed = p, [], [], 0, False
            if closed:
                continue
            ids.append(i)
            texts.append(t)
            held += len(t)
            closed = bool(ahead)
            if len(texts) > 1 and (closed or held > most):
                yield _compare(ids, texts)
                ids, texts, held = ids[-1:], texts[-1:], len(t)


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's digest, that of its edited text, and how near they and the next document are.

    Next: in descending id (ties: descending text); after the last comes the first. The edited
    text has its last third (rounded down) replaced by as many code points of the next text's start.

    * Null or empty text: the digest of no bytes (all zero). Texts under three bytes hold no
      triplet, so only their length tells them apart.
    * Null ids come last; repeated rows are neighbours like any others; a single row is its own next.
    * Empty table: empty result. Other columns are not carried.

    Ids are cut into ranges whose last ids occur in the data, so the one row that a range needs
    from its neighbour is known beforehand and is sent there too: one shuffle, no global order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cuts = range_cuts(rows, "_id", parts_wanted(spark))
    top = rows.agg(F.max("_id").alias("m")).first()["m"]
    own, at_cut = range_part("_id", cuts), range_part("_up", cuts)
    place = lambda part, ahead: F.struct(part.cast("int").alias("_part"), F.lit(ahead).alias("_ahead"))
    places = F.array_compact(F.array(place(own, 0), F.when(at_cut > own, place(at_cut, 1)), F.when(F.col("_id").eqNullSafe(F.lit(top)), place(F.lit(0), 1))))
    dealt = rows.withColumn("_up", F.col("_id") + 1).select(F.inline(places), "_id", "_text")
    placed = dealt.repartitionById(len(cuts) + 1, F.col("_part")).sortWithinPartitions("_part", "_ahead", F.desc_nulls_last("_id"), F.desc("_text"))
    return placed.mapInArrow(_with_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return fingerprint_with_next(docs.select("doc_id", "text"))
