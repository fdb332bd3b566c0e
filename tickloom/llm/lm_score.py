"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

A word's class is a path in a tree: digits of a hash of the word, 16 branches a level, with so many
levels that about 64 words share a path. P(word | history) is the product of a softmax at every
node of the path and of P(word | path):

    P(digit | node, history) ~ P(digit | node) * exp(sum over features of weight * value)

* Features are the word before, those two and three back (skips), and the two before together (an
  n-gram), each with the node. A feature's value for a digit is the log of its count beside the
  feature over the node's share of the digit, and 0 if they never met.
* The counts stand in a hashed table of rows of 16, as many as the training tokens ask for, up to a
  bound. Beyond it rarer words count as features by their first digit only, the fewest that let
  the rest find room; the commonest words of any corpus keep rows of their own.
* The weights, one by level, kind of feature, how often the feature occurred, and how many of the
  last four words a rare n-gram foretold (none, one, more: the text repeats another), are trained by
  gradient: every task takes steps over all its positions and the results are averaged, by their
  positions. Texts are in two halves, and each is weighed with the other half's counts, as a new
  text would be; for scoring, both halves count together.
* Words of one path share what is left by their smoothed counts over all training texts.

Word counts never meet in one place. Words that make up 2^-20 or more of all are at most 2^20, so
their counts are sent to every task; the other words' occurrences are joined with the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_wanted, pieces, small_batches, stash
from .shingles import WordHasher

WAYS = 16
#: About this many words share a path, as far as the least and most levels of a tree allow.
LEAF_WORDS, LEAST_LEVELS, MOST_LEVELS = 64, 2, 4
#: A table has four rows for each training token, within these bounds; 32 MB of codes at most.
LEAST_ROWS, MOST_ROWS, BLOCK = 1 << 12, 1 << 21, 1 << 12
#: A row takes so many features; of a word at most so many occurrences count as features of their own.
LOAD, WORTH = 8, 100
#: Kinds of features: how many words back each looks.
KINDS = ((1,), (2,), (3,), (1, 2))
#: Weights differ by the feature's occurrences (none, 1, 2-3, 4-7, ... 32 and more) in each mode.
TIMES, MODES = 8, 3
BUCKETS = TIMES * MODES
#: What foretells: the last kind of feature, at the second level, where it occurred at most 7 times.
TELLING, RARE = len(KINDS) - 1, 24
#: Words with at least this share of all tokens have their counts sent; there are at most 1 / share.
SENT_SHARE = 2.0**-20
#: The hash that stands for the end of a text, and for what is before its first word.
END, START = np.uint64(0x9D39247E33776D41), np.uint64(7)
LOG10 = np.log(10)
#: A count is kept as one byte, 8 steps to a doubling: code c stands for the log STEP * (c - 1).
STEP = np.float32(np.log(2) / 8)
BUCKET_OF = np.minimum(np.r_[0, 1 + (np.arange(255) + 2) // 8], TIMES - 1)
#: Logits of so many tokens are computed together, rows of so many are looked for, features of so many are sorted.
TOGETHER, SOUGHT, SORTED = 2048, 1 << 15, 1 << 18
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * TWO
    return x ^ (x >> np.uint64(29))


@dataclass
class Tokens:
    """The tokens of several texts in turn: hash, path and text of each; sizes: tokens a text."""

    hashes: np.ndarray
    path: np.ndarray
    text: np.ndarray
    sizes: np.ndarray

    def back(self, d: int, seen: np.ndarray) -> np.ndarray:
        """What features see of the token d before each, START before a text's first."""
        out = np.full(len(seen), START)
        out[d:] = seen[: max(len(seen) - d, 0)]
        first = np.cumsum(self.sizes) - self.sizes
        for k in range(d):
            out[(first + k)[self.sizes > k]] = START
        return out


def path_of(hashes: np.ndarray) -> np.ndarray:
    """MOST_LEVELS digits of each word, the first one highest."""
    return (mixed(hashes + ONE) >> np.uint64(64 - 4 * MOST_LEVELS)).astype(np.int64)


def tokens_of(texts: list[str | None], hasher: WordHasher) -> Tokens:
    words, count = hasher.of(texts)
    sizes = count + 1
    hashes = np.full(int(sizes.sum()), END, np.uint64)
    word = np.ones(len(hashes), bool)
    word[np.cumsum(sizes) - 1] = False
    hashes[word] = words
    return Tokens(hashes, path_of(hashes), np.repeat(np.arange(len(sizes)), sizes), sizes)


def histories(t: Tokens, near: Places) -> np.ndarray:
    """(kinds, tokens) hashes of features' words; words not in ``near`` are seen by their first digit."""
    seen = np.where(near.of(t.hashes) >= 0, t.hashes, (t.path >> 4 * (MOST_LEVELS - 1)).astype(np.uint64))
    backs = {d: t.back(d, seen) for kind in KINDS for d in kind}
    out = np.empty((len(KINDS), len(t.hashes)), np.uint64)
    for k, kind in enumerate(KINDS):
        out[k] = k + 1
        for d in kind:
            out[k] = mixed(out[k] * ONE + backs[d])
    return out


class Places:
    """Where hashes stand in a sorted array of distinct ones: at a slot by their first bits, or, where several share one, by search."""

    def __init__(self, words: np.ndarray):
        bits = max(4, int(len(words)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.words = words
        slot = (words >> self.shift).astype(np.int64)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(words), dtype=np.int32)[::-1]
        self.others = np.flatnonzero(self.slots[slot] != np.arange(len(words)))
        self.crowded = words[self.others]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that are not there."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        place = self.slots.take((hashes >> self.shift).view(np.int64))
        out = np.where(self.words.take(place, mode="clip") == hashes, place, -1)
        if len(self.crowded):
            left = np.flatnonzero((out < 0) & (place >= 0))
            at = np.minimum(np.searchsorted(self.crowded, hashes[left]), len(self.crowded) - 1)
            out[left] = np.where(self.crowded[at] == hashes[left], self.others[at], -1)
        return out


def cuts(start: int, end: int, size: int = TOGETHER) -> list[slice]:
    return [slice(a, min(a + size, end)) for a in range(start, end, size)]


def rows_of(history: np.ndarray, path: np.ndarray, levels: range, rows: int) -> np.ndarray:
    """(levels, kinds, tokens): the table row of each token's feature of each kind at its node of these levels."""
    turn = np.stack([(path >> 4 * (MOST_LEVELS - level)).astype(np.uint64) + np.uint64(level << 40) for level in levels]) * TWO
    x = history + turn[:, None]
    y = x >> np.uint64(30)
    x ^= y
    x *= TWO
    np.right_shift(x, np.uint64(29), out=y)
    x ^= y
    x >>= np.uint64(24)
    x &= np.uint64(rows - 1)
    return x.view(np.int64)


def digit_of(path: np.ndarray, level: int) -> np.ndarray:
    return path >> 4 * (MOST_LEVELS - 1 - level) & WAYS - 1


@dataclass
class Model:
    """shares: each node's log probabilities by level; near: words that are features; table: codes of counts;
    weights: level, kind, bucket; mass: log10 of each path's smoothed total; words, counts: those sent to every task."""

    levels: int
    shares: list[np.ndarray]
    near: np.ndarray
    table: np.ndarray
    weights: np.ndarray
    mass: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int


class Logits:
    """Logits of digits from a table of codes, the nodes' shares and the weights.

    Rows of 16 bytes and their totals are fetched apart. Values are kept in units of STEP, as code - unit where there is a
    code, so that every step runs over the digits of many tokens at once; weights come 16 times each for the same reason.
    """

    def __init__(self, table: np.ndarray, shares: list[np.ndarray]):
        self.cells, self.totals = np.ascontiguousarray(table[:, :WAYS]), np.ascontiguousarray(table[:, WAYS])
        self.bucket = BUCKET_OF.astype(np.uint8).take(self.totals)
        self.shares, self.units = shares, [1 + s / STEP for s in shares]
        self.levels = range(len(shares))
        self.room = [np.empty(len(KINDS) * TOGETHER * WAYS, x) for x in (np.uint8, np.uint8, np.float32, np.float32, np.float32)]

    def modes(self, t: Tokens, h: np.ndarray, base: np.ndarray | int, rows: int) -> np.ndarray:
        """For each token how many of the four before it a rare n-gram foretold: 0, 1, or 2 for more."""
        level = min(1, self.levels[-1])
        at = rows_of(h[TELLING:], t.path, range(level, level + 1), rows)[0, 0] + base
        told = np.cumsum(np.r_[0, (self.cells.ravel().take(at * WAYS + digit_of(t.path, level)) > 0) & (self.totals.take(at) <= RARE)])
        place = np.arange(len(t.path))
        first = np.repeat(np.cumsum(t.sizes) - t.sizes, t.sizes)
        return np.minimum(told[place] - told[np.maximum(place - 4, first)], MODES - 1)

    def found(self, h: np.ndarray, path: np.ndarray, mode: np.ndarray, base: np.ndarray | int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(levels, kinds, tokens): each feature's row, and where its weight stands among a level's weights of all kinds and buckets.

        All at once, before any row is read: the buckets stay in the cache.
        """
        at = np.empty((len(self.levels), len(KINDS), len(path)), np.int64)
        place = np.empty(at.shape, np.uint8)
        part = (mode * TIMES + np.arange(len(KINDS))[:, None] * BUCKETS).astype(np.uint8)
        for z in cuts(0, len(path)):
            x = rows_of(h[:, z], path[z], self.levels, rows)
            x += base if isinstance(base, int) else base[z]
            at[..., z], place[..., z] = x, self.bucket.take(x)
        place += part
        return at, place

    def of(self, level: int, at: np.ndarray, place: np.ndarray, path: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (kinds, tokens, digits) values and (tokens, digits) logits at the rows ``at``. The values are good until the next call."""
        node, shape = path >> 4 * (MOST_LEVELS - level), (*at.shape, WAYS)
        codes, there, value, known, weight = (x[: at.size * WAYS].reshape(shape) for x in self.room)
        self.cells.take(at, axis=0, out=codes, mode="clip")
        value[...] = codes
        np.not_equal(codes, 0, out=there.view(bool))
        known[...] = there
        value -= self.units[level].take(node, axis=0)
        value *= known
        out = np.einsum("knd,knd->nd", value, weights.take(place, axis=0, out=weight, mode="clip"))
        out += self.shares[level].take(node, axis=0)
        return value, out


def spread(weights: np.ndarray) -> np.ndarray:
    """(levels, kinds and buckets, digits): each weight for every digit of a value."""
    return np.repeat((weights * STEP).astype(np.float32).reshape(len(weights), -1, 1), WAYS, axis=2)


def exp_sums(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each logit's exponential, in its place, and the sums of rows; logits stay far from the limits of exp."""
    np.exp(z, out=z)
    return z, z @ np.ones(WAYS, z.dtype)


# ---- counts of words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, path, c) of the words of a task's texts, a few million tokens together."""
    hasher, waiting, count = WordHasher(), [], 0

    def out() -> pa.RecordBatch:
        value, times = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.record_batch({"hash": pa.array(value.view(np.int64)), "path": pa.array(path_of(value)), "c": pa.array(times)})

    for batch in pieces(batches, 0, 2 << 20):
        t = tokens_of(batch.column(0).to_pylist(), hasher)
        waiting.append(t.hashes)
        count += len(t.hashes)
        if count > 3_000_000:
            yield out()
            waiting, count = [], 0
    if waiting:
        yield out()


def word_counts(train: DataFrame) -> DataFrame:
    """(hash, path, c): every distinct token of the training texts and its count."""
    rows = train.select("text").mapInArrow(_counted, "hash long, path long, c long")
    return stash(rows.groupBy("hash").agg(F.first("path").alias("path"), F.sum("c").alias("c")), "word-counts")


# ---- the table of features


def half_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """0 or 1 for each text, by its words."""
    first = np.cumsum(sizes) - sizes
    return (mixed(np.add.reduceat(hashes, first) + ONE) >> np.uint64(63)).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)


def _cells_of(h: np.ndarray, path: np.ndarray, base: np.ndarray, levels: int, rows: int) -> np.ndarray:
    """The cells of the table that the features of some tokens add to."""
    digits = np.stack([digit_of(path, level) for level in range(levels)])
    at = rows_of(h, path, range(levels), rows)
    at *= WAYS
    at += (digits + base)[:, None]
    return at.astype(np.int32).ravel()


def _features_counted(batches: Iterator[pa.RecordBatch], near: np.ndarray, levels: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(block, half, width, counts) of a task's texts: the table's non-empty blocks."""
    hasher, press, near = WordHasher(), zstandard.ZstdCompressor(level=1), Places(near)
    met = np.zeros(2 * rows * WAYS, np.uint16)

    def out() -> Iterator[pa.RecordBatch]:
        by = met.reshape(2, -1, min(BLOCK, rows) * WAYS)
        for half in (0, 1):
            for b in np.flatnonzero(by[half].any(axis=1)):
                x = by[half, b]
                narrow = x.astype("<u1") if x.max() < 256 else x.astype("<u2")
                yield pa.record_batch({"block": pa.array([b], pa.int32()), "half": pa.array([half], pa.int32()), "width": pa.array([narrow.itemsize], pa.int32()), "counts": pa.array([press.compress(narrow.tobytes())], pa.binary())})

    for batch in pieces(batches, 0, 1 << 20):
        t = tokens_of(batch.column(0).to_pylist(), hasher)
        h, base = histories(t, near), half_of(t.hashes, t.sizes)[t.text] * (rows * WAYS)
        for a in range(0, len(t.path), SORTED):
            at = np.sort(np.concatenate([_cells_of(h[:, z], t.path[z], base[z], levels, rows) for z in cuts(a, min(a + SORTED, len(t.path)))]))
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            at, times = at[first], np.diff(np.r_[first, len(at)])
            for part in range(0, int(times.max()), 60_000):  # more than a cell holds come in several goes
                some = np.clip(times - part, 0, 60_000)
                sums = met.take(at) + some
                if (sums > 65_535).any():
                    yield from out()
                    met[:], sums = 0, some
                met[at] = sums
    yield from out()


COUNTS = "block int, half int, width int, counts binary"


def _summed(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows by block: the sums of each half, or in the end the codes of both halves and of all."""
    press, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    block, sums = None, [None, None]

    def out() -> pa.RecordBatch:
        rows = [(h, s) for h, s in enumerate(sums) if s is not None]
        if last:
            a, b = (np.zeros_like(rows[0][1]) if s is None else s for s in sums)
            rows = [(h, codes(s)) for h, s in enumerate((a, b, a + b))]
        raw = [press.compress(s.tobytes()) for _, s in rows]
        columns = [pa.array([block] * len(rows), pa.int32()), pa.array([h for h, _ in rows], pa.int32()), pa.array([s.itemsize for _, s in rows], pa.int32()), pa.array(raw, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "half", "width", "counts"])

    for batch in batches:
        for b, half, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block:
                if block is not None:
                    yield out()
                block, sums = b, [None, None]
            x = np.frombuffer(open_.decompress(raw), f"<u{width}").astype(np.int64)
            sums[half] = x if sums[half] is None else sums[half] + x
    if block is not None:
        yield out()


def codes(counts: np.ndarray) -> np.ndarray:
    """Counts and the totals of rows as bytes: 0 for none, else 1 + 8 * log2, rounded."""
    counts = counts.reshape(-1, WAYS)
    counts = np.concatenate([counts, counts.sum(axis=1, keepdims=True)], axis=1)
    return np.where(counts > 0, np.minimum(255, 1 + np.rint(8 * np.log2(np.maximum(counts, 1)))), 0).astype(np.uint8)


def feature_tables(train: DataFrame, near: np.ndarray, levels: int, rows: int) -> np.ndarray:
    """(3, rows, 17) codes: the counts of either half of the texts and of all, and the rows' totals."""
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast(near)
    found = train.select("text").mapInArrow(lambda b: _features_counted(b, sent.value, levels, rows), COUNTS)
    # Twice, so that one task sums about the root of the number of tables.
    some = found.withColumn("some", F.abs(F.xxhash64("counts")) % 16).repartition(parts_wanted(spark), "block", "some").sortWithinPartitions("block")
    whole = some.drop("some").mapInArrow(lambda b: _summed(b, False), COUNTS)
    whole = whole.repartition(parts_wanted(spark), "block").sortWithinPartitions("block").mapInArrow(lambda b: _summed(b, True), COUNTS)
    table = np.zeros((3, rows, WAYS + 1), np.uint8)
    open_, step = zstandard.ZstdDecompressor(), min(BLOCK, rows)
    for r in whole.toLocalIterator():
        table[r["half"], r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(open_.decompress(bytes(r["counts"])), np.uint8).reshape(step, WAYS + 1)
    return table


# ---- training


def slopes(logits: Logits, level: int, at: np.ndarray, place: np.ndarray, path: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The gradient of the log likelihood by kind and bucket: values seen less values expected."""
    value, z = logits.of(level, at, place, path, weights)
    p, total = exp_sums(z)
    here = np.arange(0, z.size, WAYS) + digit_of(path, level)
    seen = value.reshape(len(KINDS), -1).take(here, axis=1)
    value *= p
    seen -= value @ np.ones(WAYS, value.dtype) / total
    return STEP * np.bincount(place.ravel(), seen.ravel(), len(KINDS) * BUCKETS)


class Steps:
    """Gradient ascent with moments."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights, self.rate, self.n = weights.copy(), rate, np.zeros(len(weights))
        self.mean, self.square = np.zeros_like(weights), np.zeros_like(weights)

    def take(self, level: int, g: np.ndarray) -> None:
        self.n[level] += 1
        n = self.n[level]
        m, s = self.mean[level], self.square[level]
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        rate = self.rate / np.sqrt(1 + n / 50)
        self.weights[level] += rate * (m / (1 - 0.9**n)) / (np.sqrt(s / (1 - 0.99**n)) + 1e-6)


def _train_task(batches: Iterator[pa.RecordBatch], near: np.ndarray, tables: np.ndarray, shares: list[np.ndarray], weights: np.ndarray, rate: float, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """One row: how many positions the task met, every one once, and its weights times that number.

    The first steps take few positions each, so that small inputs make steps too; from then on ``most``.
    """
    hasher, steps, met, rows = WordHasher(), Steps(weights, rate), 0, tables.shape[1]
    logits, near = Logits(tables.reshape(2 * rows, WAYS + 1), shares), Places(near)
    for batch in pieces(batches, 0, 1 << 20):
        t = tokens_of(batch.column(0).to_pylist(), hasher)
        h, other = histories(t, near), (1 - half_of(t.hashes, t.sizes)[t.text]) * rows
        mode = logits.modes(t, h, other, rows)
        for s in cuts(0, len(t.path), SOUGHT):
            path, a = t.path[s], 0
            at, place = logits.found(h[:, s], path, mode[s], other[s], rows)
            while a < len(path):
                end = min(a + min(most, 128 << int(steps.n[0]) // 16), len(path))
                wide, total = spread(steps.weights), np.zeros((len(shares), len(KINDS) * BUCKETS))
                for z in cuts(a, end):
                    for level in logits.levels:
                        total[level] += slopes(logits, level, at[level, :, z], place[level, :, z], path[z], wide[level])
                for level in logits.levels:
                    steps.take(level, total[level].reshape(len(KINDS), BUCKETS) / (end - a))
                a = end
        met += len(t.path)
    if met:
        yield pa.record_batch({"met": pa.array([met], pa.int64()), "weights": pa.array([(steps.weights * met).ravel().tolist()], pa.list_(pa.float64()))})


def node_shares(paths: np.ndarray, counts: np.ndarray, levels: int) -> list[np.ndarray]:
    """Each level's nodes' log shares of their digits, smoothed by half a token."""
    total = np.bincount(paths, counts, WAYS**MOST_LEVELS)
    out = []
    for level in range(levels):
        by = total.reshape(WAYS**level, WAYS, -1).sum(axis=2) + 0.5
        out.append(np.log(by / by.sum(axis=1, keepdims=True)).astype(np.float32))
    return out


def near_words(words: np.ndarray, times: np.ndarray, levels: int, rows: int) -> np.ndarray:
    """The words that are features themselves: those of the highest counts whose features find room. Equal counts go together."""
    order = np.argsort(-times, kind="stable")
    room = np.cumsum(np.minimum(times[order], WORTH)) * levels * len(KINDS) <= LOAD * rows
    if room.all():
        return np.sort(words.view(np.uint64))
    return np.sort(words[times > times[order][np.argmin(room)]].view(np.uint64))


def fit(train: DataFrame, counts: DataFrame, rounds: int = 1, rate: float = 0.03) -> Model:
    """The model of texts (text) and their word counts. Each round meets every position of every text."""
    spark = train.sparkSession
    found = counts.groupBy("path").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    paths, c, v = (found.column(k).to_numpy() for k in range(3))
    n, distinct = int(c.sum()), int(v.sum())
    levels = int(np.clip(np.ceil(np.log2(max(distinct, 1) / LEAF_WORDS) / 4), LEAST_LEVELS, MOST_LEVELS))
    rows = 1 << int(np.clip(np.ceil(np.log2(max(4 * n, 1))), np.log2(LEAST_ROWS), np.log2(MOST_ROWS)))
    shares = node_shares(paths, c, levels)
    leaf = paths >> 4 * (MOST_LEVELS - levels)
    mass = np.log10(np.bincount(leaf, c, WAYS**levels) + 0.5 * (np.bincount(leaf, v, WAYS**levels) + 1))
    often = counts.where(F.col("c") >= max(1.0, n * SENT_SHARE)).select("hash", "c").toArrow()
    words, times = often.column(0).to_numpy(), often.column(1).to_numpy()
    near = near_words(words, times, levels, rows)
    tables = feature_tables(train, near, levels, rows)
    weights = np.full((levels, len(KINDS), BUCKETS), 1 / len(KINDS))
    sent = spark.sparkContext.broadcast((near, tables[:2]))
    for _ in range(rounds):
        done = train.select("text").mapInArrow(lambda b, w=weights: _train_task(b, *sent.value, shares, w, rate), "met long, weights array<double>")
        sums = done.select("met", F.posexplode("weights").alias("k", "w")).groupBy("k").agg(F.sum("met").alias("met"), F.sum("w").alias("w")).collect()
        for r in sums:
            weights.ravel()[r["k"]] = r["w"] / r["met"]
    sent.unpersist()
    order = np.argsort(words.view(np.uint64))
    return Model(levels, shares, near, tables[2].copy(), weights, mass, words[order], times[order], n, distinct)


# ---- scoring


def shape_of(model: Model, logits: Logits, near: Places, t: Tokens) -> np.ndarray:
    """log10 of P(path | history) less the path's mass, for every token."""
    h, out, rows = histories(t, near), np.zeros(len(t.path)), len(model.table)
    mode, wide = logits.modes(t, h, 0, rows), spread(model.weights)
    for s in cuts(0, len(t.path), SOUGHT):
        at, place = logits.found(h[:, s], t.path[s], mode[s], 0, rows)
        for z in cuts(0, at.shape[2]):
            path = t.path[s][z]
            for level in logits.levels:
                _, logit = logits.of(level, at[level, :, z], place[level, :, z], path, wide[level])
                out[s][z] += logit.ravel().take(np.arange(0, logit.size, WAYS) + digit_of(path, level))
                out[s][z] -= np.log(exp_sums(logit)[1])
    return out / LOG10 - model.mass[t.path >> 4 * (MOST_LEVELS - model.levels)]


SCORED = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("counted", pa.float64()), ("shaped", pa.float64())])


def _find(model: Model, words: Places, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """For each token: is its word's count here, and which."""
    at = words.of(t.hashes)
    if not len(model.words):
        return at >= 0, np.zeros(len(at), np.int64)
    return at >= 0, model.counts.take(at, mode="clip")


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, doc_id, text): sums over the paths of all tokens and over the words whose counts are here."""
    hasher, logits, near, words = WordHasher(), Logits(model.table, model.shares), Places(model.near), Places(model.words.view(np.uint64))
    for batch in pieces(batches, 3, 1 << 20):
        t, n = tokens_of(batch.column(3).to_pylist(), hasher), batch.num_rows
        here, c = _find(model, words, t)
        known = np.where(here, np.log10(c + 0.5), 0)
        sums = [pa.array(t.sizes), pa.array(np.bincount(t.text, here, n).astype(np.int64)), pa.array(np.bincount(t.text, known, n)), pa.array(np.bincount(t.text, shape_of(model, logits, near, t), n))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *sums], schema=SCORED)


def _rare(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(hash, id, part) of every token whose count was not sent."""
    hasher, words = WordHasher(), Places(model.words.view(np.uint64))
    for batch in pieces(batches, 2, 2 << 20):
        t = tokens_of(batch.column(2).to_pylist(), hasher)
        rare = np.flatnonzero(words.of(t.hashes) < 0)
        of = pa.array(t.text[rare])
        yield pa.record_batch({"hash": pa.array(t.hashes[rare].view(np.int64)), "id": batch.column(0).take(of), "part": batch.column(1).take(of)})


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held_out: int = 1, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    * Words are runs of other than ASCII white space, A-Z lower-cased; the end is a token, so a
      null, empty or blank text has one token.
    * Rows with a null id are scored, learnt from by none, and not held out.
    * Rows that are equal in id and text are counted and scored each.
    * Nothing to learn from: every token's base probability is 1 (0.5 / 0.5).
    * Empty table: empty result. Other columns are not carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    remainder = F.crc32(F.col("doc_id").cast("string")) % fold
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    train = rows.where(remainder != held_out)
    counts = word_counts(train)
    model = fit(train, counts, rounds)
    sent = spark.sparkContext.broadcast(model)
    # Rows are told apart by id and a hash of their text; without an id, by two hashes of it.
    keyed = rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("id"), F.hash(F.col("doc_id").isNull(), "text").alias("part"), "doc_id", "text")
    scored = keyed.mapInArrow(lambda b: _score(b, sent.value), "id long, part int, doc_id long, n_tokens long, n_known long, counted double, shaped double")
    scored = scored.withColumn("copies", F.lit(1))
    rare = keyed.select("id", "part", "text").mapInArrow(lambda b: _rare(b, sent.value), "hash long, id long, part int")
    c = F.coalesce("c", F.lit(0))
    part = rare.join(counts.select("hash", "c"), "hash", "left").groupBy("id", "part").agg(F.count_if(c > 0).alias("n_known"), F.sum(F.log10(c + 0.5)).alias("counted"))
    part = part.select("id", "part", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), "n_known", "counted", F.lit(0.0).alias("shaped"), F.lit(0).alias("copies"))
    sums = scored.unionByName(part).groupBy("id", "part").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "counted", "shaped", "copies")])
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    one = lambda x: F.col(x) / F.col("copies")
    mass = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    return each.select(
        "doc_id",
        F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"),
        one("n_tokens").cast("long").alias("n_tokens"),
        one("n_known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (one("counted") - one("n_tokens") * mass).alias("base_score"),
        (one("counted") + one("shaped")).alias("score"),
    )
