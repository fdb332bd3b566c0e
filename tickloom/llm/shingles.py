"""Words and word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers that mix a word's hash into a shingle's.
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, with A-Z lower-cased."""
    return (text or "").encode().lower().split()


#: What of eight bytes belongs to a word of so many.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one at a time.
LONG = 256


def _stirred(h: np.ndarray, eight: np.ndarray) -> np.ndarray:
    h = (h ^ eight) * MIX
    h = (h ^ (h >> np.uint64(29))) * STEP
    return h ^ (h >> np.uint64(32))


class WordHasher:
    """Hashes of all words of texts at once, eight bytes of every word a round; A-Z count as a-z."""

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Every word's hash in turn, and how many words each text has."""
        return self.of_bytes([(t or "").encode() for t in texts])

    def of_bytes(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b" ".join(raw).lower() + b" " * 9, np.uint8)
        blank = (x == 32) | (x - np.uint8(9) <= 4)
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.r_[0, edge]
        start, size = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray((len(x) - 7,), "<u8", x, strides=(1,))
        h = _stirred(size.astype(np.uint64) * STEP, eight[start] & MASKS[np.minimum(size, 8)])
        live, k = np.flatnonzero(size > 8), 8
        for i in live[size[live] > LONG]:
            h[i] = xxhash.xxh64_intdigest(x[start[i] : start[i] + size[i]].tobytes(), 17)
        live = live[size[live] <= LONG]
        while len(live):
            h[live] = _stirred(h[live], eight[start[live] + k] & MASKS[np.minimum(size[live] - k, 8)])
            k += 8
            live = live[size[live] > k]
        bounds = np.cumsum([len(t) + 1 for t in raw])
        return h, np.diff(np.r_[0, np.searchsorted(start, bounds)]).astype(np.int64)


def _mixed(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX + w
    return (x ^ (x >> np.uint64(29))) * STEP


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row."""
    n = len(words) - k + 1
    x = np.full(max(n, 0), k, np.uint64)
    for i in range(k if n > 0 else 0):
        x = _mixed(x, words[i : i + n])
    return x ^ (x >> np.uint64(32))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit id of the set."""
    h = xxhash.xxh64_intdigest(shingles.tobytes(), 17)
    return h - (1 << 64) if h >> 63 else h


class Shingler:
    """Shingle sets of texts: the distinct runs of ``size`` words, ascending, as hashes.

    Of fewer words the whole sequence is one shingle; of none there is none.
    """

    def __init__(self, size: int):
        self.size, self.hasher = size, WordHasher()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        words, count = self.hasher.of(texts)
        rolled = _rolled(words, self.size)
        out, at = [], 0
        for n in count.tolist():
            if n >= self.size:
                out.append(_distinct(rolled[at : at + n - self.size + 1]))
            else:
                out.append(_rolled(words[at : at + n], n) if n else words[:0])
            at += n
        return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]
