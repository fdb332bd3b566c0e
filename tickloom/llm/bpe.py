"""BPE encoding and decoding in batched numpy merge rounds, for tokenizer files of word-end BPE.

The symbols of many words lie in one flat array. A round looks up the key of every adjacent pair
by binary search among the sorted keys of all merges, takes each word's lowest rank, and merges it
in all words at once. Words that have no merge left drop out.

White space separates, so a text is its chunks between ASCII white space, one after another; a
worker keeps the ids of the chunks it met lately (``chunks``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkCache, WordSplitter, check_settings, rejoin
from .common import pieces, small_batches

NEVER = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it is one, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encodes and decodes as the file's own library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for t, i in (vocab | self.special).items():
            self.tokens[i] = t
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        # A rank whose product takes part in no earlier merge: all its places in a word can be merged at once.
        first = np.full(self.size, NEVER, np.int64)
        np.minimum.at(first, np.concatenate([keys // self.size, keys % self.size]), np.tile(np.arange(len(keys)), 2))
        self.safe = first[made] > np.arange(len(made))
        self.words = WordSplitter(self.special)

    def _ranks_of(self, sym: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each symbol; inside: the next symbol is of the same word."""
        out = np.full(len(sym), NEVER, np.int32)
        at = np.flatnonzero(inside)
        keys = sym[at].astype(np.int64) * self.size + sym[at + 1]
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == keys
        out[at[hit]] = self.ranks[place[hit]]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (their bytes, at least one each) in turn, and where each word's end."""
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            inside = np.r_[word[1:] == word[:-1], False]
            rank = self._ranks_of(sym, inside)
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(best != NEVER, lengths)
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, rank = sym[live], word[live], rank[live]
                lengths, best = lengths[best != NEVER], best[best != NEVER]
                if not len(sym):
                    break
            each = np.repeat(best, lengths)
            hit = np.flatnonzero(rank == each)
            # Left to right without overlap: of adjacent hits every second one counts.
            run = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
            since = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            first = np.r_[True, word[hit][1:] != word[hit][:-1]]
            hit = hit[(since % 2 == 0) & self.safe[each[hit]] | first]
            sym[hit] = self.made[each[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        out_word = np.concatenate([w for w, _ in done])
        out_sym = np.concatenate([s for _, s in done])
        order = np.argsort(out_word, kind="stable")
        return out_sym[order], np.cumsum(np.bincount(out_word, minlength=len(words)))

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk (bytes without a line feed), little-endian 32-bit."""
        parts = self.words.split([c.decode() for c in chunks])
        known = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        words = list({w for w in parts if w not in known and w != "\n"})
        if words:
            flat, ends = self.merge([w.encode() for w in words])
            raw, at = flat.astype("<u4").tobytes(), 0
            for w, end in zip(words, (4 * ends).tolist()):
                known[w] = raw[at:end]
                at = end
        return rejoin(parts, known)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with one space between, as the library decodes for a file that names no decoder."""
        return " ".join([self.tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[WordBpe, ChunkCache]:
    """One a worker process, kept from task to task."""
    bpe = WordBpe(path)
    return bpe, ChunkCache(bpe.encode_chunks)


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coded(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    bpe, cache = coder(path)
    for batch in pieces(batches, 1, 2 << 20):
        ids = cache.ids([t or "" for t in batch.column(1).to_pylist()])
        decoded = [bpe.decode(np.frombuffer(i, "<u4")) for i in ids]
        n = pa.array([len(i) // 4 for i in ids], pa.int64())
        if digest:
            sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
            yield pa.record_batch([batch.column(0), n, sha(ids), sha(d.encode() for d in decoded)], schema=DIGEST)
        else:
            yield pa.record_batch([batch.column(0), n, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=OUT)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each document's id, n_tokens, ids (32-bit little-endian) and decoded text; ``digest``: their SHA-256.

    * Null or empty text, or white space only: no ids, empty decoded text.
    * Null ids, repeated rows: a row each, as they stand. Empty table: empty result.
    * A word of any length is encoded whole. Other columns are not carried.
    """
    small_batches(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, n_tokens long, ids binary, decoded string"
    return rows.mapInArrow(lambda b: _coded(b, path, digest), kind)


def op5(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return encode_decode(docs, path, digest=True)
