"""Exact encoding with a sentencepiece model of type BPE, by backtracking, and decoding.

A sequence of pieces is what merging makes of a text exactly if merging makes of every two neighbours,
taken alone, these two again. So the longest piece is tried at each place, then shorter ones, each
against its predecessor only; a place from which nothing leads on is marked as failed and never
entered again. One scan of an Aho-Corasick automaton over the reversed chunk finds the longest piece
that starts at each place.

No piece has a space after another character, or a letter beside another character than a space, so a
text is cut before every run of spaces and between letters and others, and a worker keeps the ids of
the chunks it met lately (``chunks``).
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkCache
from .common import pieces, small_batches

#: What stands for a space in the pieces.
SPACE = "▁"
CHUNK = re.compile(r" *[^\W\d_¹²³]+| *(?:[\W\d_¹²³](?<! ))+| +")
#: Types of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceBpe:
    """Encodes and decodes as the model's own library does, without sampling and without ids for begin and end."""

    #: Pairs of pieces whose check is kept.
    KNOWN_PAIRS = 400_000

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("this model normalises or encodes texts in another way")
        names = [p.piece for p in model.pieces]
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.id = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == NORMAL}
        self.byte_id = {int(name[3:5], 16): i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == BYTE}
        if any(len(CHUNK.findall(name.replace(SPACE, " "))) > 1 for name in self.id) or len(self.byte_id) != 256:
            raise ValueError("pieces that span chunks, or bytes without a piece")
        self.longest = ahocorasick.Automaton()
        for name in self.id:
            self.longest.add_word(name[::-1], name)
        self.longest.make_automaton()
        self.shorter = {name: next((name[:k] for k in range(len(name) - 1, 0, -1) if name[:k] in self.id), None) for name in self.id}
        self.known: dict[tuple[str, str], bool] = {}
        self.kinds, self.control = kinds, {i for i, kind in enumerate(kinds) if kind == CONTROL}
        unknown = model.trainer_spec.unk_surface.encode()
        byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.raw = [byte_of.get(i, b"" if kind == CONTROL else unknown if kind == UNKNOWN else name.replace(SPACE, " ").encode()) for i, (name, kind) in enumerate(zip(names, kinds))]
        self.decimal = [str(i) for i in range(len(names))]

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the cheapest piece of two neighbours first, of equals the leftmost."""
        parts, cost = list(text), self.cost
        while len(parts) > 1:
            found = [(cost[p], i) for i, p in enumerate(map(str.__add__, parts, parts[1:])) if p in cost]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether the two stay as they are when their text is merged anew; ``before`` is empty at the start."""
        pair = before, piece
        if len(self.known) >= self.KNOWN_PAIRS:
            self.known.clear()
        ok = self.known[pair] = self.merged(before + piece) == [p for p in pair if p]
        return ok

    def tokens(self, chunk: str) -> list[str]:
        """The pieces of a chunk in which SPACE stands for spaces; a letter that no piece is stands alone."""
        n, known, shorter = len(chunk), self.known, self.shorter
        start: list[str | None] = [None] * n
        seen = -1
        for end, piece in self.longest.iter(chunk[::-1]):
            # Of the pieces that end at one place the longest comes first.
            if end != seen:
                start[n - 1 - end], seen = piece, end
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        at, last, piece = 0, "", start[0] or chunk[0]
        while True:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = known.get((last, piece))
                    if fits or fits is None and self.fits(last, piece):
                        break
                # After all pieces the bare letter, if it is none.
                if piece in shorter:
                    piece = shorter[piece]
                    if piece is None and end > at + 1 and chunk[at] not in shorter:
                        piece = chunk[at]
                else:
                    piece = None
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
                continue
            out.append(piece)
            if end == n:
                return out
            at, last, piece = end, piece, start[end] or chunk[end]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, little-endian 32-bit."""
        out, ids = [], self.id
        for chunk in chunks:
            found: list[int] = []
            for piece in self.tokens(chunk.replace(" ", SPACE)):
                if piece in ids:
                    found.append(ids[piece])
                else:
                    found += [self.byte_id[b] for b in piece.encode()]
            out.append(struct.pack(f"<{len(found)}I", *found))
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """The chunks of a text with the space that every text begins with; none of an empty one."""
        return CHUNK.findall(" " + text.replace(SPACE, " ")) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the space that a text begins with, bytes that form no letter replaced one by one."""
        raw = [self.raw[i] for i in ids]
        first = next((k for k, r in enumerate(raw) if r), None)
        if first is not None and self.kinds[ids[first]] == NORMAL and raw[first].startswith(b" "):
            raw[first] = raw[first][1:]
        if self.control.isdisjoint(ids):
            return b"".join(raw).decode("utf-8", "each_byte")
        # Bytes on both sides of a control piece form no letter together.
        cuts = [k for k, i in enumerate(ids) if i in self.control]
        return "".join(b"".join(raw[a:b]).decode("utf-8", "each_byte") for a, b in zip([0, *cuts], [*cuts, len(ids)]))


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[PieceBpe, ChunkCache]:
    """One a worker process, kept from task to task."""
    bpe = PieceBpe(path)
    return bpe, ChunkCache(bpe.encode_chunks, 80 << 20, split=bpe.split)


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coded(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    bpe, cache = coder(path)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in pieces(batches, 1, 2 << 20):
        raw = cache.ids([t or "" for t in batch.column(1).to_pylist()])
        ids = [np.frombuffer(r, "<u4").tolist() for r in raw]
        n = pa.array([len(i) for i in ids], pa.int64())
        decoded = [bpe.decode(i) for i in ids]
        if digest:
            joined = pa.array([sha(",".join([bpe.decimal[k] for k in i])) for i in ids], pa.string())
            yield pa.record_batch([batch.column(0), n, joined, pa.array(map(sha, decoded), pa.string())], schema=DIGEST)
        else:
            yield pa.record_batch([batch.column(0), n, pa.array(raw, pa.binary()), pa.array(decoded, pa.string())], schema=OUT)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each document's id, n_tokens, ids (32-bit little-endian) and decoded text; ``digest``: their SHA-256 instead, of the decimal ids with commas between.

    * Null or empty text: no ids, empty decoded text. Spaces alone are encoded like others.
    * Null ids, repeated rows: a row each, as they stand. Empty table: empty result.
    * A run of any length without a space is encoded whole. Other columns are not carried.
    """
    small_batches(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, n_tokens long, ids binary, decoded string"
    return rows.mapInArrow(lambda b: _coded(b, path, digest), kind)


def op13(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """``encode_decode`` with digests; nulls, repeats, long texts, empty tables and other columns as there."""
    return encode_decode(docs, path, digest=True)
