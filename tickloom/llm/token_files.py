"""Token-id output: Arrow files of fixed-size lists, readable in place.

A data set is a folder with two Arrow files for each range of ids:

* ``seq-NNNNN.arrow``: batches of ``input_ids`` (fixed-size list of ``length`` unsigned integers)
  and ``mask`` (fixed-size list of bits: 1 for a token, 0 for the padding that ends the file).
  The file format's footer has each batch's place, so any sequence of a memory-mapped file is a
  view: sequence k is row ``k % rows`` of batch ``k // rows``, without a copy.
* ``doc-NNNNN.arrow``: ``doc_id``, ``start`` (in this file's tokens) and ``n_tokens`` a document.

Files are written under a name of their own and then renamed, so a task that runs twice leaves
one whole file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkCache, WordSplitter, check_settings, rejoin
from .common import new_path, parts_wanted, pieces, range_cuts, range_part, small_batches

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, n_docs long, n_tokens long, n_sequences long"


class Library:
    """The tokenizers library over the words of texts, a batch of words a call."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        check_settings(json.loads(self.model.to_str()))
        self.model.no_padding()
        self.model.no_truncation()
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = WordSplitter(t.content for t in self.model.get_added_tokens_decoder().values())
        self.met = ChunkCache(self._words, 80 << 20, block=2000)
        self.cache = ChunkCache(self._chunks)

    def _words(self, words: list[str]) -> list[bytes]:
        got = self.model.encode(words, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(got.ids, self.kind).tobytes()
        ends = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(words))) * self.kind.itemsize
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """A chunk's words are encoded alone, as the library does; the words met lately are kept too."""
        words = self.words.split([c.decode() for c in chunks])
        return rejoin(words, self.met.look_up({w for w in words if w != "\n"}))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(i, self.kind) for i in self.cache.ids(texts)]


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> Library:
    """One a worker process, kept from task to task."""
    return Library(path)


class SequenceWriter:
    """Cuts a stream of ids into rows of ``length`` and writes them ``rows`` at a time."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int):
        self.kind, self.length, self.rows = kind, length, rows
        item = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.count, self.sequences = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= self.length * self.rows:
            self._flush(self.length * self.rows)

    def _flush(self, unit: int) -> None:
        flat = np.concatenate(self.held)
        whole = len(flat) // unit * unit
        for k in range(0, whole, unit):
            self._write(flat[k : k + unit], np.ones(unit, bool))
        self.held, self.count = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, mask: np.ndarray) -> None:
        item = self.schema.field(0).type.value_type
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(flat, item), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.sequences += len(flat) // self.length

    def close(self) -> None:
        if self.count:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, np.arange(len(padded)) < len(flat))
        self.out.close()


def _names(folder: str, part: int) -> tuple[pafs.FileSystem, str, str]:
    fs, root = pafs.FileSystem.from_uri(folder)
    return fs, f"{root}/seq-{part:05d}.arrow", f"{root}/doc-{part:05d}.arrow"


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, length: int, rows: int) -> Iterator[pa.RecordBatch]:
    model, part, mine = tokenizer_of(path), TaskContext.get().partitionId(), uuid.uuid4().hex
    fs, seq_name, doc_name = _names(folder, part)
    fs.create_dir(seq_name.rpartition("/")[0], recursive=True)
    at = n_docs = 0
    with fs.open_output_stream(f"{seq_name}.{mine}") as seq_sink, fs.open_output_stream(f"{doc_name}.{mine}") as doc_sink:
        seq, index = SequenceWriter(seq_sink, model.kind, length, rows), pa.ipc.new_file(doc_sink, DOCS)
        end = np.array([end_id], model.kind)
        for batch in pieces(batches, 1):
            ids = model.encode(batch.column(1).to_pylist())
            sizes = np.array([len(i) + 1 for i in ids])
            for i in ids:
                seq.add(i)
                seq.add(end)
            starts = at + np.cumsum(sizes) - sizes
            index.write_batch(pa.record_batch([batch.column(0), pa.array(starts), pa.array(sizes)], schema=DOCS))
            at, n_docs = at + int(sizes.sum()), n_docs + len(sizes)
        seq.close()
        index.close()
    fs.move(f"{seq_name}.{mine}", seq_name)
    fs.move(f"{doc_name}.{mine}", doc_name)
    yield pa.record_batch({"part": pa.array([part], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([at], pa.int64()), "n_sequences": pa.array([seq.sequences], pa.int64())})


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, rows: int = 64) -> list[tuple[int, int]]:
    """Write the data set in ascending id and return (part, tokens before it), one pair a file.

    The driver gets four numbers a file, never ids or texts.

    * Null or empty text: the end id alone. Null ids come first; ties are in order of text.
    * Repeated rows are documents of their own. Empty table: one pair of files without rows.
    * Other columns are not carried. The mask is 0 only after a file's last token.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cuts = range_cuts(data, "_id", parts_wanted(spark))
    dealt = data.withColumn("_part", range_part("_id", cuts)).repartitionById(len(cuts) + 1, F.col("_part"))
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("_id"), "_text").select("_id", "_text")
    manifest = ordered.mapInArrow(lambda b: _write_part(b, folder, path, end_id, length, rows), MANIFEST).collect()
    before, out = 0, []
    for m in sorted(manifest, key=lambda m: m["part"]):
        out.append((m["part"], before))
        before += m["n_tokens"]
    return out


class TokenFile:
    """One part of a data set, opened in place."""

    def __init__(self, folder: str, part: int):
        fs, seq_name, doc_name = _names(folder, part)
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = (lambda name: pa.memory_map(name)) if local else fs.open_input_file
        self.seq, self.docs = pa.ipc.open_file(opened(seq_name)), pa.ipc.open_file(opened(doc_name))
        self.length = self.seq.schema.field(0).type.list_size
        self._at, self._flat = -1, None

    def flat(self, batch: int) -> np.ndarray:
        """All ids of a batch, row after row, as a view."""
        if batch != self._at:
            self._at, self._flat = batch, self.seq.get_batch(batch).column(0).flatten().to_numpy()
        return self._flat

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        per = self.seq.get_batch(0).num_rows
        row = self.seq.get_batch(k // per).slice(k % per, 1)
        return row.column(0).flatten().to_numpy(), row.column(1).flatten().to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids of a span, a batch's share at a time."""
        per = self.seq.get_batch(0).num_rows * self.length if n else 1
        while n:
            inside = start % per
            got = self.flat(start // per)[inside : inside + n]
            yield got
            start, n = start + len(got), n - len(got)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read_parts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = TokenFile(folder, part)
            for k in range(file.docs.num_record_batches):
                docs = file.docs.get_batch(k)
                sums = []
                for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                    crc = 0
                    for ids in file.tokens(start, n):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                starts = docs.column(1).to_numpy() + before
                yield pa.record_batch([docs.column(0), pa.array(starts), docs.column(2), pa.array(sums, pa.int64())], schema=READ)


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, int]]) -> DataFrame:
    """A row for each document from the files: doc_id, start in the whole data set, n_tokens, ids_crc32."""
    rows = spark.createDataFrame(parts, "part int, before long").repartitionById(max(1, len(parts)), F.col("part"))
    return rows.mapInArrow(lambda b: _read_parts(b, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    folder = new_path(spark, "token-files")
    if "://" not in folder:
        folder = f"file://{folder}"
    return read_token_files(spark, folder, write_token_files(docs, folder, path, end_id))
