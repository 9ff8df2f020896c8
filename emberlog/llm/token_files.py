"""Operator 1: token ids as Arrow stream files of equal-length sequences.

A file holds record batches of two columns, ``ids`` (fixed-size lists of
unsigned integers) and ``mask`` (fixed-size lists of booleans, false over the
padding that ends a file).  Buffers are not compressed, so a memory-mapped file
gives any sequence and its mask without a copy.  Beside it lies an index, an
Arrow stream of (doc_id, start, n_tokens), whose starts count from the file's
first id.

Rows go to the files in ascending doc_id (null first; repeated doc_ids by a
hash of the text); repeated rows are written as often as they occur.  A null or
empty text gives the end id alone, a very long one runs on over as many sequences
as it needs; an empty table gives no file and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import filesystem
from .word_table import encoded

SEQUENCE_LENGTH = 2048
SEQUENCES_A_BATCH = 64
FILES_SCHEMA = "part int, path string, n_docs long, n_tokens long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class TokenFileWriter:
    """Appends documents to one file; holds no more than a batch of ids."""

    def __init__(self, fs, path: str, length: int, dtype: str):
        self.fs, self.path, self.length, self.dtype = fs, path, length, np.dtype(dtype)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.kind, self.size = kind, length * SEQUENCES_A_BATCH
        attempt = uuid.uuid4().hex
        self.temporary = {k: f"{path}.{k}.{attempt}" for k in ("arrows", "index.arrows")}
        self.streams = {k: fs.open_output_stream(p) for k, p in self.temporary.items()}
        self.out = pa.ipc.new_stream(self.streams["arrows"], self.schema)
        self.index = pa.ipc.new_stream(self.streams["index.arrows"], INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens, self.n_docs = self.n_tokens + len(ids), self.n_docs + 1
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.size:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.size * self.size
            for at in range(0, whole, self.size):
                self._write(flat[at : at + self.size], self.size)
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole
        if len(self.rows) >= 10_000:
            self._write_index()

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((flat, self.kind), (mask, pa.bool_()))]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def _write_index(self) -> None:
        if self.rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)]
            self.index.write_batch(pa.record_batch(columns, schema=INDEX))
            self.rows = []

    def close(self) -> None:
        """Finish, and give the files their names: a repeated attempt of a task replaces whole files."""
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self._write_index()
        self.out.close()
        self.index.close()
        for k, s in self.streams.items():
            s.close()
            self.fs.move(self.temporary[k], f"{self.path}.{k}")


class TokenFile:
    """Random access to one file by a memory map (local paths) or ranged reads: all batches but the last have one size."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path + ".arrows") if fs.type_name == "local" else fs.open_input_file(path + ".arrows")
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.begin = self.source.tell()
        self.held = 0, self._read(self.begin)
        self.step = self.source.tell() - self.begin
        # a stream ends with eight bytes that are no batch
        self.last = max(-(-(self.source.size() - 8 - self.begin) // self.step) - 1, 0)
        self.n = self.last * SEQUENCES_A_BATCH + self._batch(self.last).num_rows

    def _read(self, at: int) -> pa.RecordBatch:
        self.source.seek(at)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.held[0] != k:
            self.held = k, self._read(self.begin + k * self.step)
        return self.held[1]

    def __len__(self) -> int:
        return self.n

    def _find(self, i: int) -> tuple[pa.RecordBatch, int]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self._batch(i // SEQUENCES_A_BATCH), i % SEQUENCES_A_BATCH

    def sequence(self, i: int) -> np.ndarray:
        """Sequence ``i``, a view of the file where that is mapped."""
        batch, k = self._find(i)
        column = batch.column(0)
        n = column.type.list_size
        return column.values.slice((column.offset + k) * n, n).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        batch, k = self._find(i)
        column = batch.column(1)
        n = column.type.list_size
        return column.values.slice((column.offset + k) * n, n)


def largest_id(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values())


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, length: int = SEQUENCE_LENGTH, dtype: str = "uint16", partitions: int | None = None) -> DataFrame:
    """Write ``docs`` below ``out`` and return a row (part, path, n_docs, n_tokens) for each file, parts in doc_id order.

    ``dtype`` must hold the vocabulary's largest id, else this raises.  One
    shuffle, by ranges of doc_id; ids are made after it, so that only texts move.
    """
    most = max(end_id, largest_id(tokenizer_path))
    if most > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} does not hold the id {most}")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fs, base = filesystem(out)
    fs.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        for doc_id, ids in encoded(batches, tokenizer_path, end_id):
            if writer is None:
                fs, base = filesystem(out)
                writer = TokenFileWriter(fs, f"{base}/part-{part:06d}", length, dtype)
            writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            row = {"part": part, "path": f"{out}/part-{part:06d}", "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(write, FILES_SCHEMA)


def read_token_files(spark: SparkSession, files: list) -> DataFrame:
    """Per document of the files (rows of :func:`write_token_files`): doc_id, start over all files, n_tokens, ids_crc32."""
    total, rows = 0, []
    for f in sorted(files, key=lambda f: f.part):
        rows.append((f.path, total))
        total += f.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from digest_file(path, base)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, "path string, base long").repartition(len(rows)).mapInArrow(read, schema)


def digest_file(uri: str, base: int) -> Iterator[pa.RecordBatch]:
    """The documents of one file, with a checksum over the ids as the file holds them."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path + ".arrows") as tokens, fs.open_input_file(path + ".index.arrows") as index:
        sequences = iter(pa.ipc.open_stream(tokens))
        held, begins = np.empty(0, "<u4"), 0
        for documents in pa.ipc.open_stream(index):
            starts, counts = documents.column(1).to_pylist(), documents.column(2).to_pylist()
            sums = []
            for start, count in zip(starts, counts, strict=True):
                crc, at, left = 0, start, count
                while left:
                    if at >= begins + len(held):
                        begins += len(held)
                        batch = next(sequences)
                        held = batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                    piece = held[at - begins : at - begins + left]
                    crc = zlib.crc32(piece.tobytes(), crc)
                    at, left = at + len(piece), left - len(piece)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([documents.column(0), pa.array([s + base for s in starts], pa.int64()), documents.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
