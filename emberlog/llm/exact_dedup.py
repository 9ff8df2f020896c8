"""Operator 3: Grace hash deduplication of texts.

Texts are equal when identical after each run of ASCII white space becomes one
space; null counts as empty.  Three steps:

1. Every scan task builds an open-addressing table of the texts it meets, so a
   text that fills a third of the corpus leaves each task once.  Each row gets
   the number of its entry.
2. The entries, with complete texts, are partitioned by hash (the shuffle is the
   first level of partitioning).  A task whose entries outgrow its table
   partitions them further into spill files, by other bits of the hash and
   recursively, until each bucket fits; then the table compares complete texts.
   A hash whose entries are more bytes than a task should read is first merged
   in parts, dealt by a salt.
3. Rows join their entry's group by number.  No number belongs to more rows than
   one scan task read, so no key is hot.

One row of each group stays: of smallest doc_id, and among several such rows the
one read first; one without doc_id only if no row of the group has an id.
Repeated rows each return a row.  Texts of any length are compared whole.  An
empty table gives no rows; other columns are ignored, and stay in :func:`drop_exact`.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import filesystem, scratch, written
from .word_table import byte_slices, text_slices

#: Bytes of text in one table, in a scan task and in a bucket.
TABLE_BYTES = 48_000_000
FANOUT = 16
SPACE = b" \t\n\r\x0b\x0c"
NO_ID = (1 << 63) - 1
#: Bytes of one text's entries that a task reads at most, but for this share of all entries: fewer than ``HOT_SHARE`` hashes have more.
HOT_BYTES, HOT_SHARE = 64_000_000, 1 << 16
ROWS = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("entry", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("row", pa.int64()), ("text", pa.binary())])


def normalise(text: bytes) -> bytes:
    """Every run of ASCII white space as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    core = b" ".join(words)
    return (b" " if text[0] in SPACE else b"") + core + (b" " if text[-1] in SPACE else b"")


class TextTable:
    """Open addressing with linear probing; a slot is taken as equal only after its whole text was compared."""

    def __init__(self) -> None:
        self.slots, self.used, self.bytes = [-1] * 1024, 0, 0
        self.hashes: list[int] = []
        self.texts: list[bytes] = []

    def find(self, h: int, text: bytes) -> tuple[int, bool]:
        """(entry of the text, whether it is new)."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return e, False
            at = (at + 1) & mask
        e = self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + 100
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: a row for each document, and with the text a row for each entry."""
    base, n_entries, n_rows = TaskContext.get().partitionId() << 33, 0, 0
    table, counts, least, shas = TextTable(), [], [], []

    def entries() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(table.texts), 512):
            to = min(at + 512, len(table.texts))
            lowest, rows = zip(*least[at:to], strict=True)
            columns = [shas[at:to], range(base + n_entries + at, base + n_entries + to), counts[at:to], lowest, rows, table.texts[at:to]]
            yield pa.record_batch([pa.nulls(to - at, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, ROWS.types[1:], strict=True))], schema=ROWS)

    for ids, texts in byte_slices(batches):
        out_sha, out_entry, first = [], [], base + n_rows
        for doc_id, text in zip(ids, texts, strict=True):
            text = normalise(text)
            sha = hashlib.sha256(text).digest()
            e, new = table.find(int.from_bytes(sha[:8], "little"), text)
            if new:
                counts.append(0)
                least.append((NO_ID, base + n_rows))
                shas.append(sha)
            counts[e] += 1
            if doc_id is not None and doc_id < least[e][0]:
                least[e] = doc_id, base + n_rows
            out_sha.append(sha)
            out_entry.append(base + n_entries + e)
            n_rows += 1
        k = len(ids)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out_sha, pa.binary()), pa.array(out_entry, pa.int64()), *(pa.nulls(k, pa.int64()) for _ in range(2)), pa.array(range(first, first + k), pa.int64()), pa.nulls(k, pa.binary())], schema=ROWS)
        if table.bytes > TABLE_BYTES:
            yield from entries()
            n_entries += len(table.texts)
            table, counts, least, shas = TextTable(), [], [], []
    yield from entries()


GROUPS = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_HEAD = struct.Struct("<32sqqqqq")


class Spill:
    """Records (sha, entry, n, least, row, text) in ``FANOUT`` files of the shared folder, removed once read."""

    def __init__(self, folder: str, depth: int):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.paths = [f"{base}/{uuid.uuid4().hex}" for _ in range(FANOUT)]
        self.files = [self.fs.open_output_stream(p, buffer_size=1 << 20) for p in self.paths]
        self.byte = 31 - depth

    def add(self, record: tuple[bytes, int, int, int, int, bytes]) -> None:
        sha, entry, n, least, row, text = record
        self.files[sha[self.byte] % FANOUT].write(_HEAD.pack(sha, entry, n, least, row, len(text)) + text)

    def buckets(self) -> Iterator[Iterator[tuple]]:
        for f in self.files:
            f.close()
        for path in self.paths:
            yield self._read(path)
            self.fs.delete_file(path)

    def _read(self, path: str) -> Iterator[tuple]:
        with self.fs.open_input_stream(path, buffer_size=1 << 20) as f:
            while head := f.read(_HEAD.size):
                sha, entry, n, least, row, size = _HEAD.unpack(head)
                yield sha, entry, n, least, row, f.read(size)


def grace(records: Iterator[tuple], folder: str, limit: int = TABLE_BYTES, depth: int = 0) -> Iterator[tuple]:
    """(sha, text, (group_size, keep_id, keep_row), entries) of each group of equal texts among records (sha, entry, n, least, row, text).

    Texts that outgrow ``limit`` go to spill files by the hash's next bits; the
    31st level would use its last byte, and one text alone always fits.
    """
    table, members, shas = TextTable(), [], []
    spill = None
    for record in records:
        if spill is not None:
            spill.add(record)
            continue
        sha, entry, n, lowest, row, text = record
        e, new = table.find(int.from_bytes(sha[:8], "little"), text)
        if new:
            members.append([])
            shas.append(sha)
        members[e].append((entry, n, lowest, row))
        if table.bytes > limit and len(table.texts) > 1 and depth < 24:
            spill = Spill(folder, depth)
            for sha, text, own in zip(shas, table.texts, members, strict=True):
                for member in own:
                    spill.add((sha, *member, text))
            table, members, shas = TextTable(), [], []
    if spill is None:
        for sha, text, own in zip(shas, table.texts, members, strict=True):
            least, row = min((lowest, row) for _, _, lowest, row in own)
            yield sha, text, (sum(n for _, n, _, _ in own), least, row), [entry for entry, *_ in own]
    else:
        for bucket in spill.buckets():
            yield from grace(bucket, folder, limit, depth + 1)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, most)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def hot_texts(entries: DataFrame, size: Column, hot_bytes: int) -> DataFrame | None:
    """(_sha, _parts) of the hashes whose entries should be merged in parts first; None if there are none.

    They are fewer than ``HOT_SHARE`` by their bytes, so they can be broadcast.
    """
    sizes = entries.groupBy(F.col("sha").alias("_sha")).agg(F.sum(size).alias("_bytes"), F.count("*").alias("_n"))
    total = entries.agg(F.sum(size)).first()[0] or 0
    most = max(hot_bytes, total // HOT_SHARE)
    hot = sizes.filter((F.col("_bytes") > most) & (F.col("_n") > 1)).select("_sha", F.ceil(F.col("_bytes") / most).alias("_parts"))
    hot = written(hot, "exact-hot")
    return None if hot.isEmpty() else hot


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(_scan, "doc_id long, sha binary, entry long, n long, least long, row long, text binary"), "exact-entries")
    folder = scratch(spark, "exact-spill")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    record = ["sha", "entry", "n", "least", "row", "text"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a hot text: a record for each, and (entry, the record's) of its entries, without text."""
        merged = pa.schema([*(ROWS.field(c) for c in record), ("of", pa.int64())])

        def out() -> Iterator[tuple]:
            for sha, text, (size, least, row), own in grace(_records(batches), folder, table_bytes):
                yield sha, own[0], size, least, row, text, None
                for entry in own:
                    yield None, entry, None, None, None, None, own[0]

        yield from _batched(out(), merged, 512)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((entry, least, row, size) for _, _, (size, least, row), own in grace(_records(batches), folder, table_bytes) for entry in own)
        yield from _batched(found, GROUPS, 10_000)

    entries = rows.filter("text is not null").select(*record)
    groups_schema = "entry long, keep_id long, keep_row long, group_size long"
    hot = hot_texts(entries, F.octet_length("text") + 100, hot_bytes)
    if hot is None:
        groups = entries.repartition(n, "sha").mapInArrow(bucket, groups_schema)
    else:
        salted = entries.join(F.broadcast(hot), entries["sha"] == hot["_sha"]).withColumn("_salt", F.pmod(F.xxhash64("entry"), F.col("_parts")))
        merged = salted.repartition(n, "sha", "_salt").select(*record).mapInArrow(merge, "sha binary, entry long, n long, least long, row long, text binary, of long")
        merged = written(merged, "exact-merged")
        others = entries.join(F.broadcast(hot), entries["sha"] == hot["_sha"], "left_anti")
        whole = others.unionByName(merged.filter("of is null").select(*record))
        groups = written(whole.repartition(n, "sha").mapInArrow(bucket, groups_schema), "exact-groups")
        of = merged.filter("of is not null").select(F.col("entry").alias("_entry"), F.col("of").alias("_of"))
        mapped = of.join(groups, of["_of"] == groups["entry"]).select(F.col("_entry").alias("entry"), "keep_id", "keep_row", "group_size")
        groups = groups.join(of, groups["entry"] == of["_entry"], "left_anti").unionByName(mapped)
    own = rows.filter("text is null").select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "entry", "row")
    return own.join(groups, "entry").select("doc_id", F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


class Best:
    """The best row, of smallest (doc_id, row), for each text of batches (sha, row, documents' columns); whole rows stay in Arrow."""

    def __init__(self, doc_id: int, text: int):
        self.doc_id, self.text = doc_id, text
        self.table, self.bytes = TextTable(), 0
        self.best: list[tuple[int, int, int, int]] = []
        self.held: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch, texts: list[bytes], shas: list[bytes]) -> None:
        fresh: list[int] = []
        ids, rows = batch.column(self.doc_id).to_pylist(), batch.column(1).to_pylist()
        for k, (sha, row, doc_id, text) in enumerate(zip(shas, rows, ids, texts, strict=True)):
            e, new = self.table.find(int.from_bytes(sha[:8], "little"), text)
            mine = NO_ID if doc_id is None else doc_id
            if new:
                self.best.append((NO_ID, NO_ID, 0, 0))
            if (mine, row) < self.best[e][:2]:
                self.best[e] = mine, row, len(self.held), len(fresh)
                fresh.append(k)
        if fresh:
            self.held.append(batch.take(pa.array(fresh, pa.int64())))
            self.bytes += self.held[-1].nbytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is best so far."""
        places: list[list[int]] = [[] for _ in self.held]
        for _, _, at, k in self.best:
            places[at].append(k)
        for batch, own in zip(self.held, places, strict=True):
            if own:
                yield batch.take(pa.array(sorted(own), pa.int64()))


def _with_texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches, with their normalised texts."""
    for part in text_slices(batches, at):
        yield part, [normalise(t or b"") for t in part.column(at).cast(pa.binary()).to_pylist()]


def grace_rows(batches: Iterator[pa.RecordBatch], doc_id: int, text: int, folder: str, limit: int = TABLE_BYTES, depth: int = 0) -> Iterator[pa.RecordBatch]:
    """The best row for each text of batches (sha, row, documents' columns), with spill files of Arrow streams as in :func:`grace`."""
    best, spill = Best(doc_id, text), None
    for part, texts in _with_texts(batches, text):
        if spill is not None:
            spill.add(part)
            continue
        best.add(part, texts, part.column(0).to_pylist())
        if best.table.bytes + best.bytes > limit and len(best.table.texts) > 1 and depth < 24:
            spill = RowSpill(folder, depth, part.schema)
            for held in best.rows():
                spill.add(held)
            best = Best(doc_id, text)
    if spill is None:
        yield from best.rows()
    else:
        for bucket in spill.buckets():
            yield from grace_rows(bucket, doc_id, text, folder, limit, depth + 1)


class RowSpill:
    """Batches dealt by a byte of their first column, the hash, to ``FANOUT`` Arrow streams of the shared folder, removed once read."""

    def __init__(self, folder: str, depth: int, schema: pa.Schema):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.paths = [f"{base}/{uuid.uuid4().hex}" for _ in range(FANOUT)]
        self.files = [self.fs.open_output_stream(p) for p in self.paths]
        self.streams = [pa.ipc.new_stream(f, schema) for f in self.files]
        self.byte = 31 - depth

    def add(self, batch: pa.RecordBatch) -> None:
        places: list[list[int]] = [[] for _ in range(FANOUT)]
        for k, sha in enumerate(batch.column(0).to_pylist()):
            places[sha[self.byte] % FANOUT].append(k)
        for stream, own in zip(self.streams, places, strict=True):
            if own:
                stream.write_batch(batch.take(pa.array(own, pa.int64())))

    def buckets(self) -> Iterator[Iterator[pa.RecordBatch]]:
        for stream, file in zip(self.streams, self.files, strict=True):
            stream.close()
            file.close()
        for path in self.paths:
            yield self._read(path)
            self.fs.delete_file(path)

    def _read(self, path: str) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_stream(path) as f:
            yield from pa.ipc.open_stream(f)


def drop_exact(docs: DataFrame, table_bytes: int = TABLE_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs`` with the one row of each group of equal texts that stays; all columns stay.

    The best row for each entry of a scan task moves with all its columns, once,
    to its text's bucket, and what is best there is the result: no join.
    """
    spark, columns = docs.sparkSession, docs.columns
    doc_id, text = 2 + columns.index("doc_id"), 2 + columns.index("text")
    # documents' columns by number: their names may be any
    numbered = docs.select(*(F.col(f"`{c}`").cast("string" if c == "text" else docs.schema[c].dataType).alias(f"c{k}") for k, c in enumerate(columns)))
    schema = "sha binary, row long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    folder = scratch(spark, "exact-spill")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, best = TaskContext.get().partitionId() << 33, Best(doc_id, text)
        for part, texts in _with_texts(batches, text - 2):
            shas = [hashlib.sha256(t).digest() for t in texts]
            numbers = pa.array(range(row, row + len(texts)), pa.int64())
            row += len(texts)
            best.add(pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), numbers, *part.columns], names=["sha", "row", *part.schema.names]), texts, shas)
            if best.table.bytes + best.bytes > TABLE_BYTES:
                yield from best.rows()
                best = Best(doc_id, text)
        yield from best.rows()

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grace_rows(batches, doc_id, text, folder, table_bytes)

    entries = written(numbered.mapInArrow(scan, schema), "exact-rows")
    size = F.octet_length(entries.columns[text]) + 100
    hot = hot_texts(entries, F.coalesce(size, F.lit(100)), hot_bytes)
    whole = entries
    if hot is not None:
        salted = entries.join(F.broadcast(hot), entries["sha"] == hot["_sha"]).withColumn("_salt", F.pmod(F.xxhash64("row"), F.col("_parts")))
        merged = salted.repartition(n, "sha", "_salt").select(*entries.columns).mapInArrow(bucket, schema)
        whole = entries.join(F.broadcast(hot), entries["sha"] == hot["_sha"], "left_anti").unionByName(merged)
    kept = whole.repartition(n, "sha").mapInArrow(bucket, schema)
    return kept.select(*(F.col(f"c{k}").cast(docs.schema[c].dataType).alias(c) for k, c in enumerate(columns)))
