"""Operator 6: cost-balanced packing of token ids into sequences.

A document's cost in a sequence is linear plus quadratic in its length
(``linear * n + n * n``: projections, and attention within the document).
Within a window of documents the shortest possible number of sequences is
opened, documents are taken by descending cost, and each goes to the sequence
of lowest cost that has room for it.  A document that fits nowhere whole is cut
over the roomiest sequences, so a window pads fewer than ``capacity`` tokens in
all, and every id lies in exactly one piece.

Windows are parts of a task's own rows: there is no shuffle, memory is bounded
by the window, and a lost task is repeated alone.  Of sequences that cost the
same, the one that was opened first among those of least room is taken; documents of one
length go in the order they are read.  Null or empty texts are the end id alone,
very long ones are cut over many sequences; repeated rows are packed as often as they occur; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_table import encoded

CAPACITY = 2048
#: Linear over quadratic cost a token: 6 x the model's width, here 1024.
LINEAR = 6144
#: Tokens packed together.
WINDOW_TOKENS = 6_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class OpenSequences:
    """Sequences by room left: heaps by cost, under a tree that has the lowest cost of each range of room."""

    def __init__(self, n: int, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.none = 1 << 62
        self.tree = [self.none] * (2 * self.leaves)
        self.heaps: dict[int, list[tuple[int, int]]] = {capacity: [(0, k) for k in range(n)]}
        self._refresh(capacity)

    def _refresh(self, room: int) -> None:
        heap = self.heaps.get(room)
        tree, at = self.tree, self.leaves + room
        tree[at] = heap[0][0] if heap else self.none
        at >>= 1
        while at:
            lowest = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == lowest:
                break
            tree[at] = lowest
            at >>= 1

    def cheapest(self, need: int) -> int | None:
        """The room of the lowest-cost sequence that has ``need`` left; None if there is none."""
        tree, best, node = self.tree, self.none, 0
        low, high, above = self.leaves + need, 2 * self.leaves, []
        while low < high:
            if low & 1:
                if tree[low] < best:
                    best, node = tree[low], low
                low += 1
            if high & 1:
                high -= 1
                above.append(high)
            low, high = low >> 1, high >> 1
        for k in reversed(above):  # by rising room
            if tree[k] < best:
                best, node = tree[k], k
        if not node:
            return None
        while node < self.leaves:
            node = 2 * node if tree[2 * node] == best else 2 * node + 1
        return node - self.leaves

    def roomiest(self) -> int:
        return max(room for room, heap in self.heaps.items() if heap and room)

    def place(self, room: int, length: int, cost: int) -> tuple[int, int]:
        """Put ``length`` ids into the cheapest sequence with this room; (sequence, offset)."""
        spent, sequence = heapq.heappop(self.heaps[room])
        self._refresh(room)
        heapq.heappush(self.heaps.setdefault(room - length, []), (spent + cost, sequence))
        self._refresh(room - length)
        return sequence, self.capacity - room


def plan(lengths: list[int], capacity: int = CAPACITY, linear: int = LINEAR) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(number of sequences, pieces (document, start, length, sequence, offset)) for one window."""
    total = sum(lengths)
    n = -(-total // capacity)
    open_ = OpenSequences(n, capacity)
    work = [(min(capacity, length - at), k, at) for k, length in enumerate(lengths) for at in range(0, length, capacity)]
    work.sort(key=lambda w: (-w[0], w[1], w[2]))
    pieces = []
    for length, k, at in work:
        while length:
            room = open_.cheapest(length)
            here = length if room is not None else min(length, room := open_.roomiest())
            sequence, offset = open_.place(room, here, here * (linear + here))
            pieces.append((k, at, here, sequence, offset))
            length, at = length - here, at + here
    pieces.sort(key=lambda p: (p[3], p[4]))
    return n, pieces


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, linear: int = LINEAR, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[object, np.ndarray]] = []
        size = 0
        for doc_id, ids in encoded(batches, tokenizer_path, end_id):
            held.append((doc_id, ids))
            size += len(ids)
            if size >= window_tokens:
                n, out = window(held, sequence)
                yield from out
                held, size, sequence = [], 0, sequence + n
        if held:
            yield from window(held, sequence)[1]

    def window(held: list[tuple[object, np.ndarray]], base: int) -> tuple[int, list[pa.RecordBatch]]:
        n, pieces = plan([len(ids) for _, ids in held], capacity, linear)
        rows = [(held[k][0], at, here, zlib.crc32(held[k][1][at : at + here]), len(held[k][1]), base + s, offset) for k, at, here, s, offset in pieces]
        return n, [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)]

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
