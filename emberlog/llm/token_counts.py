"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

A word starts as a linked list of symbols.  A heap holds its adjacent pairs by
rank, then by position; the lowest is popped and merged again and again, and
stale pairs are passed over.  The count is the number of symbols at the start
less the number of merges; no ids are made.

The rules around the merging (normaliser, pre-tokenizer, word end, byte alphabet,
special strings) are those of the tokenizer's file; where a chunk is not Latin
letters with punctuation after them, the library normalises and parts it.  A merge never
reaches over white space, so counts of distinct chunks are kept in a table.
Null texts are empty: no bytes, no tokens.  Repeated rows each return a row; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_table import ChunkTable, Runs, parts_at_space, parts_letters, slices, split_words, worker_table

LIMIT = 2048
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class MergeCounter:
    """Counts tokens as the tokenizers library does for a word-end byte-pair model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or not parts_at_space(spec):
            raise ValueError("a byte-level BPE model with word ends, over words parted at white space, is needed")
        self.by_runs = parts_letters(spec)
        self.end = model["end_of_word_suffix"]
        rules = Tokenizer.from_file(path)
        self.normaliser, self.words = rules.normalizer, rules.pre_tokenizer
        names: dict[str, int] = {}
        self.ids = names
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            ids = [names.setdefault(x, len(names)) for x in (a, b, a + b)]
            self.pairs.setdefault(ids[0] << 20 | ids[1], rank << 20 | ids[2])
        self.known = model["vocab"]
        self.bytes = byte_alphabet()
        self.of_shown = {c: b for b, c in enumerate(self.bytes)}
        self.bare = [names.get(c, -1) for c in self.bytes]
        self.ended = [names.get(c + self.end, -1) for c in self.bytes]
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cores, self.whole = ChunkTable(self._count_cores), ChunkTable(self._count_whole)

    def merge(self, word: bytes) -> int:
        """Symbols of ``word`` less merges."""
        n = len(word)
        if n < 2:
            return n
        symbols = [self.bare[b] for b in word]
        symbols[-1] = self.ended[word[-1]]
        pairs, after, before = self.pairs, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            found = pairs.get(symbols[at] << 20 | symbols[at + 1])
            if found is not None:
                heap.append((found >> 20) << 32 | at)
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            at = top & 0xFFFFFFFF
            right = after[at]
            if right >= n or symbols[at] < 0:
                continue
            found = pairs.get(symbols[at] << 20 | symbols[right])
            if found is None or found >> 20 != top >> 32:
                continue
            symbols[at], symbols[right] = found & 0xFFFFF, -1
            left -= 1
            then = after[at] = after[right]
            if then < n:
                before[then] = at
                if (found := pairs.get(symbols[at] << 20 | symbols[then])) is not None:
                    heappush(heap, (found >> 20) << 32 | at)
            if (back := before[at]) >= 0 and (found := pairs.get(symbols[back] << 20 | symbols[at])) is not None:
                heappush(heap, (found >> 20) << 32 | back)
        return left

    def _count_cores(self, cores: list[str]) -> list[int]:
        return [self.merge(c.encode("utf-8")) for c in cores]

    def _count_whole(self, chunks: list[str]) -> list[int]:
        """Chunks of any kind: special strings, then the library's normaliser and pre-tokenizer, then merging of each word."""
        return [self._count_one(c) for c in chunks]

    def _count_one(self, text: str) -> int:
        pieces, total = [text], 0
        if self.special is not None and (total := len(self.special.findall(text))):
            pieces = self.special.split(text)
        for piece in pieces:
            for word, _ in self.words.pre_tokenize_str(self.normaliser.normalize_str(piece) if self.normaliser else piece):
                total += self.merge(bytes(map(self.of_shown.__getitem__, word)))
        return total

    def count(self, texts: pa.StringArray) -> np.ndarray:
        """Tokens of each text."""
        words = split_words(texts)
        if not self.by_runs:
            return words.sums(np.array(self.whole.lookup(words.distinct.to_pylist()), np.int64))
        runs = Runs(words.distinct)
        values = np.zeros(len(words.distinct), np.int64)
        cores, tails, whole = (np.array(t.lookup(x), np.int64) for t, x in ((self.cores, runs.cores), (self.whole, runs.tails), (self.whole, runs.whole)))
        values[runs.fits] = cores[runs.core_codes] + tails[runs.tail_codes]
        values[~runs.fits] = whole
        return words.sums(values)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_table(("merge", tokenizer_path), lambda: MergeCounter(tokenizer_path))
        for part in slices(batches):
            counts = counter.count(part.column(1))
            yield pa.record_batch([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)], schema=SCHEMA)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
