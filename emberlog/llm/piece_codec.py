"""Operator 4: SentencePiece encoding and decoding by a distinct-chunk table.

The model's pieces hold white-space markers only at their start, so no piece
reaches from a character into a following marker.  A text then falls into
marked words: each distinct one is segmented and decoded once a table, and ids
and texts are joined back by position.  :func:`crosses` tests a model for this;
for one that fails, whole texts are the chunks.

Null texts are empty: the end id alone, decoded to an empty text.  A text of
white space keeps it.  Repeated rows each return a row; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_table import ChunkTable, Words, coded, drop_texts, slices, split_at, worker_table

MARK = "▁"
_MARKED = re.compile(" *[^ ]+| +")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def crosses(pieces: list[str]) -> bool:
    """Whether any piece has a marker after another character."""
    return any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


class PieceTable:
    """marked word -> (decimal ids joined by spaces, decoded text), by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = crosses([self.model.id_to_piece(i) for i in range(self.model.get_piece_size())])
        self.lone = self.model.piece_to_id(MARK)
        self.ids = ChunkTable(self._segment)

    def chunks(self, texts: pa.StringArray) -> Words:
        """Marked words, each without its first marker, which encoding adds again; texts hold no other form of the marker."""
        if self.whole:
            found = texts.dictionary_encode()
            lengths = (pc.binary_length(texts).to_numpy() > 0).astype(np.int64)
            return Words(found.dictionary, found.indices.to_numpy()[lengths > 0], np.r_[0, np.cumsum(lengths)])
        odd = pc.match_substring_regex(texts, "^ | $|  ")
        if not pc.any(odd).as_py():
            return drop_texts(split_at(texts, " "), pc.equal(texts, ""))
        # runs of spaces: the first marks the word, the others stay in it
        lists = [_spaced(t) if o else t.split(" ") if t else [] for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
        return coded(pa.array(lists, pa.list_(pa.string())), drop_empty=False)

    def _segment(self, chunks: list[str]) -> list[tuple[bytes, str, int]]:
        found = self.model.encode(chunks, num_threads=1)
        found = [ids if c else [self.lone] for c, ids in zip(chunks, found, strict=True)]
        texts = self.model.decode(found)
        return [(" ".join(map(str, ids)).encode(), c if text == c else text, len(ids)) for c, ids, text in zip(chunks, found, texts, strict=True)]

    def joined(self, texts: pa.StringArray) -> Iterator[tuple[int, bytes, str]]:
        """Per text: the number of its ids, the ids in decimal, the decoded text."""
        words = self.chunks(pc.replace_substring(texts, MARK, " "))
        values = self.ids.lookup(words.distinct.to_pylist())
        counts = words.sums(np.fromiter((v[2] for v in values), np.int64, len(values))).tolist()
        decimal, decoded = [v[0] for v in values], [v[1] for v in values]
        codes, offsets = words.codes.tolist(), words.offsets.tolist()
        for n, a, b in zip(counts, offsets[:-1], offsets[1:], strict=True):
            own = codes[a:b]
            yield n, b" ".join(map(decimal.__getitem__, own)), " ".join(map(decoded.__getitem__, own))


def _spaced(text: str) -> list[str]:
    return [c[1:] for c in _MARKED.findall(" " + text)]


def encode_documents(docs: DataFrame, model_path: str, end_id: int = 2) -> DataFrame:
    """Per row: doc_id, n_tokens (with the end id), ids_sha256, decoded_sha256."""
    end = str(end_id).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(("piece", model_path), lambda: PieceTable(model_path))
        for part in slices(batches):
            rows = [(n + 1, hashlib.sha256(b"%s %s" % (ids, end) if n else end).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()) for n, ids, text in table.joined(part.column(1))]
            yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types[1:], strict=True))], schema=SCHEMA)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_text(text: str, model_path: str, end_id: int = 2) -> tuple[list[int], str]:
    """(ids with the end id, decoded text) of one text through the same table."""
    table = worker_table(("piece", model_path), lambda: PieceTable(model_path))
    _, ids, decoded = next(table.joined(pa.array([text], pa.string())))
    return [*map(int, ids.split()), end_id], decoded
