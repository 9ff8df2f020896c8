"""Operator 2: a quality classifier on supervised subword embeddings.

Every word gives hashed features: itself, its character n-grams with word
boundaries, and a mark when it repeats the word before it.  Each bucket has a
learned vector; a document is the average of its features' vectors, and a
softmax over two classes gives the score.  Vectors and output weights are
trained together by numpy stochastic gradient descent, a document a step, with a
falling rate.  Case and punctuation stay in the words, since they tell quality.

Fitting takes a bounded sample of labelled documents outside the held-out fold
(``SAMPLE``), with all features of their whole texts; what reaches the driver is
at most ``SAMPLE`` times ``BUCKETS`` counts.  Scoring covers all rows and whole
texts: as the output is linear in the average, each bucket reduces to one number
and each distinct word to a sum and a count.

Null and empty texts have no features and get the prior as the output layer has
it; very long ones count whole.  Without labelled rows every score is 0.5.
Documents whose ids hash alike come in the order of their ids.  Repeated rows
each return a row, an empty table none; other columns are ignored, and stay in
:func:`keep_good`, which decides on each row by its own text.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample
from .store import discard
from .word_table import ChunkTable, segment_sums, slices, split_words, text_slices, worker_table

SAMPLE = 3000
BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.3
#: The bucket of the mark for a repeated word.
REPEAT = 0


def word_features(word: bytes) -> list[int]:
    """Buckets of one word: the word, then its n-grams between boundary marks."""
    marked = b"<" + word + b">"
    crc, n = zlib.crc32, len(marked)
    return [crc(marked) % (BUCKETS - 1) + 1, *(crc(marked[i : i + g]) % (BUCKETS - 1) + 1 for g in GRAMS for i in range(n - g + 1))]


def repeats(words: list[bytes]) -> int:
    return sum(map(bytes.__eq__, words, words[1:]))


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts = np.zeros(BUCKETS, np.int64)
    for word, n in Counter(words).items():
        np.add.at(counts, word_features(word), n)
    counts[REPEAT] = repeats(words)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.int32), (counts[buckets] / counts.sum()).astype(np.float32)


class SubwordModel:
    """Bucket vectors and a two-class softmax output."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.vectors = ((r.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
        self.output = np.zeros((DIM + 1, 2), np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> SubwordModel:
        r, steps, step = np.random.default_rng(seed), epochs * len(rows), 0
        for _ in range(epochs):
            for k in r.permutation(len(rows)):
                buckets, shares = rows[k]
                lr = rate * (1 - step / steps)
                step += 1
                hidden = np.append(shares @ self.vectors[buckets], np.float32(1))
                logits = hidden @ self.output
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[labels[k]] -= 1
                back = self.output[:-1] @ p
                self.output -= lr * np.outer(hidden, p)
                # a share is a small part of a document: the vectors' step is larger by that scale
                self.vectors[buckets] -= (lr * 20) * shares[:, None] * back
        return self

    def margins(self) -> tuple[np.ndarray, float]:
        """(each bucket's part in the logit difference, the difference of the biases)."""
        return (self.vectors @ (self.output[:-1, 1] - self.output[:-1, 0])).astype(np.float64), float(self.output[-1, 1] - self.output[-1, 0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> SubwordModel:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [document_features(t) for t in part.column(1).to_pylist()]
                columns = [[b.astype("<u2").tobytes() for b, _ in found], [s.astype("<f4").tobytes() for _, s in found]]
                yield pa.record_batch([part.column(0), *(pa.array(c, pa.binary()) for c in columns), part.column(2)], names=["doc_id", "buckets", "shares", "label"])

    chosen = labelled_sample(docs, labels, label, sample)
    rows = chosen.mapInArrow(features, "doc_id long, buckets binary, shares binary, label int").toArrow().sort_by("doc_id")
    discard(chosen)
    model = SubwordModel()
    found = [(np.frombuffer(b.as_buffer(), "<u2"), np.frombuffer(s.as_buffer(), "<f4")) for b, s in zip(rows["buckets"], rows["shares"], strict=True)]
    return model.fit(found, rows["label"].to_pylist()) if found else model


def _scorer(docs: DataFrame, model: SubwordModel) -> Callable[[pa.StringArray], np.ndarray]:
    """A function that tasks of ``docs`` may call for the scores of texts."""
    shared, version = docs.sparkSession.sparkContext.broadcast(model.margins()), uuid.uuid4().hex

    def scores(texts: pa.StringArray) -> np.ndarray:
        margins, bias = shared.value

        def fill(words: list[str]) -> list[complex]:
            """Each word's sum of margins, and its number of features: one small object for both."""
            found = [word_features(w.encode("utf-8")) for w in words]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = margins[np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))]
            return (np.add.reduceat(flat, np.r_[0, np.cumsum(counts)[:-1]]) + 1j * counts).tolist()

        table = worker_table(("quality",), lambda: ChunkTable(fill), version)
        words = split_words(texts)
        values = np.array(table.lookup(words.distinct.to_pylist()), complex)
        same = np.r_[words.codes[1:] == words.codes[:-1], False]
        same[words.offsets[1:] - 1] = False  # the last word of a text, and of the one before empty ones
        again = segment_sums(same.astype(np.int64), words.offsets)
        totals, counts = words.sums(values.real) + again * margins[REPEAT], words.sums(values.imag) + again
        return 1 / (1 + np.exp(-totals / np.maximum(counts, 1) - bias))

    return scores


def score(docs: DataFrame, model: SubwordModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scores = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.record_batch([part.column(0), pa.array(scores(part.column(1)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay.  Rows are filtered where they are read."""
    scores, at = _scorer(docs, fit(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            texts = pc.fill_null(part.column(at).cast(pa.string()), "")
            yield part.filter(pa.array(scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
