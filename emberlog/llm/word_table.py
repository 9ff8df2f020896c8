"""Words of many texts at a time, as codes into their distinct values, and per-worker tables of these.

A slice of texts is split and dictionary-encoded by Arrow's kernels, so Python
meets only distinct words: each gets its value (ids, a count, a weight) from a
table that a worker keeps, and numpy carries values back to positions.
Tokenizers that never join tokens over white space give a text the
concatenation of what they give its chunks, which makes such tables exact.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries a table holds before it starts again; bounds a worker's memory, not the result.
MAX_ENTRIES = 350_000
#: Longer chunks are looked up each time and not kept.
MAX_KEPT = 200
#: New chunks whose values are made in one call; bounds what a call holds meanwhile.
FILL = 16_384
#: Bytes of text handled together; one longer text is a slice of its own.
SLICE_BYTES = 6_000_000
SLICE_ROWS = 4096


class Words:
    """``codes[offsets[i]:offsets[i + 1]]`` are the words of text i, as indices into ``distinct``."""

    def __init__(self, distinct: pa.StringArray, codes: np.ndarray, offsets: np.ndarray):
        self.distinct, self.codes, self.offsets = distinct, codes, offsets

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of its words' values; ``values`` has one for each distinct word."""
        return segment_sums(values[self.codes], self.offsets)


def segment_sums(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.result_type(flat, np.int64))
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(flat, offsets[full], dtype=out.dtype)
    return out


def coded(lists: pa.ListArray, drop_empty: bool) -> Words:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    found = lists.flatten().dictionary_encode()
    distinct, codes = found.dictionary, found.indices.to_numpy()
    empty = pc.index(distinct, "").as_py() if drop_empty else -1
    if empty >= 0:
        solid = codes != empty
        offsets = np.r_[0, np.cumsum(solid)][offsets]
        codes = codes[solid]
    return Words(distinct, codes, offsets)


def split_words(texts: pa.StringArray) -> Words:
    """Maximal runs without ASCII white space."""
    return coded(pc.ascii_split_whitespace(texts), drop_empty=True)


def drop_texts(words: Words, drop: pa.BooleanArray) -> Words:
    """``words`` without those of the texts to drop, which then have none."""
    gone = drop.to_numpy(zero_copy_only=False)
    if not gone.any():
        return words
    lengths = np.diff(words.offsets)
    keep = np.repeat(~gone, lengths)
    return Words(words.distinct, words.codes[keep], np.r_[0, np.cumsum(np.where(gone, 0, lengths))])


def split_at(texts: pa.StringArray, mark: str) -> Words:
    """What lies between marks, empty strings too; an empty text is one empty string."""
    return coded(pc.split_pattern(texts, mark), drop_empty=False)


class ChunkTable:
    """distinct chunk -> value, where ``fill(list of new chunks)`` gives the values."""

    def __init__(self, fill: Callable[[list[str]], list], max_entries: int = MAX_ENTRIES):
        self.fill, self.max_entries, self.known = fill, max_entries, {}

    def lookup(self, distinct: list[str]) -> list:
        values = list(map(self.known.get, distinct))
        fresh = [k for k, v in enumerate(values) if v is None]
        if fresh:
            if len(self.known) + len(fresh) > self.max_entries:
                self.known = {}
            for at in range(0, len(fresh), FILL):
                some = fresh[at : at + FILL]
                chunks = [distinct[k] for k in some]
                for k, c, v in zip(some, chunks, self.fill(chunks), strict=True):
                    values[k] = v
                    if len(c) <= MAX_KEPT:
                        self.known[c] = v
        return values


_tables: dict[tuple, tuple[str, object]] = {}


def worker_table(key: tuple, make: Callable[[], object], version: str = ""):
    """The object a worker process keeps from task to task; another key or version replaces it, so that operators that follow one another don't add up."""
    if key not in _tables or _tables[key][0] != version:
        _tables.clear()
        _tables[key] = (version, make())
    return _tables[key][1]


def text_slices(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches whose column ``at`` is text, in parts of about ``SLICE_BYTES`` of it; the rows stay as they are.

    After the last, a worker gives back the memory that Arrow keeps for later use: tasks of other operators follow in it.
    """
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))
        start, n = 0, batch.num_rows
        while start < n:
            before = size[start - 1] if start else 0
            to = min(max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right"))), start + SLICE_ROWS, n)
            yield batch.slice(start, to - start)
            start = to
    pa.default_memory_pool().release_unused()


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Such parts of batches whose second column is text; null texts become empty."""
    for part in text_slices(batches, 1):
        texts = part.column(1)
        if texts.null_count:
            part = pa.RecordBatch.from_arrays([part.column(0), pc.fill_null(texts, ""), *part.columns[2:]], names=part.schema.names)
        yield part


def byte_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as UTF-8 bytes) of a slice at a time."""
    for part in slices(batches):
        yield part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()


#: A tokenizer file's rules under which white space parts words, and letters are lower-cased and parted from punctuation.
WORD_RULE = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
LOWER_RULE = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}


def parts_letters(spec: dict) -> bool:
    """Whether a chunk's letters and the punctuation after them are encoded apart, whatever the letters' case."""
    return spec["normalizer"] == LOWER_RULE and spec["pre_tokenizer"] == WORD_RULE and all(t["special"] for t in spec["added_tokens"])


def parts_at_space(spec: dict) -> bool:
    """Whether no token reaches over white space, nor depends on what lies beyond it."""
    return spec["pre_tokenizer"] == WORD_RULE and spec["normalizer"] in (LOWER_RULE, None, {"type": "Lowercase"}, {"type": "NFC"})


_SUFFIX = ".,!?;:#*$%&|"
_RUNS = f"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[{_SUFFIX}]*)$"


class Runs:
    """Distinct chunks taken apart: Latin letters in lower case, with punctuation after them; ``whole`` has the other chunks.

    A tokenizer that lower-cases and parts letters from punctuation gives such a
    chunk what it gives its letters, then what it gives its punctuation, and
    letters recur far more often than chunks do.
    """

    def __init__(self, distinct: pa.StringArray):
        found = pc.extract_regex(distinct, _RUNS)
        valid = pc.is_valid(found)
        self.fits = valid.to_numpy(zero_copy_only=False)
        fitting = found.filter(valid)
        cores = pc.utf8_lower(pc.struct_field(fitting, "core")).dictionary_encode()
        tails = pc.struct_field(fitting, "tail").dictionary_encode()
        self.cores, self.core_codes = cores.dictionary.to_pylist(), cores.indices.to_numpy()
        self.tails, self.tail_codes = tails.dictionary.to_pylist(), tails.indices.to_numpy()
        self.whole = distinct.filter(pc.invert(valid)).to_pylist()


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pool[start : start + length] of each one after another, their ends)."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return pool[at], ends


def pooled(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all values one after another as 32-bit integers, starts, lengths)."""
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return np.frombuffer(b"".join(values), "<u4"), np.cumsum(lengths) - lengths, lengths


class JsonTokens:
    """Token ids of texts, by the tokenizers library, through tables of distinct chunks.

    New chunks go through the whole tokenizer, many in one call, parted by a
    special token whose id then parts the ids.  Where the tokenizer's own rules
    (``parts_letters``) part letters from punctuation, chunks are first taken
    apart (``Runs``), and letters go to its model alone.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not parts_at_space(spec):
            raise ValueError("a tokenizer that parts words at white space is needed")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items() if t.special}
        self.mark = next(iter(self.special), None)
        self.whole, self.cores = ChunkTable(self._whole), ChunkTable(self._fill_cores)
        self.end = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.by_runs = bool(self.end) and parts_letters(spec)
        if self.by_runs:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(self.end)]] = True
            shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.latin = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}

    def _fill_cores(self, cores: list[str]) -> list[bytes]:
        shown = [c if c.isascii() else c.translate(self.latin) for c in cores]
        joined = [" ".join(shown[at : at + 2000]) for at in range(0, len(shown), 2000)]
        parts: list[bytes] = []
        for at in range(0, len(joined), 16):
            for enc in self.model.encode_batch_fast(joined[at : at + 16], add_special_tokens=False):
                ids = np.asarray(enc.ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                parts += self._cut(ids, np.r_[0, cuts[:-1]], cuts)
        return parts

    @staticmethod
    def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)]

    def _whole(self, chunks: list[str]) -> list[bytes]:
        one = lambda c: np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        if self.mark is None:
            return [one(c) for c in chunks]
        plain = [len(c) <= MAX_KEPT and not any(s in c for s in self.special) for c in chunks]
        kept = [c for c, p in zip(chunks, plain, strict=True) if p]
        parts: list[bytes] = []
        joined = [self.mark.join(kept[at : at + 1000]) for at in range(0, len(kept), 1000)]
        for at in range(0, len(joined), 16):
            for enc in self.tokenizer.encode_batch_fast(joined[at : at + 16], add_special_tokens=False):
                ids = np.asarray(enc.ids, "<u4")
                cuts = np.flatnonzero(ids == self.special[self.mark])
                parts += self._cut(ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])
        ready = iter(parts)
        return [next(ready) if p else one(c) for c, p in zip(chunks, plain, strict=True)]

    def _distinct(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, starts, lengths) of the ids of distinct chunks."""
        if not self.by_runs:
            return pooled(self.whole.lookup(distinct.to_pylist()))
        runs = Runs(distinct)
        cores, tails, whole = pooled(self.cores.lookup(runs.cores)), pooled(self.whole.lookup(runs.tails)), pooled(self.whole.lookup(runs.whole))
        # two pieces for each chunk: letters and punctuation, or the whole and nothing
        starts, lengths = np.zeros((len(distinct), 2), np.int64), np.zeros((len(distinct), 2), np.int64)
        starts[runs.fits, 0], lengths[runs.fits, 0] = cores[1][runs.core_codes], cores[2][runs.core_codes]
        starts[runs.fits, 1], lengths[runs.fits, 1] = len(cores[0]) + tails[1][runs.tail_codes], tails[2][runs.tail_codes]
        starts[~runs.fits, 0], lengths[~runs.fits, 0] = len(cores[0]) + len(tails[0]) + whole[1], whole[2]
        pool, _ = gathered(np.concatenate((cores[0], tails[0], whole[0])), starts.ravel(), lengths.ravel())
        each = lengths.sum(1)
        return pool, np.cumsum(each) - each, each

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's)."""
        words = split_words(texts)
        pool, starts, lengths = self._distinct(words.distinct)
        ids, ends = gathered(pool, starts[words.codes], lengths[words.codes])
        return ids, np.r_[0, ends][words.offsets]


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, token ids with the end id) of each row."""
    tokens, end = worker_table(("json", path), lambda: JsonTokens(path)), np.array([end_id], "<u4")
    for part in slices(batches):
        ids, offsets = tokens.encode(part.column(1))
        for doc_id, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield doc_id, np.concatenate((ids[a:b], end))
