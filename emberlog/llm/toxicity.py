"""Operator 9: toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled rows: words, and word beginnings shared by
several words, that occur so much more often in toxic documents that chance
among all terms tried is no explanation; near copies count as one document.  It lies in a trie.
The Levenshtein automata of all entries run over the trie together: a state is
the set of (trie node, edits so far), made when first met and kept, so a word is
read once, letter by letter, and is dropped as soon as no entry can follow.
Short entries match exactly, longer ones within one edit.

Every hit is scored in its context: weight by the entry's evidence, and less
inside a quotation, or after an opening mark that never closes if a reporting
word precedes it in the window.  Sums over the hits, and their highest, are the
inputs of a logistic model.  Quoted and misspelled hits are rare in labelled
rows, so rows made by rule show them to the model too.

Null, empty and blank texts have no hits and get the score of a text without
any; very long ones are read whole.  Without labelled rows of both classes there
is no lexicon and every score is 0.  Documents whose ids hash alike come in the
order of their ids; entries that fit a word equally well give the greater
weight.  A swap of neighbouring letters is two edits.  Repeated rows each return
a row, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample
from .near_dedup import shingle_sets, signature
from .store import discard, written
from .word_table import ChunkTable, slices, split_words, worker_table

SAMPLE = 8000
STEM_LENGTHS = (3, 4, 5, 6, 7)
#: How many times the documents of any one of its words a beginning must have.
STEM_GAIN = 1.5
MIN_DOCUMENTS = 4
MIN_PRECISION = 0.8
#: The same for beginnings, which clean words may have by accident; the density of hits tells those apart.
STEM_PRECISION = 0.5
#: Share of the toxic documents that have it, at least.
MIN_SHARE = 0.01
#: Chance that any of the terms tried enters the lexicon by accident.
ACCIDENT = 0.05
#: Hashes that near copies in the sample are known by.
FAMILY_HASHES = 4
#: Entries of so many letters may differ by one edit.
FUZZY_FROM = 5
#: What a hit one edit off weighs against an exact one.
NEAR = 0.5
#: What a quoted hit weighs.
QUOTED = 0.3
WINDOW = 6
MAX_STATES = 50_000
#: Weight of a row made by rule.
MADE = 0.2
THRESHOLD = 0.5
#: Words that introduce another's speech, in the languages of the corpus, and quotation marks with what closes them.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes cited reported dijo dice escribió citó llamó sagte sagt schrieb zitierte nannte dit écrit disait cité appelé".split())
CLOSERS = {'"': '"', "`": "`", "“": "”“", "„": "“”", "‘": "’", "«": "»", "»": "«", "‹": "›", "›": "‹"}
QUOTES = "\"'`«»“”„‘’‹›"
PUNCTUATION = QUOTES + ".,;:!?()[]{}<>|*#$%&-_/\\…¿¡"


class Trie:
    """Entries as nested nodes: children by letter, and the entry that ends there."""

    def __init__(self, entries: dict[str, tuple[float, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[float, bool, int] | None] = [None]
        for word, (weight, stem) in sorted(entries.items()):
            node = 0
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][letter]
            self.ends[node] = (weight, stem, int(len(word) >= FUZZY_FROM))


class TrieAutomaton:
    """The product of the trie and Levenshtein automata of one edit, determinised as words need it."""

    def __init__(self, entries: dict[str, tuple[float, bool]], edits: int = 1):
        self.trie, self.edits = Trie(entries), edits
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[float, int] | None] = []
        self.sure: list[tuple[float, int] | None] = []
        self._number(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that letters left out lead to, each with its fewest edits."""
        work = list(nodes.items())
        while work:
            node, e = work.pop()
            if e < self.edits:
                for child in self.trie.children[node].values():
                    if nodes.get(child, self.edits + 1) > e + 1:
                        nodes[child] = e + 1
                        work.append((child, e + 1))
        return nodes

    def _number(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(end, e) for node, e in key if (end := self.trie.ends[node]) and e <= end[2]]
            best = lambda found: max(((w, e) for (w, _, _), e in found), key=lambda x: (-x[1], x[0]), default=None)
            self.final.append(best(ends))
            self.sure.append(best([(end, e) for end, e in ends if end[1]]))
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.edits and nodes.get(node, self.edits + 1) > e:
                nodes[node] = e

        for node, e in self.states[state]:
            put(node, e + 1)  # a letter too many
            for other, child in self.trie.children[node].items():
                put(child, e + (other != letter))
        found = self._number(self._closed(nodes)) if nodes else -1
        self.moves[state][letter] = found
        return found

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the closest entry that the word is, or that begins it."""
        if len(self.states) > MAX_STATES:
            self._reset()
        state, stem = 0, None
        moves = self.moves
        for letter in word:
            then = moves[state].get(letter)
            state = self._step(state, letter) if then is None else then
            if state < 0:
                return stem
            if self.sure[state] is not None and (stem is None or self.sure[state][1] <= stem[1]):
                stem = self.sure[state]
        whole = self.final[state]
        return whole if whole is not None and (stem is None or whole[1] <= stem[1]) else stem


def core(chunk: str) -> str:
    return chunk.strip(PUNCTUATION).lower()


def terms(text: bytes) -> set[str]:
    """Distinct words of letters, between ASCII white space."""
    return {w for w in map(core, (c.decode("utf-8") for c in set(text.split()))) if len(w) >= 3 and w.isalpha()}


def learn_exceptions(sample: DataFrame, entries: dict[str, tuple[float, bool]]) -> set[str]:
    """Words one edit off an entry that are no misspellings: those with a share of the clean documents as great as of the toxic ones."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = TrieAutomaton(entries).match
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally[label].update(terms(text))
        found = [w for w in tally[0] | tally[1] if (hit := match(w)) and hit[1]]
        yield pa.record_batch([pa.array(found, pa.string()), *(pa.array([tally[k][w] for w in found], pa.int64()) for k in (0, 1))], names=["term", "clean", "toxic"])

    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    counted = sample.select("text", "label").mapInArrow(near, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return {r.term for r in counted.filter((F.col("clean") > 0) & (F.col("clean") * n.get(1, 0) >= F.col("toxic") * n.get(0, 0))).collect()}


def evidence(toxic: int, clean: int, base: float) -> float:
    """At most the negative logarithm of the chance that so many of a term's documents are toxic, if each is so with chance ``base``."""
    n = toxic + clean
    share = toxic / n
    if share <= base:
        return 0.0
    return n * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if clean else 0.0))


def apart(sample: DataFrame) -> DataFrame:
    """The sample without near copies: a document goes if another of smaller id has one of its ``FAMILY_HASHES`` least shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [signature(s, FAMILY_HASHES).astype(np.int64).tolist() if len(s) else [] for s in shingle_sets(part, 3)]
            yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "hashes"])

    hashes = sample.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, hashes array<long>")
    one = hashes.select("doc_id", F.posexplode("hashes").alias("k", "h"))
    least = one.groupBy("k", "h").agg(F.min("doc_id").alias("first"), F.collect_set("doc_id").alias("ids"))
    copies = least.select("first", F.explode("ids").alias("doc_id")).filter("doc_id <> first").select("doc_id").distinct()
    return sample.join(copies, "doc_id", "left_anti")


def learn_lexicon(sample: DataFrame) -> dict[str, tuple[float, bool]]:
    """entry -> (weight, whether it is a beginning), from a bounded sample of labelled documents.

    The driver gets the terms with enough evidence: no more than the sample has words, over ``MIN_DOCUMENTS``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                tally[bool(label)].update(words)
                tally[bool(label)].update({w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k})
        keys = list(tally[True] | tally[False])
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            yield pa.record_batch([pa.array(some, pa.string()), *(pa.array([tally[toxic][k] for k in some], pa.int64()) for toxic in (True, False))], names=["term", "toxic", "clean"])

    totals = {bool(r.label): r["count"] for r in sample.groupBy("label").count().collect()}
    if not (totals.get(True) and totals.get(False)):
        return {}
    counted = sample.select("text", "label").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = written(counted, "toxicity-terms")
    strong = counted.filter((F.col("toxic") >= MIN_DOCUMENTS) & (F.col("toxic") >= F.when(F.col("term").endswith("*"), STEM_PRECISION).otherwise(MIN_PRECISION) * (F.col("toxic") + F.col("clean"))) & (F.col("toxic") >= MIN_SHARE * totals[True]))
    rows, tried = strong.orderBy(F.desc("toxic"), "term").collect(), counted.count()
    discard(counted)
    base, least = totals[True] / (totals[True] + totals[False]), math.log(max(tried, 1) / ACCIDENT)
    found = {r.term: (evidence(r.toxic, r.clean, base), r.toxic, math.log((r.toxic + 0.5) / (totals[True] + 1)) - math.log((r.clean + 0.5) / (totals[False] + 1))) for r in rows}
    words = {t: toxic for t, (_, toxic, _) in found.items() if not t.endswith("*")}
    stems: dict[str, float] = {}
    for t, (strength, toxic, weight) in sorted(found.items(), key=lambda f: (-f[1][0], f[0])):
        t = t[:-1] if t.endswith("*") else ""
        if t and strength > least and not any(t.startswith(s) or s.startswith(t) for s in stems) and toxic >= STEM_GAIN * max((n for w, n in words.items() if w.startswith(t)), default=0):
            stems[t] = weight
    return {s: (w, True) for s, w in stems.items()} | {t: (found[t][2], False) for t in words if found[t][0] > least and not any(t.startswith(s) for s in stems)}


INPUTS = 7


class ContextScorer:
    """Document features from hits and their windows."""

    def __init__(self, entries: dict[str, tuple[float, bool]], exceptions: set[str] = frozenset()):
        self.automaton, self.exceptions = TrieAutomaton(entries) if entries else None, exceptions
        self.table = ChunkTable(self._fill)

    def _fill(self, chunks: list[str]) -> list[tuple[float, int]]:
        """(weight, edits), or (0, 0) for no hit."""
        if self.automaton is None:
            return [(0.0, 0)] * len(chunks)
        match, exceptions = self.automaton.match, self.exceptions
        found = [(w, match(w)) if len(w := core(c)) >= 3 else (w, None) for c in chunks]
        return [hit if hit is not None and not (hit[1] and w in exceptions) else (0.0, 0) for w, hit in found]

    def features(self, texts: pa.StringArray) -> np.ndarray:
        """Rows of (any exact hit, its sum, any near hit, its sum, any quoted hit, highest, both sums for 100 words)."""
        words = split_words(texts)
        values = np.array(self.table.lookup(words.distinct.to_pylist()), float).reshape(-1, 2)
        out = np.zeros((len(texts), INPUTS))
        places = np.flatnonzero(values[words.codes, 0] != 0)
        if not len(places):
            return out
        marked = pc.match_substring_regex(words.distinct, "[" + QUOTES + "]").to_numpy(zero_copy_only=False)
        for k, own in groupby(places.tolist(), key=lambda at: int(np.searchsorted(words.offsets, at, "right")) - 1):
            first, end = int(words.offsets[k]), int(words.offsets[k + 1])
            marks = first + np.flatnonzero(marked[words.codes[first:end]])
            spans, left_open = quotations(zip(marks.tolist(), words.distinct.take(pa.array(words.codes[marks])).to_pylist(), strict=True))
            for at in own:
                weight, edits = values[words.codes[at]]
                before = words.distinct.take(pa.array(words.codes[max(first, at - WINDOW) : at])).to_pylist()
                damp = QUOTED if quoted(at, spans, left_open, before) else 1.0
                value = damp * weight * (NEAR if edits else 1.0)
                row, near = out[k], 2 * bool(edits)
                row[near] = max(row[near], damp)
                row[near + 1] += value
                row[4] = max(row[4], damp < 1)
                row[5] = max(row[5], value)
            out[k, 6] = math.log1p(100 * (out[k, 1] + out[k, 3]) / (end - first))
        out[:, (1, 3)] = np.log1p(out[:, (1, 3)])
        return out


def quotations(words: Iterable[tuple[int, str]]) -> tuple[list[tuple[int, int]], list[int]]:
    """((first, last) position of each quotation, positions of opening marks that nothing closes) from (position, word), ascending.

    A mark opens at the head of a word, or alone, and closes at the tail of the
    same or a later word; inside a quotation only its own closing mark counts.
    An opening mark of the same kind inside means that the one before never
    closed.  Apostrophes are no marks unless they enclose one word.
    """
    spans: list[tuple[int, int]] = []
    left_open: list[int] = []
    began, closers, opener = -1, "", ""
    for at, word in words:
        bare = word.strip(PUNCTUATION)
        head, tail = (word[: word.index(bare)], word[word.rindex(bare) + len(bare) :]) if bare else (word, word)
        if bare and began < 0 and "'" in head and "'" in tail:
            spans.append((at, at))
        alone = not bare
        for c in head:
            if began >= 0 and c == opener and not alone:
                left_open.append(began)
                began = at
            elif began < 0 and c in CLOSERS:
                began, closers, opener = at, CLOSERS[c], c
                alone = False
                if not bare:
                    tail = ""
        for c in tail:
            if began >= 0 and c in closers and (bare or began < at):
                spans.append((began, at))
                began = -1
    if began >= 0:
        left_open.append(began)
    return spans, left_open


def quoted(at: int, spans: list[tuple[int, int]], left_open: list[int], before: list[str]) -> bool:
    """Whether position ``at`` lies in a quotation, or a reporting word and an open mark come in the window before it."""
    k = bisect_right(spans, (at, math.inf)) - 1
    if k >= 0 and spans[k][0] <= at <= spans[k][1]:
        return True
    k = bisect_right(left_open, at) - 1
    return k >= 0 and at - left_open[k] <= len(before) and any(w.strip(PUNCTUATION).lower() in REPORTING for w in before)


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 40, ridge: float = 0.1) -> np.ndarray:
    """Coefficients and intercept by Newton's method with a ridge."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weights * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weights * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def with_made(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, labels and weights, with rows made by rule that labelled ones hardly show: toxic rows as if every exact hit were one edit off, and, not toxic, as if every hit were quoted."""
    hits = x[(y == 1) & (x[:, 0] > 0)]
    off, cited = hits.copy(), hits.copy()
    off[:, 2] = np.maximum(off[:, 2], off[:, 0])
    off[:, 3] = np.log1p(np.expm1(off[:, 3]) + NEAR * np.expm1(off[:, 1]))
    off[:, :2] = 0
    off[:, 5] *= NEAR
    off[:, 6] = np.log1p(NEAR * np.expm1(off[:, 6]))
    cited[:, (0, 2, 5)] *= QUOTED
    cited[:, (1, 3, 6)] = np.log1p(QUOTED * np.expm1(cited[:, (1, 3, 6)]))
    cited[:, 4] = 1
    return np.r_[x, off, cited], np.r_[y, np.ones(len(off)), np.zeros(len(cited))], np.r_[np.ones(len(x)), np.full(2 * len(hits), MADE)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[dict, set, np.ndarray]:
    """(lexicon, exceptions, coefficients) from one bounded sample; exceptions from one half of it, coefficients from the other."""
    rows = labelled_sample(docs, labels, label, sample)
    first = F.xxhash64("doc_id", F.lit("half")) % 2 == 0
    entries = learn_lexicon(apart(rows))
    if not entries:
        discard(rows)
        return {}, set(), np.r_[np.zeros(INPUTS), -30.0]
    exceptions = learn_exceptions(rows.filter(first), entries)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ContextScorer(entries, exceptions)
        for batch in batches:
            found = scorer.features(batch.column(1).cast(pa.string()))
            yield pa.record_batch([batch.column(0), pa.array(found.tolist(), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "label"])

    got = rows.filter(~first).mapInArrow(features, "doc_id long, x array<double>, label int").toArrow().sort_by("doc_id")
    x, y = np.array(got["x"].to_pylist()).reshape(-1, INPUTS), np.array(got["label"].to_pylist(), float)
    discard(rows)
    return entries, exceptions, fit_logistic(*with_made(x, y))


def score(docs: DataFrame, model: tuple[dict, set, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    shared, version = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, exceptions, w = shared.value
        scorer = worker_table(("toxicity",), lambda: ContextScorer(entries, exceptions), version)
        for part in slices(batches):
            logits = scorer.features(part.column(1)) @ w[:-1] + w[-1]
            yield pa.record_batch([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
