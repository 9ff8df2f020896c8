"""Operator 5: quality rules with thresholds that adapt to each language and source.

One pass over whole texts measures each document.  KLL sketches of the measures
are made for every (language, source) and merged for every language and for the
whole corpus, so nothing is read twice and sketches of other days can be merged
in.  A group's thresholds lie a multiple of its quartile spread from its median;
no cutoff is fixed.  Shares are smoothed by half a unit of what they count, so
that documents without any of it still have a spread, by their lengths.  A
source's thresholds lie within its language's, and a language's shares within
the corpus's, so none lifts its bounds by its own junk.  Groups with few
documents, and sources with under half their language's spread (copies, mostly),
take those of their language, then of the corpus.  A spread of a language is half
the corpus's at least; a corpus without spread sets no bound.  Rows then join
their group's thresholds, and the verdict is kept unless a measure lies beyond.

Null texts count as empty: no words, so ``base_failed``.  Very long texts are
measured whole; a measure equal to its threshold stays.  Null languages and
sources are groups of their own.  Repeated rows each return a row, an empty
table none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .word_table import slices

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS = 20
#: Documents a group needs for thresholds of its own.
MIN_GROUP = 200
#: Quartile spreads between the median and the thresholds.
SPREADS = 6.0
#: Measures that fail on either side.
TWO_SIDED = ("word_length",)
SKETCH_K = 400
MEASURES = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))])


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + n] ^ (codes[k : k + n] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # equal windows always mix alike; those that do are compared word by word
    suspects = np.zeros(n, bool)
    suspects[order[1:][same]] = suspects[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for at in np.flatnonzero(suspects).tolist():
        seen.setdefault(tuple(words[at : at + WINDOW]), []).append(at)
    covered = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for at in places:
                covered[at] += 1
                covered[at + WINDOW] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    solid = text.translate(None, WHITE)
    return len(words), len(solid.decode("utf-8")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _shares() -> dict[str, Column]:
    """The measures; shares with half a unit added: a symbol, a line, two windows of repeated words."""
    share = lambda count, of, unit: (F.col(count) + unit / 2) / (F.col(of) + unit)
    return {"symbol_share": share("n_symbols", "word_chars", 1), "dup_line_share": share("n_dup_lines", "n_lines", 1), "repeat_share": share("n_repeat_words", "n_words", 2 * WINDOW), "word_length": F.col("word_chars") / F.greatest("n_words", F.lit(1))}


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, the counts, and ``base_failed``; kept in the shared folder, without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts = [pa.array(c, pa.int64()) for c in zip(*map(measure, part.column(1).cast(pa.binary()).to_pylist()), strict=True)]
            yield pa.record_batch([part.column(0), *counts, *part.columns[2:]], names=[*MEASURES.names, "lang", "source"])

    group = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(g.cast("string") for g in group))
    schema = ", ".join([*(f"{c} long" for c in MEASURES.names), "lang string", "source string"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return written(texts.mapInArrow(run, schema).withColumn("base_failed", failed), "quality-measures")


def thresholds(rows: DataFrame) -> DataFrame:
    """Per (lang, source): a lower and an upper bound of each measure."""
    shares = _shares()
    sketches = rows.filter("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(name) for name, c in shares.items()))
    merged = lambda df: df.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(name).alias(name) for name in shares))

    def middles(df: DataFrame, mark: str) -> DataFrame:
        out = [F.col("n").alias(f"n_{mark}")]
        for name in shares:
            low, mid, high = (F.kll_sketch_get_quantile_double(name, F.lit(q)) for q in (0.25, 0.5, 0.75))
            out += [mid.alias(f"{name}_mid_{mark}"), (high - low).alias(f"{name}_spread_{mark}")]
        keys = [c for c in ("lang", "source") if c in df.columns]
        return df.select(*keys, *out)

    sketches = written(sketches, "quality-sketches")
    own, language, corpus = middles(sketches, "own"), middles(merged(sketches.groupBy("lang")), "lang"), middles(merged(sketches.groupBy()).filter("n > 0"), "all")
    language = language.withColumnRenamed("lang", "_lang")
    joined = own.join(language, own["lang"].eqNullSafe(language["_lang"]), "left").join(F.broadcast(corpus), how="left")
    for name in shares:
        spread = {mark: F.col(f"{name}_spread_{mark}") for mark in ("all", "lang", "own")}
        reach = lambda mark, width, sign: F.when(width > 0, F.col(f"{name}_mid_{mark}") + sign * SPREADS * width)  # noqa: E731, B023
        wide = F.greatest(spread["lang"], spread["all"] / 2)
        few = F.col("n_lang") < MIN_GROUP
        base = F.when(few, spread["all"]).otherwise(wide)
        alike = (F.col("n_own") < MIN_GROUP) | (2 * spread["own"] < base) | (spread["own"] == 0)
        for side, sign, inner in (("low", -1, F.greatest), ("high", 1, F.least)):
            corpus_bound, language_bound = reach("all", spread["all"], sign), reach("lang", wide, sign)
            if name not in TWO_SIDED:
                language_bound = inner(language_bound, corpus_bound)
            outer = F.when(few, corpus_bound).otherwise(language_bound)
            joined = joined.withColumn(f"{name}_{side}", F.when(alike, outer).otherwise(inner(reach("own", spread["own"], sign), outer)))
    return joined.select("lang", "source", *(f"{name}_{side}" for name in shares for side in ("low", "high")))


def judge(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = measured(docs)
    limits = thresholds(rows).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    beyond = F.lit(False)
    for name, share in _shares().items():
        beyond |= F.coalesce(share > F.col(f"{name}_high"), F.lit(False))
        if name in TWO_SIDED:
            beyond |= F.coalesce(share < F.col(f"{name}_low"), F.lit(False))
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))
