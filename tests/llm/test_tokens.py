"""Token operators against the libraries, on odd texts and by round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import packing, piece_codec, token_counts, token_files
from emberlog.llm.word_table import FILL, ChunkTable, JsonTokens, split_at, split_words

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n\t ", "a", " a  b ", "Ünï Straße ÉCOLE İSTANBUL ΣΑΣ", "é ́x", "don't I'LL we've", "<|endoftext|> x<|startoftext|>y <|end", "日本語 テキスト", "a\x1cb\x85c\xa0d", "🙂🙂 ok", "x" * 3000, "!!!??? ...", "1234 5a6", "▁a ▁ b▁", "<s></s><unk>", "a\0b", "tab\tnew\r\nline", "ªº ﬁ", "word.word,word!! ##x"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (3, ODD[3]), (None, "no id"), (-5, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"start": F.lit("clash"), "n_tokens": F.lit(0), "part": F.lit(1), "tie": F.lit(2), "score": F.lit(None).cast("double")})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)


def texts(table):
    return sorted(((r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))


def test_token_files(spark, table, library, tmp_path):
    files = token_files.write_token_files(table, f"file://{tmp_path}/out", WORD, end_id=2, length=16, partitions=3).collect()
    got = token_files.read_token_files(spark, files).collect()
    want, at = [], 0
    for doc_id, text in texts(table):
        ids = [*library[0].encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    flat = []
    for f in sorted(files, key=lambda f: f.part):
        one = token_files.TokenFile(f.path)
        for k in range(len(one)):
            ids, mask = one.sequence(k), one.mask(k).to_numpy(zero_copy_only=False)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            flat += ids[mask].tolist()
        with pytest.raises(IndexError):
            one.sequence(len(one))
    assert flat == [i for _, t in texts(table) for i in (*library[0].encode(t, add_special_tokens=False).ids, 2)]


def test_token_files_empty(spark, table, tmp_path):
    files = token_files.write_token_files(table.limit(0), f"file://{tmp_path}/none", WORD, end_id=2).collect()
    out = token_files.read_token_files(spark, files)
    assert files == [] and out.count() == 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_token_file_reads_ranges(tmp_path, monkeypatch):
    from pyarrow import fs

    ids = np.arange(20_000, dtype="<u4") % 60_000
    writer = token_files.TokenFileWriter(fs.LocalFileSystem(), f"{tmp_path}/part", 16, "uint16")
    for at in range(0, len(ids), 700):
        writer.add(at, ids[at : at + 700])
    writer.close()
    mapped = token_files.TokenFile(f"file://{tmp_path}/part")
    remote = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    monkeypatch.setattr(token_files, "filesystem", lambda uri: (remote, uri.removeprefix("file://")))
    ranged = token_files.TokenFile(f"file://{tmp_path}/part")
    assert len(mapped) == len(ranged) == 1250 and not isinstance(ranged.source, pa.MemoryMappedFile)
    for k in (0, 1249, 63, 64, 700, 1215, 1216):
        assert mapped.sequence(k).tolist() == ranged.sequence(k).tolist() == ids[16 * k : 16 * k + 16].tolist() and not mapped.sequence(k).flags.owndata


def test_token_ids_must_fit(table, tmp_path):
    with pytest.raises(ValueError, match="uint8"):
        token_files.write_token_files(table, f"file://{tmp_path}/small", WORD, end_id=2, dtype="uint8")


def test_other_tokenizer_rules(tmp_path, library):
    """Without lower-casing, chunks go through the library whole; tokenizers that join over white space are refused."""
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    cased = Tokenizer.from_file(str(tmp_path / "cased.json"))
    counter, tokens = token_counts.MergeCounter(str(tmp_path / "cased.json")), JsonTokens(str(tmp_path / "cased.json"))
    many = [t for t in ODD if t.isascii()] + ["Stone hInTeR. ÉCOLE!!"]
    ids, offsets = tokens.encode(pa.array(many))
    for k, text in enumerate(many):
        want = cased.encode(text, add_special_tokens=False).ids
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want and counter.count(pa.array([text]))[0] == len(want)
    for make in (JsonTokens, token_counts.MergeCounter):
        with pytest.raises(ValueError, match="white space"):
            make(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts(table, library):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table, WORD, limit=10).collect())
    want = sorted((i is not None, i or 0, len(t.encode()), n := len(library[0].encode(t, add_special_tokens=False).ids), n > 10) for i, t in texts(table))
    assert got == want and token_counts.count_tokens(table.limit(0), WORD).count() == 0


def test_piece_codec(table, library):
    def want(i, t):
        ids = [*library[1].encode(t), 2]
        return i is not None, i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library[1].decode(ids).encode()).hexdigest()

    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.encode_documents(table, PIECE).collect())
    assert got == sorted(want(i, t) for i, t in texts(table))


_letters = st.text(st.one_of(st.sampled_from(" \n\t.,!'’<>|_-▁éÉßñ0123456789"), st.characters(codec="utf-8", exclude_characters="\0")), max_size=60)


@given(st.lists(_letters, min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text(library, many):
    tokens = JsonTokensOnce.get()
    ids, offsets = tokens.encode(pa.array(many, pa.string()))
    counts = Counter.get().count(pa.array(many, pa.string()))
    pieces = list(Pieces.get().joined(pa.array(many, pa.string())))
    for k, text in enumerate(many):
        want = library[0].encode(text, add_special_tokens=False).ids
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want
        assert counts[k] == len(want)
        own = library[1].encode(text)
        assert [int(i) for i in pieces[k][1].split()] == own and pieces[k][0] == len(own)
        assert pieces[k][2] == library[1].decode(own)


class Once:
    made = None

    @classmethod
    def get(cls):
        if cls.made is None:
            cls.made = cls.make()
        return cls.made


class JsonTokensOnce(Once):
    make = staticmethod(lambda: JsonTokens(WORD))


class Counter(Once):
    make = staticmethod(lambda: token_counts.MergeCounter(WORD))


class Pieces(Once):
    make = staticmethod(lambda: piece_codec.PieceTable(PIECE))


def test_merging_many_symbols():
    word = b"abcdefgh" * 500
    want = len(Tokenizer.from_file(WORD).encode(word.decode(), add_special_tokens=False).ids)
    assert Counter.get().merge(word) == want


def test_encode_text_round_trip(library):
    ids, text = piece_codec.encode_text("A tale of two cities", PIECE)
    assert ids == [*library[1].encode("A tale of two cities"), 2] and text == "A tale of two cities"
    assert piece_codec.encode_text("", PIECE) == ([2], "") and piece_codec.crosses(["a▁b"]) and not piece_codec.crosses(["▁▁a", "b"])


def test_splitting():
    w = split_words(pa.array(["", " a b ", "b"]))
    assert [[w.distinct[c].as_py() for c in w.codes[a:b]] for a, b in zip(w.offsets, w.offsets[1:])] == [[], ["a", "b"], ["b"]]
    assert w.sums(np.ones(len(w.distinct), np.int64)).tolist() == [0, 2, 1]
    s = split_at(pa.array(["a  b"]), " ")
    assert [s.distinct[c].as_py() for c in s.codes] == ["a", "", "b"]


def test_table_starts_again_when_full():
    calls = []
    t = ChunkTable(lambda cs: calls.append(len(cs)) or [c.upper() for c in cs], max_entries=3)
    assert t.lookup(["a", "b"]) == ["A", "B"] and t.lookup(["a", "c"]) == ["A", "C"] and t.lookup(["d", "e"]) == ["D", "E"] and len(t.known) <= 3


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_packing_plan(lengths):
    n, pieces = packing.plan(lengths, capacity=512)
    assert n == -(-sum(lengths) // 512)
    covered, rooms = {}, {}
    for k, at, length, sequence, offset in pieces:
        covered.setdefault(k, []).append((at, length))
        rooms.setdefault(sequence, []).append((offset, length))
    for k, own in covered.items():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end == lengths[k]
    for own in rooms.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 512


def plan_by_hand(lengths, capacity, linear):
    """Every choice by looking at every sequence."""
    n = -(-sum(lengths) // capacity)
    room, cost, out = [capacity] * n, [0] * n, []
    work = [(min(capacity, length - at), k, at) for k, length in enumerate(lengths) for at in range(0, length, capacity)]
    for length, k, at in sorted(work, key=lambda w: (-w[0], w[1], w[2])):
        while length:
            fits = [s for s in range(n) if room[s] >= length]
            widest = max(room)
            best = min(fits, key=lambda s: (cost[s], room[s], s)) if fits else min((s for s in range(n) if room[s] == widest), key=lambda s: (cost[s], s))
            here = min(length, room[best])
            out.append((k, at, here, best, capacity - room[best]))
            room[best], cost[best] = room[best] - here, cost[best] + here * (linear + here)
            length, at = length - here, at + here
    return n, sorted(out, key=lambda p: (p[3], p[4]))


@given(st.lists(st.integers(1, 300), min_size=1, max_size=60), st.sampled_from([1, 7, 6144]))
@settings(max_examples=150, deadline=None)
def test_packing_places_as_by_hand(lengths, linear):
    assert packing.plan(lengths, 128, linear) == plan_by_hand(lengths, 128, linear)


def test_packing_balances_cost():
    _, pieces = packing.plan([100, 90, 80, 70, 60, 112], capacity=256)
    first = {s for k, _, _, s, _ in pieces if k in (0, 5)}
    assert len(first) == 2  # the two dearest documents are not together


def test_packing(table, library):
    rows = packing.pack(table, WORD, end_id=1, capacity=64, window_tokens=200).collect()
    by_sequence, total = {}, 0
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(len(library[0].encode(t, add_special_tokens=False).ids) + 1 for _, t in texts(table))
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    ids = [*library[0].encode("x" * 3000, add_special_tokens=False).ids, 1]
    for r in rows:
        if r.doc_id == ODD.index("x" * 3000):
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(table.limit(0), WORD, 1).count() == 0


def test_table_filled_in_parts():
    """Values come in order and once, over several calls and when the table starts again."""
    calls = []

    def fill(chunks):
        calls.append(len(chunks))
        return [len(c) + int(c) for c in chunks]

    words = [str(k) for k in range(2 * FILL + 5)]
    table = ChunkTable(fill, max_entries=len(words))
    want = [len(c) + int(c) for c in words]
    assert table.lookup(words) == want and calls == [FILL, FILL, 5]
    assert table.lookup(words[::-1]) == want[::-1] and len(calls) == 3
    assert table.lookup([*words[:3], "9" * 300, "123456789"]) == [*want[:3], 300 + int("9" * 300), 9 + 123456789]
    assert len(table.known) == 1  # the table started again; the long one is not kept
