"""Exact and near copies against plain Python."""

import hashlib
import os
import random
import re
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import exact_dedup, near_dedup
from emberlog.llm.components import connected_components
from emberlog.llm.queries import oracle_sql, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"entry": F.lit("clash"), "node": F.lit(1), "keys": F.lit(None).cast("int"), "kept": F.lit(True), "doc": F.lit(0)})


EXACT = [(1, "a b"), (2, "a  b"), (3, "a\n\tb"), (4, " a b"), (5, None), (6, ""), (7, " "), (8, "\n"), (9, "a\xa0b"), (9, "a\xa0b"), (10, "x" * 200_000), (11, "x" * 200_000), (12, "x" * 199_999), (None, "a b"), (None, "only here")]


def by_hand(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    out, stayed = [], set()
    for i, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        stays = i == keep and norm(t) not in stayed
        if stays:
            stayed.add(norm(t))
        out.append((i, keep, len(own), stays, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


#: A third of the rows are one text, ids repeat with equal and with other texts, and each text has many copies.
COPIES = [(2, "a"), (2, "b"), (1, "b"), (7, "z"), (7, "z"), (None, "n"), (None, "n"), (None, None), *((100 - k // 2, "hot  text" if k % 3 else "hot text") for k in range(40)), *((200 + k, f"t {k % 6} " * 30) for k in range(60))]


@pytest.mark.parametrize("rows", [EXACT, COPIES])
@pytest.mark.parametrize("limit,hot", [(exact_dedup.TABLE_BYTES, exact_dedup.HOT_BYTES), (500, exact_dedup.HOT_BYTES), (500, 200)])
def test_exact(spark, rows, limit, hot):
    df = table(spark, rows).repartition(3)
    got = exact_dedup.exact_groups(df, table_bytes=limit, hot_bytes=hot)
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.collect()), key=repr) == by_hand(rows)
    kept = exact_dedup.drop_exact(df, table_bytes=limit, hot_bytes=hot)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    found = sorted(((r.doc_id, norm(r.text), r.entry, r.doc) for r in kept.collect()), key=repr)
    groups = {}
    for i, t in rows:
        least = groups.get(norm(t))
        groups[norm(t)] = i if least is None else least if i is None else min(i, least)
    assert found == sorted(((i, t, "clash", 0) for t, i in groups.items()), key=repr)


def test_exact_without_rows(spark):
    none = table(spark, EXACT).limit(0)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op7_near_dedup"])
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, DATA)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_grace_recursion_and_probing(tmp_path):
    records = []
    for k in range(400):
        text = f"text {k % 90} ".encode() * 20
        records.append((hashlib.sha256(text).digest(), k, 1, 1000 - k, k, text))
    got = {e: (least, n) for _, _, (n, least, _), own in exact_dedup.grace(iter(records), f"file://{tmp_path}/spill", limit=3000) for e in own}
    for k in range(400):
        same = [j for j in range(400) if j % 90 == k % 90]
        assert got[k] == (1000 - max(same), len(same))
    assert not list((tmp_path / "spill").iterdir())
    t = exact_dedup.TextTable()
    for k in range(5000):  # one hash for all: texts decide
        assert t.find(7, b"%d" % (k % 300))[0] == k % 300
    assert exact_dedup.normalise(b" \n") == b" " and exact_dedup.normalise(b"") == b""


def components_by_hand(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {x: root for x, root in components_by_hand(links).items() if x != root}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_by_hand(rows, size, percent):
    sets = {}
    for i, t in rows:
        words = [w.encode().lower() for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        sets[i] = frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for own in holders.values():
        for a, b in combinations(sorted(own), 2):
            common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    roots = components_by_hand(links)
    return {i: (len(s), roots.get(i, i)) for i, s in sets.items()}


def family(r, n, words, edits):
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(edits)):
            own[r.randrange(words)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 6])
@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near(spark, block, size, percent):
    r = random.Random(5)
    texts = ["", None, " \n", "one", "one two", "One TWO", "one two three", "ÉCOLE É x y", "école é x y", "z " * 50_000]
    texts += family(r, 60, 120, 8) + family(r, 3, 400, 20) + family(r, 2, 10, 2) + [" ".join(f"u{r.randrange(10**6)}" for _ in range(80)) for _ in range(40)]
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_groups(table(spark, rows).repartition(3), size, percent, block=block).collect()}
    assert got == near_by_hand(rows, size, percent)


def test_near_repeats_and_empties(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = near_dedup.near_groups(table(spark, rows)).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got) == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_groups(table(spark, rows).limit(0)).count() == 0
    assert near_dedup.drop_near(table(spark, rows).limit(0)).count() == 0


def test_near_leaves_one_row_of_each_group(spark):
    r = random.Random(3)
    a, b, c = (family(r, 4, 200, 3) for _ in range(3))
    rows = [(5, a[0]), (5, a[0]), (5, a[1]), (9, a[2]), (2, b[0]), (2, b[0]), (2, b[0]), (1, c[0]), (3, b[1]), (None, c[1]), (None, c[1]), (None, None), (None, None), (8, ""), (8, "")]
    df = table(spark, rows).repartition(3)
    got = near_dedup.drop_near(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    kept = [(x.doc_id, x.text) for x in got.collect()]
    assert sorted((i for i, t in kept if t), key=repr) == [1, 2, 5] and sorted((x for x in kept if not x[1]), key=repr) == [(8, ""), (8, ""), (None, None), (None, None)]
    assert {t for i, t in kept if i == 5} <= set(a) and (2, b[0]) in kept


def test_blocks_bounded_by_bytes(spark):
    r = random.Random(8)
    rows = list(enumerate(family(r, 30, 2000, 40) + family(r, 12, 300, 5)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_groups(table(spark, rows).repartition(3), 3, 85, block_bytes=40_000).collect()}
    assert got == near_by_hand(rows, 3, 85)


def test_hubs(spark, monkeypatch):
    """Every join sends its heavy keys by broadcast."""
    from emberlog.llm import joins

    monkeypatch.setattr(joins, "HEAVY", 4)
    links = [(0, k) for k in range(1, 300)] + [(k, 1000 + k % 3) for k in range(1, 200)] + [(5000, k) for k in range(5001, 5040)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: root for x, root in components_by_hand(links).items() if x != root}


def test_packed_sets():
    s = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64))
    got = near_dedup.unpacked(near_dedup.packed(s))
    assert got.tolist() == [int(x) >> 16 << 16 for x in s] and len(near_dedup.packed(s)) == 600 and not len(near_dedup.unpacked(b""))


def test_posterior_bounds():
    n, t = 64, 0.85
    grid = np.linspace(0, 1, 20001)
    for m in (30, 45, near_dedup.fewest_agreements(n, t), 60):
        density = grid**m * (1 - grid) ** (n - m)
        tail = density[grid >= t].sum() / density.sum()
        assert (tail >= near_dedup.MISS) == (m >= near_dedup.fewest_agreements(n, t))
    assert near_dedup.fewest_agreements(256, 0.85) > near_dedup.fewest_agreements(128, 0.85)


def test_intersections_by_matrix_products():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 3000, 400).astype(np.uint64)) for _ in range(12)]
    b = near_dedup.Block(list(range(12)), [bytes(near_dedup.HASHES)] * 12, sets)
    i, j = np.triu_indices(12, 1)
    assert b.common(i, j).tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j)]
