"""Operator 7: MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of distinct shingles, hashed to 64 bits.  Equal sets
   are one node, so exact copies never meet as pairs.
2. A signature's bands give bucket keys.  Buckets of one node, and buckets with
   the same nodes as another, are dropped before anything heavy moves.
3. Buckets that touch form families.  A family of up to ``BLOCK`` nodes and
   ``BLOCK_BYTES`` of sets goes to one task, each node once.  Larger families go
   bucket by bucket, and buckets beyond a block in several.
4. In a block, signatures of all pairs are compared a batch of positions at a
   time.  After m agreements in n positions the similarity's posterior (uniform
   prior) is Beta(m + 1, n - m + 1); a pair is given up as soon as the
   probability that it reaches the threshold is below ``MISS``.  Survivors are
   verified on whole sets, those of highest estimate first, and left alone once
   their nodes are connected.
5. Links give components.  In a bucket of several blocks, nodes outside its
   largest component meet the other blocks too; pairs inside that component
   need no test, so no link between different components is lost.  First only
   signatures meet; sets follow for the nodes that have a surviving pair.

A pair at the threshold shares no band with probability (1 - t^ROWS)^BANDS, for
0.85 under 1e-6.  Only keys, nodes and links are aggregated; no pair is emitted
but verified links of a spanning forest.

Null and empty texts, and texts without words, have no shingles, are linked with
nothing and are their own component.  Rows that repeat a doc_id with the same
text are one document's; with different texts, each row has its own set.  A null
doc_id never names a component unless no row of it has an id.  Very long texts
are whole sets; a set larger than a block is a block of its own.  An empty table
gives no rows; other columns are ignored.  :func:`drop_near` leaves one row of
each component, whatever ids repeat, and every row without shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .joins import weighed_join
from .store import discard, written
from .word_table import ChunkTable, slices, split_words, worker_table

BANDS, ROWS = 25, 5
HASHES = 256
BATCH = 32
BLOCK = 384
#: Bytes of packed sets in a block, about.
BLOCK_BYTES = 48_000_000
MISS = 1e-4
#: Words whose hashes a worker keeps.
KEPT_WORDS = 200_000
SEED = 11
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1
_r = np.random.default_rng(SEED)
_A = (_r.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _r.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_M = _r.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words together if there are fewer."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(size, n)
    h = np.full(n - k + 1, k if n < size else 0, np.uint64)
    for j in range(k):
        h = _mix(h * _M[0] + words[j : n - k + 1 + j] * _M[1 + j % 7])
    return np.unique(h)


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Least values under ``hashes`` linear functions of the shingles' upper 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    best = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 1024):
        np.minimum(best, (x[:, at : at + 1024] * _A[:hashes] + _B[:hashes]).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = _mix(h * _M[0] + rows[:, j])
    return h.view(np.int64)


def shingle_sets(part: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text in the second column."""
    words = split_words(part.column(1))
    table = worker_table(("shingle-words",), lambda: ChunkTable(lambda ws: [xxhash.xxh64_intdigest(_lower(w)) for w in ws], KEPT_WORDS))
    values = np.array(table.lookup(words.distinct.to_pylist()), np.uint64)[words.codes] if len(words.distinct) else np.empty(0, np.uint64)
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        yield shingle_set(values[a:b], size)


def _lower(word: str) -> bytes:
    """A-Z in lower case; other letters as they are."""
    return word.encode("utf-8").lower()


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, th (a hash of its text), row (a number), n_shingles, node (128 bits of the set; null without shingles), keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a copy in the same task needs no keys again
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches):
            n, nodes, keys = [], [], []
            for s in shingle_sets(part, size):
                n.append(len(s))
                node = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                nodes.append(node)
                keys.append(None if node is None or node in seen else band_keys(signature(s, BANDS * ROWS)))
                if node is not None and len(seen) < 2_000_000:
                    seen.add(node)
            numbers = pa.array(range(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.record_batch([part.column(0), part.column(2), numbers, pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "row", "n_shingles", "node", "keys"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    return texts.mapInArrow(run, "doc_id long, th long, row long, n_shingles long, node binary, keys array<long>")


def payloads(texts: DataFrame, size: int) -> DataFrame:
    """Per row of (node, text), once a task: node, sig (lowest byte of each position), shingles (48 bits of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows of a document with no id of its own
        for part in slices(batches):
            nodes, sigs, sets = [], [], []
            for node, s in zip(part.column(0).to_pylist(), shingle_sets(part, size), strict=True):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sigs.append(signature(s).astype(np.uint8).tobytes())
                    sets.append(packed(s))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["node", "sig", "shingles"])

    return texts.mapInArrow(run, "node long, sig binary, shingles binary")


def packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each: two sets of a thousand agree by chance in a shingle once in 10^8 pairs."""
    return np.ascontiguousarray(shingles.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def fewest_agreements(n: int, threshold: float, miss: float = MISS) -> int:
    """The fewest agreements in n positions after which P(similarity >= threshold) is still at least ``miss``.

    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


class Block:
    """Nodes of one group, with what pairs need; sets only where links are verified."""

    def __init__(self, nodes: list[int], sigs: list[bytes], sets: list[np.ndarray], sizes: list[int] | None = None):
        self.nodes, self.sets = nodes, sets
        self.sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(nodes), HASHES)
        self.sizes = np.array([len(s) for s in sets] if sizes is None else sizes)
        self.parent = list(range(len(nodes)))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def survivors(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the signatures leave, by falling estimate."""
        small, large = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        able = 100 * small >= percent * large
        i, j, agree = i[able], j[able], np.zeros(int(able.sum()), np.int32)
        for n in range(BATCH, HASHES + 1, BATCH):
            agree += (self.sig[i, n - BATCH : n] == self.sig[j, n - BATCH : n]).sum(axis=1, dtype=np.int32)
            left = agree >= fewest_agreements_at(n, percent)
            i, j, agree = i[left], j[left], agree[left]
        order = np.argsort(-agree, kind="stable")
        return i[order], j[order]

    def links(self, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """The components that verified links of the pairs make: each node with the least of its component."""
        step = 200_000
        for at in range(0, len(i), step):
            a, b = self.survivors(i[at : at + step], j[at : at + step], percent)
            common = self.common(a, b) if len(a) > 4 * len(self.nodes) else None
            for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if self.find(x) == self.find(y):
                    continue
                n = int(common[k]) if common is not None else len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
                if 100 * n >= percent * (self.sizes[x] + self.sizes[y] - n):
                    self.join(x, y)
        return [(self.nodes[k], self.nodes[root]) for k in range(len(self.nodes)) if (root := self.find(k)) != k]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sizes of intersections of many pairs, by products of 0/1 matrices over the shingles that several nodes have."""
        if not hasattr(self, "products"):
            owner = np.repeat(np.arange(len(self.sets)), self.sizes)
            values, codes, counts = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
            shared = np.cumsum(counts > 1) - 1
            kept = counts[codes] > 1
            owner, codes = owner[kept], shared[codes[kept]]
            order = np.argsort(codes, kind="stable")
            owner, codes = owner[order], codes[order]
            n = int(codes[-1]) + 1 if len(codes) else 0
            self.products = np.zeros((len(self.sets), len(self.sets)), np.float32)
            for at in range(0, n, 4096):
                low, high = np.searchsorted(codes, (at, at + 4096))
                m = np.zeros((len(self.sets), 4096), np.float32)
                m[owner[low:high], codes[low:high] - at] = 1
                self.products += m @ m.T
        return self.products[i, j]


_fewest: dict[tuple[int, int], int] = {}


def fewest_agreements_at(n: int, percent: int) -> int:
    if (n, percent) not in _fewest:
        _fewest[n, percent] = fewest_agreements(n, percent / 100)
    return _fewest[n, percent]


def _in_groups(groups: DataFrame, one: Callable[[list[tuple]], list[tuple]], columns: list[str], schema: str, partitions: int) -> DataFrame:
    """What ``one`` makes of the rows (side, node, sig, n, ...) of each group (grp, part), which meet in one task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for grp, part, *row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if (grp, part) != key:
                        if len(rows) > 1 and (found := one(rows)):
                            yield batch_of(found)
                        key, rows = (grp, part), []
                    rows.append(row)
        if len(rows) > 1 and (found := one(rows)):
            yield batch_of(found)

    dealt = groups.select("grp", "part", "side", "node", *columns).repartition(partitions, "grp", "part").sortWithinPartitions("grp", "part")
    return dealt.mapInArrow(run, schema)


def _pairs(rows: list[tuple]) -> tuple[dict[int, tuple], list[int], np.ndarray, np.ndarray]:
    """(a row for each node, nodes, pairs i and j) of one group's rows (side, node, ...).

    Side 2 holds every pair; otherwise a pair is a node on side 0 and one on side 1.
    """
    once = {r[1]: r for r in rows}
    sides: dict[int, set[int]] = {}
    for r in rows:
        sides.setdefault(r[1], set()).add(r[0])
    nodes = sorted(once)  # the least of a component is its root here and over all blocks
    i, j = np.triu_indices(len(nodes), 1)
    if 2 not in set().union(*sides.values()):
        zero, one = (np.array([s in sides[x] for x in nodes]) for s in (0, 1))
        across = (zero[i] & one[j]) | (one[i] & zero[j])
        i, j = i[across], j[across]
    return once, nodes, i, j


def verified(groups: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Nodes and the least nodes (a, b) they are connected with in each group (grp, part) of rows (grp, part, side, node, sig, n, shingles)."""

    def one(rows: list[tuple]) -> list[tuple[int, int]]:
        once, nodes, i, j = _pairs(rows)
        block = Block(nodes, [once[x][2] for x in nodes], [unpacked(once[x][4]) for x in nodes])
        return block.links(i, j, percent)

    return _in_groups(groups, one, ["sig", "n", "shingles"], "a long, b long", partitions)


def surviving(groups: DataFrame, percent: int, partitions: int) -> DataFrame:
    """The rows (grp, part, side, node) of nodes with a pair that the signatures leave, from rows (grp, part, side, node, sig, n)."""

    def one(rows: list[tuple]) -> list[tuple]:
        once, nodes, i, j = _pairs(rows)
        block = Block(nodes, [once[x][2] for x in nodes], [], [once[x][3] for x in nodes])
        left: set[int] = set()
        for at in range(0, len(i), 200_000):
            for side in block.survivors(i[at : at + 200_000], j[at : at + 200_000], percent):
                left.update(np.unique(side).tolist())
        alive = {nodes[k] for k in left}
        return [(r[4], r[5], r[0], r[1]) for r in rows if r[1] in alive]

    own = groups.withColumns({"own_grp": F.col("grp"), "own_part": F.col("part")})
    return _in_groups(own, one, ["sig", "n", "own_grp", "own_part"], "grp long, part long, side long, node long", partitions)


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept; linked at ``percent`` of shared shingles or more."""
    return _grouped(docs, size, percent, block, block_bytes).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, size: int, percent: int, block: int, block_bytes: int) -> DataFrame:
    """Per row of ``docs``: doc_id, th, n_shingles, component_id, and ``stays``: true for one row of each component and for rows without shingles."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(sketched(docs, size), "near-rows")
    # a node is a distinct set; its number is fixed once the table is written
    id_ = F.coalesce("doc_id", F.lit(NO_ID))
    one = [F.min(id_).alias("id"), F.min_by("th", id_).alias("th"), F.min_by("row", id_).alias("row"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")]
    bands = [F.max(F.get("keys", F.lit(k))).alias(f"k{k}") for k in range(BANDS)]  # long by long: such buffers need no sort
    sets = rows.filter("node IS NOT NULL").groupBy(F.col("node").alias("set")).agg(*one, *bands)
    nodes = written(sets.select(F.monotonically_increasing_id().alias("node"), "set", "id", "th", "row", "n", "copies", F.array(*(f"k{k}" for k in range(BANDS))).alias("keys")), "near-nodes")
    n_rows, n_nodes = rows.count(), nodes.count()
    keys = nodes.select("node", F.col("n").alias("size"), F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("n > 1")
    once = buckets.groupBy("n", "least", "x").agg(F.min("key").alias("_key"), F.max("size").alias("bucket_size"))
    once = once.select("_key", F.col("n").alias("bucket_n"), "bucket_size", "least")
    found = weighed_join(keys, once, ("key", "_key"), "bucket_n", BANDS * n_nodes)
    members = written(found.select("key", "bucket_n", "bucket_size", "least", "node", "size"), "near-members")

    families = connected_components(members.filter("node <> least"), "node", "least")
    label = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select(F.col("node").alias("_node"), F.col("n").alias("size")), F.col("node") == F.col("_node")).select("node", "root", "size")
    label = written(label, "near-families")
    sizes = label.groupBy("root").agg(F.count("*").alias("family_n"), F.sum("size").alias("family_size")).withColumnRenamed("root", "_root")
    fits = (F.col("family_n") <= block) & (F.col("family_size") * 6 <= block_bytes)
    small = written(weighed_join(label, sizes, ("root", "_root"), "family_n", n_nodes).select(F.col("node").alias("_node"), "root", fits.alias("small")), "near-small")
    discard(families, label)
    blocks = F.greatest(F.ceil(F.col("bucket_n") / block), F.ceil(F.col("bucket_size") * 6 / block_bytes))
    placed = F.pmod(F.xxhash64("node", "key"), blocks)
    large_members = members.join(small.filter(~F.col("small")), members["node"] == F.col("_node"), "left_semi").select(F.col("key").alias("grp"), placed.alias("part"), blocks.alias("blocks"), "node")
    groups = small.filter("small").select(F.xxhash64("root").alias("grp"), F.lit(-1).cast("long").alias("part"), F.lit(1).cast("long").alias("blocks"), F.col("_node").alias("node"))
    large_members = written(large_members, "near-large")
    discard(members)
    tasks = groups.unionByName(large_members).withColumn("side", F.lit(2).cast("long"))

    wanted = nodes.join(small, nodes["node"] == small["_node"], "left_semi").select("node", F.col("id").alias("_id"), F.col("th").alias("_th"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted, (F.coalesce(texts["doc_id"], F.lit(NO_ID)) == F.col("_id")) & (F.xxhash64(texts["text"]) == F.col("_th"))).select("node", "text")
    stored = written(payloads(texts, size), "near-payloads")
    payload = stored.withColumnRenamed("node", "_pnode").withColumn("n", (F.octet_length("shingles") / 6).cast("long"))
    with_payload = lambda df, *columns: df.join(payload.select("_pnode", *columns), df["node"] == F.col("_pnode"))
    links = written(verified(with_payload(tasks, "sig", "n", "shingles"), percent, n), "near-links")
    discard(small)
    found = connected_components(links)

    # buckets of several blocks: what lies outside the bucket's largest component meets the other blocks
    several = large_members.filter("blocks > 1")
    if not several.isEmpty():
        several = several.join(found.withColumnRenamed("node", "_n"), several["node"] == F.col("_n"), "left")
        labelled = written(several.select("grp", "part", "blocks", "node", F.coalesce("root", "node").alias("root")), "near-labelled")
        counts = labelled.groupBy("grp", "root").agg(F.count("*").alias("c"))
        largest = counts.groupBy("grp").agg(F.max_by("root", "c").alias("_top"), F.sum("c").alias("_c")).withColumnRenamed("grp", "_grp")
        n_labelled = labelled.count()
        marked = weighed_join(labelled, largest, ("grp", "_grp"), "_c", n_labelled)
        marked = written(marked.select("grp", "part", "blocks", "node", (F.col("root") != F.col("_top")).alias("outside")), "near-marked")
        discard(labelled)
        others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        # group (i, j): every node of block i on side 0, those of block j outside the largest component on side 1
        outer = marked.groupBy("grp").agg(F.collect_set(F.when(F.col("outside"), F.col("part"))).alias("homes"), F.count("*").alias("_c")).withColumnRenamed("grp", "_g")
        first = weighed_join(marked, outer, ("grp", "_g"), "_c", n_labelled).select("grp", "part", "blocks", "node", F.explode("homes").alias("home"))
        first = first.filter("part <> home").select("grp", (F.col("part") * F.col("blocks") + F.col("home")).alias("part"), F.lit(0).cast("long").alias("side"), "node")
        second = marked.filter("outside").select("grp", "blocks", "node", F.col("part").alias("home"), F.explode(others).alias("i")).filter("i <> home")
        second = second.select("grp", (F.col("i") * F.col("blocks") + F.col("home")).alias("part"), F.lit(1).cast("long").alias("side"), "node")
        alive = written(surviving(with_payload(first.unionByName(second), "sig", "n"), percent, n), "near-alive")
        more = written(verified(with_payload(alive, "sig", "n", "shingles"), percent, n), "near-links")
        joined = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        discard(marked, alive, more, found)
        found = joined
    discard(links, large_members, stored)

    named = nodes.select("node", "set", "id", "row", "copies").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = written(named.select("set", "id", "row", "copies", F.coalesce("root", "node").alias("root")), "near-named")
    discard(nodes, found)
    lowest = named.groupBy("root").agg(F.min("id").alias("lowest"), F.min_by("row", "id").alias("stay"), F.count("*").alias("members")).withColumnRenamed("root", "_root")
    of_set = weighed_join(named, lowest, ("root", "_root"), "members", n_nodes).select(F.col("set").alias("_set"), "copies", F.when(F.col("lowest") != NO_ID, F.col("lowest")).alias("component_id"), "stay")
    of_set = written(of_set, "near-of-set")
    discard(named)
    out = weighed_join(rows, of_set, ("node", "_set"), "copies", n_rows, "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", "th", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("stay"))).alias("stays"), alone.alias("alone"))


def drop_near(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies, one of smallest doc_id; rows without shingles and all columns stay.

    Rows are known by doc_id and a hash of the text; of rows that agree in both, one is taken.
    """
    found = written(_grouped(docs, size, percent, BLOCK, BLOCK_BYTES), "near-decisions")
    key = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    stay = found.filter("stays")
    repeated = found.filter("NOT alone").groupBy("doc_id", "th").agg(F.count("*").alias("times")).filter("times > 1")
    same = lambda df: docs.join(df, docs["doc_id"].eqNullSafe(df["_id"]) & (F.xxhash64(docs["text"].cast("string")) == df["_th"]), "left_semi")
    if repeated.isEmpty():
        return same(key(stay))
    repeated = key(repeated)
    is_repeated = stay["doc_id"].eqNullSafe(repeated["_id"]) & (stay["th"] == repeated["_th"])
    once, many = (same(key(stay.join(repeated, is_repeated, how))) for how in ("left_anti", "left_semi"))
    one = many.groupBy(F.col("doc_id").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th")).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return once.unionByName(one.select("_row.*"))
