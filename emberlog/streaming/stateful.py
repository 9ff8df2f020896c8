"""Operators that keep state from batch to batch, by key."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vendor import with_parts
from ..sources.binary import attach_templates, ipfix_sets

MAX_BYTES = 8 << 20
LATENCY_MS = 10_000


class Parts:
    """Parts of one message.  ``counting`` completes by the number of parts that came, repeats too; else by distinct numbers.

    A message of one part, when counting, does not complete as it arrives: it
    leaves when it is evicted.
    """

    def __init__(self, state: tuple | None = None):
        self.micros, self.tag, self.src, self.total, self.count, self.size = state[:6] if state else (None, None, None, 0, 0, 0)
        self.bodies: dict[int, str] = dict(zip(state[6], state[7], strict=True)) if state else {}

    def add(self, micros: int, tag: str, src: bytes | None, total: int, seq: int, body: str) -> None:
        if not self.count:
            self.micros, self.tag, self.src, self.total = micros, tag, src, total
        if not 0 <= seq < self.total:
            return
        self.size += len(body) - len(self.bodies.get(seq, ""))
        self.bodies[seq] = body
        self.count += 1

    def complete(self, counting: bool) -> bool:
        return self.count == self.total > 1 if counting else len(self.bodies) == self.total > 0

    def joined(self) -> str:
        return "".join(self.bodies[k] for k in sorted(self.bodies))

    def row(self) -> tuple:
        return self.micros, self.tag, self.src, self.total, self.count, self.size, list(self.bodies), list(self.bodies.values())


_STATE = "micros long, tag string, src binary, total long, count long, size long, seqs array<long>, bodies array<string>"
_SHARD = "messages array<struct<" + ", ".join(f.replace(" ", ": ", 1) for f in f"host string, cat string, id long, last long, {_STATE}".split(", ")) + ">>"
_OUT = "micros long, tag string, src binary, body string, complete boolean"


class Shard:
    """Parts of many messages, the one longest without a part first."""

    def __init__(self, rows: list = ()):
        self.held: dict[tuple, tuple[int, Parts]] = {tuple(r[:3]): (r[3], Parts(tuple(r[4:]))) for r in rows}
        self.size = sum(p.size for _, p in self.held.values())

    def add(self, key: tuple, now: int, *part) -> Parts:
        """The message after one more part, now the last to go."""
        _, parts = self.held.pop(key, (now, Parts()))
        self.size -= parts.size
        parts.add(*part)
        self.size += parts.size
        self.held[key] = now, parts
        return parts

    def take(self, key: tuple) -> Parts:
        _, parts = self.held.pop(key)
        self.size -= parts.size
        return parts

    def evicted(self, before: int, most: int) -> Iterator[Parts]:
        """What got its last part before a time, and then the oldest until ``most`` bytes are left."""
        while self.held:
            key, (last, _) = next(iter(self.held.items()))
            if last > before and self.size <= most:
                break
            yield self.take(key)

    def rows(self) -> list[tuple]:
        return [(*key, last, *parts.row()) for key, (last, parts) in self.held.items()]


def reassemble_stream(df: DataFrame, counting: bool = False, latency_ms: int = LATENCY_MS, max_bytes: int = MAX_BYTES, max_total: int | None = None, shards: int = 64) -> DataFrame:
    """Multipart messages as they complete: (ts, tag, src, data, complete).

    State is kept by (host, category, id), so keys spread over the cluster; a
    message that gets no part for ``latency_ms`` of processing time, or outgrows
    ``max_bytes``, leaves as far as it came.  With ``max_total`` all messages
    together hold no more bytes: they lie in ``shards`` by their keys, each with
    its share of the limit, and those longest without a part leave first.

    Time-outs make batches without data, so an ``availableNow`` query ends only
    with ``spark.sql.streaming.noDataMicroBatches.enabled`` false.
    """
    names = ("host", "cat", "id", "total", "seq", "body")
    parts = with_parts(df).select(F.unix_micros("ts").alias("micros"), "tag", "src", *(F.col(f"_{n}").alias(n) for n in names)).filter("id IS NOT NULL AND total > 0 AND seq < total")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Parts(state.get if state.exists else None)
        out = []
        if state.hasTimedOut:
            out.append((held.micros, held.tag, held.src, held.joined(), held.complete(False)))
            state.remove()
        else:
            for batch in batches:
                for r in batch.sort_values(["micros", "seq"], kind="stable").itertuples(index=False):
                    held.add(r.micros, r.tag, r.src, r.total, r.seq, r.body)
                    if held.complete(counting) or held.size > max_bytes:
                        out.append((held.micros, held.tag, held.src, held.joined(), held.complete(counting)))
                        held = Parts()
            if held.count:
                state.update(held.row())
                state.setTimeoutDuration(latency_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["micros", "tag", "src", "body", "complete"])

    def step_shard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard, now, left = Shard(state.get[0] if state.exists else ()), state.getCurrentProcessingTimeMs(), []
        for batch in () if state.hasTimedOut else batches:
            for r in batch.sort_values(["micros", "seq"], kind="stable").itertuples(index=False):
                which = (r.host, r.cat, r.id)
                held = shard.add(which, now, r.micros, r.tag, r.src, r.total, r.seq, r.body)
                if held.complete(counting) or held.size > max_bytes:
                    left.append(shard.take(which))
                left += shard.evicted(now - latency_ms, max_total // shards)
        left += shard.evicted(now - latency_ms, max_total // shards)
        if shard.held:
            state.update((shard.rows(),))
            state.setTimeoutDuration(latency_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(p.micros, p.tag, p.src, p.joined(), p.complete(counting)) for p in left], columns=["micros", "tag", "src", "body", "complete"])

    if max_total is None:
        keyed, run, kept = parts.groupBy("host", "cat", "id"), step, _STATE
    else:
        keyed, run, kept = parts.withColumn("shard", F.pmod(F.xxhash64("host", "cat", "id"), F.lit(shards))).groupBy("shard"), step_shard, _SHARD
    found = keyed.applyInPandasWithState(run, _OUT, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found.select(F.timestamp_micros("micros").alias("ts"), "tag", "src", F.col("body").cast("binary").alias("data"), "complete")


def sessions(df: DataFrame) -> DataFrame:
    """Version 9 and 10 flow packets (payloads) with templates that their session has seen; by (domain, source), on streams.

    Packets of one key are taken in the order of their time within a batch.
    """
    from pyspark.sql.types import BinaryType, IntegerType, MapType, StructField, StructType

    state_type = StructType([StructField("known", MapType(IntegerType(), BinaryType()))])

    @F.pandas_udf("long")
    def domain(data: pd.Series) -> pd.Series:
        return data.map(lambda d: -1 if (s := ipfix_sets(bytes(d))) is None else s[1])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(state.get[0] or {}) if state.exists else {}
        for batch in batches:
            batch = batch.sort_values("micros", kind="stable")
            raw = [bytes(d) for d in batch["data"]]
            out = attach_templates(raw, known)
            for packet in raw:
                if (parsed := ipfix_sets(packet)) is not None:
                    for set_id, part in parsed[2]:
                        if set_id in (0, 2) and len(part) >= 8:
                            known[int.from_bytes(part[4:6], "big")] = part
            yield pd.DataFrame({"micros": batch["micros"], "tag": batch["tag"], "data": out})
        state.update((known,))

    rows = df.select(F.unix_micros("ts").alias("micros"), "tag", "data", F.coalesce(F.hex("src"), F.lit("")).alias("source"), domain(F.col("data")).alias("domain"))
    found = rows.groupBy("domain", "source").applyInPandasWithState(step, "micros long, tag string, data binary", state_type, "append", GroupStateTimeout.NoTimeout)
    return found.select(F.timestamp_micros("micros").alias("ts"), "tag", "data")


class TokenBucket:
    """Bytes a second with a burst: how long to wait before sending."""

    def __init__(self, rate: float, burst: float, clock=time.monotonic):
        self.rate, self.burst, self.clock = rate, burst, clock
        self.level, self.at = burst, clock()

    def wait(self, size: int) -> float:
        now = self.clock()
        self.level = min(self.burst, self.level + (now - self.at) * self.rate) - size
        self.at = now
        return max(0.0, -self.level / self.rate)


def throttled(send, rate: float, burst: float):
    """A sender for micro-batches that keeps to a rate of payload bytes."""
    bucket = TokenBucket(rate, burst)

    def run(batch: DataFrame, number: int | None = None) -> None:
        size = batch.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n")).first().n
        time.sleep(bucket.wait(size))
        send(batch, number)

    return run
