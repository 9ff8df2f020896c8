"""Aggregates over entries and over statistics of searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..entry import ev_get


def overview(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """Entries and bytes in each bucket of time: (ts, count, bytes)."""
    return df.groupBy(F.window("ts", width)["start"].alias("ts")).agg(F.count("*").alias("count"), F.sum(F.octet_length("data")).alias("bytes"))


def merge_stats(stats: DataFrame) -> DataFrame:
    """Statistics of modules (ts, pos, name, in_count, in_bytes, out_count, out_bytes, duration), merged by position: sums, and the longest duration."""
    sums = [F.sum(c).alias(c) for c in ("in_count", "in_bytes", "out_count", "out_bytes")]
    return stats.groupBy("pos", "name").agg(F.max("ts").alias("ts"), *sums, F.max("duration").alias("duration"))


def facet_numeric(df: DataFrame, value: Column | str) -> DataFrame:
    """(count, min, max) of an attribute or expression."""
    value = ev_get(value).try_cast("double") if isinstance(value, str) else value
    return df.agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"))


def facet_values(df: DataFrame, value: Column, top: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The ``top`` values with their counts, and ``Other`` for the rest; ties by value.

    Values are ranked after counting.  Ranks beyond ``top`` are cut before rows
    are brought together, and ``Other`` is what the top leaves of the total, so
    no task holds all values of a group.
    """
    counted = df.groupBy(*by, value.cast("string").alias("value")).agg(F.count("*").alias("count")).filter("value IS NOT NULL")
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "value"))
        best = counted.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")
    else:
        best = counted.orderBy(F.desc("count"), "value").limit(top)
    total = counted.groupBy(*by).agg(F.sum("count").alias("_all")) if by else counted.agg(F.sum("count").alias("_all"))
    named = best.groupBy(*by).agg(F.sum("count").alias("_top")) if by else best.agg(F.sum("count").alias("_top"))
    joined = total.join(named, list(by)) if by else total.crossJoin(named)  # one row on each side
    rest = joined.select(*by, F.lit("Other").alias("value"), (F.col("_all") - F.col("_top")).alias("count")).filter("count > 0")
    return best.unionByName(rest)


def facet_by(df: DataFrame, column: str = "tag") -> DataFrame:
    """Entries for each tag or source."""
    return df.groupBy(column).agg(F.count("*").alias("count"))


def ingest_rates(df: DataFrame, now: Column, unit: str = "hour", n: int = 24) -> DataFrame:
    """Entries and bytes in each of the last ``n`` whole hours or minutes before ``now``, empty ones too."""
    end = F.date_trunc(unit, now)
    step = F.expr(f"INTERVAL 1 {unit}")
    start = end - F.expr(f"INTERVAL {n} {unit}")
    found = df.filter((F.col("ts") >= start) & (F.col("ts") < end)).groupBy(F.date_trunc(unit, "ts").alias("_b")).agg(F.count("*").alias("count"), F.sum(F.octet_length("data")).alias("bytes"))
    buckets = df.sparkSession.range(1).select(F.explode(F.sequence(start, end - step, step)).alias("bucket"))
    return buckets.join(found, F.col("bucket") == F.col("_b"), "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def ingest_totals(df: DataFrame, now: Column) -> DataFrame:
    """Entries and bytes of all time and of the last day."""
    day = F.col("ts") >= now - F.expr("INTERVAL 1 DAY")
    size = F.octet_length("data")
    return df.agg(F.count("*").alias("count"), F.sum(size).alias("bytes"), F.count_if(day).alias("day_count"), F.sum(F.when(day, size).otherwise(0)).alias("day_bytes"))


def distinct_ingesters(df: DataFrame, tags: str = "tags", address: str = "address") -> DataFrame:
    """How many differ by their set of tags and their address."""
    return df.agg(F.count_distinct(F.xxhash64(F.array_sort(tags), address)).alias("ingesters"))


def magnitude(values: Column) -> Column:
    """Sum over an array of (label, value)."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v["value"].cast("bigint"))


def consolidate_shards(shards: DataFrame, cutoff: Column) -> DataFrame:
    """Shards (start, end, size) that start in one second as one, those before the cutoff gone, starts not before it, in order."""
    whole = shards.groupBy(F.date_trunc("second", "start").alias("start")).agg(F.max("end").alias("end"), F.sum("size").alias("size"))
    return whole.filter(F.col("end") > cutoff).withColumn("start", F.greatest("start", cutoff)).orderBy("start")


def tag_union(*lists: Column) -> Column:
    """All tags once, in the order they first come."""
    return F.array_distinct(F.concat(*lists))


def gauge(df: DataFrame, name: str, value: Column) -> DataFrame:
    """(name, magnitude, min, max): the latest value, within its bounds."""
    return df.agg(F.max_by(value, F.struct("ts", "nsec_rem")).alias("magnitude"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.lit(name).alias("name"), "magnitude", "min", "max")


def moving_rate(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Entries a second over the last ``seconds``, for each second that has entries."""
    counted = df.groupBy("tag", F.date_trunc("second", "ts").alias("second")).agg(F.count("*").alias("n"))
    window = Window.partitionBy("tag").orderBy(F.col("second").cast("long")).rangeBetween(-(seconds - 1), 0)
    return counted.select("tag", "second", (F.sum("n").over(window) / seconds).alias("rate"))


def human_size(n: Column) -> Column:
    """A number of bytes with its unit."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    out = F.format_string(f"%.2f {units[-1]}", n / 1024.0**5)
    for k in range(len(units) - 2, 0, -1):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.2f {units[k]}", n / 1024.0**k)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(out)
