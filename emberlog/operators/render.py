"""Renderers: results in the shapes that clients show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..entry import text
from .filters import geofence


def raw(df: DataFrame, descending: bool = False) -> DataFrame:
    from ..entry import order

    return df.orderBy(*order(descending))


def as_text(df: DataFrame) -> DataFrame:
    return df.select("ts", "tag", text().alias("data"))


def as_hex(df: DataFrame) -> DataFrame:
    return df.select("ts", "tag", F.hex("data").alias("data"))


def table(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Named columns as strings, with the time."""
    return df.select("ts", *(c.cast("string").alias(n) for n, c in columns.items()))


def same_table(a: DataFrame, b: DataFrame) -> Column | bool:
    """Whether two tables have the same columns and rows."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def chart(df: DataFrame, name: Column, value: Column, names: Sequence[str], width: str = "1 hour") -> DataFrame:
    """A row for each bucket of time, a column for each name in order; what is missing or not a number is null."""
    wide = df.withColumn("_n", name).groupBy(F.window("ts", width)["start"].alias("ts")).pivot("_n", sorted(names)).agg(F.sum(value))
    return wide.select("ts", *(F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None).cast("double")).alias(n) for n in sorted(names)))


def chart_names(df: DataFrame, name: Column, top: int = 100) -> list[str]:
    """At most ``top`` names of a chart, by name."""
    return [r.n for r in df.select(name.alias("n")).filter("n IS NOT NULL").distinct().orderBy("n").limit(top).collect()]


def chart_long(df: DataFrame, name: Column, value: Column, width: str = "1 hour") -> DataFrame:
    """A row for each bucket and name: for any number of names."""
    return df.groupBy(F.window("ts", width)["start"].alias("ts"), name.alias("name")).agg(F.sum(value).alias("value"))


def graph(df: DataFrame, source: Column, target: Column, value: Column | None = None, group: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, name, group), edges (src, dst, value)); ids are dense from 0, by name.

    Names are numbered by range partitions and their counts, so no task holds all.
    """
    value = value if value is not None else F.lit(1)
    edges = df.groupBy(source.cast("string").alias("s"), target.cast("string").alias("t")).agg(F.sum(value).alias("value")).filter("s IS NOT NULL AND t IS NOT NULL")
    g = group if group is not None else F.lit(0)
    names = df.select(F.explode(F.array(F.struct(source.cast("string").alias("name"), g.alias("group")), F.struct(target.cast("string").alias("name"), g.alias("group")))).alias("x")).select("x.*").filter("name IS NOT NULL").groupBy("name").agg(F.min("group").alias("group"))
    nodes = dense_ids(names, "name")
    a, b = nodes.select(F.col("name").alias("s"), F.col("id").alias("src")), nodes.select(F.col("name").alias("t"), F.col("id").alias("dst"))
    return nodes, edges.join(a, "s").join(b, "t").select("src", "dst", "value")


def dense_ids(df: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """Rows numbered from 0 by a unique key.

    One job finds the least key and the count of each sorted range, a row a
    partition; these bounds, which hold for any later run, then deal the rows,
    which are numbered within their range and offset by the counts before it.
    """
    from pyspark.sql.window import Window

    ranged = df.select(key).repartitionByRange(key)
    found = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("least"), F.count("*").alias("n"))
    bounds = sorted((r["least"], r["n"]) for r in found.collect())
    if not bounds:
        return df.select(F.lit(0).cast("bigint").alias(id_column), *df.columns)
    starts = [sum(n for _, n in bounds[:k]) for k in range(len(bounds))]
    least = F.array(*(F.lit(b) for b, _ in bounds))
    # the number of the range: bounds are ascending
    part = F.size(F.filter(least, lambda b: b <= F.col(key)))
    offset = F.element_at(F.array(*(F.lit(s).cast("bigint") for s in starts)), F.col("_part"))
    numbered = df.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(key)).cast("bigint"))
    return numbered.withColumn("_part", offset).select((F.col("_part") + F.col("_k") - 1).alias(id_column), *df.columns)


def stackgraph(df: DataFrame, key: Column, label: Column, value: Column) -> DataFrame:
    """(key, values [(label, value)] by label, magnitude)."""
    summed = df.groupBy(key.alias("key"), label.alias("label")).agg(F.sum(value).alias("value"))
    rows = summed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("label", "value"))).alias("values"), F.sum("value").alias("magnitude"))
    return rows


def pointmap(df: DataFrame, lat: Column, lon: Column, metadata: dict[str, Column], fence: Sequence[float] = (0, 0, 0, 0)) -> DataFrame:
    """(lat, long, metadata) of points inside the fence (south, west, north, east)."""
    rows = df.select(lat.cast("double").alias("lat"), lon.cast("double").alias("long"), F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in metadata.items())).alias("metadata"))
    return rows.filter(geofence(F.col("lat"), F.col("long"), *fence))


def heatmap(df: DataFrame, lat: Column, lon: Column, value: Column, fence: Sequence[float] = (0, 0, 0, 0)) -> DataFrame:
    """(lat, long, magnitude) inside the fence."""
    rows = df.groupBy(lat.cast("double").alias("lat"), lon.cast("double").alias("long")).agg(F.sum(value).alias("magnitude"))
    return rows.filter(geofence(F.col("lat"), F.col("long"), *fence))


def point_to_point(df: DataFrame, source: tuple[Column, Column], target: tuple[Column, Column], value: Column, fence: Sequence[float] = (0, 0, 0, 0)) -> DataFrame:
    """(src_lat, src_long, dst_lat, dst_long, magnitude) with an end inside the fence."""
    cols = [c.cast("double").alias(n) for c, n in zip((*source, *target), ("src_lat", "src_long", "dst_lat", "dst_long"), strict=True)]
    rows = df.groupBy(*cols).agg(F.sum(value).alias("magnitude"))
    return rows.filter(geofence(F.col("src_lat"), F.col("src_long"), *fence) | geofence(F.col("dst_lat"), F.col("dst_long"), *fence))


def explore(df: DataFrame) -> DataFrame:
    """Entries with the words of their payload: (start, text), starts from 0; one pass carries the offset along."""
    words, gaps = F.regexp_extract_all(text(), F.lit(r"\S+"), F.lit(0)), F.split(text(), r"\S+", -1)
    none = F.array().cast("array<struct<start: int, text: string>>")
    add = lambda a, x: F.struct((a["at"] + F.length(x["gap"]) + F.length(x["word"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("start"), x["word"].alias("text")))).alias("out"))
    pairs = F.transform("_w", lambda w, k: F.struct(F.get(F.col("_g"), k).alias("gap"), w.alias("word")))
    out = df.withColumns({"_w": words, "_g": gaps})
    return out.select("ts", "tag", "data", F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda a: a["out"]).alias("elements"))


def text_lines(df: DataFrame) -> DataFrame:
    """One string column, as a text file takes it."""
    return df.select(text().alias("value"))
