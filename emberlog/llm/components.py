"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import weighed_join
from .store import discard, passed_on, written

#: Rows of edges a task, and tasks of a round at least: rounds of few edges need not write many small files.
EDGES_A_TASK, LEAST_TASKS = 200_000, 48


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of ``links`` that is not the least of its component: (node, root), the root being the least.

    Every round ends in a table of the shared folder, and the round's before it
    goes.  Joins are on a node with one row on one side; the edges of a hub stay
    where they are (:func:`weighed_join`), and its neighbours are never gathered.
    Rounds go on until nothing moves, about as often as the logarithm of the longest path.
    """
    edges = written(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(), "star")
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in count():
        total = edges.count()
        tasks = min(n, max(LEAST_TASKS, total // EDGES_A_TASK))
        # large star: whoever hangs on a node that has a lesser neighbour moves to that neighbour
        ends = F.array(F.struct(F.col("hi").alias("_at"), F.col("lo").alias("m"), F.lit(0).alias("d")), F.struct(F.col("lo").alias("_at"), F.lit(None).cast("long").alias("m"), F.lit(1).alias("d")))
        both = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("_at").agg(F.min("m").alias("_m"), F.sum("d").alias("_d"))
        large = weighed_join(edges, both.filter("_d > 0"), ("lo", "_at"), "_d", total)
        large = large.select("hi", F.coalesce("_m", "lo").alias("lo"), F.col("_m").isNotNull().cast("int").alias("moved"))
        large = written(large.groupBy("hi", "lo").agg(F.max("moved").alias("moved")).coalesce(tasks), "star")
        discard(edges)
        # small star: a node with several lesser neighbours ties them to the least
        low = large.groupBy("hi").agg(F.min("lo").alias("_m"), F.count("*").alias("_n")).withColumnRenamed("hi", "_at")
        left = large.filter("moved = 1").select(F.lit(1)).union(low.filter("_n > 1").select(F.lit(1)))
        if left.isEmpty():
            return passed_on(large, large.select(F.col("hi").alias("node"), F.col("lo").alias("root")))
        joined = weighed_join(large, low, ("hi", "_at"), "_n", total)
        small = joined.select(F.explode(F.array(F.struct(F.col("hi"), F.col("_m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("_m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        edges = written(small.filter("hi <> lo").distinct().coalesce(tasks), "star")
        discard(large)
