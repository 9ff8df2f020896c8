"""Joins in which no key's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A broadcast holds fewer keys than this.
HEAVY = 4096


def weighed_join(rows: DataFrame, table: DataFrame, on: tuple[str, str], weight: str | Column, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` where ``rows[on[0]] = table[on[1]]``, a key that is unique in ``table``.

    ``weight`` is a column of ``table``: the rows that have its key, or more, ``total``
    being their sum at least.  Keys of over ``total / HEAVY`` rows are fewer than
    ``HEAVY``, whatever the data: they are broadcast and their rows stay where they
    are.  The others move, none with more than that share.
    """
    left, right = on
    weight = F.col(weight) if isinstance(weight, str) else weight
    heavy = F.broadcast(table.filter(weight > total / HEAVY))
    light = table.filter(~(weight > total / HEAVY))
    here = rows.join(heavy, rows[left] == heavy[right])
    rest = rows.join(F.broadcast(heavy.select(F.col(right).alias("_heavy"))), rows[left] == F.col("_heavy"), "left_anti")
    return here.unionByName(rest.join(light, rest[left] == light[right], how))
