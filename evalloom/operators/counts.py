"""Work on counts of distinct values, with a short way where they are few."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.ranges import lookup, running_before

#: Up to so many rows of numbers a table goes to all tasks, or through one plain window: some tens of megabytes.
FEW = 500_000
#: The same for tables that hold texts.
FEW_TEXTS = 10_000


def lower_rows(counts: DataFrame, by: Sequence[str], value: str, n: str, name: str) -> DataFrame:
    """Add the rows that stand for smaller values of the group, from a written table of counts."""
    if counts.count() > FEW:
        return running_before(counts, by, value, n, name)
    before = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(n).over(before), F.lit(0)))


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Join a table (unique on ``on``; ``weight`` rows each) to ``df``; nulls in ``on`` are equal."""
    keyed = table.select(F.struct(*on).alias("_key"), *[c for c in table.columns if c not in on])
    rows = df.withColumn("_key", F.struct(*on))
    if table.limit(FEW + 1).count() > FEW:
        return lookup(rows, keyed, ["_key"], weight).drop("_key")
    return rows.join(F.broadcast(keyed.drop(weight)), "_key", "left").drop("_key")
