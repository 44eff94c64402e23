"""Connected components of links between numbers, by alternating large-star and small-star rounds.

A table of links that a task holds in some megabytes is no work for rounds: each would be several shuffles of next to
nothing. Its links are merged in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.sources.scratch import settle

#: Up to so many links (16 bytes each) one task merges them; above, no task holds more than its share.
FEW_LINKS = 200_000


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all links of a task; the smaller root of two always stays one."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while above.setdefault(top, top) != top:
            top = above[top]
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            one, two = root(u), root(v)
            above[max(one, two)] = min(one, two)
    nodes = list(above)
    yield pd.DataFrame({"node": nodes, "root": [root(x) for x in nodes]}, dtype="int64")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link to another; ``root`` is the smallest node of its component.

    Up to ``FEW_LINKS`` links are merged in one task. Of more, every round is a few shuffles of the remaining links and is
    written out, so that lineage stays short; the number of rounds grows with the logarithm of the links. Only a count and a
    checksum come to the driver. Hubs are pre-aggregated where they are counted.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = settle(links.filter(F.col(a) != F.col(b)).select(high, low))
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInPandas(_merged, "node long, root long")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select("u", "v", "m")
        edges = settle(
            small.select("u", F.col("m").alias("v")).unionAll(small.filter("v != m").select(F.col("v"), F.col("m"))).distinct()
        )
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
