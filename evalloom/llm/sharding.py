"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table: start at
``offset`` and step by ``skip``, both from the shard's name. Shards take turns, each claiming its
next preferred slot that is free, until the table is full. A key hashes to a slot and the slot
names the shard: constant time per row, nearly equal shares, and few moves when shards change.

The table is a parameter's size (``slots``), never the data's, which bounds its broadcast.

Defined cases: rows are kept whole, each with exactly one shard; equal keys share a slot; a null
key column counts as its own value; an empty table stays empty; columns of the input are kept,
and one of them may not be called like an added column (an error says so).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime well above a hundred times the shard counts in use, so that shares differ by under one percent.
SLOTS = 65537
SLOTS_MAX = 1 << 22


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Shard number of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if not _is_prime(slots) or slots < len(shards) or slots > SLOTS_MAX:
        raise ValueError(f"slots must be a prime from the number of shards to {SLOTS_MAX}")
    steps = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
        steps.append([offset, skip])
    table, free = [-1] * slots, slots
    while free:
        for shard, step in enumerate(steps):
            while table[step[0]] >= 0:
                step[0] = (step[0] + step[1]) % slots
            table[step[0]] = shard
            free -= 1
            if not free:
                break
    return table


def slot_of(keys: Sequence[Column], slots: int = SLOTS) -> Column:
    """Slot of a row. Nulls are marked, since the hash alone would skip them."""
    marked = [c for k in keys for c in (k.isNull(), k)]
    return F.pmod(F.xxhash64(*marked), F.lit(slots)).cast("int")


def assign(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` (the shard's number). One broadcast join, no shuffle of ``df``."""
    if taken := {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} exist already")
    spark: SparkSession = df.sparkSession
    rows = [(slot, shard) for slot, shard in enumerate(fill_table(shards, slots))]
    table = spark.createDataFrame(rows, "slot int, shard int")
    keyed = df.withColumn("slot", slot_of([F.col(f"`{k}`") for k in keys], slots))
    # At most SLOTS_MAX rows of eight bytes. A slot is never null, so the join keeps every row.
    return keyed.join(F.broadcast(table), "slot").select(*[keyed[f"`{c}`"] for c in df.columns], "slot", "shard")


def write_shards(
    df: DataFrame, path: str, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, files_per_shard: int = 1
) -> None:
    """Write ``path/shard=<n>/``, each shard in up to ``files_per_shard`` files.

    A shard is spread over its files by its rows' own content, so a hot key (all of whose rows
    belong to one shard) still becomes several tasks.
    """
    placed = assign(df, keys, shards, slots)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id()), F.lit(files_per_shard))
    spread = spread if files_per_shard > 1 else F.lit(0)
    placed.withColumn("_file", spread).repartition(len(shards) * files_per_shard, "shard", "_file").drop("_file").write.partitionBy(
        "shard"
    ).parquet(path)


def shard_sizes(placed: DataFrame, size: Column | None = None) -> DataFrame:
    """(shard, n_rows, n_bytes): how even a placement is."""
    size = F.lit(0) if size is None else size
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).cast("long").alias("n_bytes"))
