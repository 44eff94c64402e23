"""Split selection, batches, shards, chunks and seeded samples over a stored row index."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.counts import FEW_TEXTS
from evalloom.operators.ranges import global_rank, sorted_rank
from evalloom.sources.scratch import settle

SPLIT_PATTERN = re.compile(r"\A(?P<name>[^\[]*)(?:\[(?P<range>.*?)\]*)?\Z", re.S)


def with_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Positions 0, 1, 2 … by a unique key, a number or a string (in byte order)."""
    if df.schema[key].dataType.simpleString() == "string":
        ranked = sorted_rank(df, [F.col(key)], name)
    else:
        ranked = global_rank(df, F.col(key), name=name)
    return ranked.withColumn(name, F.col(name) - 1)


def with_file_position(df: DataFrame, name: str = "idx") -> DataFrame:
    """Positions 0, 1, 2 … in file and line order of a frame straight from a file reader.

    Needs no sort: each scanned block knows where it starts, so a table with one
    row per block turns positions inside a block into positions overall.
    """
    columns = df.columns
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    in_order = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = settle(
        placed.groupBy("_file", "_block")
        .agg(F.min("_mid").alias("_first"), F.greatest(F.count("*"), F.count(columns[0])).alias("_n"))
        .select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_before"))
    )
    # One row per scanned block: so few that the lines need not be shuffled to meet them.
    few = blocks.count() <= FEW_TEXTS
    return placed.join(F.broadcast(blocks) if few else blocks, ["_file", "_block"]).select(
        *columns, (F.col("_mid") - F.col("_first") + F.col("_before")).alias(name)
    )


def row_total(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return df.agg(F.count("*")).scalar()


def parse_split(expr: str) -> tuple[str, int | None, int | None]:
    """Name and half-open range of ``name``, ``name[a:b]`` or ``name[i]``; no percentages, no negatives."""
    found = SPLIT_PATTERN.match(expr)
    name, span = found["name"], found["range"]
    if span is None:
        return name, None, None
    left, colon, right = span.partition(":")
    if not colon:
        start = int(left)
        end: int | None = start + 1
    else:
        start = int(left) if left else 0
        end = int(right) if right else None
    if start < 0 or (end is not None and end < 0):
        raise ValueError(f"negative position in split expression {expr!r}")
    return name, start, end


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, order: str = "idx") -> DataFrame:
    """Rows with ``start <= idx < end``: a plain filter, so it reaches the scan."""
    kept = df.filter(F.col(order) >= start) if start else df
    return kept if end is None else kept.filter(F.col(order) < end)


def split_condition(df: DataFrame, expr: str | None, order: str = "idx") -> tuple[Column, Column, int | None]:
    """Condition of a split expression, the one of its name alone, and the rows it asks for at least."""
    if expr is None:
        raise ValueError("split expression must be provided")
    name, start, end = parse_split(expr)
    named = F.col("split") == name if "split" in df.columns else F.lit(True)
    inside = named
    if start:
        inside = inside & (F.col(order) >= start)
    if end is not None:
        inside = inside & (F.col(order) < end)
    return inside, named, end if end is not None and end > (start or 0) else None


def split_slice(df: DataFrame, expr: str | None, order: str = "idx", strict: bool = True) -> DataFrame:
    """Rows of a split expression. With a ``split`` column the name selects, else it is ignored.

    ``strict`` reads the highest index once and rejects a range past the end.
    """
    if expr is None:
        raise ValueError("split expression must be provided")
    name, start, end = parse_split(expr)
    if "split" in df.columns:
        df = df.filter(F.col("split") == name)
    if start is None:
        return df
    if strict and end is not None and end > start:
        last = df.agg(F.max(order)).first()[0]
        if last is None or end > last + 1:
            raise IndexError(f"{expr!r} reaches past {0 if last is None else last + 1} rows")
    return slice_rows(df, start, end, order)


def batch_id(df: DataFrame, size: int, order: str = "idx", total: Column | None = None) -> DataFrame:
    """Batches of ``size`` rows, the remainder joining the last one.

    ``total`` may give the row count (see ``row_total``) of a cheaper frame than ``df``.
    """
    if size < 1:
        raise ValueError("batch size must be at least 1")
    last = F.greatest(F.floor(F.col("_total") / size) - 1, F.lit(0))
    return (
        df.withColumn("_total", row_total(df) if total is None else total)
        .withColumn("batch_id", F.least(F.floor(F.col(order) / size), last).cast("long"))
        .drop("_total")
    )


def shard_id(df: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """Round-robin shard of every row."""
    return df.withColumn("shard", F.pmod(F.col(order), F.lit(n)).cast("int"))


def shard_sizes(df: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """Rows per shard, empty shards included."""
    shards = df.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    counts = shard_id(df, n, order).groupBy("shard").agg(F.count("*").alias("rows"))
    return shards.join(counts, "shard", "left").select("shard", F.coalesce("rows", F.lit(0)).alias("rows"))


def even_chunks(df: DataFrame, n: int, order: str = "idx", total: Column | None = None) -> DataFrame:
    """``n`` contiguous chunks, the first ones one row longer; closed form, so nothing is sorted."""
    base, extra = F.floor(F.col("_total") / n), F.pmod(F.col("_total"), F.lit(n))
    in_long = extra * (base + 1)
    pos = F.col(order)
    chunk = F.when(pos < in_long, F.floor(pos / (base + 1))).otherwise(
        extra + F.floor(F.try_divide(pos - in_long, base))
    )
    counted = df.withColumn("_total", row_total(df) if total is None else total)
    return counted.withColumn("chunk", chunk.cast("long")).drop("_total")


def default_seed(seed: int) -> int:
    return 2 * seed + 1


def seeded_sample(df: DataFrame, n: int, seed: int, order: str = "idx") -> DataFrame:
    """The first ``n`` rows of a seeded shuffle, in shuffle order. Too few rows is an error.

    Rows are ordered by the md5 of seed and index. A histogram of the first four hex
    digits tells which of 65,536 slices are wanted, so no more than the sample and one
    slice is shuffled, ranked and sorted.
    """
    keyed = df.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string"))))
    keyed = keyed.withColumn("_slice", F.substr("_key", F.lit(1), F.lit(4)))
    upto = F.sum("_n").over(W.orderBy("_slice"))
    slices = keyed.groupBy("_slice").agg(F.count("*").alias("_n")).withColumn("_upto", upto)
    cut = slices.agg(
        F.min(F.when(F.col("_upto") >= n, F.struct("_slice", (n - F.col("_upto") + F.col("_n")).alias("_rest")))).alias(
            "_cut"
        )
    ).scalar()
    known = F.when(F.col("_cut").isNotNull(), F.col("_cut")).otherwise(
        F.raise_error(F.lit(f"sample of {n} rows is larger than the data")).cast("struct<_slice:string,_rest:bigint>")
    )
    cutting = keyed.withColumn("_cut", cut).withColumn("_cut", known).filter(F.col("_slice") <= F.col("_cut._slice"))
    ranked = W.partitionBy("_slice").orderBy("_key", order)
    inside = (F.col("_slice") < F.col("_cut._slice")) | (F.col("_rn") <= F.col("_cut._rest"))
    sample = cutting.withColumn("_rn", F.row_number().over(ranked)).filter(inside)
    return sample.orderBy("_key", order).drop("_key", "_slice", "_cut", "_rn")


def restore_order(df: DataFrame, order: str = "idx") -> DataFrame:
    return df.orderBy(order)


def ordered_distinct(df: DataFrame, key: str, order: str = "idx") -> DataFrame:
    """Distinct keys in the order they were first seen."""
    return df.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)


def check_splits(requested: Sequence[str], supported: Sequence[str]) -> None:
    unknown = sorted(set(requested) - set(supported))
    if unknown:
        raise ValueError(f"unknown splits {unknown}; supported: {sorted(supported)}")


def parse_splits(value: str) -> list[str]:
    """Names of a comma list; an empty list is an error."""
    names = [part.strip() for part in value.split(",") if part.strip()]
    if not names:
        raise ValueError("splits must be a comma-separated list, e.g. gsm8k,math")
    return names


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """Apply a function to pandas batches; it may drop or add rows."""
    return df.mapInPandas(lambda frames: (fn(frame) for frame in frames), schema)


def union_shards(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def name_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def keep_keys(a: DataFrame, b: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of ``a`` whose key is in ``b``."""
    return a.join(b, on, "left_semi")


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)
