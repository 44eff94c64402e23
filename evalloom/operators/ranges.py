"""Positional work over very large or very uneven groups.

Spark runs one window group in one task. A run, user or layer that holds a third
of all rows would therefore be one task. These helpers cut such groups into
ordered ranges, do the window inside a range, and bring in what earlier ranges
add (a sum, the last rows) as a few extra rows at the head of each range. The
range borders only balance the load: any borders give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.sources.scratch import settle

MAX_RANGES = 4096
HEAVY_SHARE = 10_000
#: A table of ranges goes to all tasks while it cannot have more rows.
SENT_ROWS = 100_000


def range_count(spark: SparkSession) -> int:
    """A power of two near the session's shuffle partitions, between 8 and 4096."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    count = 8
    while count < min(wanted, MAX_RANGES):
        count *= 2
    return count


def _borders(values: dict[str, str], count: int) -> Column:
    """Struct of ascending approximate quantiles, ``count - 1`` of each numeric column."""
    shares = [i / count for i in range(1, count)]
    return F.struct(*[F.percentile_approx(c, shares, 10 * count).alias(n) for n, c in values.items()])


def _place(df: DataFrame, value: str, borders: Column, count: int, name: str) -> DataFrame:
    """Add the number of borders at or below a value: a binary search, one select per halving."""
    df = df.withColumn(name, F.lit(0))
    for i in range(1, count.bit_length()):
        ahead = F.col(name) + (count >> i)
        reached = F.col(value) >= F.try_element_at(borders, ahead)
        df = df.withColumn(name, F.when(reached, ahead).otherwise(F.col(name)))
    return df


def _same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    out = F.lit(True)
    for name in by:
        out = out & left[name].eqNullSafe(right[name])
    return out


def add_range(df: DataFrame, by: Sequence[str], order: str, name: str = "_range") -> DataFrame:
    """Tag rows with a range of a numeric ``order`` column, higher ranges holding higher values.

    Only groups above one range's share of all rows are cut; there are fewer of them than
    ranges, so their list is broadcast. All other rows get range 0. Without grouping
    columns everything is one group and is cut. ``{name}_cut`` tells rows of cut groups:
    filter by that, since a filter on the range itself would be pushed below the search
    and repeat it many times over.

    Rows without an order value come before all others of their group, as in an ascending
    window: in a cut group they are range 0, which later ranges count in.
    """
    count = range_count(df.sparkSession)
    hot = F.lit(True)
    tagged = df
    if by:
        sizes = settle(df.groupBy(*by).agg(F.count("*").alias("_size")))
        total = sizes.agg(F.sum("_size")).scalar()
        large = settle(
            sizes.withColumn("_total", total).filter(F.col("_size") * count > F.col("_total")).select(*by, F.lit(1).alias("_hot"))
        )
        tagged = df.join(F.broadcast(large), _same(df, large, by), "left").select(*[df[c] for c in df.columns], "_hot")
        hot = F.col("_hot").isNotNull()
    cut = F.when(hot, F.col(order))
    keyed = tagged.withColumn("_is_hot", hot).withColumn("_cut", cut)
    found = keyed.filter(F.col("_cut").isNotNull()).agg(_borders({"b": "_cut"}, count).alias("_b")).scalar()
    placed = _place(keyed.withColumn("_b", found), "_cut", F.col("_b.b"), count, name)
    return placed.select(
        *df.columns,
        F.when(F.col("_cut").isNotNull(), F.col(name) + 1).otherwise(0).alias(name),
        F.col("_is_hot").alias(f"{name}_cut"),
    )


def group_window(by: Sequence[str]) -> W:
    """Window over the rows of a group; callers keep these to a few rows per range."""
    return W.partitionBy(*by) if by else W.partitionBy(F.lit(0))


def global_rank(
    df: DataFrame, primary: Column, tie: Column | None = None, name: str = "rank", order: Sequence[Column] | None = None
) -> DataFrame:
    """Rank from 1 over all rows, ascending by (primary, tie), without a single-task sort.

    ``primary`` and ``tie`` are numeric. A primary value held by many rows gets ranges
    of its own, which are cut further by ``tie``. ``order`` refines the order inside a
    range when the two numbers are only a prefix of the true sort key. ``df`` is read
    three times, twice for the key columns only.
    """
    count = range_count(df.sparkSession)
    keyed = df.withColumn("_p", primary)
    keys = {"p": "_p"}
    if tie is not None:
        keyed = keyed.withColumn("_t", tie)
        keys["t"] = "_t"
    found = keyed.agg(_borders(keys, count).alias("_b")).scalar()
    placed = _place(keyed.withColumn("_b", found), "_p", F.col("_b.p"), count, "_pr")
    if tie is None:
        placed = placed.withColumn("_tr", F.lit(0))
    else:
        own = F.try_element_at("_b.p", F.greatest("_pr", F.lit(1))) == F.col("_p")
        placed = _place(placed.withColumn("_own", F.coalesce(own, F.lit(False))), "_t", F.col("_b.t"), count, "_tr")
        placed = placed.withColumn("_tr", F.when(F.col("_own"), F.col("_tr")).otherwise(0)).withColumn(
            "_pr", F.col("_pr") * 2 - F.col("_own").cast("int")
        )
    placed = placed.drop("_b", "_own")
    # Two levels: rows before a range of the first key, one row per range, then rows before each of its cuts.
    sizes = placed.groupBy("_pr", "_tr").agg(F.count("*").alias("_n"))
    outer = sizes.groupBy("_pr").agg(F.sum("_n").alias("_n")).select(
        "_pr", F.coalesce(F.sum("_n").over(W.orderBy("_pr").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_outer")
    )
    cuts = W.partitionBy("_pr").orderBy("_tr").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.join(outer, "_pr").select("_pr", "_tr", (F.col("_outer") + F.coalesce(F.sum("_n").over(cuts), F.lit(0))).alias("_before"))
    inside = W.partitionBy("_pr", "_tr").orderBy(*(order or [F.col(c) for c in keys.values()]))
    sent = 2 * count * count <= SENT_ROWS
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(before) if sent else before, ["_pr", "_tr"])
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_p", "_t", "_pr", "_tr", "_rn", "_before")
    )


def sorted_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank from 1 over all rows by any sort key, strings with long common prefixes among them.

    Spark samples the key itself for the borders of its range shuffle. Partitions are sorted
    and written, so that counts and positions come from the same rows; what earlier
    partitions hold is one row per partition. ``order`` should be unique: equal keys share a task.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    placed = settle(ranged).withColumn("_part", F.shiftright("_mid", 33))
    before = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
        .select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per range partition: bounded by the setting, not by the data.
    ranked = placed.join(F.broadcast(before), "_part")
    return ranked.withColumn(name, (F.col("_before") + inside + 1).cast("long")).drop("_part", "_mid", "_before")


def running_before(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group with a smaller ``order`` (unique inside a group)."""
    kind = "double" if df.schema[value].dataType.simpleString() in ("double", "float") else "long"
    ranged = add_range(df, by, order).withColumn("_add", F.col(value).cast(kind)).withColumn("_head", F.lit(0))
    earlier = group_window(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    heads = (
        ranged.filter("_range_cut")
        .groupBy(*by, "_range")
        .agg(F.sum("_add").alias("_add"))
        .select(*by, "_range", F.sum("_add").over(earlier).alias("_add"), F.lit(1).alias("_head"))
        .filter(F.col("_add").isNotNull())
    )
    both = ranged.unionByName(heads, allowMissingColumns=True)
    inside = W.partitionBy(*by, "_range").orderBy(F.desc("_head"), order).rowsBetween(W.unboundedPreceding, -1)
    return (
        both.withColumn(name, F.coalesce(F.sum("_add").over(inside), F.lit(0)))
        .filter(F.col("_head") == 0)
        .drop("_range", "_range_cut", "_add", "_head")
    )


def previous_rows(df: DataFrame, by: Sequence[str], order: str, value: str, n: int) -> DataFrame:
    """Add ``{value}_lag1 … {value}_lag{n}`` by ascending ``order``; like ``lag`` per group, for groups of any size."""
    ranged = add_range(df, by, order)
    last = W.partitionBy(*by, "_range").orderBy(F.desc(order))
    # The last n rows of every range, then the last n of all earlier ranges: a few rows per range.
    tails = (
        ranged.filter("_range_cut")
        .select(*by, "_range", F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_row"), order)
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") <= n)
        .groupBy(*by, "_range")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    earlier = group_window(by).orderBy("_range").rowsBetween(-n, -1)
    carried = F.slice(F.reverse(F.flatten(F.collect_list("_rows").over(earlier))), 1, n)
    heads = (
        tails.select(*by, "_range", carried.alias("_carried"))
        .select(*by, "_range", F.explode("_carried").alias("_row"))
        .select(*by, "_range", F.col("_row.o").alias(order), F.col("_row.v").alias(value), F.lit(True).alias("_head"))
    )
    both = ranged.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    inside = W.partitionBy(*by, "_range").orderBy(order)
    # One select, so that all lags share one window operator.
    lags = [F.lag(value, k).over(inside).alias(f"{value}_lag{k}") for k in range(1, n + 1)]
    return both.select("*", *lags).filter(~F.col("_head")).drop("_range", "_range_cut", "_head")


def lookup(
    df: DataFrame, table: DataFrame, on: Sequence[str], weight: str, how: str = "left", stored: bool = False
) -> DataFrame:
    """Join a lookup table (unique on ``on``) whose ``weight`` says how many rows each key stands for.

    Keys above 1/10,000 of all rows, of which there are at most 10,000, are broadcast;
    the others are shuffled. Rows that found a heavy key, and rows with a null in ``on`` (which
    match nothing), are spread by their source partition in that shuffle. A hot key absent from
    the table is left to Spark's adaptive skew join. The table is read three times, so it is
    written out first unless it is ``stored`` already.
    """
    on = list(on)
    table = table if stored else settle(table)
    values = [c for c in table.columns if c not in on and c != weight]
    total = table.agg(F.sum(weight)).scalar()
    weighed = table.withColumn("_total", total)
    is_heavy = F.col(weight) * HEAVY_SHARE > F.col("_total")
    heavy = weighed.filter(is_heavy).select(*on, F.struct(*values, F.lit(1).alias("_hit")).alias("_heavy"))
    rare = weighed.filter(~is_heavy).select(
        *on, F.lit(0).alias("_salt"), F.struct(*values, F.lit(1).alias("_hit")).alias("_rare")
    )
    settled = F.col("_heavy").isNotNull()
    for name in on:
        settled = settled | F.col(name).isNull()
    spread = F.when(settled, 1 + F.spark_partition_id()).otherwise(0)
    joined = df.join(F.broadcast(heavy), on, "left").withColumn("_salt", spread).join(rare, [*on, "_salt"], "left")
    found = F.coalesce("_heavy", "_rare")
    if how == "inner":
        joined = joined.filter(found.isNotNull())
    return joined.select(*df.columns, *[found[v].alias(v) for v in values])
