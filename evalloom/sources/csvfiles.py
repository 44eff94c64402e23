"""CSV records of many files with their own headers in one scan, line breaks inside quotes included.

A line starts a record unless an odd number of quotes stands before it in its file. Scanned blocks of a file are
counted apart: one bit per block (odd or even), added up over the blocks before it, says whether a block starts inside
quotes. So files stay splittable, and only lines that are no record of their own are put together.

Quotes open and close cells and are doubled inside them, as CSV writers do; a lone quote inside an unquoted cell is not
told from an opening one. Lines end in a line feed, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.ranges import lookup
from evalloom.sources.scratch import settle

#: Stands for a comma between cells while commas inside quotes are left alone.
BETWEEN = "\x01,\x01"


def _lines(spark: SparkSession, paths: Sequence[str], options: dict[str, str]) -> DataFrame:
    """(value, source_path, block, m, quotes) of every line; ``m`` ascends within a block."""
    lines = spark.read.options(lineSep="\n", **options).text(list(paths))
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("m"),
        (F.length("value") - F.length(F.translate("value", '"', ""))).alias("quotes"),
    )


def csv_records(spark: SparkSession, paths: Sequence[str], **options: str) -> tuple[DataFrame, DataFrame]:
    """Records (source_path, block, m, first, record) of CSV files and a written table (source_path, lines) of the files.

    ``first`` marks a file's first record, its header. A record's ``block`` and ``m`` are those of its first line.
    ``options`` go to the text reader.
    """
    lines = _lines(spark, paths, options)
    blocks = settle(lines.groupBy("source_path", "block").agg(F.sum("quotes").alias("quotes"), F.count(F.lit(1)).alias("lines")))
    # One row per scanned block.
    before = W.partitionBy("source_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    opened = blocks.select("source_path", "block", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("_before"))
    # A group is one scanned block.
    so_far = W.partitionBy("source_path", "block").orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.select(
        "*",
        F.coalesce(F.sum("quotes").over(so_far), F.lit(0)).alias("_inside"),
        (F.count(F.lit(1)).over(so_far) + F.col("block") == 0).alias("first"),
    ).join(opened, ["source_path", "block"])
    depth = F.col("_before") + F.col("_inside")
    # Stored, since headers and rows read both parts: lines are sorted within their blocks once and joined once.
    marked = settle(
        placed.select(
            "source_path", "block", "m", "first", "value", (depth % 2 == 0).alias("starts"), ((depth + F.col("quotes")) % 2 == 0).alias("ends")
        )
    )
    whole = marked.filter("starts AND ends").select("source_path", "block", "m", "first", F.col("value").alias("record"))
    records = whole.unionByName(settle(_joined_lines(marked.filter("NOT (starts AND ends)"))))
    records = records.withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter(F.col("record") != "")
    return records, settle(blocks.groupBy("source_path").agg(F.sum("lines").alias("lines")))


def _joined_lines(parts: DataFrame) -> DataFrame:
    """Records of several lines. A line belongs to the last one before it that starts a record, in its own block or an earlier one."""
    start = F.when(F.col("starts"), F.struct("block", "m", "first"))
    to_here = W.partitionBy("source_path", "block").orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    own = parts.withColumn("_own", F.last(start, ignorenulls=True).over(to_here))
    heads = own.groupBy("source_path", "block").agg(F.max("_own").alias("_last"))
    before = W.partitionBy("source_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = heads.select("source_path", "block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    placed = own.join(carried, ["source_path", "block"]).withColumn("_r", F.coalesce("_own", "_carried"))
    # One record's lines come together: the group is as large as the record.
    lines = F.array_sort(F.collect_list(F.struct("block", "m", "value")))
    grouped = placed.groupBy("source_path", "_r").agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("record"))
    return grouped.select("source_path", "_r.block", "_r.m", "_r.first", "record")


def cells(record: Column) -> Column:
    """Cells of a record; a cell with nothing in it is null, one with two quotes in it is empty."""
    # Between quotes every second piece is inside; commas of the others part cells.
    pieces = F.split(record, '"', -1)
    outside = F.transform(pieces, lambda s, i: F.when(i % 2 == 0, F.replace(s, F.lit(","), F.lit(BETWEEN))).otherwise(s))
    raw = F.split(F.array_join(outside, '"'), BETWEEN, -1)
    quoted = lambda c: F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1)
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(quoted(c), inner(c)).when(c != "", c))


def read_tables(spark: SparkSession, paths: Sequence[str], **options: str) -> tuple[DataFrame, int]:
    """Rows of all files as text, with ``source_path`` and ``row_order``, and the number of files that have a header.

    Columns are the union of all headers' names, in the order first seen over files by path; a column repeated in a
    header counts where it stands last. Where a file has no such column, or a row no such cell, the
    row's cell is null. A header table joined by file says where each column stands, so the plan depends on the number of
    columns alone, not on that of files or headers.
    """
    records, files = csv_records(spark, paths, **options)
    # A row of each file, from tables that may be read in very many pieces: no task for every piece.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    headers = settle(records.filter("first").select("source_path", cells(F.col("record")).alias("names")).coalesce(parts))
    seen = headers.select("source_path", F.posexplode("names").alias("pos", "name")).filter(F.col("name").isNotNull())
    # One row per column of the result.
    names = [r["name"] for r in seen.groupBy("name").agg(F.min(F.struct("source_path", "pos")).alias("at")).orderBy("at").collect()]
    last = lambda name: F.size("names") + 1 - F.array_position(F.reverse("names"), F.lit(name))
    places = F.array(*[F.when(F.array_contains("names", F.lit(n)), last(n)).cast("int") for n in names])
    layout = headers.join(files, "source_path").select("source_path", places.alias("_at"), "lines")
    rows = lookup(records.filter("NOT first"), layout, ["source_path"], "lines").withColumn("_cells", cells(F.col("record")))
    order = F.struct("source_path", F.col("block").alias("file_block_start"), "m").alias("row_order")
    found = [F.try_element_at("_cells", F.col("_at")[i]).alias(name) for i, name in enumerate(names)]
    return rows.select(*found, "source_path", order), headers.count()
