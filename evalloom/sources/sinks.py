"""Writers for graded records, metrics, results, averages, predictions and run manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.grade import RECORD_COLUMNS, accuracy
from evalloom.operators.leaderboard import SOURCE, as_text_table
from evalloom.operators.results import append_rows
from evalloom.sources.readers import read_result_csv
from evalloom.sources.scratch import remove, scratch, settle

FOLDER = "split_dir"


def _write_by_split(df: DataFrame, path: str) -> None:
    """JSON lines in idx order, one folder per split; the ``split`` field stays in the records."""
    (
        df.withColumn(FOLDER, F.col("split"))
        .repartitionByRange(FOLDER, "idx")
        .sortWithinPartitions(FOLDER, "idx")
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .partitionBy(FOLDER)
        .json(path)
    )


def write_predictions(graded: DataFrame, folder: str) -> None:
    _write_by_split(graded.select(*RECORD_COLUMNS), f"{folder}/predictions")


def write_debug(graded: DataFrame, folder: str) -> None:
    """Records of ``grade(..., debug=True)`` with their nested judge record."""
    columns = ["idx", "split", "prompt", "instruction", "reference", "prediction_raw", "prediction", "judge", "correct"]
    _write_by_split(graded.select(*columns), f"{folder}/debug")


def write_metrics(graded: DataFrame, folder: str) -> None:
    """Accuracy and total of every split."""
    (
        accuracy(graded, ["split"])
        .withColumnRenamed("split", FOLDER)
        .write.mode("overwrite")
        .partitionBy(FOLDER)
        .json(f"{folder}/metrics")
    )


def append_results(new: DataFrame, path: str) -> None:
    """Append result rows to a parquet table. Old files are not touched, so writers may run side by side."""
    new.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result table with the columns of every append; cells a row lacks are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def append_result_csv(spark: SparkSession, old: str, new: DataFrame, out: str) -> None:
    """Old CSV rows and new ones under the extended header, written to a new path."""
    before = read_result_csv(spark, [old]).drop("source_path", "row_order")
    write_csv(append_rows(before, as_text_table(new)), out)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV files with a header; quotes are doubled, white space at the ends of cells stays."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_avg(df: DataFrame, out: str) -> None:
    """Averages as CSV, one folder per source file where there are several. No rows is an error."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    write_csv(as_text_table(df), out, SOURCE if SOURCE in df.columns else None)


def average_path(source: str) -> str:
    """``…/x_results.csv`` to ``…/x_results_avg.csv``."""
    folder, slash, name = source.rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{folder}{slash}{stem}_avg.csv"


def average_path_of(source: Column) -> Column:
    """Column form of :func:`average_path`; the escapes of a file's URI are undone."""
    plain = F.when(source.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:/"), F.url_decode(F.replace(source, F.lit("+"), F.lit("%2B")))).otherwise(source)
    return F.concat(F.regexp_replace(plain, r"([^/])\.[^./]*\z", "$1"), F.lit("_avg.csv"))


def write_json(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_named(df: DataFrame, write: Callable[[DataFrame, str, str], None] = write_csv, target: str = "target") -> int:
    """Write the rows of each ``target`` to the file of that name, in their order; returns the number of files.

    ``write`` puts rows into folders by a column, :func:`write_csv` or :func:`write_json`.

    Files are finished in the shared folder first, one task per file. Then each is copied next to its target under a hidden
    name and renamed over it, so that a reader sees the old file or the new one, and a run that
    stopped half-way is simply repeated. The driver walks the finished files one by one.
    """
    spark = df.sparkSession
    stage = scratch(spark)
    others = [c for c in df.columns if c != target]
    keyed = df.withColumn("_o", F.monotonically_increasing_id()).withColumn("_g", F.md5(F.col(target)))
    # The order and the rows are written once: the same plan may not give the same order twice.
    rows = settle(keyed)
    files = rows.repartition("_g").sortWithinPartitions("_g", "_o").select("_g", *others)
    write(files, stage, "_g")
    written = 0
    for row in rows.groupBy("_g").agg(F.first(target).alias("target")).toLocalIterator():
        _put_in_place(spark, f"{stage}/_g={row['_g']}", row["target"])
        written += 1
    remove(spark, stage)
    return written


def _put_in_place(spark: SparkSession, folder: str, target: str) -> None:
    """Move the single part file of a folder over ``target``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    parts = fs.Path(folder + "/part-*")
    store = parts.getFileSystem(conf)
    found = store.globStatus(parts)
    if len(found) != 1:
        raise RuntimeError(f"{len(found)} finished files for {target}")
    wanted = fs.Path(target)
    hidden = fs.Path(wanted.getParent(), f".{wanted.getName()}.{uuid.uuid4().hex}")
    home = hidden.getFileSystem(conf)
    try:
        fs.FileUtil.copy(store, found[0].getPath(), home, hidden, False, conf)
        over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        over[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(home.getUri(), conf).rename(hidden, wanted, over)
    finally:
        home.delete(hidden, False)


def write_avg_beside(df: DataFrame) -> int:
    """Averages of every source file as ``<stem>_avg.csv`` beside it; returns the number of files. No rows is an error.

    ``df`` has the column ``source_path``. Sources whose averages would share a file are an error.
    """
    rows = settle(as_text_table(df).withColumn("target", average_path_of(F.col(SOURCE))))
    sources, targets = rows.agg(F.count_distinct(SOURCE), F.count_distinct("target")).first()
    if not targets:
        raise ValueError("no rows to write")
    if sources > targets:
        raise ValueError(f"{sources} sources would share {targets} files of averages")
    return write_named(rows.drop(SOURCE))


def write_inference(df: DataFrame, path: str) -> None:
    df.select("instruction", "prediction").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(runs: DataFrame, path: str) -> None:
    """Run settings with total minutes and seconds per step (from ``seconds`` and ``steps``)."""
    timed = runs.withColumn("total_training_time", F.col("seconds") / 60.0).withColumn(
        "training_time_per_step_sec", F.try_divide("seconds", "steps")
    )
    timed.drop("seconds", "steps").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
