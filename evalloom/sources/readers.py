"""Datasets, evaluation items, instructions, result tables and adapter settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.core import or_empty, strip_ws
from evalloom.operators.splits import check_splits, split_condition, with_file_position
from evalloom.sources.csvfiles import read_tables

# Question and answer fields of the two evaluation files, and the adapter file name.
EVAL_FIELDS = {"gsm8k": ("query", "response"), "math": ("instruction", "output")}
ADAPTER_FILE = "adapter_config.json"


def load_dataset(
    spark: SparkSession,
    name: str | None,
    subset: str | None = None,
    fmt: str = "parquet",
    data_files: str | Sequence[str] | Mapping[str, str | Sequence[str]] | None = None,
    data_dir: str | None = None,
    cache_dir: str | None = None,
    streaming: bool = False,
    keep_in_memory: bool = False,
    schema: str | T.StructType | None = None,
    **options,
) -> DataFrame:
    """A dataset as one frame; a mapping of split names to files adds a ``split`` column.

    Without files the path is ``[data_dir/]name[/subset]``. ``cache_dir`` writes the rows
    there as parquet and reads them back. Options that are None are dropped.
    """
    if not name:
        raise ValueError("dataset name is required")
    given = {k: v for k, v in options.items() if v is not None}

    def read(paths: str | Sequence[str]) -> DataFrame:
        reader = (spark.readStream if streaming else spark.read).format(fmt).options(**given)
        reader = reader.schema(schema) if schema is not None else reader
        if streaming and not isinstance(paths, str):
            raise ValueError("a stream reads one path")
        return reader.load(paths if isinstance(paths, str) else list(paths))

    under = lambda path: f"{data_dir.rstrip('/')}/{path}" if data_dir else path
    if isinstance(data_files, Mapping):
        parts = [read(paths).withColumn("split", F.lit(split)) for split, paths in data_files.items()]
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part, allowMissingColumns=True)
    else:
        df = read(data_files or under(f"{name}/{subset}" if subset else name))
    if cache_dir and not streaming:
        target = f"{cache_dir.rstrip('/')}/{name.replace('/', '-')}{'_' + subset if subset else ''}"
        df.write.mode("overwrite").parquet(target)
        df = spark.read.parquet(target)
    if keep_in_memory and not streaming:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def load_splits(
    df: DataFrame,
    train_split: str = "train",
    eval_split: str | None = None,
    test_split: str | None = None,
    order: str = "idx",
) -> DataFrame:
    """Configured splits of an indexed dataset in one frame, ``split`` naming each; ``train`` is always there."""
    chosen = {"train": train_split, "validation": eval_split, "test": test_split}
    found = {split: split_condition(df, expr, order) for split, expr in chosen.items() if split == "train" or expr}
    asked = {split: end for split, (_, _, end) in found.items() if end is not None}
    if asked:
        # All ends are checked in one read of the index.
        last = df.agg(*[F.max(F.when(found[split][1], F.col(order))).alias(split) for split in asked]).first()
        for split, end in asked.items():
            if last[split] is None or end > last[split] + 1:
                raise IndexError(f"{chosen[split]!r} reaches past {0 if last[split] is None else last[split] + 1} rows")
    # One read for all splits; a row in several of them comes once for each.
    any_of = F.lit(False)
    for inside, _, _ in found.values():
        any_of = any_of | inside
    names = F.array_compact(F.array(*[F.when(inside, F.lit(split)) for split, (inside, _, _) in found.items()]))
    others = [c for c in df.columns if c != "split"]
    return df.filter(any_of).select(*others, F.explode(names).alias("split"))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one fails the job."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("allowSingleQuotes", "false")
    return reader.json(path if isinstance(path, str) else list(path))


def read_eval_items(spark: SparkSession, split: str, path: str) -> DataFrame:
    """Evaluation items (idx, split, instruction, reference) of one split; missing fields are empty."""
    check_splits([split], EVAL_FIELDS)
    question, answer = EVAL_FIELDS[split]
    rows = with_file_position(read_jsonl(spark, path, f"{question} string, {answer} string"))
    return rows.select(
        "idx",
        F.lit(split).alias("split"),
        or_empty(F.col(question)).alias("instruction"),
        or_empty(F.col(answer)).alias("reference"),
    )


def read_instructions(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """One instruction per non-blank line, or a single given text as it is."""
    if text is not None:
        return spark.createDataFrame([(text,)], "instruction string")
    if path is None:
        raise ValueError("either a text or a path is needed")
    lines = spark.read.text(path).select(strip_ws(F.col("value")).alias("instruction"))
    return lines.filter(F.col("instruction") != "")


# --- result tables ----------------------------------------------------------------------------------------


def scan_results(spark: SparkSession, roots: Sequence[str], glob: str = "*results.csv") -> DataFrame:
    """Files (source_path, length) matching a name pattern under files or folders, each once.

    Only the listing is read, in which Spark leaves out files of no length. A root that does
    not exist or no match at all is an error.
    """
    roots = list(dict.fromkeys(r.rstrip("/") if len(r) > 1 else r for r in roots))
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(roots)
        .select(F.col("path").alias("source_path"), "length")
        .dropDuplicates(["source_path"])
    )
    if listing.isEmpty():
        raise ValueError(f"no file named {glob} under {roots}")
    return listing


def scan_averages(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    return scan_results(spark, roots, "*_results_avg.csv")


def read_result_csv(spark: SparkSession, files: DataFrame | Sequence[str]) -> DataFrame:
    """All rows as text, with ``source_path`` and the row position ``row_order``.

    One scan whatever the headers: columns are matched by name. Cells may hold line breaks. An empty file is an error.
    :func:`read_results_under` does the same for roots, without a list of paths.
    """
    paths = [r[0] for r in files.select("source_path").collect()] if isinstance(files, DataFrame) else list(files)
    if not paths:
        raise ValueError("no result files given")
    rows, headers = read_tables(spark, paths)
    if headers < len(paths):
        raise ValueError("empty result file (no header)")
    return rows


def read_results_under(spark: SparkSession, roots: Sequence[str], glob: str = "*results.csv") -> DataFrame:
    """Rows of all files of :func:`scan_results`, as :func:`read_result_csv` gives them."""
    roots = [r.rstrip("/") if len(r) > 1 else r for r in roots]
    # A root below another one would be read twice.
    apart = sorted({r for r in roots if not any(r.startswith(other + "/") for other in roots)})
    listing = scan_results(spark, apart, glob)
    rows, headers = read_tables(spark, apart, recursiveFileLookup="true", pathGlobFilter=glob)
    if headers < len(listing._jdf.inputFiles()):
        raise ValueError(f"empty result file (no header) under {apart}")
    return rows


def read_averages_under(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    return read_results_under(spark, roots, "*_results_avg.csv")


# --- adapters ---------------------------------------------------------------------------------------------


def scan_adapters(spark: SparkSession, root: str) -> DataFrame:
    """Folders under ``root`` as (adapter_path, kept): kept where they hold adapter settings.

    Works on the file listing, so a folder without any file is not seen.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    below = files.select(F.substring_index(F.col("path"), base + "/", -1).alias("rest"), "path")
    inside = below.filter(F.contains("rest", F.lit("/"))).select(
        F.concat(F.lit(base + "/"), F.substring_index("rest", "/", 1)).alias("adapter_path"),
        (F.col("rest") == F.concat(F.substring_index("rest", "/", 1), F.lit("/" + ADAPTER_FILE))).alias("hit"),
    )
    return inside.groupBy("adapter_path").agg(F.bool_or("hit").alias("kept"))


def read_adapters(spark: SparkSession, root: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Adapter settings (adapter_path, adapter struct) of all adapter folders below ``root``."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", ADAPTER_FILE)
    rows = (reader.schema(schema) if schema is not None else reader).json(root)
    path = F.regexp_replace(F.regexp_replace("_metadata.file_path", r"\Afile:/*", "/"), "/[^/]*\\z", "")
    return rows.select(path.alias("adapter_path"), F.struct(*rows.columns).alias("adapter"))


def adapter_rank(adapters: DataFrame) -> DataFrame:
    """Add ``rank``; settings without ``r`` fail the job."""
    missing = F.concat(F.lit("no rank 'r' in "), "adapter_path")
    if "r" not in adapters.schema["adapter"].dataType.fieldNames():
        return adapters.withColumn("rank", F.raise_error(missing).cast("int"))
    rank = F.col("adapter.r").cast("int")
    return adapters.withColumn("rank", F.coalesce(rank, F.raise_error(missing).cast("int")))
