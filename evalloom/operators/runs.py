"""Run registry: checks, settings, experiment grids and batch plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.names import field, field_type

# Fields every run configuration needs.
REQUIRED_FIELDS = ("model", "peft", "dataset", "training", "model.name_or_path", "dataset.name")


def check_runs(runs: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Add ``failed_rules`` (missing fields, in order) and ``valid``."""
    rules = [
        F.when(F.col(path).isNull() if field_type(runs, path) is not None else F.lit(True), F.lit(path))
        for path in required
    ]
    return runs.withColumn("failed_rules", F.array_compact(F.array(*rules))).withColumn(
        "valid", F.size("failed_rules") == 0
    )


def check_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("passed"),
        F.count_if(~F.col("valid")).alias("failed"),
    )


def merged_settings(base: Column, override: Column) -> Column:
    """Merge maps of dotted setting names; the override wins, also with null.

    A plain override value replaces a whole base section and the other way round.
    """
    base, override = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (base, override))

    def replaced(key: Column) -> Column:
        return F.exists(
            F.map_keys(override),
            lambda o: (o == key)
            | F.startswith(key, F.concat(o, F.lit(".")))
            | F.startswith(o, F.concat(key, F.lit("."))),
        )

    return F.map_concat(F.map_filter(base, lambda k, _: ~replaced(k)), override)


def merge_settings(base: DataFrame, override: DataFrame, on: str) -> DataFrame:
    """Default settings with each run's own on top, both as a map column ``settings``."""
    joined = base.join(override.select(on, F.col("settings").alias("_override")), on, "left")
    return joined.withColumn("settings", merged_settings(F.col("settings"), F.col("_override"))).drop("_override")


def run_grid(seeds: DataFrame, methods: Sequence[str], restart_methods: Sequence[str] = ()) -> DataFrame:
    """Expected runs (seed, init_lora_weights, restart): every method, and the restart variant of some."""
    plans = [F.struct(F.lit(m).alias("init_lora_weights"), F.lit(False).alias("restart")) for m in methods]
    plans += [F.struct(F.lit(m).alias("init_lora_weights"), F.lit(True).alias("restart")) for m in restart_methods]
    return seeds.select("seed").distinct().select("seed", F.inline(F.array(*plans)))


def missing_runs(
    grid: DataFrame, results: DataFrame, on: Sequence[str] = ("seed", "init_lora_weights", "restart")
) -> DataFrame:
    """Grid rows without a result."""
    return grid.join(results.select(*on).distinct(), list(on), "left_anti")


def batch_plan(runs: DataFrame, flag_errors: bool = False) -> DataFrame:
    """Add accumulation steps, real per-device batch, steps and evaluation interval.

    Reads training.per_device_train_batch_size, global_batch_size, num_train_epochs,
    total_eval_times (defaults 8, 8, 3, 50), num_processes and train_rows. A batch that does
    not divide evenly fails the job, or with ``flag_errors`` is named in ``plan_error``.
    """
    per_device = field(runs, "training.per_device_train_batch_size", 8).cast("long")
    whole = field(runs, "training.global_batch_size", 8).cast("long")
    epochs = field(runs, "training.num_train_epochs", 3)
    evals = field(runs, "training.total_eval_times", 50).cast("long")
    processes = field(runs, "num_processes", 1).cast("long")
    div = lambda a, b: F.floor(F.try_divide(a, b)).cast("long")
    staged = runs.withColumn("_share", div(whole, processes))
    one_pass = F.col("_share") <= per_device
    accumulation = F.when(one_pass, F.lit(1)).otherwise(div(whole, per_device * processes)).cast("long")
    device_batch = F.when(one_pass, F.col("_share")).otherwise(per_device)
    staged = staged.withColumn("gradient_accumulation_steps", accumulation).withColumn(
        "real_per_device_train_batch_size", device_batch
    )
    error = (
        F.when(F.pmod(whole, processes) != 0, "global batch does not divide by the processes")
        .when(
            ~one_pass & (whole != per_device * F.col("gradient_accumulation_steps") * processes),
            "global batch is no multiple of the device batch",
        )
        .cast("string")
    )
    planned = (
        staged.withColumn("max_steps", div(epochs * F.col("train_rows"), whole))
        .withColumn("eval_steps", div(F.col("max_steps"), evals))
        .withColumn("plan_error", error)
        .drop("_share")
    )
    if flag_errors:
        return planned
    checked = F.when(F.col("plan_error").isNotNull(), F.raise_error(F.col("plan_error")).cast("long"))
    return planned.withColumn("max_steps", F.coalesce(checked, F.col("max_steps"))).drop("plan_error")


def global_batch_size(runs: DataFrame) -> Column:
    """The configured global batch, else device batch times accumulation times processes."""
    product = (
        field(runs, "training.per_device_train_batch_size", 8).cast("long")
        * field(runs, "training.gradient_accumulation_steps", 1).cast("long")
        * field(runs, "num_processes", 1).cast("long")
    )
    return F.coalesce(field(runs, "training.global_batch_size").cast("long"), product)
