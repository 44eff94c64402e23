"""Step logs: turning points, jumps, best and newest checkpoints, early stopping, cadence.

A log is long: (run, step, value), with ``grp`` for parameter groups and ``name`` for metric names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.ranges import add_range, lookup, previous_rows, running_before


def _groups(log: DataFrame) -> list[str]:
    return ["run", *(["grp"] if "grp" in log.columns else [])]


def turning_points(log: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Steps (run, step) where a value that was not rising starts to rise, in any parameter group."""
    lagged = previous_rows(log, _groups(log), "step", "value", 2)
    rises = F.col("value") - F.col("value_lag1") > eps
    flat_before = F.col("value_lag1") - F.col("value_lag2") <= eps
    return lagged.filter(rises & flat_before).select("run", "step").distinct()


def value_jumps(log: DataFrame, warmup: int, rel: float = 1e-12) -> DataFrame:
    """Steps (run, step) after warm-up whose value exceeds the one before, in any parameter group."""
    lagged = previous_rows(log, _groups(log), "step", "value", 1)
    jump = (F.col("step") > warmup) & (F.col("value") > F.col("value_lag1") * (1.0 + rel))
    return lagged.filter(jump).select("run", "step").distinct()


def _of_metric(log: DataFrame, metric: str | None) -> DataFrame:
    return log if metric is None else log.filter(F.col("name") == metric)


def best_checkpoint(log: DataFrame, metric: str | None, greater: bool = True) -> DataFrame:
    """Best step per run, the earliest on ties, as (run, step, value)."""
    rows = _of_metric(log, metric).filter(F.col("value").isNotNull())
    signed = F.col("value") if greater else -F.col("value")
    top = F.max(F.struct(signed.alias("v"), (-F.col("step")).alias("s"), F.col("value").alias("value")))
    return rows.groupBy("run").agg(top.alias("_top")).select(
        "run", (-F.col("_top.s")).alias("step"), F.col("_top.value").alias("value")
    )


def keep_last_n(checkpoints: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of every run (one row per run and step).

    Counted off in step ranges, the same way for every ``n``. Rows without a step are the oldest.
    """
    columns = checkpoints.columns
    last = F.lit((1 << 63) - 1) if checkpoints.schema["step"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.lit(float("inf"))
    counted = checkpoints.withColumn("_back", F.coalesce(-F.col("step"), last)).withColumn("_one", F.lit(1))
    return running_before(counted, ["run"], "_back", "_one", "_newer").filter(F.col("_newer") < n).select(*columns)


def early_stop(log: DataFrame, metric: str | None, patience: int, greater: bool = True) -> DataFrame:
    """(run, stop_step): first step with ``patience`` evaluations since the best one, null if there is none.

    The running best is a maximum over (value, minus position), so equal values do not
    count as better. Runs too large for one task are cut into step ranges, each of which
    starts with one row that stands for the rows before it.
    """
    rows = _of_metric(log, metric).filter(F.col("value").isNotNull())
    signed = F.col("value") if greater else -F.col("value")
    ranged = add_range(rows.select("run", "step", signed.alias("_v")), ["run"], "step")
    cut = ranged.filter("_range_cut")
    at = F.row_number().over(W.partitionBy("run", "_range").orderBy("step")).cast("long")
    top = F.max(F.struct(F.col("_v").alias("v"), (-F.col("_rn")).alias("at")))
    earlier = W.partitionBy("run").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    heads = (
        cut.withColumn("_rn", at)
        .groupBy("run", "_range")
        .agg(F.count("*").alias("_n"), top.alias("_top"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_top", F.struct(F.col("_top.v").alias("v"), (F.col("_top.at") - F.col("_before")).alias("at")))
        .select("run", "_range", F.col("_before").alias("_count"), F.max("_top").over(earlier).alias("_top"))
        .filter(F.col("_top").isNotNull())
    )
    both = ranged.withColumn("_count", F.lit(1).cast("long")).unionByName(heads, allowMissingColumns=True)
    # The head row has no step and therefore comes first.
    upto = W.partitionBy("run", "_range").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = both.withColumn("_pos", F.sum("_count").over(upto))
    here = F.coalesce("_top", F.struct(F.col("_v").alias("v"), (-F.col("_pos")).alias("at")))
    waited = placed.select("run", "step", (F.col("_pos") + F.max(here).over(upto)["at"]).alias("_since"))
    return (
        waited.filter(F.col("step").isNotNull())
        .groupBy("run")
        .agg(F.min(F.when(F.col("_since") >= patience, F.col("step"))).alias("stop_step"))
    )


def cadence(log: DataFrame, every: int, warmup: int = 0, cooldown: int = 0) -> DataFrame:
    """Rows at every ``every``-th step between warm-up and the last ``cooldown`` steps.

    The run length is ``max_steps`` where the log has it, else its highest step.
    """
    due = (F.col("step") >= every) & (F.pmod(F.col("step"), F.lit(every)) == 0) & (F.col("step") >= warmup)
    if "max_steps" in log.columns:
        return log.filter(due & (F.col("step") <= F.col("max_steps") - cooldown))
    lengths = log.groupBy("run").agg(F.max("step").alias("_max"), F.count("*").alias("_n"))
    return (
        lookup(log, lengths, ["run"], "_n").filter(due & (F.col("step") <= F.col("_max") - cooldown)).drop("_max")
    )


def run_rates(runs: DataFrame) -> DataFrame:
    """Minutes, seconds per step and rows per second from ``seconds``, ``steps`` and ``samples``."""
    out = runs.withColumn("minutes", F.col("seconds") / 60.0).withColumn(
        "sec_per_step", F.try_divide(F.col("seconds"), F.col("steps"))
    )
    return out.withColumn("steps_per_sec", F.try_divide(F.col("steps"), F.col("seconds"))).withColumn(
        "samples_per_sec", F.try_divide(F.col("samples"), F.col("seconds"))
    )
