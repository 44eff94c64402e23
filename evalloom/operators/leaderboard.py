"""Mean, deviation and count per configuration; macro mean over datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.core import or_empty, strip_ws
from evalloom.functions.formats import format_10g
from evalloom.sources.scratch import settle

# Default key columns, in order.
LEADERBOARD_KEYS = ("base_model", "dataset_name", "init_lora_weights", "extra", "r", "lora_alpha")
MACRO_KEYS = ("base_model", "init_lora_weights", "extra", "r", "lora_alpha")
SOURCE = "source_path"
#: A cast alone would also read a type suffix, as in ``1d``.
NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf|infinity)$"


def clean_key(name: str) -> Column:
    """Key cell: null is empty, white space around it does not count."""
    return strip_ws(or_empty(F.col(name).cast("string"))).alias(name)


def parsed_metric(df: DataFrame, name: str) -> Column:
    """Metric cell as double; a cell that is no number fails the job."""
    if df.schema[name].dataType.simpleString() != "string":
        return F.col(name).cast("double")
    text = strip_ws(or_empty(F.col(name)))
    return F.coalesce(
        F.when(text.rlike(NUMBER), text.try_cast("double")),
        F.raise_error(F.concat(F.lit(f"no number in {name}: '"), text, F.lit("'"))).cast("double"),
    )


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {', '.join(sorted(df.columns))}")


def key_list(*groups: Sequence[str]) -> list[str]:
    """Keys of all lists in first-seen order, each once."""
    return list(dict.fromkeys(k for group in groups for k in group))


def leaderboard(
    df: DataFrame,
    keys: Sequence[str] = LEADERBOARD_KEYS,
    metric: str = "metric_eval_accuracy",
    by_source: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Mean, sample deviation (0 for one run) and count of a metric per key, best mean first.

    Equal means keep first-seen order when ``order`` names a row position, else key order.
    """
    keys = key_list(keys)
    grouping = [*([SOURCE] if by_source else []), *keys]
    require_columns(df, [*grouping, metric])
    rows = df.select(
        *([F.col(SOURCE)] if by_source else []),
        *[clean_key(k) for k in keys],
        parsed_metric(df, metric).alias("_v"),
        *([F.col(order).alias("_order")] if order else []),
    )
    table = rows.groupBy(*grouping).agg(
        F.avg("_v").alias(f"{metric}_mean"),
        F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias(f"{metric}_std"),
        F.count("*").alias(f"{metric}_n"),
        *([F.min("_order").alias("_order")] if order else []),
    )
    # The range sort samples its input first, so that the rows are read once for the written averages.
    table = settle(table)
    ties = ["_order"] if order else keys
    lead = [F.asc(SOURCE)] if by_source else []
    return table.orderBy(*lead, F.desc(f"{metric}_mean"), *ties).drop("_order")


def metric_columns(df: DataFrame, prefix: str = "metric_eval_", suffix: str = "_mean") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def drop_blank_metrics(df: DataFrame, value: str) -> DataFrame:
    return df.filter(strip_ws(or_empty(F.col(value).cast("string"))) != "")


def macro_mean(
    df: DataFrame,
    keys: Sequence[str] = MACRO_KEYS,
    prefix: str = "metric_eval_",
    suffix: str = "_mean",
    order: str | None = None,
) -> DataFrame:
    """Mean over every matching metric column of all rows per key, blank cells skipped, best first."""
    keys = key_list(keys)
    if not keys:
        raise ValueError("no key columns given")
    require_columns(df, keys)
    metrics = metric_columns(df, prefix, suffix)
    if not metrics:
        raise ValueError(f"no column named {prefix}*{suffix}")
    ids = [*[clean_key(k) for k in keys], *([F.col(order).alias("_order")] if order else [])]
    wide = df.select(*ids, *[F.col(m).cast("string").alias(m) for m in metrics])
    names = [*keys, *(["_order"] if order else [])]
    long = drop_blank_metrics(wide.unpivot(names, metrics, "_metric", "_text"), "_text")
    pooled = (
        long.select(*names, parsed_metric(long, "_text").alias("_v"))
        .groupBy(*keys)
        .agg(
            F.avg("_v").alias("metric_eval_mean_avg"),
            F.count("*").alias("metric_eval_mean_n"),
            *([F.min("_order").alias("_order")] if order else []),
        )
    )
    ties = ["_order"] if order else keys
    # Means that agree in their ten written digits count as equal.
    written = F.format_string("%.9e", "metric_eval_mean_avg").cast("double")
    return pooled.withColumn("_written", written).orderBy(F.desc("_written"), *ties).drop("_order", "_written")


def as_text_table(df: DataFrame) -> DataFrame:
    """Doubles in ten significant digits and everything else as text: the form written to CSV."""
    return df.select(
        *[
            (format_10g(F.col(n)) if t == "double" else F.col(n).cast("string")).alias(n)
            for n, t in df.dtypes
        ]
    )
