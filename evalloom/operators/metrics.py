"""Classification and regression metrics over logits."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions import arrays
from evalloom.operators.counts import attach, lower_rows
from evalloom.operators.ranges import lookup
from evalloom.operators.user_metrics import UserMetric, user_metrics
from evalloom.sources.scratch import settle

logger = logging.getLogger(__name__)

REGRESSION_TASKS = ("stsb",)


def _no_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def hit_rate(pred: Column, label: Column) -> Column:
    return F.avg((pred == label).cast("double"))


def binary_f1(pred: Column, label: Column) -> Column:
    tp = F.count_if((pred == 1) & (label == 1))
    return _no_zero(2.0 * tp, 2 * tp + F.count_if((pred == 1) != (label == 1)))


def matthews(pred: Column, label: Column) -> Column:
    """Matthews correlation of two binary columns, 0 where undefined."""
    tp, tn = F.count_if((pred == 1) & (label == 1)), F.count_if((pred != 1) & (label != 1))
    fp, fn = F.count_if((pred == 1) & (label != 1)), F.count_if((pred != 1) & (label == 1))
    # Doubles throughout: the product of four counts leaves the range of long.
    a, b, c, d = (x.cast("double") for x in (tp, tn, fp, fn))
    return _no_zero(a * b - c * d, F.sqrt((a + c) * (a + d) * (b + c) * (b + d)))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation, null for a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


# Metric columns by task. Pearson and Spearman share one list and come from the same counts.
metric_registry: dict[str, tuple[str, ...]] = {
    "sst2": ("accuracy",), "mnli": ("accuracy",), "qnli": ("accuracy",), "rte": ("accuracy",), "wnli": ("accuracy",),
    "mrpc": ("accuracy", "f1"), "qqp": ("accuracy", "f1"),
    "cola": ("matthews_correlation",),
    "stsb": ("pearson", "spearmanr"),
}

_COLUMNS = {
    "accuracy": lambda: hit_rate(F.col("pred"), F.col("label")),
    "f1": lambda: binary_f1(F.col("pred"), F.col("label")),
    "matthews_correlation": lambda: matthews(F.col("pred"), F.col("label")),
}

#: Users' metrics by name, next to the built-in ones.
user_registry: dict[str, UserMetric] = {}


def register_metric(task: str, name: str, metric: UserMetric | None = None) -> None:
    """Add a metric to a task, new or known: a user's own, or a built-in one by its name."""
    if metric is None and name not in (*_COLUMNS, "pearson", "spearmanr"):
        raise ValueError(f"no built-in metric {name!r}")
    if metric is not None and name in (*_COLUMNS, "pearson", "spearmanr"):
        raise ValueError(f"{name!r} is a built-in metric")
    if metric is not None:
        user_registry[name] = metric
    metric_registry[task] = tuple(dict.fromkeys([*metric_registry.get(task, ()), name]))


def _first_output(df: DataFrame, logits: str) -> tuple[Column, T.DataType]:
    """Logits column and type; of a struct of model outputs the first field counts."""
    kind, column = df.schema[logits].dataType, F.col(logits)
    if isinstance(kind, T.StructType):
        return column[kind.fields[0].name], kind.fields[0].dataType
    return column, kind


def with_prediction(df: DataFrame, regression: bool = False, logits: str = "logits") -> DataFrame:
    """Add ``pred``: class of the highest logit, sign of a single logit, or the value of a regression head."""
    column, kind = _first_output(df, logits)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        column, kind = arrays.last_position(column), kind.elementType
    if isinstance(kind, T.ArrayType):
        pred = F.element_at(column, 1).cast("double") if regression else arrays.argmax(column)
    else:
        pred = column.cast("double") if regression else arrays.above_zero(column)
    return df.withColumn("pred", pred)


def rank_table(df: DataFrame, value: str, by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Average rank of every distinct value per group, with the number of rows that hold it (``_n``).

    ``n`` names the rows that a row of ``df`` stands for, one without it.
    """
    held = F.count("*") if n is None else F.sum(n)
    counts = settle(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(held.alias("_n")))
    lower = lower_rows(counts, by, value, "_n", "_lower")
    return lower.select(*by, value, (F.col("_lower") + (F.col("_n") + 1) / 2).alias(f"{value}_rank"), "_n")


def average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``{value}_rank``: rank inside the group, ties sharing their mean rank.

    Ranks are worked out on distinct values and looked up, so equal values never meet in one task.
    """
    return lookup(df, rank_table(df, value, by), [*by, value], "_n")


def correlations(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``pearson`` and ``spearmanr`` of ``pred`` and ``label`` per group; null where a side is constant.

    The rows are read once, into counts of distinct pairs. Ranks and means are attached to the pairs, and moments are
    sums weighted by the counts, so work after the first pass follows the number of distinct pairs.
    """
    by = list(by)
    both = df.select(*by, F.col("pred").cast("double").alias("pred"), F.col("label").cast("double").alias("label"))
    pairs = settle(both.dropna(subset=["pred", "label"]).groupBy(*by, "pred", "label").agg(F.count("*").alias("_w")))
    sums = [(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(f"{c}_mean") for c in ("pred", "label")]
    means = pairs.groupBy(*by).agg(F.sum("_w").alias("_n"), *sums)
    # Ranks that share ties have the mean of plain ranks.
    middle = [((F.col("_n") + 1) / 2).alias(f"{side}_rank_mean") for side in ("pred", "label")]
    means = means.select(*by, "pred_mean", "label_mean", *middle, "_n")
    columns = ("pred", "label", "pred_rank", "label_rank")
    centred = pairs
    for side in ("pred", "label"):
        centred = attach(centred, rank_table(pairs, side, by, "_w"), [*by, side], "_n")
    if by:
        centred = attach(centred, means, by, "_n")
    else:
        centred = centred.withColumns({f"{c}_mean": F.lit(v) for c, v in zip(columns, means.first(), strict=False)})
    moved = centred.select(*by, "_w", *[(F.col(c) - F.col(f"{c}_mean")).alias(c) for c in columns])
    product = lambda x, y: F.sum(F.col(x) * F.col(y) * F.col("_w"))
    ratio = lambda x, y: F.try_divide(product(x, y), F.sqrt(product(x, x)) * F.sqrt(product(y, y)))
    return moved.groupBy(*by).agg(ratio("pred", "label").alias("pearson"), ratio("pred_rank", "label_rank").alias("spearmanr"))


def _side_by_side(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Frames of one row per group joined by group; null groups are equal."""
    out = parts[0]
    for part in parts[1:]:
        keyed = part.select(F.struct(F.lit(0), *by).alias("_key"), *[c for c in part.columns if c not in by])
        out = out.withColumn("_key", F.struct(F.lit(0), *by)).join(keyed, "_key", "left").drop("_key")
    return out


def task_metric(df: DataFrame, task: str, by: Sequence[str] = ()) -> DataFrame | None:
    """Metrics of one task per group from ``pred`` (or ``logits``) and ``label``; unknown tasks give None.

    A user's metric reads the columns it names.
    """
    if task not in metric_registry:
        logger.warning("no metric for task %s", task)
        return None
    wanted = metric_registry[task]
    regression = task in REGRESSION_TASKS
    if "pred" not in df.columns and "logits" in df.columns:
        df = with_prediction(df, regression)
    plain = [name for name in wanted if name in _COLUMNS]
    parts = []
    if plain:
        parts.append(df.groupBy(*by).agg(*[_COLUMNS[name]().alias(name) for name in plain]))
    if set(wanted) & {"pearson", "spearmanr"}:
        parts.append(correlations(df, by))
    own = {name: user_registry[name] for name in wanted if name in user_registry}
    if own:
        parts.append(user_metrics(df, own, by))
    return _side_by_side(parts, by).select(*by, *wanted)
