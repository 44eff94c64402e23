"""Padding of encoded rows inside batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.arrays import LABEL_MASK, ones_like, pad_to


def _padded_length(ids: Column, multiple: int | None) -> Column:
    longest = F.max(F.size(ids)).over(W.partitionBy("batch_id"))
    return (F.ceil(longest / multiple) * multiple).cast("int") if multiple else longest


def _with_length(df: DataFrame, multiple: int | None) -> DataFrame:
    return df.withColumn("_len", _padded_length(F.col("input_ids"), multiple))


def _padded_mask(df: DataFrame) -> Column:
    """Given masks padded with 0, or ones over each row where any mask in the batch is missing."""
    ones = ones_like(F.col("input_ids"))
    if "attention_mask" not in df.columns:
        return pad_to(ones, F.col("_len"), 0)
    return pad_to(F.when(F.col("_masked"), F.col("attention_mask")).otherwise(ones), F.col("_len"), 0)


def collate(
    df: DataFrame, pad_id: int | None, multiple: int | None = 8, label_pad: int = LABEL_MASK, eos_id: int | None = None
) -> DataFrame:
    """Completion batches: ids, mask and labels of one length per ``batch_id``.

    The length is the batch maximum rounded up to ``multiple``. A row without labels is
    all ``label_pad``, unless no row of the batch has any: then labels repeat the ids.
    A batch has a bounded number of rows, so the window needs no splitting.
    """
    pad = pad_id if pad_id is not None else (eos_id or 0)
    lengths = _with_length(df, multiple)
    if "attention_mask" in df.columns:
        lengths = lengths.withColumn("_masked", F.count_if(F.col("attention_mask").isNull()).over(W.partitionBy("batch_id")) == 0)
    ids = pad_to(F.col("input_ids"), F.col("_len"), pad)
    if "labels" in df.columns:
        lengths = lengths.withColumn("_labelled", F.count("labels").over(W.partitionBy("batch_id")) > 0)
        given = F.coalesce("labels", F.array().cast("array<int>"))
        labels = F.when(F.col("_labelled"), pad_to(given, F.col("_len"), label_pad)).otherwise(ids)
    else:
        labels = ids
    kept = [c for c in df.columns if c not in ("input_ids", "attention_mask", "labels")]
    return lengths.select(
        *kept, ids.alias("input_ids"), _padded_mask(df).alias("attention_mask"), labels.alias("labels")
    )


def collate_plain(df: DataFrame, pad_id: int, multiple: int | None = 8, label_pad: int = LABEL_MASK) -> DataFrame:
    """Language-model batches without labels of their own: labels are the padded ids with pads masked."""
    base = collate(df.drop("labels"), pad_id, multiple)
    masked = F.transform("input_ids", lambda i: F.when(i == pad_id, label_pad).otherwise(i))
    return base.withColumn("labels", masked)


def collate_classes(df: DataFrame, pad_id: int, multiple: int | None = 8) -> DataFrame:
    """Classification batches: ids and mask padded, the class label as it is."""
    label = ["labels"] if "labels" in df.columns else []
    padded = collate(df.withColumnRenamed("labels", "_class"), pad_id, multiple).drop("labels")
    return padded.withColumnRenamed("_class", "labels") if label else padded


def collator_for(
    df: DataFrame, task_type: str, pad_id: int, multiple: int | None = 8
) -> Callable[[DataFrame], DataFrame]:
    """Collator by task: completions when a causal task has labels, plain when not, classes otherwise."""
    if str(task_type).lower() == "causal_lm":
        return partial(collate if "labels" in df.columns else collate_plain, pad_id=pad_id, multiple=multiple)
    return partial(collate_classes, pad_id=pad_id, multiple=multiple)
