"""The four jobs end to end."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import STOP_STRINGS, cut_at_stop, instruction_prompt
from evalloom.operators.encode import processor_for
from evalloom.operators.grade import SUPPORTED_SPLITS, TASKS, grade
from evalloom.operators.leaderboard import LEADERBOARD_KEYS, MACRO_KEYS, leaderboard, macro_mean
from evalloom.operators.predict import batch_predict
from evalloom.operators.splits import batch_id, check_splits, seeded_sample
from evalloom.sources import readers, sinks
from evalloom.sources.scratch import settle


def prepare_dataset(
    df: DataFrame,
    dataset_name: str,
    tokenizer,
    train_split: str = "train",
    eval_split: str | None = None,
    test_split: str | None = None,
    **options,
) -> DataFrame:
    """Indexed rows to encoded splits with the processor of the dataset."""
    processor = processor_for(dataset_name)
    return processor(readers.load_splits(df, train_split, eval_split, test_split), tokenizer, **options)


def calibration_batches(encoded: DataFrame, n: int, seed: int, size: int, collator) -> DataFrame:
    """A seeded sample of encoded rows, batched and padded."""
    sample = seeded_sample(encoded.select("idx", "input_ids", "attention_mask", "labels"), n, seed)
    return collator(batch_id(sample, size))


def predict_items(items: DataFrame, load: Callable, batch_size: int = 1) -> DataFrame:
    """Completions (idx, split, prediction_raw) for evaluation items."""
    prompted = items.select("idx", "split", instruction_prompt(F.col("instruction")).alias("prompt"))
    return batch_predict(prompted, "prompt", load, batch_size).select("idx", "split", "prediction_raw")


def evaluate(
    spark: SparkSession,
    item_paths: Mapping[str, str],
    completions: DataFrame,
    folder: str,
    splits: Sequence[str] | None = None,
    profile: str = "accelerate",
    debug: bool = False,
) -> DataFrame:
    """Grade the chosen splits, write records and metrics, and return the graded rows."""
    chosen = list(splits or SUPPORTED_SPLITS)
    check_splits(chosen, SUPPORTED_SPLITS)
    # Records, metrics and the returned frame read the same graded rows.
    parts = {
        split: settle(grade(readers.read_eval_items(spark, split, item_paths[split]), completions, TASKS[split], profile, debug))
        for split in chosen
    }
    for split, part in parts.items():
        sinks.write_predictions(part, f"{folder}/{split}")
        sinks.write_metrics(part, f"{folder}/{split}")
        if debug:
            sinks.write_debug(part, f"{folder}/{split}")
    columns = [*sinks.RECORD_COLUMNS, "answer"]
    out: DataFrame | None = None
    for part in parts.values():
        out = part.select(*columns) if out is None else out.unionByName(part.select(*columns))
    return out


def infer(instructions: DataFrame, prompt: Callable, load: Callable, batch_size: int = 1) -> DataFrame:
    """Instructions to (instruction, prediction) with a prompt column function and a predictor."""
    asked = instructions.withColumn("prompt", prompt(F.col("instruction")))
    answered = batch_predict(asked, "prompt", load, batch_size)
    return answered.select("instruction", cut_at_stop(F.col("prediction_raw"), STOP_STRINGS).alias("prediction"))


def build_leaderboard(
    spark: SparkSession,
    roots: Sequence[str],
    metric: str = "metric_eval_accuracy",
    keys: Sequence[str] = LEADERBOARD_KEYS,
) -> DataFrame:
    """Averages per result file found under the roots."""
    rows = readers.read_results_under(spark, roots)
    return leaderboard(rows, keys, metric, by_source=True, order="row_order")


def write_leaderboard(
    spark: SparkSession,
    roots: Sequence[str],
    metric: str = "metric_eval_accuracy",
    keys: Sequence[str] = LEADERBOARD_KEYS,
) -> int:
    """Averages of every result file as ``<stem>_avg.csv`` beside it, where :func:`build_macro_mean` finds them."""
    return sinks.write_avg_beside(build_leaderboard(spark, roots, metric, keys))


def build_macro_mean(
    spark: SparkSession,
    roots: Sequence[str],
    keys: Sequence[str] = MACRO_KEYS,
    prefix: str = "metric_eval_",
    suffix: str = "_mean",
) -> DataFrame:
    """Macro mean over the average files found under the roots."""
    rows = readers.read_averages_under(spark, roots)
    return macro_mean(rows, keys, prefix, suffix, order="row_order")
