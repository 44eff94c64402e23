"""Completions to graded records, accuracy and invalid outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import grading
from evalloom.functions.core import or_empty
from evalloom.functions.text import cut_at_stop, instruction_prompt

# The evaluation splits.
SUPPORTED_SPLITS = ("gsm8k", "math")
TASKS = {"gsm8k": "numeric", "math": "symbolic"}
RECORD_COLUMNS = ("idx", "split", "instruction", "reference", "prediction", "correct", "expected_answer")


def join_completions(items: DataFrame, completions: DataFrame, on: Sequence[str] = ("split", "idx")) -> DataFrame:
    """Prompts, completions and gold answers by position."""
    return items.join(completions.select(*on, "prediction_raw"), list(on))


def _integer_text(number: Column) -> Column:
    return F.coalesce(number.try_cast("decimal(38,0)").cast("string"), number.cast("string"))


def _grade_numeric(df: DataFrame, profile: str, debug: bool) -> DataFrame:
    read = df.withColumn("_x", grading.extract_number(F.col("prediction"))).withColumn(
        "_gold", grading.gold_number(F.col("reference"), profile)
    )
    graded = read.withColumn("correct", F.coalesce(F.col("_x.value") == F.col("_gold"), F.lit(False)))
    judge = F.struct(
        F.lit("gsm8k").alias("task"),
        grading.gold_text(F.col("reference")).alias("expected_raw"),
        F.col("_gold").alias("expected_number"),
        F.col("_x.value").alias("pred_number"),
        F.struct("_x.found_answer_prefix", "_x.answer_field", "_x.matched_token", "_x.parse_error").alias("extraction"),
    )
    graded = graded.withColumn("judge", judge) if debug else graded
    return (
        graded.withColumn("expected_answer", _integer_text(F.col("_gold")))
        .withColumn("answer", _integer_text(F.col("_x.value")))
        .drop("_x", "_gold")
    )


def _grade_symbolic(df: DataFrame, profile: str, debug: bool) -> DataFrame:
    read = df.withColumn("_boxed", grading.last_boxed(F.col("reference"))).withColumn(
        "answer", grading.extract_symbolic(F.col("prediction"), profile)
    )
    read = read.withColumn("expected_answer", grading.strip_boxed(F.col("_boxed")))
    # One null gives false, and two nulls are wrong too: a missing gold answer is never right.
    present = F.col("expected_answer").isNotNull() & F.col("answer").isNotNull()
    graded = read.withColumn(
        "correct", present & grading.equivalent(F.col("answer"), F.col("expected_answer"), profile)
    )
    if debug:
        parts = grading.symbolic_parts(F.col("prediction"))
        judge = F.struct(
            F.lit("math").alias("task"),
            F.col("_boxed").alias("expected_boxed"),
            F.col("expected_answer"),
            grading.normalise_latex(F.col("expected_answer"), profile)["value"].alias("expected_normalized"),
            F.col("answer").alias("pred_answer"),
            grading.normalise_latex(F.col("answer"), profile)["value"].alias("pred_normalized"),
            F.struct(
                F.contains(F.col("prediction"), F.lit(grading.ANSWER_MARKER)).alias("found_answer_prefix"),
                parts["answer_field"].alias("answer_field"),
                parts["extracted_temp"].alias("extracted_temp"),
                parts["extracted"].alias("extracted"),
            ).alias("extraction"),
        )
        graded = graded.withColumn("judge", judge)
    return graded.drop("_boxed")


def grade_joined(df: DataFrame, task: str, profile: str = "accelerate", debug: bool = False) -> DataFrame:
    """Grade rows that hold ``reference`` and ``prediction_raw`` already. Works on streams too."""
    grading.check_profile(profile)
    if task not in TASKS.values():
        raise ValueError(f"unknown task {task!r}; known: {', '.join(TASKS.values())}")
    cut = df.withColumn("reference", or_empty(F.col("reference"))).withColumn(
        "prediction", cut_at_stop(F.col("prediction_raw"))
    )
    graded = (_grade_numeric if task == "numeric" else _grade_symbolic)(cut, profile, debug)
    return graded.withColumn("prompt", instruction_prompt(F.col("instruction"))) if debug else graded.drop(
        "prediction_raw"
    )


def grade(
    items: DataFrame, completions: DataFrame, task: str, profile: str = "accelerate", debug: bool = False
) -> DataFrame:
    """Join completions to their items and judge them; ``answer`` is what was extracted."""
    return grade_joined(join_completions(items, completions), task, profile, debug)


def accuracy(graded: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Share of correct rows and their number; 0.0 without rows."""
    return graded.groupBy(*by).agg(
        F.coalesce(F.avg(F.col("correct").cast("int")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("total")
    )


def invalid_outputs(graded: DataFrame) -> DataFrame:
    """Rows from which no answer could be read."""
    return graded.filter(F.col("answer").isNull())
