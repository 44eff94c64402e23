"""Batch prediction with a user's own model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def batch_predict(
    df: DataFrame,
    prompt: str,
    load: Callable[[], Callable[[list[str]], list[str]]],
    batch_size: int = 400,
    output: str = "prediction_raw",
) -> DataFrame:
    """Add the predictor's text for every prompt. ``load()`` runs once per Python task, not per row."""
    if batch_size < 1:
        raise ValueError("batch size must be at least 1")

    @F.pandas_udf(StringType())
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predictor = load()
        for batch in batches:
            prompts = batch.fillna("").tolist()
            texts: list[str] = []
            for start in range(0, len(prompts), batch_size):
                texts.extend(predictor(prompts[start : start + batch_size]))
            yield pd.Series(texts, index=batch.index, dtype=object)

    return df.withColumn(output, predict(F.col(prompt)))
