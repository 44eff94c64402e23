"""Encoding, grading and result append on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalloom.operators.encode import ArrowTokenizer, encode_sft
from evalloom.operators.grade import grade


def read_json_stream(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """Stream of the JSON-lines files that arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def encode_stream(sdf: DataFrame, tokenizer: ArrowTokenizer, **options) -> DataFrame:
    """Typed examples to encoded rows, row by row; a vocabulary table needs ``write_batches`` instead."""
    if not isinstance(tokenizer, ArrowTokenizer):
        raise TypeError("encode_stream needs an ArrowTokenizer; use write_batches for table vocabularies")
    return encode_sft(sdf, tokenizer, **options)


def grade_stream(completions: DataFrame, items: DataFrame, task: str, profile: str = "accelerate") -> DataFrame:
    """Grade a stream of completions against a static item table."""
    return grade(items, completions, task, profile)


def write_batches(
    sdf: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Run a batch operator on every micro-batch and write it to ``path/batch=<id>``.

    A batch that is repeated after a failure overwrites its own folder, so rows land once.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_stream(sdf: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of result rows to a table read with ``sinks.read_results``."""
    return write_batches(sdf, lambda batch: batch, path, checkpoint, once)
