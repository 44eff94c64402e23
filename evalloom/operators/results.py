"""Result rows: construction from metrics and run settings, and schema-evolving append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.core import or_empty
from evalloom.functions.formats import cell_json, format_5f, init_label, record_json
from evalloom.functions.text import last_segment

# Adapter settings copied into a result row, source name first; an earlier source wins.
ADAPTER_FIELDS = (
    ("r", "r"), ("lora_r", "r"), ("lora_alpha", "lora_alpha"), ("lora_dropout", "lora_dropout"),
    ("target_modules", "target_modules"), ("bias", "bias"), ("use_dora", "use_dora"), ("use_rslora", "use_rslora"),
)
MODEL_FIELDS = ("base_model_name_or_path", "base_model")


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union whose header is the old columns and then the new ones; cells a row lacks are null."""
    return existing.unionByName(new, allowMissingColumns=True)


def adapter_fields(settings: T.StructType, name: str = "adapter") -> list[Column]:
    """Adapter columns that are present in the settings struct, lists as JSON text."""
    found: dict[str, list[Column]] = {}
    kinds = {f.name: f.dataType for f in settings.fields}
    for source, target in ADAPTER_FIELDS:
        if source in kinds:
            column = F.col(f"{name}.{source}")
            if isinstance(kinds[source], T.ArrayType):
                column = cell_json(column)
            elif isinstance(kinds[source], (T.MapType, T.StructType)):
                column = record_json(column)
            found.setdefault(target, []).append(column)
    return [F.coalesce(*columns).alias(target) for target, columns in found.items()]


def attach_adapter(results: DataFrame, adapters: DataFrame, on: str = "adapter_path") -> DataFrame:
    """Adapter settings (struct ``adapter``) by path; rows without one keep null."""
    return results.join(adapters.select(on, "adapter"), on, "left")


def _fallback(df: DataFrame, given: str, settings: dict[str, T.DataType], names: Sequence[str]) -> Column:
    columns = [F.col(given).cast("string")] if given in df.columns else []
    columns += [F.col(f"adapter.{n}").cast("string") for n in names if n in settings]
    return F.coalesce(*columns) if columns else F.lit(None).cast("string")


def result_rows(
    metrics: DataFrame, runs: DataFrame, extras: Sequence[str] = (), on: Sequence[str] = ("run_name",)
) -> DataFrame:
    """One result row per run from its metrics and settings.

    ``metrics`` holds the key and one column per metric, each prefixed ``metric_``.
    ``runs`` may hold base_model, dataset_name, subset, timestamp, init_lora_weights,
    extra, seed, run_time and a struct ``adapter`` that fills in model and
    initialisation. A blank ``subset`` is null; the column stays, since dropping it would read the data first.
    """
    names = [c for c in metrics.columns if c not in on]
    joined = runs.join(metrics, list(on))
    settings = (
        {f.name: f.dataType for f in runs.schema["adapter"].dataType.fields} if "adapter" in runs.columns else {}
    )

    def text(name: str) -> Column:
        return or_empty(F.col(name).cast("string")) if name in runs.columns else F.lit("")

    row = [
        text("timestamp").alias("timestamp"),
        or_empty(last_segment(_fallback(runs, "base_model", settings, MODEL_FIELDS))).alias("base_model"),
        text("dataset_name").alias("dataset_name"),
    ]
    if "subset" in runs.columns:
        row.append(F.nullif(text("subset"), F.lit("")).alias("subset"))
    row += [
        init_label(_fallback(runs, "init_lora_weights", settings, ["init_lora_weights"])).alias("init_lora_weights"),
        text("extra").alias("extra"),
        text("seed").alias("seed"),
    ]
    if "run_time" in runs.columns:
        row.append(F.col("run_time"))
    row += [F.col(n).alias(f"metric_{n}") for n in names]
    if settings:
        row += adapter_fields(runs.schema["adapter"].dataType)
    row += [text(e).alias(e) for e in extras]
    return joined.select(*row)


def accuracy_rows(metrics: DataFrame, extras: Sequence[str] = ()) -> DataFrame:
    """Short rows: model, dataset and accuracy with five decimals."""
    return metrics.select("model", "dataset", format_5f(F.col("accuracy")).alias("accuracy"), *extras)
