"""Run names, tags and run paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.core import bind, or_empty
from evalloom.functions.formats import format_0e
from evalloom.functions.text import last_segment, path_safe

# The trainer whose runs carry a restart suffix, and the default trainer.
RESTART_TRAINER = "CleanedSvdRefactorTrainer"
PLAIN_TRAINER = "Trainer"


def field_type(df: DataFrame, path: str) -> T.DataType | None:
    """Type of a dotted field, or None where the schema has no such field."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


def field(df: DataFrame, path: str, default=None) -> Column:
    """A dotted field; the default where the schema lacks it or the value is null."""
    if field_type(df, path) is None:
        return F.lit(default)
    return F.col(path) if default is None else F.coalesce(F.col(path), F.lit(default))


def shown(df: DataFrame, path: str, default: str = "None") -> Column:
    """Field as name text: booleans capitalised, missing as ``None``."""
    kind = field_type(df, path)
    if kind is None:
        return F.lit(default)
    value = F.col(path)
    text = F.when(value, "True").otherwise("False") if isinstance(kind, T.BooleanType) else value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit(default))


def is_set(df: DataFrame, path: str) -> Column:
    """Whether a field holds something: not null, not false, not 0, not empty."""
    kind = field_type(df, path)
    if kind is None:
        return F.lit(False)
    value = F.col(path)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(kind, T.StringType):
        return or_empty(value) != ""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value != 0, F.lit(False))
    return value.isNotNull()


def _suffix(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def run_name(runs: DataFrame, name: str = "run_name", timestamp: str = "timestamp") -> DataFrame:
    """Add the run name built from model, dataset, rank, scale, initialisation, variant, seed and time."""
    text = F.concat(
        last_segment(F.col("model.name_or_path")),
        F.lit("_"),
        last_segment(F.col("dataset.name")),
        _suffix(is_set(runs, "dataset.subset"), "_", shown(runs, "dataset.subset")),
        F.lit("_r"), shown(runs, "peft.lora_r"),
        F.lit("_a"), shown(runs, "peft.lora_alpha"),
        F.lit("_"), shown(runs, "peft.init_lora_weights"),
        F.lit("_"), shown(runs, "peft.variant"),
        _suffix(
            F.coalesce(field(runs, "trainer.name") == RESTART_TRAINER, F.lit(False)),
            "_sr-init#rp", shown(runs, "trainer.repeat_n", "0"),
            "&rwr", shown(runs, "trainer.repeat_warmup_ratio", "0"),
        ),
        F.lit("_s"), shown(runs, "training.seed"),
        F.lit("_"), shown(runs, timestamp),
    )
    return runs.withColumn(name, text)


def cache_key(runs: DataFrame, name: str = "cache_key") -> DataFrame:
    """Add the cache file name of data-driven initialisations."""
    seed = F.coalesce(
        field(runs, "peft.lora_init_kwargs.init_seed").cast("long"),
        field(runs, "training.seed", 42).cast("long") * 2 + 1,
    )
    text = F.concat(
        path_safe(F.col("model.name_or_path")),
        F.lit("_"),
        path_safe(F.col("dataset.name")),
        _suffix(is_set(runs, "dataset.subset"), "_", path_safe(shown(runs, "dataset.subset"))),
        F.lit("_r"), shown(runs, "peft.lora_r"),
        F.lit("_dp"), shown(runs, "peft.lora_init_kwargs.init_num_samples", "512"),
        F.lit("_"), seed.cast("string"), F.lit(".pt"),
    )
    return runs.withColumn(name, text)


def factor_ref(runs: DataFrame, name: str = "factor_ref") -> DataFrame:
    """Add the factor-file reference from flat settings columns."""
    text = F.concat(
        last_segment(F.col("model_name")), F.lit("_"), last_segment(F.col("dataset_name")),
        _suffix(is_set(runs, "model_max_length"), "_len", shown(runs, "model_max_length")),
        F.lit("_r"), shown(runs, "rank"), F.lit("_rho"), shown(runs, "rho"),
        F.lit("_bs"), shown(runs, "batch_size"), F.lit("_seed"), shown(runs, "seed"),
        F.lit("_"), shown(runs, "early_stop_redist_metric"), shown(runs, "early_stop_sim_thresh"),
        _suffix(is_set(runs, "scale_by_singular_values"), "_scaled"),
        _suffix(is_set(runs, "whiten"), "_whitened"),
        _suffix(is_set(runs, "use_label_mask"), "_labelmask"),
    )
    return runs.withColumn(name, text)


def tracker_name(runs: DataFrame, name: str = "tracker_name") -> DataFrame:
    """Add the tracker's run name from flat settings columns; ``rho`` is read from the factor file name."""
    is_eva = F.coalesce(field(runs, "lora_init") == "eva", F.lit(False))
    with_rho = is_set(runs, "redistribute") | is_eva
    file = field(runs, "svd_filepath", "")
    rho = F.nullif(F.regexp_extract(file, r"rho\d+", 0), F.lit(""))
    found = F.coalesce(rho, F.raise_error(F.lit("no rho in the factor file name")).cast("string"))
    text = F.concat(
        last_segment(F.col("model_name")), F.lit("_"), last_segment(F.col("dataset_name")),
        F.lit("_"), shown(runs, "adapter_type"), F.lit("_r"), shown(runs, "lora_dim"),
        F.lit("_"), shown(runs, "lora_init"),
        _suffix(with_rho, "_", found),
        _suffix(with_rho & F.contains(file, F.lit("_scaled")), "_scaled"),
        _suffix(is_eva & is_set(runs, "n_components_for_init"), "_n_init", shown(runs, "n_components_for_init")),
    )
    return runs.withColumn(name, text)


def tracker_project(runs: DataFrame, name: str = "tracker_project", default: str = "nlp") -> DataFrame:
    """Add the tracker's project name."""
    text = F.concat(
        shown(runs, "wandb.project", default),
        F.lit("_"), path_safe(shown(runs, "model.name_or_path", "")),
        F.lit("_"), last_segment(shown(runs, "dataset.name", "")),
        _suffix(is_set(runs, "dataset.subset"), "_", shown(runs, "dataset.subset")),
    )
    return runs.withColumn(name, text)


def run_tags(runs: DataFrame, name: str = "tags") -> DataFrame:
    """Add the list of tags that describe a run."""

    def tag(path: str, label: str, value: Column | None = None, also: Column | None = None) -> Column:
        condition = is_set(runs, path) if also is None else is_set(runs, path) & also
        return F.when(condition, F.concat(F.lit(label), shown(runs, path) if value is None else value))

    def flag(path: str, label: str, also: Column | None = None) -> Column:
        return F.when(is_set(runs, path) if also is None else is_set(runs, path) & also, F.lit(label))

    optim = F.replace(
        F.replace(shown(runs, "training.optim"), F.lit("adamw_torch_fused"), F.lit("adamw-fused")),
        F.lit("adamw_torch"),
        F.lit("adamw"),
    )
    trainer = F.replace(
        F.replace(shown(runs, "trainer.name"), F.lit("Trainer"), F.lit("")), F.lit("Spectral"), F.lit("Spec")
    )
    modules_type = field_type(runs, "peft.target_modules")
    modules = (
        F.array_join("peft.target_modules", "&") if isinstance(modules_type, T.ArrayType) else F.lit(None).cast("string")
    )
    tags = F.array(
        tag("peft.variant", "variant:"),
        tag("peft.lora_r", "rank:"),
        tag("peft.lora_alpha", "alpha:"),
        tag("peft.init_lora_weights", "init:", also=shown(runs, "peft.init_lora_weights") != "gaussian"),
        flag("peft.use_dora", "dora"),
        flag("peft.use_rslora", "rslora"),
        flag("peft.use_qalora", "qalora"),
        tag("training.learning_rate", "lr:", format_0e(field(runs, "training.learning_rate"))),
        tag("training.optim", "optim:", optim),
        F.concat(
            F.lit("bs:"),
            shown(runs, "training.per_device_train_batch_size", "1"),
            F.lit("x"),
            shown(runs, "training.gradient_accumulation_steps", "1"),
        ),
        flag("training.bf16", "bf16"),
        flag("training.fp16", "fp16", ~is_set(runs, "training.bf16")),
        flag("training.gradient_checkpointing", "grad-ckpt"),
        tag("trainer.name", "trainer:", trainer, shown(runs, "trainer.name") != PLAIN_TRAINER),
        tag("dataset.name", "data:"),
        tag("model.name_or_path", "model:", last_segment(shown(runs, "model.name_or_path"))),
        tag("peft.task_type", "task:"),
        tag("peft.target_modules", "tgt-mods:", modules),
    )
    return runs.withColumn(name, F.array_compact(tags))


def parse_run_path(path: Column, mode: str = "strict") -> Column:
    """Struct (run_name, timestamp, seed, extra) of a run folder or one of its checkpoints.

    ``strict`` takes the last ``_`` part as time. ``robust`` also knows times that hold a ``_`` themselves.
    """
    if mode not in ("strict", "robust"):
        raise ValueError("mode must be 'strict' or 'robust'")
    clean = F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)*", "/"), r"(?<=[^/])/\z", "")
    base = bind(
        clean,
        lambda p: F.when(
            F.contains(last_segment(p), F.lit("checkpoint")), F.element_at(F.split(F.concat(F.lit("/"), p), "/"), -2)
        ).otherwise(last_segment(p)),
    )

    def strict(b: Column) -> Column:
        def pick(parts: Column) -> Column:
            before, third = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-3))
            return F.struct(
                b.alias("run_name"),
                F.element_at(parts, -1).alias("timestamp"),
                F.regexp_extract(or_empty(before), r"\As([+-]?[0-9]+)\z", 1).try_cast("int").alias("seed"),
                F.when(F.startswith(or_empty(third), F.lit("sr")), third).otherwise("none").alias("extra"),
            )

        return bind(F.split(b, "_"), pick)

    def robust(b: Column) -> Column:
        tail = r"_s(\d+)_(\d{8}_?\d{6})\z"

        def pick(head: Column) -> Column:
            return F.struct(
                b.alias("run_name"),
                F.regexp_extract(b, tail, 2).alias("timestamp"),
                F.regexp_extract(b, tail, 1).try_cast("int").alias("seed"),
                F.when(F.startswith(head, F.lit("sr")), head).otherwise("none").alias("extra"),
            )

        known = bind(F.substring_index(F.regexp_replace(b, tail, ""), "_", -1), pick)
        return F.when(F.rlike(b, F.lit(tail)), known).otherwise(strict(b))

    return bind(base, strict if mode == "strict" else robust)
