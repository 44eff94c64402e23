"""Run registry queries: names, tags, paths, checks, settings, grids and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import formats, names, text
from evalloom.operators import runs as ops
from evalloom.operators.splits import keep_columns
from evalloom.queries.registry import joined, query, table

SEED_KEY = "o_custkey % 97"


def _configs(spark, sf_dir):
    """Run configurations composed from orders."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    kind = F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int")
    return table(spark, sf_dir, "orders").select(
        key,
        F.struct(F.concat(F.lit("org/m"), kind).alias("name_or_path")).alias("model"),
        F.struct(
            F.lit("meta/glue").alias("name"), F.when(key % 3 == 0, "mrpc").when(key % 3 == 1, "").alias("subset")
        ).alias("dataset"),
        F.struct(
            F.lit("lora").alias("variant"),
            (kind * 4).alias("lora_r"),
            F.lit(1).alias("lora_alpha"),
            F.when(status == "F", "True").when(status == "O", "gaussian").otherwise("eva").alias("init_lora_weights"),
            (key % 4 == 0).alias("use_dora"),
            F.when(key % 2 == 0, "SEQ_CLS").alias("task_type"),
            F.array(F.lit("query"), F.lower(status)).alias("target_modules"),
            F.struct(F.when(key % 5 == 0, F.lit(7)).alias("init_seed"), F.lit(256).alias("init_num_samples")).alias(
                "lora_init_kwargs"
            ),
        ).alias("peft"),
        F.struct(
            F.when(status == "P", names.RESTART_TRAINER).otherwise("Trainer").alias("name"),
            F.lit(1).alias("repeat_n"),
            F.lit(0.06).alias("repeat_warmup_ratio"),
        ).alias("trainer"),
        F.struct(
            (F.col("o_custkey") % 97).alias("seed"),
            F.when(key % 2 == 0, "4e-4").otherwise("1e-05").alias("learning_rate"),
            F.when(key % 2 == 0, "adamw_torch_fused").otherwise("adamw_torch").alias("optim"),
            F.lit(32).alias("per_device_train_batch_size"),
            (key % 3 == 0).alias("bf16"),
            (key % 2 == 0).alias("fp16"),
        ).alias("training"),
        F.concat(F.lit("2026012209"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("timestamp"),
    )


INIT = "CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'gaussian' ELSE 'eva' END"
RANK = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 4"
STAMP = "'2026012209' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')"
RUN_NAME = f"""
    'm' || substr(o_orderpriority, 1, 1) || '_glue' || CASE WHEN o_orderkey % 3 = 0 THEN '_mrpc' ELSE '' END || '_r' || {RANK} || '_a1_'
    || {INIT} || '_lora' || CASE WHEN o_orderstatus = 'P' THEN '_sr-init#rp1&rwr0.06' ELSE '' END || '_s' || {SEED_KEY} || '_' || {STAMP}
"""


@query("run_name_build", f"SELECT o_orderkey, {RUN_NAME} AS run_name FROM orders")
def run_name_build(spark, sf_dir):
    return names.run_name(_configs(spark, sf_dir)).select("o_orderkey", "run_name")


@query(
    "run_name_parse",
    f"""
    SELECT o_orderkey, {RUN_NAME} AS run_name, {STAMP} AS timestamp, CAST({SEED_KEY} AS INTEGER) AS seed,
           CASE WHEN o_orderstatus = 'P' THEN 'sr-init#rp1&rwr0.06' ELSE 'none' END AS extra FROM orders
    """,
)
def run_name_parse(spark, sf_dir):
    path = F.concat(
        F.lit("outputs//x/"), F.col("run_name"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("/checkpoint-10")).otherwise("/"),
    )
    named = names.run_name(_configs(spark, sf_dir)).withColumn("_p", names.parse_run_path(path))
    return named.select("o_orderkey", "_p.run_name", "_p.timestamp", "_p.seed", "_p.extra")


@query(
    "run_name_parse_robust",
    f"""
    SELECT o_orderkey, '20260122_0' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS timestamp,
           CAST({SEED_KEY} AS INTEGER) AS seed, CASE WHEN o_orderstatus = 'P' THEN 'sr&rp1' ELSE 'none' END AS extra,
           '0' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS strict_timestamp, NULL::INTEGER AS strict_seed
    FROM orders
    """,
)
def run_name_parse_robust(spark, sf_dir):
    path = F.concat(
        F.lit("m_glue_lora"), F.when(F.col("o_orderstatus") == "P", "_sr&rp1").otherwise(""), F.lit("_s"),
        (F.col("o_custkey") % 97).cast("string"), F.lit("_20260122_0"),
        F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"),
    )
    parsed = table(spark, sf_dir, "orders").select(
        "o_orderkey", names.parse_run_path(path, "robust").alias("r"), names.parse_run_path(path).alias("s")
    )
    return parsed.select(
        "o_orderkey", "r.timestamp", "r.seed", "r.extra", F.col("s.timestamp").alias("strict_timestamp"),
        F.col("s.seed").alias("strict_seed"),
    )


@query(
    "run_tags",
    f"""
    SELECT o_orderkey, array_to_string(list_filter([
        'variant:lora', 'rank:' || {RANK}, 'alpha:1', CASE WHEN o_orderstatus <> 'O' THEN 'init:' || {INIT} END,
        CASE WHEN o_orderkey % 4 = 0 THEN 'dora' END, CASE WHEN o_orderkey % 2 = 0 THEN 'lr:4e-04' ELSE 'lr:1e-05' END,
        CASE WHEN o_orderkey % 2 = 0 THEN 'optim:adamw-fused' ELSE 'optim:adamw' END, 'bs:32x1',
        CASE WHEN o_orderkey % 3 = 0 THEN 'bf16' WHEN o_orderkey % 2 = 0 THEN 'fp16' END,
        CASE WHEN o_orderstatus = 'P' THEN 'trainer:CleanedSvdRefactor' END, 'data:meta/glue', 'model:m' || substr(o_orderpriority, 1, 1),
        CASE WHEN o_orderkey % 2 = 0 THEN 'task:SEQ_CLS' END, 'tgt-mods:query&' || lower(o_orderstatus)], lambda t: t IS NOT NULL), ' ') AS tags
    FROM orders
    """,
)
def run_tags(spark, sf_dir):
    return names.run_tags(_configs(spark, sf_dir)).select("o_orderkey", F.array_join("tags", " ").alias("tags"))


@query(
    "run_keys",
    f"""
    SELECT o_orderkey, 'org-m' || substr(o_orderpriority, 1, 1) || '_meta-glue' || CASE WHEN o_orderkey % 3 = 0 THEN '_mrpc' ELSE '' END
               || '_r' || {RANK} || '_dp256_' || CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE ({SEED_KEY}) * 2 + 1 END || '.pt' AS cache_key,
           'nlp_org-m' || substr(o_orderpriority, 1, 1) || '_glue' || CASE WHEN o_orderkey % 3 = 0 THEN '_mrpc' ELSE '' END AS tracker_project
    FROM orders
    """,
)
def run_keys(spark, sf_dir):
    keyed = names.tracker_project(names.cache_key(_configs(spark, sf_dir)))
    return keyed.select("o_orderkey", "cache_key", "tracker_project")


FACTOR_REF = """
    'm' || p_size || '_d' || CASE WHEN p_partkey % 2 = 0 THEN '_len512' ELSE '' END || '_r' || p_size || '_rho2_bs4_seed' || p_partkey
    || '_ratio0.99' || CASE WHEN p_partkey % 3 = 0 THEN '_scaled' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '_whitened' ELSE '' END
    || CASE WHEN p_partkey % 7 = 0 THEN '_labelmask' ELSE '' END
"""


@query(
    "factor_refs",
    f"""
    SELECT p_partkey, {FACTOR_REF} AS factor_ref, 'm' || p_size || '_d_lora_r' || p_size || '_' ||
           CASE WHEN p_partkey % 2 = 0 THEN 'eva_rho2' || CASE WHEN p_partkey % 3 = 0 THEN '_scaled' ELSE '' END
                || CASE WHEN p_partkey % 4 = 0 THEN '_n_init4' ELSE '' END ELSE 'gaussian' END AS tracker_name
    FROM part
    """,
)
def factor_refs(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    flat = table(spark, sf_dir, "part").select(
        key,
        F.concat(F.lit("org/m"), size).alias("model_name"),
        F.lit("x/d").alias("dataset_name"),
        F.when(key % 2 == 0, 512).alias("model_max_length"),
        size.alias("rank"), F.lit(2).alias("rho"), F.lit(4).alias("batch_size"), key.alias("seed"),
        F.lit("ratio").alias("early_stop_redist_metric"), F.lit(0.99).alias("early_stop_sim_thresh"),
        (key % 3 == 0).alias("scale_by_singular_values"), (key % 5 == 0).alias("whiten"), (key % 7 == 0).alias("use_label_mask"),
        F.lit("lora").alias("adapter_type"), size.alias("lora_dim"),
        F.when(key % 2 == 0, "eva").otherwise("gaussian").alias("lora_init"), F.lit(False).alias("redistribute"),
        F.when(key % 4 == 0, 4).alias("n_components_for_init"),
    )
    referenced = names.factor_ref(flat).withColumn("svd_filepath", F.concat("factor_ref", F.lit("_svd.bin")))
    return names.tracker_name(referenced).select("p_partkey", "factor_ref", "tracker_name")


CHECKED = """
    SELECT c_custkey, list_filter([
        CASE WHEN c_acctbal < 0 THEN 'model' END, CASE WHEN c_custkey % 11 = 0 THEN 'training' END, 'extra.field',
        CASE WHEN c_acctbal < 0 OR c_nationkey = 3 THEN 'model.name_or_path' END], lambda t: t IS NOT NULL) AS failed FROM customer
"""
RULES = ["model", "training", "extra.field", "model.name_or_path"]


def _checked(spark, sf_dir, rules):
    model = F.struct(F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("name_or_path"))
    configs = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, model).alias("model"),
        F.when(F.col("c_custkey") % 11 != 0, F.struct("c_acctbal")).alias("training"),
    )
    return ops.check_runs(configs, rules)


@query(
    "config_check",
    f"SELECT c_custkey, array_to_string(failed, ',') AS failed_rules, len(failed) = 0 AS valid FROM ({CHECKED})",
)
def config_check(spark, sf_dir):
    out = _checked(spark, sf_dir, RULES)
    return out.select("c_custkey", F.array_join("failed_rules", ",").alias("failed_rules"), "valid")


@query(
    "config_check_summary",
    f"SELECT count(*) AS total, count(*) FILTER (len(failed) = 1) AS passed, count(*) FILTER (len(failed) > 1) AS failed FROM ({CHECKED})",
)
def config_check_summary(spark, sf_dir):
    return ops.check_summary(_checked(spark, sf_dir, [r for r in RULES if r != "extra.field"]))


@query(
    "settings_merge",
    """
    WITH s AS (
        SELECT c_custkey, 'peft.r' AS k, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '8' END AS v FROM customer
        UNION ALL SELECT c_custkey, 'peft.bias', 'none' FROM customer
        UNION ALL SELECT c_custkey, 'name', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END FROM customer
        UNION ALL SELECT c_custkey, 'trainer.name', 't' FROM customer WHERE c_custkey % 5 <> 0
        UNION ALL SELECT c_custkey, 'trainer', 'plain' FROM customer WHERE c_custkey % 5 = 0)
    SELECT * FROM s
    """,
)
def settings_merge(spark, sf_dir):
    rows, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    base = rows.select(
        key,
        F.create_map(
            F.lit("peft.r"), F.lit("8"), F.lit("peft.bias"), F.lit("none"), F.lit("name"), F.col("c_name"),
            F.lit("trainer.name"), F.lit("t"),
        ).alias("settings"),
    )
    pairs = F.array_compact(
        F.array(
            F.when(key % 2 == 0, F.struct(F.lit("peft.r").alias("k"), F.col("c_nationkey").cast("string").alias("v"))),
            F.when(key % 3 == 0, F.struct(F.lit("name").alias("k"), F.lit(None).cast("string").alias("v"))),
            F.when(key % 5 == 0, F.struct(F.lit("trainer").alias("k"), F.lit("plain").alias("v"))),
        )
    )
    override = rows.select(key, F.map_from_entries(pairs).alias("settings"))
    merged = ops.merge_settings(base, override, "c_custkey")
    return merged.select("c_custkey", F.explode("settings").alias("k", "v"))


@query(
    "run_grid_missing",
    """
    WITH plans AS (
        SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'OTHER']) AS init_lora_weights, false AS restart
        UNION ALL SELECT unnest(['BUILDING', 'OTHER']), true),
    done AS (SELECT DISTINCT c_nationkey AS seed, c_mktsegment AS init_lora_weights, c_acctbal > 7000 AS restart FROM customer),
    grid AS (SELECT DISTINCT c_custkey AS seed, init_lora_weights, restart FROM customer, plans)
    SELECT seed, init_lora_weights, restart FROM grid WHERE (seed, init_lora_weights, restart) NOT IN (SELECT seed, init_lora_weights, restart FROM done)
    """,
)
def run_grid_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER"]
    grid = ops.run_grid(rows.select(F.col("c_custkey").alias("seed")), segments, ["BUILDING", "OTHER"])
    done = rows.select(
        F.col("c_nationkey").cast("long").alias("seed"), F.col("c_mktsegment").alias("init_lora_weights"),
        (F.col("c_acctbal") > 7000).alias("restart"),
    )
    return ops.missing_runs(grid, done)


@query(
    "batch_plan",
    """
    WITH c AS (
        SELECT o_orderkey, o_custkey % 7 + 1 AS device, (o_orderkey % 4 + 1) * 16 AS whole, o_orderkey % 3 + 1 AS procs,
               o_custkey + 1000 AS train_rows FROM orders),
    s AS (SELECT *, whole // procs AS share FROM c),
    a AS (SELECT *, CASE WHEN share <= device THEN 1 ELSE whole // (device * procs) END AS acc,
                 CASE WHEN share <= device THEN share ELSE device END AS real FROM s)
    SELECT o_orderkey, acc AS gradient_accumulation_steps, real AS real_per_device_train_batch_size,
           3 * train_rows // whole AS max_steps, (3 * train_rows // whole) // 50 AS eval_steps,
           CASE WHEN whole % procs <> 0 THEN 'global batch does not divide by the processes'
                WHEN share > device AND whole <> device * acc * procs THEN 'global batch is no multiple of the device batch' END AS plan_error,
           whole AS global_batch
    FROM a
    """,
)
def batch_plan(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct(
            (F.col("o_custkey") % 7 + 1).alias("per_device_train_batch_size"),
            ((F.col("o_orderkey") % 4 + 1) * 16).alias("global_batch_size"),
        ).alias("training"),
        (F.col("o_orderkey") % 3 + 1).alias("num_processes"),
        (F.col("o_custkey") + 1000).alias("train_rows"),
    )
    planned = ops.batch_plan(runs, flag_errors=True).withColumn("global_batch", ops.global_batch_size(runs))
    return keep_columns(
        planned,
        ["o_orderkey", "gradient_accumulation_steps", "real_per_device_train_batch_size", "max_steps", "eval_steps",
         "plan_error", "global_batch"],
    )


@query(
    "text_helpers",
    """
    SELECT o_orderkey, '1,' || o_custkey || ',3' AS ints, o_orderpriority AS segment, 'a-' || o_orderstatus || '-b' AS safe,
           CASE o_orderkey % 4 WHEN 0 THEN './eval_results.csv' WHEN 1 THEN 'out/eval_results.csv'
               WHEN 2 THEN 'out/' || o_orderstatus || '/eval_results.csv' ELSE '/x.d/eval_results.csv' END AS path
    FROM orders
    """,
)
def text_helpers(spark, sf_dir):
    key = F.col("o_orderkey")
    path = (
        F.when(key % 4 == 0, "").when(key % 4 == 1, "out/a.csv").when(key % 4 == 2, F.concat(F.lit("out/"), "o_orderstatus")).otherwise("/x.d/")
    )
    return table(spark, sf_dir, "orders").select(
        key,
        joined(text.int_list(F.concat(F.lit(" 1,"), F.col("o_custkey").cast("string"), F.lit(",, 3 ")))).alias("ints"),
        text.last_segment(F.concat(F.lit("org/"), "o_orderpriority")).alias("segment"),
        text.path_safe(F.concat(F.lit("a/"), "o_orderstatus", F.lit("/b"))).alias("safe"),
        formats.resolve_output_path(path).alias("path"),
    )
