"""Sources, sinks and streams: table rows are written in the formats read elsewhere, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions.formats import cell_json
from evalloom.operators import grade as ops
from evalloom.operators import leaderboard as lb
from evalloom.operators.encode import ArrowTokenizer
from evalloom.operators.results import attach_adapter
from evalloom.operators.splits import restore_order
from evalloom.plans import jobs
from evalloom.queries.grading import NUMERIC_GRADED, _numeric, answer_with_length
from evalloom.queries.registry import joined, query, table
from evalloom.sources import readers, sinks
from evalloom.sources.scratch import scratch
from evalloom.streaming import streams


@query(
    "jsonl_items",
    """
    SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, 'math' AS split,
           CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS instruction, 'so \\boxed{' || p_size || '}' AS reference FROM part
    """,
)
def jsonl_items(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(
        F.when(F.col("p_size") % 2 != 0, F.col("p_name")).alias("instruction"),
        F.concat(F.lit("so \\boxed{"), F.col("p_size").cast("string"), F.lit("}")).alias("output"),
        F.col("p_brand").alias("ignored"),
    )
    rows.write.json(path)
    return readers.read_eval_items(spark, "math", path)


@query(
    "instruction_lines",
    """
    SELECT trim(line, chr(9) || ' ') AS instruction FROM (
        SELECT unnest([chr(9) || p_name || '  ', ' ', '', p_brand]) AS line FROM part) WHERE trim(line) <> ''
    """,
)
def instruction_lines(spark, sf_dir):
    path = scratch(spark)
    lines = F.array(F.concat(F.lit("\t"), "p_name", F.lit("  ")), F.lit(" "), F.lit(""), F.col("p_brand"))
    table(spark, sf_dir, "part").select(F.explode(lines).alias("value")).write.text(path)
    return readers.read_instructions(spark, path)


def _write_results(spark, sf_dir, path):
    """Result files of three datasets, one with a column more."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("base_model"),
        F.col("o_orderstatus").alias("init_lora_weights"),
        F.col("o_orderkey").alias("seed"),
        F.col("o_totalprice").alias("metric_eval_accuracy"),
        cell_json(F.array("o_orderpriority", "o_orderstatus")).alias("target_modules"),
    )
    for name, condition, extra in (
        ("a", "seed % 3 = 0", False), ("b", "seed % 3 = 1", True), ("c", "seed % 3 = 2", False),
    ):
        part = rows.filter(condition)
        part = part.withColumn("run_time", F.col("seed") * 2) if extra else part
        part.write.option("header", True).option("escape", '"').csv(f"{path}/{name}_results.csv")


RESULT_AVERAGES = """
    SELECT CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS dataset, o_orderpriority AS base_model,
           o_orderstatus AS init_lora_weights, avg(o_totalprice) AS mean, coalesce(stddev_samp(o_totalprice), 0.0) AS std, count(*) AS n
    FROM orders GROUP BY 1, 2, 3
"""


# Means are written in ten digits, and averaged as they are read back. Five places leave no halves among thirds of them.
MACRO_MEANS = f"""
    SELECT base_model, init_lora_weights, round(avg(CAST(format('{{:.10g}}', mean) AS DOUBLE)), 5) AS mean, count(*) AS n
    FROM ({RESULT_AVERAGES}) GROUP BY 1, 2
"""


def _result_averages(spark, sf_dir, path):
    """Averages per written result folder. Spark writes a folder of part files per result table."""
    _write_results(spark, sf_dir, path)
    found = readers.scan_results(spark, [path], "*.csv")
    rows = readers.read_result_csv(spark, found)
    dataset = F.regexp_extract("source_path", r"/([a-z])_results\.csv/", 1)
    return lb.leaderboard(
        rows.withColumn("source_path", dataset), ["base_model", "init_lora_weights"], by_source=True, order="row_order"
    )


@query(
    "result_csv_leaderboard",
    f"SELECT dataset AS source_path, base_model, init_lora_weights, round(mean, 4) AS mean, round(std, 4) AS std, n FROM ({RESULT_AVERAGES})",
)
def result_csv_leaderboard(spark, sf_dir):
    out = _result_averages(spark, sf_dir, scratch(spark))
    return out.select(
        "source_path", "base_model", "init_lora_weights", F.round("metric_eval_accuracy_mean", 4).alias("mean"),
        F.round("metric_eval_accuracy_std", 4).alias("std"), F.col("metric_eval_accuracy_n").alias("n"),
    )


@query(
    "result_csv_macro_mean",
    MACRO_MEANS,
)
def result_csv_macro_mean(spark, sf_dir):
    path = scratch(spark)
    sinks.write_avg(_result_averages(spark, sf_dir, path), f"{path}/avg")
    rows = readers.read_result_csv(spark, readers.scan_results(spark, [f"{path}/avg"], "*.csv"))
    out = lb.macro_mean(rows, ["base_model", "init_lora_weights"], order="row_order")
    return out.select(
        "base_model", "init_lora_weights", F.round("metric_eval_mean_avg", 5).alias("mean"), F.col("metric_eval_mean_n").alias("n")
    )


NOTE = "o_orderpriority || chr(10) || '\"' || o_orderstatus || '\", ' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderkey || chr(10) END"


@query(
    "result_csv_line_breaks",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS seed, {NOTE} AS note, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus || ',' || chr(10) END AS extra,
           CAST(o_custkey AS VARCHAR) AS r FROM orders
    """,
)
def result_csv_line_breaks(spark, sf_dir):
    """Cells with line breaks, quotes and commas, in files that are scanned in many pieces."""
    path = scratch(spark)
    key = F.col("o_orderkey")
    note = F.concat(
        "o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", '), F.when(key % 4 == 0, "").otherwise(F.concat(key.cast("string"), F.lit("\n")))
    )
    rows = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("seed"), note.alias("note"),
        F.when(key % 3 > 0, F.concat("o_orderstatus", F.lit(",\n"))).alias("extra"), F.col("o_custkey").cast("string").alias("r"),
    )
    sinks.write_csv(rows.repartition(3, "seed"), path)
    pieces = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(pieces)
    spark.conf.set(pieces, "65536")
    try:
        # All scans of the files are done in here; what comes back reads stored lines, in pieces of the usual size.
        return readers.read_results_under(spark, [path], "*.csv").drop("source_path", "row_order")
    finally:
        spark.conf.set(pieces, usual)


HEADERS = 24


@query(
    "result_csv_headers",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS seed, o_orderpriority AS base_model, o_orderstatus AS extra,
           CASE WHEN o_custkey % {HEADERS} % 2 = 1 THEN CAST(o_totalprice AS VARCHAR) END AS price,
           CASE WHEN o_custkey % {HEADERS} % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS customer FROM orders
    """,
)
def result_csv_headers(spark, sf_dir):
    """Files with headers of their own: names in another order, some missing; read in one scan."""
    path = scratch(spark)
    kind = (F.col("o_custkey") % HEADERS).cast("int")
    rows = table(spark, sf_dir, "orders").withColumns({"kind": kind, "file": F.concat(kind.cast("string"), F.lit("-"), (F.col("o_orderkey") % 4).cast("string"))})
    columns = {"seed": "o_orderkey", "base_model": "o_orderpriority", "extra": "o_orderstatus", "price": "o_totalprice", "customer": "o_custkey"}
    names = F.filter(
        F.array(*[F.lit(c) for c in columns]),
        lambda c: ((c != "price") | (F.col("kind") % 2 == 1)) & ((c != "customer") | (F.col("kind") % 3 == 0)),
    )
    # Names turned by the file's number.
    turned = F.concat(F.slice("_names", 1 + F.col("kind") % F.size("_names"), F.size("_names")), F.slice("_names", F.lit(1), F.col("kind") % F.size("_names")))
    values = F.create_map(*[x for c, source in columns.items() for x in (F.lit(c), F.col(source).cast("string"))])
    laid = rows.withColumn("_names", names).withColumn("_names", turned).withColumn("_values", values)
    body = laid.select("file", F.lit(1).alias("at"), F.concat_ws(",", F.transform("_names", lambda c: F.col("_values")[c])).alias("value"))
    heads = laid.select("file", F.lit(0).alias("at"), F.concat_ws(",", "_names").alias("value")).distinct()
    lines = heads.unionByName(body).repartition("file").sortWithinPartitions("file", "at")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return readers.read_results_under(spark, [path], "*.txt").select(*columns)


@query(
    "leaderboard_chain",
    MACRO_MEANS,
)
def leaderboard_chain(spark, sf_dir):
    """Result files of three datasets, their averages written beside them, and the macro mean over what is found there."""
    path = scratch(spark)
    dataset = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit(f"{path}/"), dataset, F.lit("/eval_results.csv")).alias("target"),
        F.col("o_orderpriority").alias("base_model"), F.col("o_orderstatus").alias("init_lora_weights"),
        F.col("o_orderkey").cast("string").alias("seed"), F.col("o_totalprice").cast("string").alias("metric_eval_accuracy"),
    )
    sinks.write_named(rows)
    keys = ["base_model", "init_lora_weights"]
    jobs.write_leaderboard(spark, [path], keys=keys)
    out = jobs.build_macro_mean(spark, [path], keys)
    return out.select(*keys, F.round("metric_eval_mean_avg", 5).alias("mean"), F.col("metric_eval_mean_n").alias("n"))


@query(
    "adapter_scan",
    """
    SELECT n_name, n_regionkey <> 2 AS kept, CASE WHEN n_regionkey <> 2 THEN n_regionkey + 1 END AS r, c FROM nation
    JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
    """,
)
def adapter_scan(spark, sf_dir):
    """Adapter folders by nation, those of region 2 without a settings file; kept ones with their rank, and customers counted."""
    path = scratch(spark)
    holds = F.col("n_regionkey") != 2
    file = F.when(holds, readers.ADAPTER_FILE).otherwise("notes.json")
    files = table(spark, sf_dir, "nation").select(
        F.concat(F.lit(f"{path}/"), "n_name", F.lit("/"), file).alias("target"), (F.col("n_regionkey") + 1).alias("r"), F.lit("none").alias("bias")
    )
    sinks.write_named(files, sinks.write_json)
    seen = readers.scan_adapters(spark, path)
    ranked = readers.adapter_rank(readers.read_adapters(spark, path, "r int, bias string"))
    name = lambda c: F.substring_index(c, "/", -1)
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    counted = table(spark, sf_dir, "nation").join(customers, "n_nationkey").select(F.col("n_name").alias("adapter_path"), "c")
    listed = seen.select(name("adapter_path").alias("adapter_path"), "kept").join(counted, "adapter_path")
    out = attach_adapter(listed, ranked.withColumn("adapter_path", name("adapter_path")))
    return out.select(F.col("adapter_path").alias("n_name"), "kept", F.col("adapter.r").cast("int").alias("r"), "c")


@query(
    "prediction_files",
    f"""
    SELECT idx, split, instruction, reference, prediction, correct, CAST(CAST(gold AS BIGINT) AS VARCHAR) AS expected_answer
    FROM ({NUMERIC_GRADED})
    """,
)
def prediction_files(spark, sf_dir):
    path = scratch(spark)
    rows = _numeric(spark, sf_dir)
    items = rows.select("idx", "split", "instruction", "reference")
    sinks.write_predictions(ops.grade(items, rows.select("idx", "split", "prediction_raw"), "numeric"), path)
    schema = "idx long, split string, instruction string, reference string, prediction string, correct boolean, expected_answer string"
    return readers.read_jsonl(spark, f"{path}/predictions", schema).drop(sinks.FOLDER)


@query(
    "debug_files",
    f"""
    SELECT idx, prediction_raw, token AS matched_token, number AS pred_number, gold AS expected_number, correct
    FROM ({NUMERIC_GRADED})
    """,
)
def debug_files(spark, sf_dir):
    path = scratch(spark)
    rows = _numeric(spark, sf_dir)
    items = rows.select("idx", "split", "instruction", "reference")
    sinks.write_debug(ops.grade(items, rows.select("idx", "split", "prediction_raw"), "numeric", debug=True), path)
    schema = (
        "idx long, prediction_raw string, correct boolean, "
        "judge struct<expected_number double, pred_number double, extraction struct<matched_token string>>"
    )
    out = readers.read_jsonl(spark, f"{path}/debug", schema)
    return restore_order(
        out.select(
            "idx", "prediction_raw", "judge.extraction.matched_token", "judge.pred_number", "judge.expected_number", "correct"
        )
    )


@query(
    "metric_files",
    f"SELECT 'gsm8k' AS split_dir, round(avg(CAST(correct AS INTEGER)), 9) AS accuracy, count(*) AS total FROM ({NUMERIC_GRADED})",
)
def metric_files(spark, sf_dir):
    path = scratch(spark)
    rows = _numeric(spark, sf_dir)
    items = rows.select("idx", "split", "instruction", "reference")
    sinks.write_metrics(ops.grade(items, rows.select("idx", "split", "prediction_raw"), "numeric"), path)
    out = spark.read.json(f"{path}/metrics")
    return out.select("split_dir", F.round("accuracy", 9).alias("accuracy"), "total")


@query(
    "result_table_append",
    """
    SELECT o_orderkey AS id, o_totalprice AS metric, NULL::VARCHAR AS segment FROM orders
    UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer
    """,
)
def result_table_append(spark, sf_dir):
    path = scratch(spark)
    sinks.append_results(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("metric")), path
    )
    sinks.append_results(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("metric"), F.col("c_mktsegment").alias("segment")
        ),
        path,
    )
    return sinks.read_results(spark, path)


@query(
    "inference_files",
    "SELECT text AS instruction, 'The answer is: ' || length(text) || '. ' AS prediction FROM conversations",
)
def inference_files(spark, sf_dir):
    path = scratch(spark)
    asked = table(spark, sf_dir, "conversations").select(F.col("text").alias("instruction"))
    sinks.write_inference(jobs.infer(asked, lambda c: c, answer_with_length, 128), path)
    return readers.read_jsonl(spark, path, "instruction string, prediction string")


@query(
    "run_manifest",
    """
    SELECT o_orderkey, o_orderstatus AS status, o_totalprice / 60 AS total_training_time,
           o_totalprice / (o_custkey + 1) AS training_time_per_step_sec FROM orders
    """,
)
def run_manifest(spark, sf_dir):
    path = scratch(spark)
    runs = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.struct(F.col("o_orderstatus").alias("status")).alias("config"), F.col("o_totalprice").alias("seconds"),
        (F.col("o_custkey") + 1).alias("steps"),
    )
    sinks.write_manifest(runs, path)
    schema = "o_orderkey long, config struct<status string>, total_training_time double, training_time_per_step_sec double"
    out = readers.read_jsonl(spark, path, schema)
    return out.select("o_orderkey", "config.status", "total_training_time", "training_time_per_step_sec")


@query(
    "dataset_cache",
    """
    SELECT split, n_regionkey, count(*) AS n FROM (
        SELECT 'train' AS split, n_regionkey, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
        UNION ALL SELECT 'test', n_regionkey, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) GROUP BY 1, 2
    """,
)
def dataset_cache(spark, sf_dir):
    """Two files as named splits with unlike columns, cached as parquet."""
    files = {"train": f"{sf_dir}/customer.parquet", "test": f"{sf_dir}/supplier.parquet"}
    rows = readers.load_dataset(spark, "people", data_files=files, cache_dir=scratch(spark))
    nations = readers.load_dataset(spark, "nation.parquet", data_dir=sf_dir)
    key = F.coalesce("c_nationkey", "s_nationkey").alias("n_nationkey")
    return rows.select("split", key).join(nations, "n_nationkey").groupBy("split", "n_regionkey").agg(F.count("*").alias("n"))


@query(
    "stream_grade",
    f"SELECT idx, correct, CAST(CAST(number AS BIGINT) AS VARCHAR) AS answer FROM ({NUMERIC_GRADED})",
)
def stream_grade(spark, sf_dir):
    """Completions arrive as JSON files; items are a static table; graded rows are appended batch by batch."""
    path = scratch(spark)
    rows = _numeric(spark, sf_dir)
    rows.select("idx", "split", "prediction_raw").write.json(f"{path}/in")
    arriving = streams.read_json_stream(spark, f"{path}/in", "idx long, split string, prediction_raw string")
    graded = streams.grade_stream(arriving, rows.select("idx", "split", "instruction", "reference"), "numeric")
    streams.append_stream(graded, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return sinks.read_results(spark, f"{path}/out").select("idx", "correct", "answer")


def length_tokens():
    return lambda texts: [[len(w) for w in t.split(" ") if w] for t in texts]


@query(
    "stream_encode",
    """
    WITH w AS (
        SELECT conv_id, turn, list_append(list_transform(list_filter(string_split(trim(text, chr(9) || chr(10) || chr(13) || ' '), ' '), lambda t: t <> ''), lambda t: length(t)), -1) AS t
        FROM conversations)
    SELECT conv_id, turn, array_to_string(list_slice(t, 1, 32), ',') AS target FROM w
    """,
)
def stream_encode(spark, sf_dir):
    """Typed examples as a stream; the whole budget of 32 goes to the target because the prompt is cut first."""
    path = scratch(spark)
    table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lit("GSM_SV").alias("type"), F.col("text").alias("query"), F.col("text").alias("response")
    ).write.json(f"{path}/in")
    schema = "conv_id long, turn long, type string, query string, response string"
    arriving = streams.read_json_stream(spark, f"{path}/in", schema)
    tokenizer = ArrowTokenizer(length_tokens, eos_id=-1)
    encoded = streams.encode_stream(arriving, tokenizer, max_length=32, keep=["conv_id", "turn"])
    streams.append_stream(encoded, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    target = F.filter("labels", lambda i: i != -100)
    return spark.read.parquet(f"{path}/out").select("conv_id", "turn", joined(target).alias("target"))
