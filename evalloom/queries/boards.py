"""Leaderboards, result rows and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions.formats import cell_json, format_10g, init_label, record_json
from evalloom.operators import leaderboard as lb
from evalloom.operators import metrics, results
from evalloom.operators.user_metrics import BinnedAuc
from evalloom.queries.registry import query, table


@query(
    "leaderboard_mean_std",
    """
    SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS l_extendedprice_mean,
           round(coalesce(stddev_samp(l_extendedprice), 0.0), 4) AS l_extendedprice_std,
           count(*) AS l_extendedprice_n
    FROM lineitem GROUP BY 1, 2
    """,
)
def leaderboard_mean_std(spark, sf_dir):
    board = lb.leaderboard(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return board.select(
        "l_returnflag",
        "l_linestatus",
        F.round("l_extendedprice_mean", 4).alias("l_extendedprice_mean"),
        F.round("l_extendedprice_std", 4).alias("l_extendedprice_std"),
        "l_extendedprice_n",
    )


@query(
    "leaderboard_by_source",
    """
    WITH rows AS (
        SELECT 'orders.parquet' AS source_path, o_orderpriority AS k, o_orderstatus AS s, o_totalprice AS v FROM orders
        UNION ALL
        SELECT 'customer.parquet', c_mktsegment, CASE WHEN c_acctbal < 0 THEN NULL ELSE ' ' || c_mktsegment END, c_acctbal
        FROM customer)
    SELECT source_path, trim(k) AS k, trim(coalesce(s, '')) AS s, round(avg(v), 4) AS v_mean,
           round(coalesce(stddev_samp(v), 0.0), 4) AS v_std, count(*) AS v_n
    FROM rows GROUP BY 1, 2, 3
    """,
)
def leaderboard_by_source(spark, sf_dir):
    source = F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("source_path")
    orders = table(spark, sf_dir, "orders").select(
        source,
        F.col("o_orderpriority").alias("k"),
        F.col("o_orderstatus").alias("s"),
        F.col("o_totalprice").cast("string").alias("v"),
    )
    customers = table(spark, sf_dir, "customer").select(
        source,
        F.col("c_mktsegment").alias("k"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit(" "), "c_mktsegment")).alias("s"),
        F.col("c_acctbal").cast("string").alias("v"),
    )
    board = lb.leaderboard(orders.unionByName(customers), lb.key_list(["k", "s"], ["k"]), "v", by_source=True)
    return board.select(
        "source_path", "k", "s", F.round("v_mean", 4).alias("v_mean"), F.round("v_std", 4).alias("v_std"), "v_n"
    )


@query(
    "leaderboard_macro_mean",
    """
    WITH averages AS (
        SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_quantity) AS q,
               CASE WHEN l_linenumber <> 3 THEN avg(l_discount) END AS d, avg(l_tax) AS t
        FROM lineitem GROUP BY 1, 2, 3),
    pooled AS (
        SELECT l_returnflag, l_linestatus, q AS v FROM averages
        UNION ALL SELECT l_returnflag, l_linestatus, d FROM averages
        UNION ALL SELECT l_returnflag, l_linestatus, t FROM averages)
    SELECT l_returnflag, l_linestatus, round(avg(v), 6) AS metric_eval_mean_avg, count(*) AS metric_eval_mean_n
    FROM pooled WHERE v IS NOT NULL GROUP BY 1, 2
    """,
)
def leaderboard_macro_mean(spark, sf_dir):
    averages = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus", "l_linenumber")
        .agg(
            F.avg("l_quantity").alias("metric_eval_quantity_mean"),
            F.avg("l_discount").alias("_d"),
            F.avg("l_tax").alias("metric_eval_tax_mean"),
            F.stddev_samp("l_tax").alias("metric_eval_tax_std"),
        )
    )
    blank = F.when(F.col("l_linenumber") == 3, F.lit(" ")).otherwise(F.col("_d").cast("string"))
    board = lb.macro_mean(
        averages.withColumn("metric_eval_discount_mean", blank), ["l_returnflag", "l_linestatus"]
    )
    return board.withColumn("metric_eval_mean_avg", F.round("metric_eval_mean_avg", 6))


@query(
    "results_append",
    """
    SELECT o_orderkey AS id, o_totalprice AS metric, o_orderstatus AS status, NULL::VARCHAR AS segment FROM orders
    UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer
    """,
)
def results_append(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("metric"), F.col("o_orderstatus").alias("status")
    )
    new = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("metric")
    )
    return results.append_rows(old, new)


@query(
    "result_row_build",
    """
    WITH m AS (SELECT l_orderkey, round(avg(l_quantity), 6) AS q, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT 't' || o_orderkey AS timestamp, o_orderpriority AS base_model, 'glue' AS dataset_name,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS subset,
           CASE o_orderstatus WHEN 'F' THEN 'kaiming' WHEN 'O' THEN '' ELSE 'pissa' END AS init_lora_weights,
           '' AS extra, CAST(o_custkey AS VARCHAR) AS seed, o_totalprice / 60 AS run_time,
           q AS metric_eval_quantity, n AS metric_eval_lines,
           CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 64 ELSE 16 END AS BIGINT) AS r,
           '["' || o_orderpriority || '", "' || o_orderstatus || '"]' AS target_modules,
           CAST(o_orderkey AS VARCHAR) AS run_name
    FROM orders JOIN m ON l_orderkey = o_orderkey
    """,
)
def result_row_build(spark, sf_dir):
    status = F.col("o_orderstatus")
    adapter = F.struct(
        F.concat(F.lit("org/"), "o_orderpriority").alias("base_model_name_or_path"),
        F.when(status == "F", "True").when(status != "O", "pissa").alias("init_lora_weights"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 64).alias("r"),
        F.lit(16).cast("long").alias("lora_r"),
        F.array("o_orderpriority", "o_orderstatus").alias("target_modules"),
    )
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_name"),
        F.concat(F.lit("t"), "o_orderkey").alias("timestamp"),
        F.lit("glue").alias("dataset_name"),
        F.when(status == "P", "").otherwise(status).alias("subset"),
        F.col("o_custkey").alias("seed"),
        (F.col("o_totalprice") / 60).alias("run_time"),
        adapter.alias("adapter"),
    )
    measured = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("run_name"))
        .agg(F.round(F.avg("l_quantity"), 6).alias("eval_quantity"), F.count("*").alias("eval_lines"))
    )
    return results.result_rows(measured, runs, ["run_name"])


@query(
    "adapter_join",
    """
    SELECT o_orderkey, CAST('c' || o_custkey AS VARCHAR) AS adapter_path, c_mktsegment AS model, c_nationkey AS r
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey
    """,
)
def adapter_join(spark, sf_dir):
    adapters = (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_acctbal") >= 0)
        .select(
            F.concat(F.lit("c"), "c_custkey").alias("adapter_path"),
            F.struct(
                F.col("c_mktsegment").alias("base_model_name_or_path"), F.col("c_nationkey").alias("r")
            ).alias("adapter"),
        )
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("adapter_path"))
    return results.attach_adapter(rows, adapters).select(
        "o_orderkey", "adapter_path", F.col("adapter.base_model_name_or_path").alias("model"), F.col("adapter.r").alias("r")
    )


@query(
    "accuracy_rows",
    """
    SELECT o_orderpriority AS model, o_orderstatus AS dataset,
           printf('%.5f', avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END)) AS accuracy, count(*) AS n
    FROM orders GROUP BY 1, 2
    """,
)
def accuracy_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("dataset")
    )
    hits = F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0)
    return results.accuracy_rows(rows.agg(F.avg(hits).alias("accuracy"), F.count("*").alias("n")), ["n"])


@query(
    "cell_formats",
    """
    SELECT o_orderkey, printf('%.10g', o_totalprice / 7) AS ten, printf('%.10g', o_totalprice * 1e9) AS big,
           printf('%.10g', 1 / (o_totalprice * 1000)) AS small,
           CASE o_orderstatus WHEN 'F' THEN 'kaiming' WHEN 'O' THEN '' ELSE o_orderpriority END AS init,
           '["' || o_orderpriority || '", "a\\"b"]' AS cell, '{"s":"' || o_orderstatus || '","k":' || o_orderkey || '}' AS record
    FROM orders
    """,
)
def cell_formats(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        format_10g(F.col("o_totalprice") / 7).alias("ten"),
        format_10g(F.col("o_totalprice") * 1e9).alias("big"),
        format_10g(1 / (F.col("o_totalprice") * 1000)).alias("small"),
        init_label(F.when(status == "F", "TRUE").when(status != "O", F.col("o_orderpriority"))).alias("init"),
        cell_json(F.array("o_orderpriority", F.lit('a"b'))).alias("cell"),
        record_json(F.struct(status.alias("s"), F.col("o_orderkey").alias("k"))).alias("record"),
    )


@query(
    "argmax_accuracy",
    """
    SELECT label, avg(CASE WHEN list_position(v, list_max(v)) - 1 = label THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM (SELECT label, embedding AS v FROM embeddings) GROUP BY 1
    """,
)
def argmax_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("logits")
    )
    return metrics.task_metric(rows.withColumn("g", F.col("label")), "sst2", ["g"]).withColumnRenamed("g", "label")


@query(
    "sequence_logits",
    """
    SELECT vec_id, CAST(list_position(last, list_max(last)) - 1 AS INTEGER) AS deep,
           CAST(embedding[1] > 0 AS INTEGER) AS single, CAST(embedding[3] AS DOUBLE) AS squeezed
    FROM (SELECT vec_id, embedding, list_slice(embedding, 33, 64) AS last FROM embeddings)
    """,
)
def sequence_logits(spark, sf_dir):
    vec = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.struct(F.array(F.slice(vec, 1, 32), F.slice(vec, 33, 32)).alias("out"), vec.alias("state")).alias("deep"),
        F.element_at(vec, 1).alias("single"),
        F.slice(vec, 3, 1).alias("squeezed"),
    )
    out = rows
    for name in ("deep", "single", "squeezed"):
        out = metrics.with_prediction(out, name == "squeezed", name).drop(name).withColumnRenamed("pred", name)
    return out


PREDICTED = """
    SELECT d.lang, CASE WHEN d.n_chars > 1200 THEN 1 ELSE 0 END AS p, l.quality AS y
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id
"""


def _predicted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "lang", (F.col("n_chars") > 1200).cast("int").alias("pred"), F.col("quality").alias("label")
    )


@query(
    "binary_f1",
    f"""
    SELECT lang, round(avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
           round(coalesce(2.0 * sum(CASE WHEN p = 1 AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(p + y), 0), 0.0), 9) AS f1
    FROM ({PREDICTED}) GROUP BY 1
    """,
)
def binary_f1(spark, sf_dir):
    out = metrics.task_metric(_predicted(spark, sf_dir), "mrpc", ["lang"])
    return out.select("lang", F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


@query(
    "matthews",
    f"""
    WITH c AS (
        SELECT lang, sum(CASE WHEN p = 1 AND y = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS tp,
               sum(CASE WHEN p = 0 AND y = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS tn,
               sum(CASE WHEN p = 1 AND y = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS fp,
               sum(CASE WHEN p = 0 AND y = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS fn
        FROM ({PREDICTED}) GROUP BY 1)
    SELECT lang, round(coalesce((tp * tn - fp * fn)
           / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0), 9) AS matthews_correlation
    FROM c
    """,
)
def matthews(spark, sf_dir):
    out = metrics.task_metric(_predicted(spark, sf_dir), "cola", ["lang"])
    return out.withColumn("matthews_correlation", F.round("matthews_correlation", 9))


@query(
    "pearson_spearman",
    """
    WITH r AS (
        SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y,
               rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
                   + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
                   + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry
        FROM lineitem)
    SELECT l_returnflag, round(corr(x, y), 6) AS pearson, round(corr(rx::DOUBLE, ry::DOUBLE), 6) AS spearmanr
    FROM r GROUP BY 1
    """,
)
def pearson_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.col("l_quantity").alias("pred"), F.col("l_extendedprice").alias("label")
    )
    out = metrics.task_metric(rows, "stsb", ["l_returnflag"])
    return out.select(
        "l_returnflag", F.round("pearson", 6).alias("pearson"), F.round("spearmanr", 6).alias("spearmanr")
    )


@query(
    "average_ranks",
    """
    SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value)
           + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS value_rank
    FROM events
    """,
)
def average_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return metrics.average_rank(rows, "value", ["event_type"]).drop("value")


AUC_BINS = 64


class PriceAuc(BinnedAuc):
    """How well a price tells returned lines from others."""

    def __init__(self):
        super().__init__("l_extendedprice", "returned", AUC_BINS, 0.0, 100000.0)


@query(
    "user_metric_auc",
    f"""
    WITH b AS (
        SELECT l_linestatus, greatest(0, least({AUC_BINS - 1}, CAST(floor(l_extendedprice * {AUC_BINS} / 100000.0) AS BIGINT))) AS bin,
               count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg
        FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY l_linestatus ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
    a AS (
        SELECT l_linestatus, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS share FROM lineitem GROUP BY 1)
    SELECT l_linestatus, CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / CAST(2 * sum(pos) * sum(neg) AS DOUBLE) AS auc, round(any_value(share), 9) AS accuracy
    FROM c JOIN a USING (l_linestatus) GROUP BY 1
    """,
)
def user_metric_auc(spark, sf_dir):
    """A user's metric and a built-in one of one task, per line status."""
    metrics.register_metric("returns", "accuracy")
    metrics.register_metric("returns", "auc", PriceAuc())
    returned = (F.col("l_returnflag") == "R").cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_extendedprice", returned.alias("returned"))
    out = metrics.task_metric(rows.withColumns({"pred": F.lit(1), "label": F.col("returned")}), "returns", ["l_linestatus"])
    return out.withColumn("accuracy", F.round("accuracy", 9))
