"""Layer statistics over embeddings, suppliers and orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evalloom.functions.arrays import power_scale
from evalloom.operators import layers as ops
from evalloom.queries.registry import query, table

RANK, RHO = 8, 2
LAYER_VALUES = """
    SELECT 'block.' || (vec_id // 2) || CASE vec_id % 2 WHEN 0 THEN '.attn.q' ELSE '.attn.k' END AS layer,
           unnest(range(64)) AS pos, CAST(abs(unnest(embedding)) AS DOUBLE) AS value, vec_id FROM embeddings
"""
BUDGET = f"""
    WITH v AS (SELECT *, vec_id * 64 + pos AS seq FROM ({LAYER_VALUES}) WHERE layer LIKE '%.q')
    SELECT layer, count(*) AS assigned FROM (
        SELECT layer FROM v WHERE pos < {RANK * RHO} ORDER BY value DESC, seq DESC
        LIMIT (SELECT {RANK} * count(DISTINCT layer) FROM v)) GROUP BY 1
"""


def _values(spark, sf_dir):
    kind = F.when(F.col("vec_id") % 2 == 0, ".attn.q").otherwise(".attn.k")
    name = F.concat(F.lit("block."), F.floor(F.col("vec_id") / 2).cast("string"), kind)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", name.alias("layer"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select(
        "layer", "pos", F.abs(F.col("v")).cast("double").alias("value"), (F.col("vec_id") * 64 + F.col("pos")).alias("seq")
    )


def _budget(spark, sf_dir):
    targets = spark.createDataFrame([("attn.q",)], "pattern string")
    return ops.rank_budget(_values(spark, sf_dir), targets, RANK, RHO, redistribute=True)


@query("rank_budget", BUDGET)
def rank_budget(spark, sf_dir):
    return _budget(spark, sf_dir)


@query(
    "rank_budget_flat",
    f"SELECT DISTINCT layer, {RANK}::BIGINT AS assigned FROM ({LAYER_VALUES})",
)
def rank_budget_flat(spark, sf_dir):
    return ops.rank_budget(_values(spark, sf_dir), None, RANK)


@query("rank_histogram", f"SELECT assigned, count(*) AS layers FROM ({BUDGET}) GROUP BY 1")
def rank_histogram(spark, sf_dir):
    return ops.rank_histogram(_budget(spark, sf_dir))


@query(
    "keep_components",
    f"""
    SELECT v.layer, CAST(v.pos AS INTEGER) AS pos, v.value FROM ({LAYER_VALUES}) v JOIN ({BUDGET}) b ON b.layer = v.layer
    WHERE v.pos < b.assigned
    """,
)
def keep_components(spark, sf_dir):
    return ops.keep_components(_values(spark, sf_dir), _budget(spark, sf_dir)).select("layer", "pos", "value")


@query(
    "suffix_match",
    """
    SELECT DISTINCT p_partkey, layer FROM (
        SELECT p_partkey, lower(p_type) || '.' || lower(p_brand) || '.' || replace(p_name, ' ', '.') AS layer FROM part)
    JOIN (SELECT 'ring' AS pattern UNION ALL SELECT 'red.widget' UNION ALL SELECT 'brand#2.small.ring' UNION ALL SELECT 'dget')
        ON layer = pattern OR ends_with(layer, '.' || pattern)
    """,
)
def suffix_match(spark, sf_dir):
    name = F.concat_ws(".", F.lower("p_type"), F.lower("p_brand"), F.replace("p_name", F.lit(" "), F.lit(".")))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("layer"))
    patterns = spark.createDataFrame([("ring",), ("red.widget",), ("brand#2.small.ring",), ("dget",)], "pattern string")
    return ops.match_suffix(rows, patterns)


@query(
    "shared_values",
    """
    SELECT o_custkey, o_orderkey, n FROM (
        SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1
    """,
)
def shared_values(spark, sf_dir):
    return ops.shared_values(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


FACTOR = """
    SELECT label AS layer, vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings
"""


@query(
    "layer_energy",
    f"""
    WITH f AS ({FACTOR}),
    g AS (
        SELECT a.layer, a.vec_id % 2 AS side, a.i, b.i AS j, sum(a.x * b.x) AS s
        FROM f a JOIN f b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3, 4)
    SELECT 'label.' || p.layer AS layer, round(sum(p.s * q.s), 6) AS energy
    FROM g p JOIN g q ON p.layer = q.layer AND p.i = q.i AND p.j = q.j AND p.side = 0 AND q.side = 1 GROUP BY 1
    """,
)
def layer_energy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label."), F.col("label").cast("string")).alias("layer"),
        F.col("vec_id").alias("row"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    out = ops.layer_energy(rows.filter("row % 2 = 0"), rows.filter("row % 2 = 1"))
    return out.withColumn("energy", F.round("energy", 6))


@query(
    "linear_quantile",
    """
    SELECT q, round(CASE q WHEN 0.0 THEN quantile_cont(l_extendedprice, 0.0) WHEN 0.01 THEN quantile_cont(l_extendedprice, 0.01)
        WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) WHEN 0.99 THEN quantile_cont(l_extendedprice, 0.99)
        ELSE quantile_cont(l_extendedprice, 1.0) END, 4) AS quantile
    FROM lineitem, (SELECT unnest([0.0, 0.01, 0.5, 0.99, 1.0])::DOUBLE AS q) GROUP BY q
    """,
)
def linear_quantile(spark, sf_dir):
    out = ops.linear_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.0, 0.01, 0.5, 0.99, 1.0])
    return out.withColumn("quantile", F.round("quantile", 4))


# Layer energy is the discounted revenue of a supplier. Negative keys stand for layers without energy.
LOW, HIGH = 0.8, 1.25
ENERGY = """
    SELECT l_suppkey AS layer, sum(CAST(l_extendedprice * 100 AS BIGINT) * CAST(l_discount * 100 AS BIGINT)) / 1e6 AS energy
    FROM lineitem GROUP BY 1
"""
BETAS = f"""
    WITH e AS ({ENERGY}), m AS (SELECT avg(energy) AS mean FROM e),
    r AS (SELECT greatest(energy / mean, 1e-12) AS ratio, mean FROM e, m),
    q AS (SELECT quantile_cont(ratio, 0.01) AS low, quantile_cont(ratio, 0.99) AS high, max(mean) AS mean FROM r)
    SELECT least(greatest(CASE WHEN high > 1 + 1e-15 THEN {math.log(HIGH)!r}::DOUBLE / ln(high) ELSE 0.0 END, 0.0), 10.0) AS beta_pos,
           least(greatest(CASE WHEN low < 1 - 1e-15 THEN {math.log(LOW)!r}::DOUBLE / ln(low) ELSE 0.0 END, 0.0), 10.0) AS beta_neg,
           CASE WHEN low < 1 - 1e-15 THEN low ELSE 1.0 END AS r_low, CASE WHEN high > 1 + 1e-15 THEN high ELSE 1.0 END AS r_high, mean
    FROM q
"""


def _energy(spark, sf_dir):
    parts = F.round(F.col("l_extendedprice") * 100).cast("long") * F.round(F.col("l_discount") * 100).cast("long")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("layer"))
        .agg((F.sum(parts) / 1e6).alias("energy"))
    )


@query(
    "infer_betas",
    f"""
    SELECT round(beta_pos, 6) AS beta_pos, round(beta_neg, 6) AS beta_neg, round(r_low, 6) AS r_low,
           round(r_high, 6) AS r_high, round(mean, 4) AS mean FROM ({BETAS})
    """,
)
def infer_betas(spark, sf_dir):
    out = ops.infer_betas(_energy(spark, sf_dir), LOW, HIGH)
    return out.select(
        *[F.round(c, 6).alias(c) for c in ("beta_pos", "beta_neg", "r_low", "r_high")], F.round("mean", 4).alias("mean")
    )


LAYERS = "(SELECT s_suppkey, s_acctbal, s_name FROM supplier UNION ALL SELECT -s_suppkey, s_acctbal, s_name FROM supplier)"


def _layers(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("layer"), F.col("s_acctbal").alias("alpha"), "s_name")
    return suppliers.unionByName(suppliers.withColumn("layer", -F.col("layer")))


def _scaled_sql(factor: str, source: str) -> str:
    return f"""
    SELECT s_suppkey AS layer, round(CASE WHEN energy IS NULL THEN s_acctbal ELSE {factor} END, 4) AS alpha
    FROM {LAYERS} LEFT JOIN ({ENERGY}) ON layer = s_suppkey CROSS JOIN ({source})
    """


POWER = """
    exp((beta_neg + (beta_pos - beta_neg) * (1 + tanh(ln(greatest(energy / mean, 1e-12)) / 0.4)) / 2)
        * ln(greatest(energy / mean, 1e-12)))
"""


def _scaled(spark, sf_dir, mode):
    layers = _layers(spark, sf_dir).drop("s_name")
    out = ops.reallocate_scale(_energy(spark, sf_dir), layers, mode, base=2.0, alpha_min=LOW, alpha_max=HIGH)
    return out.withColumn("alpha", F.round("alpha", 4))


@query("scale_realloc_cleaned", _scaled_sql(f"2.0 * {POWER}", BETAS))
def scale_realloc_cleaned(spark, sf_dir):
    return _scaled(spark, sf_dir, "cleaned")


@query("scale_realloc_init", _scaled_sql(f"s_acctbal * {POWER}", BETAS))
def scale_realloc_init(spark, sf_dir):
    return _scaled(spark, sf_dir, "init")


@query(
    "scale_realloc_distributed",
    _scaled_sql(
        "greatest(1 / 1.25::DOUBLE, least(pow(energy / mean, 0.25), 1.25::DOUBLE))",
        f"SELECT avg(energy) AS mean FROM ({ENERGY})",
    ),
)
def scale_realloc_distributed(spark, sf_dir):
    return _scaled(spark, sf_dir, "distributed")


@query(
    "power_scale",
    """
    SELECT o_orderkey, round(exp((0.25 + 0.25 * (1 + tanh(ln(r) / 0.4)) / 2) * ln(r)), 6) AS scale
    FROM (SELECT o_orderkey, greatest(o_totalprice / 100000, 1e-12) AS r FROM orders)
    """,
)
def power_scale_rows(spark, sf_dir):
    scale = power_scale(F.col("o_totalprice") / 100000, F.lit(0.5), F.lit(0.25))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scale, 6).alias("scale"))


@query(
    "layer_stat_join",
    f"SELECT s_suppkey AS layer, s_name, round(energy, 4) AS energy FROM {LAYERS} LEFT JOIN ({ENERGY}) ON layer = s_suppkey",
)
def layer_stat_join(spark, sf_dir):
    layers = _layers(spark, sf_dir).drop("alpha")
    return ops.attach_layer_stat(layers, _energy(spark, sf_dir)).withColumn("energy", F.round("energy", 4))


@query(
    "scale_history",
    """
    WITH e AS (SELECT user_id AS layer, event_id AS step, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)
    SELECT layer, pos, step, value AS alpha FROM e UNION ALL SELECT layer, 0, step, value + 1 FROM e WHERE pos = 1
    """,
)
def scale_history(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("layer"), F.col("event_id").alias("step"), (F.col("value") + 1).alias("old_alpha"),
        F.col("value").alias("alpha"),
    )
    return ops.scale_history(log)

