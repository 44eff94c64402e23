"""Run-log queries over the event table: users are runs, events are steps, event types are metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import runlog
from evalloom.queries.registry import query, table

LOG = "SELECT user_id AS run, event_id AS step, event_type AS name, value FROM events"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value"
    )


@query(
    "turning_points",
    f"""
    WITH l AS (
        SELECT run, step, value AS r0, lag(value, 1) OVER w AS r1, lag(value, 2) OVER w AS r2
        FROM ({LOG}) WINDOW w AS (PARTITION BY run ORDER BY step))
    SELECT run, step FROM l WHERE r0 - r1 > 1e-12 AND r1 - r2 <= 1e-12
    """,
)
def turning_points(spark, sf_dir):
    return runlog.turning_points(_log(spark, sf_dir))


@query(
    "turning_points_grouped",
    f"""
    WITH l AS (
        SELECT run, step, value AS r0, lag(value, 1) OVER w AS r1, lag(value, 2) OVER w AS r2
        FROM ({LOG}) WINDOW w AS (PARTITION BY run, name ORDER BY step))
    SELECT DISTINCT run, step FROM l WHERE r0 - r1 > 1e-12 AND r1 - r2 <= 1e-12
    """,
)
def turning_points_grouped(spark, sf_dir):
    return runlog.turning_points(_log(spark, sf_dir).withColumnRenamed("name", "grp"))


@query(
    "value_jumps",
    f"""
    WITH l AS (SELECT run, step, value, lag(value) OVER (PARTITION BY run ORDER BY step) AS prev FROM ({LOG}))
    SELECT run, step FROM l WHERE step > 100 AND value > prev * (1 + 1e-12)
    """,
)
def value_jumps(spark, sf_dir):
    return runlog.value_jumps(_log(spark, sf_dir), 100)


@query(
    "best_checkpoint_max",
    f"""
    SELECT run, step, value FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, step) AS rn FROM ({LOG}) WHERE name = 'click')
    WHERE rn = 1
    """,
)
def best_checkpoint_max(spark, sf_dir):
    return runlog.best_checkpoint(_log(spark, sf_dir), "click")


@query(
    "best_checkpoint_min",
    f"""
    SELECT run, step, value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, step) AS rn FROM ({LOG}))
    WHERE rn = 1
    """,
)
def best_checkpoint_min(spark, sf_dir):
    return runlog.best_checkpoint(_log(spark, sf_dir), None, greater=False)


@query(
    "keep_last_n",
    f"""
    SELECT run, step, name, value FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM ({LOG})) WHERE rn <= 3
    """,
)
def keep_last_n(spark, sf_dir):
    return runlog.keep_last_n(_log(spark, sf_dir), 3)


def _early_sql(sign: str, where: str) -> str:
    return f"""
    WITH l AS (SELECT run, step, {sign}value AS v, row_number() OVER (PARTITION BY run ORDER BY step) AS pos FROM ({LOG}) {where}),
    p AS (SELECT *, max(v) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l),
    i AS (SELECT *, max(CASE WHEN best IS NULL OR v > best THEN pos END) OVER (PARTITION BY run ORDER BY pos) AS last FROM p)
    SELECT run, min(CASE WHEN pos - last >= 5 THEN step END) AS stop_step FROM i GROUP BY 1
    """


@query("early_stop_max", _early_sql("", ""))
def early_stop_max(spark, sf_dir):
    return runlog.early_stop(_log(spark, sf_dir), None, 5)


@query("early_stop_min", _early_sql("-", "WHERE name = 'click'"))
def early_stop_min(spark, sf_dir):
    return runlog.early_stop(_log(spark, sf_dir), "click", 5, greater=False)


@query(
    "cadence",
    f"""
    WITH l AS (SELECT *, max(step) OVER (PARTITION BY run) AS last FROM ({LOG}))
    SELECT run, step, value FROM l WHERE step >= 10 AND step % 10 = 0 AND step >= 100 AND step <= last - 50
    """,
)
def cadence(spark, sf_dir):
    return runlog.cadence(_log(spark, sf_dir), 10, 100, 50).select("run", "step", "value")


@query(
    "run_rates",
    """
    SELECT o_orderkey AS run, o_totalprice / 60 AS minutes, o_totalprice / nullif(o_custkey % 50, 0) AS sec_per_step,
           (o_custkey % 50) / o_totalprice AS steps_per_sec, o_custkey / o_totalprice AS samples_per_sec FROM orders
    """,
)
def run_rates(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("seconds"), (F.col("o_custkey") % 50).alias("steps"),
        F.col("o_custkey").alias("samples"),
    )
    return runlog.run_rates(runs).drop("seconds", "steps", "samples")
