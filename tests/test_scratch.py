"""What a stored step leaves on disk, and how often op4 moves its hashes."""

import re
import time

from pyspark.sql import functions as F

from evalloom.llm import jaccard
from evalloom.sources.scratch import FREE_SHUFFLES, settle


def shuffles(spark):
    """Numbers of the shuffles whose files are on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return set(re.findall(r"shuffle_(\d+)_", files))


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before, setting = shuffles(spark), spark.conf.get(FREE_SHUFFLES, None)
    rows = spark.range(0, 10_000, 1, 8).groupBy((F.col("id") % 100).alias("k")).count()
    stored = settle(rows)
    until = time.time() + 20
    while len(shuffles(spark) - before) > 1 and time.time() < until:
        time.sleep(0.2)
    # The one left belongs to the count of the rows read back: one row a task.
    assert len(shuffles(spark) - before) <= 1
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
    assert stored.agg(F.sum("count")).first()[0] == 10_000


def test_hashes_are_moved_once(spark):
    rows = spark.createDataFrame(
        [(1, 1, 20, 5, list(range(6))), (2, 2, 20, 6, list(range(6))), (3, 3, 20, 6, list(range(6))), (4, 4, 20, 7, list(range(50, 56)))],
        "doc_id long, mark long, n long, g long, heads array<long>",
    )
    found = jaccard._survivors(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(h#", plan)) == 1
    assert {tuple(r) for r in found.collect()} == {(5, 20, 1), (6, 20, 2)}
