"""Positional helpers against plain Python, with one group holding most rows and many ties."""

import random

import pytest
from pyspark.sql import functions as F

from evalloom.operators import ranges, runlog, splits


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for step in range(600):
        out.append(("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), step, rng.choice([1.0, 1.0, 2.0, 0.5, 3.0])))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, step long, v double").repartition(5)


def test_global_rank_with_ties(frame, rows):
    ranked = ranges.global_rank(frame, F.col("v"), F.col("step"), "rank").collect()
    want = {step: i + 1 for i, (_, step, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}
    assert {r["step"]: r["rank"] for r in ranked} == want
    assert len(ranked) == len(rows)


def test_running_before(frame, rows):
    got = {r["step"]: r["b"] for r in ranges.running_before(frame, ["g"], "step", "v", "b").collect()}
    sums, want = {}, {}
    for g, step, v in sorted(rows, key=lambda r: r[1]):
        want[step] = sums.get(g, 0)
        sums[g] = want[step] + v
    assert got == pytest.approx(want)


def test_previous_rows(frame, rows):
    got = ranges.previous_rows(frame, ["g"], "step", "v", 3).collect()
    history, want = {}, {}
    for g, step, v in sorted(rows, key=lambda r: r[1]):
        past = history.setdefault(g, [])
        want[step] = tuple((past[-k] if len(past) >= k else None) for k in (1, 2, 3))
        past.append(v)
    assert {r["step"]: (r["v_lag1"], r["v_lag2"], r["v_lag3"]) for r in got} == want


def test_lookup_heavy_and_rare(spark):
    # 60,000 rows: one key is half of them, so it is above a ten-thousandth; the 20,000 singles are not.
    rows = spark.range(60000).select(F.when(F.col("id") < 30000, 0).otherwise(F.col("id") % 25000 + 1).alias("k"), "id")
    table = rows.filter("k < 20000").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("n"), "k"))
    out = ranges.lookup(rows, table, ["k"], "n")
    assert out.columns == ["k", "id", "name"]
    bad = out.filter(~F.col("name").eqNullSafe(F.when(F.col("k") < 20000, F.concat(F.lit("n"), F.col("k").cast("string")))))
    assert bad.count() == 0 and out.count() == 60000
    assert ranges.lookup(rows, table, ["k"], "n", "inner").count() == rows.filter("k < 20000").count()


def test_index_and_slices(spark):
    df = splits.with_index(spark.range(0, 5000, 7).withColumnRenamed("id", "key").repartition(6), "key")
    assert [tuple(r) for r in df.orderBy("key").collect()] == [(k, i) for i, k in enumerate(range(0, 5000, 7))]
    words = ["b", "a", "\u00e9", "z", "abcdefghijklmnopq", "abcdefghijklmnopr", "abcdefg", "Z", ""] + [f"prefix/of/path/{i}" for i in range(300)]
    named = splits.with_index(spark.createDataFrame([(w,) for w in words], "w string").repartition(5), "w")
    assert [r["w"] for r in named.orderBy("idx").collect()] == sorted(words, key=lambda w: w.encode())
    five = spark.range(5).withColumnRenamed("id", "idx")
    take = lambda e: sorted(r["idx"] for r in splits.split_slice(five, e).collect())
    assert [take(e) for e in ("train[:3]", "train[2:]", "train[2:4]", "train[2]", "train", "train[3:3]")] == [
        [0, 1, 2], [2, 3, 4], [2, 3], [2], [0, 1, 2, 3, 4], [],
    ]
    for bad in ("train[:10%]", "train[-1:]", "train[x]"):
        with pytest.raises(ValueError):
            splits.split_slice(five, bad)
    with pytest.raises(IndexError):
        splits.split_slice(five, "train[:6]")
    named = five.withColumn("split", F.when(F.col("idx") < 2, "test").otherwise("train"))
    assert splits.split_slice(named, "test").count() == 2
    assert splits.split_slice(five, "train[:6]", strict=False).count() == 5


def test_batches_shards_chunks(spark):
    def sizes(n, make, column):
        out = make(spark.range(n).withColumnRenamed("id", "idx")).groupBy(column).count().orderBy(column).collect()
        return [r["count"] for r in out]

    assert sizes(10, lambda d: splits.batch_id(d, 4), "batch_id") == [4, 6]
    assert sizes(3, lambda d: splits.batch_id(d, 4), "batch_id") == [3]
    assert sizes(8, lambda d: splits.batch_id(d, 4), "batch_id") == [4, 4]
    assert sizes(11, lambda d: splits.even_chunks(d, 4), "chunk") == [3, 3, 3, 2]
    assert sizes(3, lambda d: splits.even_chunks(d, 5), "chunk") == [1, 1, 1]
    shards = splits.shard_sizes(spark.range(10).withColumnRenamed("id", "idx"), 4).orderBy("shard").collect()
    assert [r["rows"] for r in shards] == [3, 3, 2, 2]
    assert splits.shard_sizes(spark.range(2).withColumnRenamed("id", "idx"), 3).filter("rows = 0").count() == 1


def test_seeded_sample(spark):
    import hashlib

    df = spark.range(3000).withColumnRenamed("id", "idx").repartition(4)
    for n, seed in ((0, 1), (10, 1), (500, 85), (3000, 2)):
        want = sorted(range(3000), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[:n]
        assert [r["idx"] for r in splits.seeded_sample(df, n, seed).collect()] == want
    with pytest.raises(Exception, match="larger than the data"):
        splits.seeded_sample(df, 3001, 1).collect()
    assert splits.default_seed(42) == 85


def test_names_and_sets(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "idx long, k string")
    assert [r["k"] for r in splits.ordered_distinct(df, "k").collect()] == ["b", "a"]
    one = spark.createDataFrame([("b",)], "k string")
    assert [r["k"] for r in splits.name_difference(df.select("k"), one).collect()] == ["a"]
    assert splits.keep_keys(df, one, "k").count() == 2 and splits.union_shards(df, df).count() == 6
    assert splits.map_batches(df, lambda p: p[p.k == "b"], df.schema).count() == 2
    with pytest.raises(ValueError):
        splits.check_splits(["x", "math"], ["gsm8k", "math"])
    assert splits.parse_splits("a, b,") == ["a", "b"]


def test_hot_groups_are_cut(spark):
    """A group or a value that holds nearly all rows is spread over ranges, none of which is large."""
    rows = spark.range(20000).select(F.col("id").alias("step"), F.lit("hot").alias("g"), F.lit(1.0).alias("v"))
    ranged = ranges.add_range(rows, ["g"], "step").groupBy("g", "_range").count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 20000 / 4
    mixed = rows.withColumn("g", F.when(F.col("step") % 2 == 0, F.lit(None)).otherwise(F.col("step").cast("string")))
    parts = ranges.add_range(mixed, ["g"], "step").groupBy(F.col("g").isNull(), "_range").count().collect()
    assert len(parts) == 9 and max(r["count"] for r in parts if r["_range"] > 0) < 20000 / 4
    plan = ranges.global_rank(rows, F.col("v"), F.col("step"), "rank")
    assert plan.agg(F.max("rank"), F.countDistinct("rank")).first()[0:2] == (20000, 20000)
    # One value for all rows: the ranks still come out of several windows, cut by the tie column.
    sizes = plan.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


def test_slice_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "idx").withColumn("x", F.lit("a")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    text = splits.split_slice(df, "train[10:20]").select("idx")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(idx,10)" in text and "LessThan(idx,20)" in text and "ReadSchema: struct<idx:bigint>" in text


def test_plans_stay_small_with_many_ranges(spark):
    """The range search must not be inlined into filters: its text would grow threefold per halving."""
    from evalloom.operators import layers, runlog

    log = spark.range(1000).select((F.col("id") % 2).alias("run"), F.col("id").alias("step"), F.rand(1).alias("value"))
    log = ranges.settle(log)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "512")
    try:
        frames = [
            runlog.turning_points(log),
            runlog.early_stop(log, None, 3),
            layers.linear_quantile(log, "value", [0.5]),
            ranges.global_rank(log, F.col("value"), F.col("step"), "r").filter("r < 10"),
            splits.with_index(log, "step").filter("idx < 10"),
        ]
        for df in frames:
            assert len(df._jdf.queryExecution().executedPlan().toString()) < 500_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _both_ways(spark, rows, call):
    """Results for one run ``r``: alone (cut into ranges) and among many small runs (not cut)."""
    schema = "run string, step long, value double"
    alone = call(spark.createDataFrame(rows, schema)).filter("run = 'r'").collect()
    crowd = [(f"x{i}", 1, 1.0) for i in range(40 * len(rows))]
    among = call(spark.createDataFrame(rows + crowd, schema)).filter("run = 'r'").collect()
    return sorted(map(str, alone)), sorted(map(str, among))


def test_null_steps_count_alike_in_cut_and_small_groups(spark):
    rows = [("r", None, 9.0), ("r", 1, 1.0), ("r", 2, 2.0), ("r", 3, 3.0), ("r", 4, 2.0)]
    calls = {
        "sums": lambda df: ranges.running_before(df, ["run"], "step", "value", "before"),
        "lags": lambda df: ranges.previous_rows(df, ["run"], "step", "value", 2),
        "turns": runlog.turning_points,
        "stop": lambda df: runlog.early_stop(df, None, 2),
        "last": lambda df: runlog.keep_last_n(df, 4),
        "many": lambda df: runlog.keep_last_n(df, 1001),
    }
    for name, call in calls.items():
        cut, small = _both_ways(spark, rows, call)
        assert cut == small, (name, cut, small)
    kept = runlog.keep_last_n(spark.createDataFrame(rows, "run string, step long, value double"), 4)
    assert sorted(r["step"] for r in kept.collect()) == [1, 2, 3, 4]
    assert runlog.keep_last_n(spark.createDataFrame([("r", i, 0.0) for i in range(1100)] + [("r", None, 0.0)], "run string, step long, value double"), 1001).count() == 1001


def test_long_common_prefixes_spread(spark):
    frame = spark.range(20000).select(F.concat(F.lit("https://example.org/item/"), F.col("id").cast("string")).alias("key"))
    placed = frame.repartitionByRange(8, "key").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in placed) < 20000 / 3
    ranked = splits.with_index(frame, "key").collect()
    assert [r["key"] for r in sorted(ranked, key=lambda r: r["idx"])] == sorted(r["key"] for r in ranked)
    assert sorted(r["idx"] for r in ranked) == list(range(20000))
    assert splits.with_index(frame.limit(0), "key").count() == 0


def test_lookup_spreads_null_keys(spark):
    rows = spark.range(40000, numPartitions=8).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"), "id")
    table = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.lit("x"))
    out = ranges.lookup(rows, table, ["k"], "n")
    assert out.filter(F.col("name").isNotNull() != F.col("k").isNotNull()).count() == 0 and out.count() == 40000
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 40000 / 2
