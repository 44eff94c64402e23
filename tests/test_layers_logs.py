import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evalloom.operators import layers, metrics, runlog


def test_rank_budget_and_histogram(spark):
    rng = random.Random(2)
    names = ["m.q", "m.k", "n.q"]
    rows = [(n, p, rng.choice([0.1, 0.2, 0.3, 0.4])) for n in names for p in range(6)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "layer string, pos int, value double, seq long")
    first = [(i, r) for i, r in enumerate(rows) if r[1] < 4]
    kept = sorted(first, key=lambda x: x[1][2])[-6:]
    want = {n: sum(1 for _, r in kept if r[0] == n) for n in names}
    got = {r["layer"]: r["assigned"] for r in layers.rank_budget(df, None, 2, redistribute=True).collect()}
    assert got == {n: c for n, c in want.items() if c}
    budget = layers.rank_budget(df, spark.createDataFrame([("q",)], "pattern string"), 2)
    assert {tuple(r) for r in budget.collect()} == {("m.q", 2), ("n.q", 2)}
    assert [tuple(r) for r in layers.rank_histogram(budget).collect()] == [(2, 2)]
    assert layers.keep_components(df, budget).count() == 4
    with pytest.raises(Exception, match="fewer than"):
        layers.rank_budget(df, None, 4, redistribute=True).collect()
    with pytest.raises(ValueError):
        layers.rank_budget(df, None, 1, redistribute=True, metric="x")


def test_suffix_and_shared(spark):
    df = spark.createDataFrame([("a.b.q",), ("a.bq",), ("q",), ("b.q.x",)], "layer string")
    pick = lambda *p: {r[0] for r in layers.match_suffix(df, spark.createDataFrame([(x,) for x in p], "pattern string")).collect()}
    assert pick("q") == {"a.b.q", "q"} and pick("b.q") == {"a.b.q"} and pick("x", "bq") == {"b.q.x", "a.bq"}
    kv = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", None), ("e", None)], "k string, v int")
    assert {tuple(r) for r in layers.shared_values(kv, "k", "v").collect()} == {(1, "a", 2), (1, "b", 2), (None, "d", 2), (None, "e", 2)}


def test_layer_energy(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(0)
    rows_a, rows_b, want = [], [], {}
    for layer in ("x", "y"):
        a, b = rng.normal(size=(3, 20)), rng.normal(size=(30, 3))
        want[layer] = float((np.linalg.svd(b @ a, compute_uv=False) ** 2).sum())
        rows_a += [(layer, j, [float(v) for v in a[:, j]]) for j in range(20)]
        rows_b += [(layer, i, [float(v) for v in b[i]]) for i in range(30)]
    schema = "layer string, row int, vec array<double>"
    out = layers.layer_energy(spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema))
    assert {r["layer"]: r["energy"] for r in out.collect()} == pytest.approx(want)


def quantile(xs, q):
    xs, q = sorted(xs), min(max(q, 0), 1)
    at = (len(xs) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return xs[lo] if lo == hi else xs[lo] * (1 - (at - lo)) + xs[hi] * (at - lo)


def test_quantile_betas_scales(spark):
    rng = random.Random(4)
    values = [rng.choice([1.0, 1.0, 2.0, rng.random() * 5]) for _ in range(101)]
    df = spark.createDataFrame([(f"l{i:03d}", v) for i, v in enumerate(values)], "layer string, energy double")
    qs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.5]
    got = {r["q"]: r["quantile"] for r in layers.linear_quantile(df, "energy", qs).collect()}
    assert got == pytest.approx({q: quantile(values, q) for q in qs})
    with pytest.raises(Exception, match="no rows"):
        layers.linear_quantile(df.filter("energy < 0"), "energy", [0.5]).collect()
    mean = statistics.fmean(values)
    ratios = [max(v / mean, 1e-12) for v in values]
    low, high = quantile(ratios, 0.01), quantile(ratios, 0.99)
    pos, neg = math.log(1.25) / math.log(high), min(10.0, math.log(0.8) / math.log(low))
    row = layers.infer_betas(df, 0.8, 1.25).first()
    assert (row["beta_pos"], row["beta_neg"]) == pytest.approx((pos, neg))
    flat = layers.infer_betas(df.withColumn("energy", F.lit(3.0)), 0.8, 1.25).first()
    assert (flat["beta_pos"], flat["beta_neg"], flat["r_low"], flat["r_high"]) == (0.0, 0.0, 1.0, 1.0)
    ends = layers.infer_betas(df, 0.8, 1.25, use_quantiles=False).first()
    assert ends["r_high"] == pytest.approx(max(ratios))
    with pytest.raises(ValueError):
        layers.infer_betas(df, 1.2, 1.25)

    def scale(r):
        x = math.log(max(r, 1e-12))
        s = 0.5 * (1 + math.tanh(x / 0.4))
        return math.exp((neg + (pos - neg) * s) * x)

    lay = spark.createDataFrame([(f"l{i:03d}", 3.0) for i in range(103)], "layer string, alpha double")
    for mode, want in (
        ("cleaned", [scale(v / mean) * 2 for v in values]),
        ("init", [scale(v / mean) * 3 for v in values]),
        ("distributed", [max(1 / 1.25, min((v / mean) ** 0.25, 1.25)) for v in values]),
    ):
        out = [r["alpha"] for r in layers.reallocate_scale(df, lay, mode).orderBy("layer").collect()]
        assert out == pytest.approx([*want, 3.0, 3.0])


def test_scale_history(spark):
    log = spark.createDataFrame([("a", 10, 2.0, 2.5), ("a", 20, 2.5, 1.5), ("b", 10, 2.0, 1.0)], "layer string, step long, old_alpha double, alpha double")
    out = [(r["layer"], r["pos"], r["alpha"]) for r in layers.scale_history(log).orderBy("layer", "pos").collect()]
    assert out == [("a", 0, 2.0), ("a", 1, 2.5), ("a", 2, 1.5), ("b", 0, 2.0), ("b", 1, 1.0)]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(6)
    rows = [("r0" if s % 3 else "r1", s, float(rng.randint(0, 30))) for s in range(400)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "run string, step long, value double").repartition(4)


def series(rows):
    out = {}
    for run, step, value in sorted(rows, key=lambda r: r[1]):
        out.setdefault(run, []).append((step, value))
    return out


def test_turning_points_and_jumps(log):
    rows, df = log
    turns, jumps = set(), set()
    for run, vals in series(rows).items():
        for i in range(1, len(vals)):
            if vals[i][0] > 50 and vals[i][1] > vals[i - 1][1] * (1 + 1e-12):
                jumps.add((run, vals[i][0]))
            if i > 1 and vals[i][1] - vals[i - 1][1] > 1e-12 >= vals[i - 1][1] - vals[i - 2][1]:
                turns.add((run, vals[i][0]))
    assert {tuple(r) for r in runlog.turning_points(df).collect()} == turns
    assert {tuple(r) for r in runlog.value_jumps(df, 50).collect()} == jumps


def test_checkpoints_and_early_stop(log):
    rows, df = log
    for greater in (True, False):
        sign = 1 if greater else -1
        best = {run: max(vals, key=lambda x: (sign * x[1], -x[0])) for run, vals in series(rows).items()}
        got = {r["run"]: (r["step"], r["value"]) for r in runlog.best_checkpoint(df, None, greater).collect()}
        assert got == best
        for patience in (3, 40, 1000):
            want = {}
            for run, vals in series(rows).items():
                top, bad, want[run] = None, 0, None
                for step, value in vals:
                    if top is None or sign * value > sign * top:
                        top, bad = value, 0
                    else:
                        bad += 1
                    if bad >= patience:
                        want[run] = step
                        break
            assert {r["run"]: r["stop_step"] for r in runlog.early_stop(df, None, patience, greater).collect()} == want
    long_tail = {(r["run"], r["step"]) for r in runlog.keep_last_n(df.union(df.withColumn("step", F.col("step") + 1000)).union(df.withColumn("step", F.col("step") + 2000)), 1001).collect()}
    assert len(long_tail) == sum(min(1001, 3 * len(v)) for v in series(rows).values()) and min(s for _, s in long_tail) >= 0
    newest = {(r["run"], r["step"]) for r in runlog.keep_last_n(df, 2).collect()}
    assert newest == {(run, s) for run, vals in series(rows).items() for s, _ in vals[-2:]}
    due = {(r["run"], r["step"]) for r in runlog.cadence(df, 50, 60, 30).collect()}
    last = {run: vals[-1][0] for run, vals in series(rows).items()}
    assert due == {(run, s) for run, s, _ in rows if s >= 60 and s % 50 == 0 and s <= last[run] - 30}


def test_metrics(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), [rng.random(), rng.random()], rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, logits array<double>, label int")
    for g in "ab":
        pairs = [(int(l[1] > l[0]), y) for k, l, y in rows if k == g]
        tp = sum(p == y == 1 for p, y in pairs)
        tn = sum(p == y == 0 for p, y in pairs)
        fp, fn = sum(p > y for p, y in pairs), sum(p < y for p, y in pairs)
        both = metrics.task_metric(df, "mrpc", ["g"]).filter(F.col("g") == g).first()
        assert both["accuracy"] == pytest.approx((tp + tn) / len(pairs)) and both["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
        mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        assert metrics.task_metric(df, "cola", ["g"]).filter(F.col("g") == g).first()[1] == pytest.approx(mcc)
    reg = [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(300)]

    def ranks(xs):
        return [sum(x < y for x in xs) + (sum(x == y for x in xs) + 1) / 2 for y in xs]

    xs, ys = zip(*reg)
    out = metrics.task_metric(spark.createDataFrame([([x], y) for x, y in reg], "logits array<double>, label double"), "stsb").first()
    assert out["pearson"] == pytest.approx(statistics.correlation(xs, ys))
    assert out["spearmanr"] == pytest.approx(statistics.correlation(ranks(xs), ranks(ys)))
    assert metrics.task_metric(df, "other") is None
    shapes = spark.createDataFrame([([[9.0, 1.0], [1.0, 2.0]], 0.5)], "deep array<array<double>>, one double")
    assert metrics.with_prediction(shapes, logits="deep").first()["pred"] == 1
    assert metrics.with_prediction(shapes, logits="one").first()["pred"] == 1
    wrapped = shapes.select(F.struct("deep", "one").alias("logits"))
    assert metrics.with_prediction(wrapped).first()["pred"] == 1
    ties = spark.createDataFrame([([2.0, 5.0, 5.0],)], "logits array<double>")
    assert metrics.with_prediction(ties).first()["pred"] == 1
    holes = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (9.0, None), (None, -5.0)], "pred double, label double")
    got = metrics.task_metric(holes, "stsb").first()
    assert got["pearson"] == pytest.approx(statistics.correlation([1, 2, 3], [2, 4, 7])) and got["spearmanr"] == pytest.approx(1.0)
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "pred double, label double")
    assert metrics.task_metric(constant, "stsb").first()["pearson"] is None
