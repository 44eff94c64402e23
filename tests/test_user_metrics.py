"""Users' metrics, rank correlations, Gram sums and quantiles against plain Python."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.operators import counts, layers, metrics, user_metrics
from evalloom.operators.user_metrics import BinnedAuc, UserMetric


def spread():
    """A metric made here, so that it travels with its code."""

    class Spread(UserMetric):
        """Largest less smallest value, nothing for no values."""

        columns = ("v",)

        def start(self):
            return None

        def add(self, state, batch):
            values = [v for v in batch.column(0).to_pylist() if v is not None]
            return self.merge(state, (min(values), max(values)) if values else None)

        def merge(self, one, other):
            if one is None or other is None:
                return one or other
            return min(one[0], other[0]), max(one[1], other[1])

        def finish(self, state):
            return None if state is None else state[1] - state[0]

    return Spread()


@pytest.mark.parametrize("groups", [4096, 2])
def test_states_are_merged_per_group(spark, monkeypatch, groups):
    monkeypatch.setattr(user_metrics, "GROUPS", groups)
    rng = random.Random(groups)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, rng.random()])) for _ in range(3000)] + [("only nulls", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(7)
    got = {(r["g"], r["h"]): r["spread"] for r in user_metrics.user_metrics(df, {"spread": spread()}, ["g", "h"]).collect()}
    want = {}
    for g, h, v in rows:
        want.setdefault((g, h), []).extend([] if v is None else [v])
    assert got == {k: max(v) - min(v) if v else None for k, v in want.items()}
    whole = user_metrics.user_metrics(df, {"spread": spread(), "auc": BinnedAuc("v", "h")}).collect()
    assert len(whole) == 1 and whole[0]["auc"] is None
    assert user_metrics.user_metrics(df.filter("false"), {"spread": spread()}).collect() == []


def test_binned_auc():
    rng = np.random.default_rng(3)
    score, label = rng.random(500), rng.integers(0, 2, 500)
    metric = BinnedAuc(bins=50)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(score[a:b]), pa.array(label[a:b])], names=["score", "label"])
    state = metric.merge(metric.add(metric.start(), batch(0, 123)), metric.add(metric.start(), batch(123, 500)))
    place = np.floor(score * 50)
    pos, neg = place[label == 1], place[label == 0]
    want = sum((p > neg).sum() + (p == neg).sum() / 2 for p in pos) / (len(pos) * len(neg))
    assert metric.finish(state) == pytest.approx(want, abs=1e-12)
    odd = pa.RecordBatch.from_arrays([pa.array([None, 5.0, -5.0]), pa.array([1, None, 1])], names=["score", "label"])
    assert metric.finish(metric.add(metric.start(), odd)) is None


def test_registered_metrics(spark):
    metrics.register_metric("own task", "accuracy")
    metrics.register_metric("own task", "spread", spread())
    rows = [("a", 1, 1, 0.5), ("a", 0, 1, 2.0), (None, 1, 1, 3.0), (None, 1, 1, None)]
    df = spark.createDataFrame(rows, "g string, pred int, label int, v double")
    out = {r["g"]: (r["accuracy"], r["spread"]) for r in metrics.task_metric(df, "own task", ["g"]).collect()}
    assert out == {"a": (0.5, 1.5), None: (1.0, 0.0)}
    assert metrics.task_metric(df, "own task").first() == (0.75, 2.5)
    with pytest.raises(ValueError):
        metrics.register_metric("own task", "nothing")
    with pytest.raises(ValueError):
        metrics.register_metric("own task", "accuracy", spread())


def ranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


@pytest.mark.parametrize("few", [100_000, 3])
def test_correlations(spark, monkeypatch, few):
    monkeypatch.setattr(counts, "FEW", few)
    rng = random.Random(few)
    rows = [(rng.choice(["a", None]), float(rng.randint(0, 5)), 1e9 + rng.randint(0, 4)) for _ in range(200)]
    rows += [("flat", 1.0, float(i)) for i in range(4)] + [("a", None, 1.0), ("a", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, pred double, label double")
    got = {r["g"]: (r["pearson"], r["spearmanr"]) for r in metrics.task_metric(df, "stsb", ["g"]).collect()}
    assert got["flat"] == (None, None)
    for g in ("a", None):
        xs, ys = zip(*[(x, y) for h, x, y in rows if h == g and x is not None and y is not None])
        assert got[g] == pytest.approx((statistics.correlation(xs, ys), statistics.correlation(ranks(xs), ranks(ys))), abs=1e-9)
    whole = metrics.task_metric(df.filter("g is null"), "stsb").first()
    assert (whole["pearson"], whole["spearmanr"]) == pytest.approx(got[None], abs=1e-9)


def test_gram_sums_by_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"l{i % 3}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(90)] + [("l0", [1.0, 2.0]), ("l1", None), (None, [2.0])]
    df = spark.createDataFrame(rows, "layer string, vec array<double>").repartition(5)
    for held in (1024, 1):
        monkeypatch.setattr(layers, "HELD_LAYERS", held)
        got = {(r["layer"], r["i"], r["j"]): r["x"] for r in layers._gram(df, "x").collect()}
        want = {}
        for layer, v in rows:
            for i in range(len(v or [])):
                for j in range(i, len(v)):
                    want[layer, i, j] = want.get((layer, i, j), 0.0) + v[i] * v[j]
        assert got == want


@pytest.mark.parametrize(("bracket", "few"), [(10_000, 100_000), (50, 3)])
def test_quantiles_in_brackets(spark, monkeypatch, bracket, few):
    """Also with brackets so narrow that they must be widened, and a value that holds a third of all rows."""
    monkeypatch.setattr(layers, "BRACKET", bracket)
    monkeypatch.setattr(counts, "FEW", few)
    rng = random.Random(bracket)
    values = [rng.gauss(0, 9) for _ in range(2000)] + [1.25] * 1000 + [None, float("inf"), -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    qs = [0.0, 0.001, 0.25, 0.5, 0.6, 0.999, 1.0, -2.0, 3.0, 0.5]
    got = {r["q"]: r["quantile"] for r in layers.linear_quantile(df, "v", qs).collect()}
    own = sorted(v for v in values if v is not None)
    for q in qs:
        at = (len(own) - 1) * min(max(q, 0.0), 1.0)
        low, part = int(at), at - int(at)
        want = own[low] if part == 0 else own[low] * (1 - part) + own[low + 1] * part
        assert got[q] == want
    one = layers.linear_quantile(df.filter(F.col("v") == 1.25), "v", [0.3]).collect()
    assert [tuple(r) for r in one] == [(0.3, 1.25)]
