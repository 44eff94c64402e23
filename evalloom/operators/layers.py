"""Per-layer statistics: rank budgets, energies, scale factors, quantiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.arrays import power_scale
from evalloom.operators.counts import lower_rows
from evalloom.operators.ranges import global_rank, lookup, running_before, sorted_rank
from evalloom.operators.user_metrics import groups_of
from evalloom.sources.scratch import settle

BUDGET_METRICS = ("ratio", "raw", "sum", "max")
BETA_LIMIT = 10.0


def name_suffixes(name: Column) -> Column:
    """All dotted endings of a name, the name itself first."""
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )


def match_suffix(df: DataFrame, patterns: DataFrame, name: str = "layer", pattern: str = "pattern") -> DataFrame:
    """Rows whose dotted name ends in one of the patterns, part by part.

    Distinct names are expanded into their endings, which turns the suffix test into an equality join.
    """
    names = df.groupBy(name).agg(F.count("*").alias("_n"))
    endings = names.select(name, "_n", F.explode(name_suffixes(F.col(name))).alias("_ending"))
    wanted = patterns.select(F.col(pattern).alias("_ending")).distinct()
    hits = endings.join(wanted, "_ending", "left_semi").select(name, "_n").distinct()
    return lookup(df, hits, [name], "_n", "inner")


def rank_budget(
    values: DataFrame,
    targets: DataFrame | None,
    rank: int,
    rho: int = 2,
    redistribute: bool = False,
    metric: str = "ratio",
) -> DataFrame:
    """Ranks per layer as (layer, assigned).

    ``values`` is (layer, pos, …) with one numeric column per metric; a plain ``value``
    column serves any metric. With ``redistribute`` the largest ``rank * layers`` of the
    first ``rank * rho`` values of every layer win, later rows first on ties: by ``seq``, a
    unique row number, where there is one, else by layer name and position. Layers that
    win nothing are left out.
    """
    if metric not in BUDGET_METRICS:
        raise ValueError(f"metric must be one of {', '.join(BUDGET_METRICS)}")
    if redistribute and rho < 1:
        raise ValueError("rho must be at least 1")
    kept = values if targets is None else settle(match_suffix(values, targets))
    wanted = rank * rho if redistribute else rank
    sizes = kept.groupBy("layer").agg(F.count("*").alias("_size"))
    enough = F.when(F.col("_size") >= wanted, F.lit(rank)).otherwise(
        F.raise_error(F.concat(F.lit(f"fewer than {wanted} values in layer "), "layer")).cast("int")
    )
    if not redistribute:
        return sizes.select("layer", enough.cast("long").alias("assigned"))
    column = "value" if "value" in kept.columns else metric
    columns = ["layer", "pos", column, *(["seq"] if "seq" in kept.columns else [])]
    first = settle(kept.filter(F.col("pos") < wanted).select(*columns))
    if "seq" in kept.columns:
        ranked = global_rank(first, -F.col(column), -F.col("seq"), "_rank")
    else:
        ranked = sorted_rank(first, [F.desc(column), F.desc("layer"), F.desc("pos")], "_rank")
    budget = sizes.agg(F.sum(enough)).scalar()
    return (
        ranked.withColumn("_budget", budget)
        .filter(F.col("_rank") <= F.col("_budget"))
        .groupBy("layer")
        .agg(F.count("*").alias("assigned"))
    )


def keep_components(values: DataFrame, budget: DataFrame) -> DataFrame:
    """Components of every layer up to its assigned rank."""
    return values.join(budget, "layer").filter(F.col("pos") < F.col("assigned")).drop("assigned")


def rank_histogram(budget: DataFrame) -> DataFrame:
    return budget.groupBy("assigned").agg(F.count("*").alias("layers"))


def shared_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (value, key, n) for values held by more than one key.

    Stays in long form: a value may be held by any number of keys.
    """
    # A struct key, so that keys sharing a null value are found too.
    keyed = df.select(F.struct(value).alias("_value"), key)
    counts = keyed.groupBy("_value").agg(F.count("*").alias("_w")).filter(F.col("_w") > 1)
    found = lookup(keyed, counts.withColumn("n", F.col("_w")), ["_value"], "_w", "inner")
    return found.select(f"_value.{value}", key, "n")


#: Layers whose sums a task holds before it sends them on.
HELD_LAYERS = 1024


def _gram(factor: DataFrame, name: str) -> DataFrame:
    """Sum of outer products per layer as (layer, i, j, name), ``i <= j``.

    A task adds up a matrix per layer and sends that: what is shuffled is bounded by tasks, layers and the square of the
    rank, whatever the number of rows. A missing element counts as zero.
    """
    kind = factor.schema["layer"].dataType.simpleString()

    def sent(sums: dict, layers: pa.DataType) -> pa.RecordBatch:
        rows = [(layer, i, j, float(x[i, j])) for layer, x in sums.items() for i in range(len(x)) for j in range(i, len(x))]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        arrays = [pa.array(c, t) for c, t in zip(columns, (layers, pa.int32(), pa.int32(), pa.float64()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["layer", "i", "j", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        layers = pa.string()
        for batch in batches:
            layers = batch.schema.field(0).type
            for (layer,), rows in groups_of(batch, 1):
                vectors = rows.column(1).drop_null()
                sizes = np.diff(vectors.offsets.to_numpy())
                width = int(sizes.max()) if len(sizes) else 0
                dense = np.zeros((len(sizes), width))
                inside = np.arange(width) < sizes[:, None]
                dense[inside] = vectors.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                held = sums.get(layer, np.zeros((0, 0)))
                size = max(len(held), width)
                total = np.zeros((size, size))
                total[: len(held), : len(held)] = held
                total[:width, :width] += dense.T @ dense
                sums[layer] = total
            if len(sums) > HELD_LAYERS:
                yield sent(sums, layers)
                sums = {}
        if sums:
            yield sent(sums, layers)

    parts = factor.select("layer", "vec").mapInArrow(add, f"layer {kind}, i int, j int, x double")
    return parts.groupBy("layer", "i", "j").agg(F.sum("x").alias(name))


def layer_energy(factor_a: DataFrame, factor_b: DataFrame) -> DataFrame:
    """Squared Frobenius norm of each layer's low-rank product, as (layer, energy).

    Both factors are (layer, row, vec) with ``vec`` of adapter-rank length: a row per
    output for B, a row per input for A. Only their small Gram matrices are joined.
    """
    both = _gram(factor_a, "a").join(_gram(factor_b, "b"), ["layer", "i", "j"])
    weight = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return both.groupBy("layer").agg(F.sum(weight * F.col("a") * F.col("b")).alias("energy"))


def attach_layer_stat(layers: DataFrame, stats: DataFrame) -> DataFrame:
    """Layer statistics onto the layer list; layers without one keep null."""
    return layers.join(stats, "layer", "left")


#: Accuracy of the sketch that finds where quantiles lie: ranks are off by a share of 1 / BRACKET at most.
BRACKET = 10_000


def _brackets(values: DataFrame, shares: Sequence[float], margin: float) -> tuple[int, list[tuple[float, float]]]:
    """Number of rows and, for every share, two values that should lie around it, ``margin`` of all ranks away."""
    ends = [(c - margin, c + margin) for c in shares]
    asked = sorted({e for pair in ends for e in pair if 0 < e < 1}) or [0.5]
    n, found = values.agg(F.count("*"), F.percentile_approx("_v", asked, BRACKET)).first()
    at = dict(zip(asked, found or [], strict=False))
    # No number is below the first bound and none, not even NaN, above the last.
    return n, [(at.get(lo, -math.inf), at.get(hi, math.nan)) for lo, hi in ends]


def linear_quantile(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles (q, quantile) with linear interpolation; q is clamped to [0, 1], no rows is an error.

    A sketch gives a bracket around every wanted rank. Rows below it are only counted; the values inside, a few
    ten-thousandths of all rows, are counted by value, and the end points are selected among them. Where a bracket misses its
    rank it is widened. No task holds all values, and only counts inside the brackets are shuffled.
    """
    asked = list(dict.fromkeys(float(q) for q in qs))
    shares = [min(max(q, 0.0), 1.0) for q in asked]
    values = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    margin = 2 / BRACKET
    while True:
        n, brackets = _brackets(values, shares, margin)
        if not n:
            raise ValueError("quantile of no rows")
        ends = [(math.floor((n - 1) * c), math.ceil((n - 1) * c)) for c in shares]
        below = list(values.agg(*[F.count_if(F.col("_v") < lo) for lo, _ in brackets]).first())
        spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(brackets)])
        around = F.filter(spans, lambda s: (F.col("_v") >= s["lo"]) & (F.col("_v") <= s["hi"]))
        placed = values.select("_v", F.explode(F.transform(around, lambda s: s["i"])).alias("_i"))
        inside = settle(placed.groupBy("_i", "_v").agg(F.count("*").alias("_n")))
        held = {r["_i"]: r["n"] for r in inside.groupBy("_i").agg(F.sum("_n").alias("n")).collect()}
        if all(low >= b and high < b + held.get(i, 0) for i, ((low, high), b) in enumerate(zip(ends, below, strict=True))):
            break
        margin *= 8
    pick = lambda numbers, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in numbers]), F.col("_i") + 1)
    start = lower_rows(inside, ["_i"], "_v", "_n", "_before").withColumn("_start", F.col("_before") + pick(below, "long"))
    # A value is an end point when the rank below or above the wanted position falls on it.
    covers = lambda rank: (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_n"))
    low, high = pick([x for x, _ in ends], "long"), pick([x for _, x in ends], "long")
    found = start.groupBy("_i").agg(F.max(F.when(covers(low), F.col("_v"))).alias("_lo"), F.max(F.when(covers(high), F.col("_v"))).alias("_hi"))
    part = pick([(n - 1) * c - math.floor((n - 1) * c) for c in shares], "double")
    between = F.when(part == 0, F.col("_lo")).otherwise(F.col("_lo") * (1 - part) + F.col("_hi") * part)
    return found.select(pick(asked, "double").alias("q"), between.alias("quantile"))


def infer_betas(
    energy: DataFrame,
    alpha_min: float,
    alpha_max: float,
    q_low: float = 0.01,
    q_high: float = 0.99,
    use_quantiles: bool = True,
    eps: float = 1e-12,
) -> DataFrame:
    """One row (beta_pos, beta_neg, r_low, r_high, mean) from a (layer, energy) table.

    The exponents map the high and low ratio to ``alpha_max`` and ``alpha_min``; a side
    without ratios beyond 1 gets exponent 0. Both stay within [0, 10].
    """
    if not 0 < alpha_min < 1 < alpha_max:
        raise ValueError("need 0 < alpha_min < 1 < alpha_max")
    energy = settle(energy)
    ratios = energy.withColumn("_mean", energy.agg(F.avg("energy")).scalar()).select(
        "_mean", F.greatest(F.col("energy") / F.col("_mean"), F.lit(eps)).alias("_ratio")
    )
    if use_quantiles:
        ends = linear_quantile(ratios, "_ratio", [q_low, q_high])
        ends = ends.agg(
            F.max(F.when(F.col("q") == q_low, F.col("quantile"))).alias("low"),
            F.max(F.when(F.col("q") == q_high, F.col("quantile"))).alias("high"),
        )
    else:
        ends = ratios.agg(F.min("_ratio").alias("low"), F.max("_ratio").alias("high"))
    ends = ends.withColumn("mean", energy.agg(F.avg("energy")).scalar())
    up, down = F.col("high") > 1.0 + 1e-15, F.col("low") < 1.0 - 1e-15
    clamp = lambda beta: F.least(F.greatest(beta, F.lit(0.0)), F.lit(BETA_LIMIT))
    return ends.select(
        clamp(F.when(up, F.try_divide(F.lit(math.log(alpha_max)), F.ln("high"))).otherwise(0.0)).alias("beta_pos"),
        clamp(F.when(down, F.try_divide(F.lit(math.log(alpha_min)), F.ln("low"))).otherwise(0.0)).alias("beta_neg"),
        F.when(down, F.col("low")).otherwise(1.0).alias("r_low"),
        F.when(up, F.col("high")).otherwise(1.0).alias("r_high"),
        "mean",
    )


REALLOCATION_MODES = ("cleaned", "init", "distributed")


def reallocate_scale(
    energy: DataFrame,
    layers: DataFrame,
    mode: str,
    base: float = 2.0,
    alpha_min: float = 0.8,
    alpha_max: float = 1.25,
    power: float = 0.25,
    clip: float | None = 1.25,
) -> DataFrame:
    """New ``alpha`` per layer of (layer, alpha); layers without energy keep theirs.

    ``cleaned``: factor times ``base``; ``init``: factor times the current value;
    ``distributed``: ``ratio ^ power``, clipped to [1/clip, clip].
    """
    if mode not in REALLOCATION_MODES:
        raise ValueError(f"mode must be one of {', '.join(REALLOCATION_MODES)}")
    energy = settle(energy)
    joined = attach_layer_stat(layers, energy)
    if mode == "distributed":
        scaled = joined.withColumn("_mean", energy.agg(F.avg("energy")).scalar())
        raised = F.pow(F.col("energy") / F.col("_mean"), F.lit(power))
        if clip is not None and clip > 0:
            raised = F.greatest(F.lit(1.0 / clip), F.least(raised, F.lit(clip)))
        new = raised
    else:
        betas = infer_betas(energy, alpha_min, alpha_max).select(F.struct("*").alias("b")).scalar()
        scaled = joined.withColumn("_b", betas)
        factor = power_scale(F.col("energy") / F.col("_b.mean"), F.col("_b.beta_pos"), F.col("_b.beta_neg"))
        new = factor * (F.lit(base) if mode == "cleaned" else F.col("alpha"))
    changed = F.when(F.col("energy").isNotNull(), new).otherwise(F.col("alpha").cast("double"))
    return scaled.select(*[c for c in layers.columns if c != "alpha"], changed.alias("alpha"))


def scale_history(log: DataFrame) -> DataFrame:
    """History rows (layer, pos, step, alpha): position 0 is the value before the first change.

    ``log`` is (layer, step, old_alpha, alpha). A layer may have any number of steps, so
    the history stays one row per value.
    """
    rows = log.select("layer", "step", "old_alpha", "alpha", F.lit(1).alias("_one"))
    counted = running_before(rows, ["layer"], "step", "_one", "_before")
    new = F.struct((F.col("_before") + 1).alias("pos"), F.col("step"), F.col("alpha"))
    old = F.struct(F.lit(0).cast("long").alias("pos"), F.col("step"), F.col("old_alpha").alias("alpha"))
    both = F.when(F.col("_before") == 0, F.array(old, new)).otherwise(F.array(new))
    return counted.select("layer", F.inline(both))

