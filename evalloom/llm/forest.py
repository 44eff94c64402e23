"""Approximate nearest neighbours by inner product: a forest of hash-prefix trees.

Vectors are lifted so that inner products become angles (one more component makes all norms
equal to the largest; queries get a zero there). In every tree a vector has a long string of hyperplane
bits; a tree is the sorted array of these strings, and the vectors below a tree node are a
run of it: those that share a prefix.

A query goes down every tree to its longest prefix matches: the deepest node with at least ``2 * (k + 1)`` vectors.
The best found give a lower bound for the k-th inner product, hence for the chance p that one bit
of a vector that good agrees. The query then goes up all trees together, to the deepest level x at
which such a vector is missed by all trees with a chance of at most ``MISS``: (1 - p^x)^trees <= MISS. Everything
below those nodes is scored, with no cap on candidates. Where a level would be the root, one tree is
read whole, which is exact.

The trees are cut at a prefix that leaves about ``CELL_ROWS`` vectors in a cell, which is the unit of work: vectors are
shuffled by (tree, cell), queries visit the cells of their node, and cells that hold far more are
salted. Equal vectors are one entry with the smallest k + 1 of their ids, which is all that any answer can need,
so a vector that holds a third of all rows is one row here.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null vec_id; of several vectors with one id the least (in array order) counts; vectors meet only
those of their own dimension; ties go to the smaller id; fewer candidates than k give all of
them; an empty table gives no rows; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalloom.sources.scratch import settle

TREES = 16
BITS = 48
MISS = 0.05
CELL_ROWS = 4096
SEED = 20
#: More entries than k + 1 are kept until scores are exact, for sums that differ in their last bit.
SPARE = 4


def codes_of(x: np.ndarray, largest: float, query: bool, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Bit strings (as integers) of every row in every tree: rows by trees."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1] + 1, trees * bits))
    lifted = x @ planes[:-1]
    if not query:
        lifted += np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))[:, None] * planes[-1]
    weight = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    return ((lifted > 0).reshape(len(x), trees, bits) * weight).sum(axis=2)


def level_for(bound: np.ndarray, norm: np.ndarray, largest: float, trees: int = TREES, miss: float = MISS, bits: int = BITS) -> np.ndarray:
    """Deepest level that a vector at least as good as ``bound`` is missed at with chance ``miss`` at most."""
    p = 1 - np.arccos(np.clip(bound / (norm * np.sqrt(largest)), -1, 1)) / np.pi
    need = np.log(1 - miss ** (1 / trees))
    with np.errstate(divide="ignore"):
        level = np.where(p >= 1, bits, np.floor(need / np.log(np.clip(p, 1e-9, 1 - 1e-12))))
    return np.where(np.isfinite(bound), np.clip(level, 0, bits), 0).astype(np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _by_dim(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from ((int(d), part) for d, part in batch.groupby("dim"))


def _placed(frame: DataFrame, shape: dict[int, tuple[float, int]]) -> DataFrame:
    """Entries (gid, dim, v) in every tree: adds tree, cell, code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, whole in _by_dim(batch):
                largest, depth = shape[dim]
                for lo in range(0, len(whole), 1000):
                    part = whole.iloc[lo : lo + 1000]
                    codes = codes_of(_matrix(part["v"]), largest, False)
                    n = len(part)
                    yield pd.DataFrame(
                        {
                            "dim": dim, "tree": np.tile(np.arange(TREES), n), "cell": (codes >> (BITS - depth)).ravel(),
                            "code": codes.ravel(), "gid": np.repeat(part["gid"].to_numpy(), TREES), "v": np.repeat(part["v"].to_numpy(), TREES),
                        }
                    )

    return frame.select("gid", "dim", "v").mapInPandas(run, "dim int, tree int, cell long, code long, gid long, v array<double>")


def _asked(frame: DataFrame, shape: dict[int, tuple[float, int]], bounded: bool) -> DataFrame:
    """Queries (gid, dim, v, bound) in the cells they visit: level -1 asks for the longest matches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, whole in _by_dim(batch):
                largest, depth = shape[dim]
                for at in range(0, len(whole), 1000):
                    part = whole.iloc[at : at + 1000]
                    x = _matrix(part["v"])
                    codes = codes_of(x, largest, True)
                    gid, v = part["gid"].to_numpy(), part["v"].to_numpy()
                    level = np.full(len(part), -1)
                    if bounded:
                        level = level_for(part["bound"].to_numpy(np.float64), np.sqrt((x * x).sum(axis=1)), largest)
                    shift = np.where(level < 0, 0, np.maximum(0, depth - level))
                    row, tree = np.divmod(np.arange(len(part) * TREES), TREES)
                    keep = (level[row] != 0) | (tree == 0)
                    row, tree = row[keep], tree[keep]
                    times = np.int64(1) << shift[row]
                    cell = codes[row, tree] >> (BITS - depth) >> shift[row] << shift[row]
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, tree, cell = np.repeat(row, times), np.repeat(tree, times), np.repeat(cell, times) + step
                    yield pd.DataFrame({"dim": dim, "tree": tree, "cell": cell, "code": codes[row, tree], "gid": gid[row], "v": v[row], "level": level[row]})

    columns = ["gid", "dim", "v", *(["bound"] if bounded else [])]
    return frame.select(*columns).mapInPandas(run, "dim int, tree int, cell long, code long, gid long, v array<double>, level int")


def _search(keep: int, least: int):
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "gid": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(entries) or not len(queries):
            return empty
        entries = entries.sort_values(["code", "gid"])
        code, ids, x = entries["code"].to_numpy(), entries["gid"].to_numpy(), _matrix(entries["v"])
        asked, level = queries["code"].to_numpy(), queries["level"].to_numpy().copy()
        # Down: the deepest node that still holds enough.
        waiting = np.flatnonzero(level < 0)
        for depth in range(BITS, -1, -1):
            lo, hi = _run(code, asked[waiting], np.full(len(waiting), depth))
            done = (hi - lo >= least) | (depth == 0)
            level[waiting[done]] = depth
            waiting = waiting[~done]
            if not len(waiting):
                break
        lo, hi = _run(code, asked, level)
        own, v = queries["gid"].to_numpy(), _matrix(queries["v"])
        out = []
        runs, which = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(runs) + 1))
        for i, (a, b) in enumerate(runs):
            members = order[edges[i] : edges[i + 1]]
            if a == b:
                continue
            step = max(1, (1 << 22) // (b - a))
            for s in range(0, len(members), step):
                rows = members[s : s + step]
                scores = v[rows] @ x[a:b].T
                n = min(keep, b - a)
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < b - a else np.tile(np.arange(n), (len(rows), 1))
                out.append(pd.DataFrame({"q": np.repeat(own[rows], n), "gid": ids[a:b][top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel()}))
        return pd.concat(out) if out else empty

    return run


def _run(code: np.ndarray, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = BITS - level
    first = asked >> shift << shift
    return np.searchsorted(code, first, "left"), np.searchsorted(code, first + (np.int64(1) << shift), "left")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best entries of every query, each once."""
    once = found.groupBy("q", "gid").agg(F.max("score").alias("score"))
    order = W.partitionBy("q").orderBy(F.desc("score"), "gid")
    return once.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vec_id, embedding`` where ``is_query`` (of vec_id) holds."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    rows = settle(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    ids = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(is_query).select("v").distinct().withColumn("q", F.lit(True))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    entries = settle(ids.join(asked, "v", "left").select(
        F.element_at("ids", 1).alias("gid"), F.size("v").alias("dim"), "v", "ids", F.coalesce("q", F.lit(False)).alias("q"), norm.alias("norm")
    ))
    # One row per dimension: as many as there are embedding models in the table.
    shape = {}
    for r in entries.groupBy("dim").agg(F.max("norm").alias("m"), F.count(F.lit(1)).alias("n")).collect():
        depth = 0
        while r["n"] > CELL_ROWS << depth and depth < BITS:
            depth += 1
        shape[r["dim"]] = (r["m"], depth)

    placed = _placed(entries, shape)
    keys = ["dim", "tree", "cell"]
    sizes = settle(placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (4 * CELL_ROWS)).alias("salts")))
    salted = placed.join(sizes, keys).withColumn("salt", F.pmod(F.xxhash64("gid"), F.col("salts"))).drop("salts")
    keep = k + 1 + SPARE

    def visit(queries: DataFrame) -> DataFrame:
        spread = queries.join(sizes, keys).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
        spread = spread.select(*[F.col(c).alias(f"q_{c}") for c in (*keys, "salt")], "code", "gid", "v", "level")
        left = salted.groupBy(*keys, "salt")
        right = spread.groupBy(*[f"q_{c}" for c in (*keys, "salt")])
        return _best(left.cogroup(right).applyInPandas(_search(keep, 2 * (k + 1)), "q long, gid long, score double"), keep)

    wanted = entries.filter("q")
    down = settle(visit(_asked(wanted, shape, False)))
    bounds = down.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    bounds = bounds.select(F.col("q").alias("_q"), F.try_element_at("s", F.lit(k + 1)).alias("bound"))
    again = wanted.join(bounds, F.col("gid") == F.col("_q"), "left")
    up = visit(_asked(again, shape, True))
    # A query's own entry (its copies) needs no search; with unequal norms its strings may differ from the query's.
    own = wanted.select(F.col("gid").alias("q"), "gid", F.col("norm").alias("score"))
    pairs = _best(down.unionAll(up).unionAll(own), keep).select(F.col("q").alias("q_gid"), F.col("gid").alias("c_gid"))

    # Exact scores of what was found, in a fixed order of summation.
    of = entries.select(F.col("gid").alias("q_gid"), F.col("v").alias("q_v"))
    to = entries.select(F.col("gid").alias("c_gid"), F.col("v").alias("c_v"), "ids")
    dot = F.aggregate(F.zip_with("q_v", "c_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(of, "q_gid").join(to, "c_gid").select("q_gid", dot.alias("score"), F.explode("ids").alias("vec_id"))
    first = W.partitionBy("q_gid").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    lists = scored.groupBy("q_gid").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("found"))
    lists = lists.join(entries.select(F.col("gid").alias("q_gid"), F.col("v").alias("_v")), "q_gid").select("_v", "found")
    members = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "v")
    answers = members.join(lists, F.col("v") == F.col("_v"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("_p", "_x")).select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score")
    )
