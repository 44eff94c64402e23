"""Metrics with a state of their own: rows are added batch by batch, states of tasks are merged."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose states a task holds before it sends them on.
GROUPS = 4096


class UserMetric:
    """A user's metric. ``columns`` are what it reads; the four steps make, fill, join and read a state.

    A state is whatever can be pickled. ``merge`` must give the same whatever the order, since rows come in batches of
    any size, and batches in tasks of any number. ``finish`` gives a number, or None where there is none.
    """

    columns: Sequence[str] = ("pred", "label")

    def start(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, batch: pa.RecordBatch) -> Any:
        raise NotImplementedError

    def merge(self, one: Any, other: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> float | None:
        raise NotImplementedError


def groups_of(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of every group of a batch, by its first ``keys`` columns; null is a key like any other."""
    if not keys or not batch.num_rows:
        if batch.num_rows:
            yield (), batch
        return
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):
        column = batch.column(i).dictionary_encode(null_encoding="encode")
        code = code * max(1, len(column.dictionary)) + column.indices.to_numpy(zero_copy_only=False)
        # Codes stay below the number of rows.
        _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    for rows in np.split(order, cuts):
        part = batch.take(pa.array(rows))
        yield tuple(part.column(i)[0].as_py() for i in range(keys)), part


def user_metrics(df: DataFrame, metrics: Mapping[str, UserMetric], by: Sequence[str] = ()) -> DataFrame:
    """Columns ``by`` and one double per metric, a row per group; without ``by`` one row, if there are rows at all.

    Every task adds its rows to states by group and sends on one state per group (more where it meets over ``GROUPS``
    groups), so what is shuffled is bounded by tasks and groups, and a group of any size is merged from a few states.
    """
    by, named = list(by), dict(metrics)
    read = list(dict.fromkeys(c for m in named.values() for c in m.columns))
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(read)])
    keys = [f"_k{i}" for i in range(len(by))]
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]

    def seen_by(metric: UserMetric, part: pa.RecordBatch) -> pa.RecordBatch:
        columns = [part.column(len(keys) + read.index(c)) for c in metric.columns]
        return pa.RecordBatch.from_arrays(columns, names=list(metric.columns))

    def sent(states: dict[tuple, list], schema: pa.Schema) -> pa.RecordBatch:
        raw = pa.array([pickle.dumps(s) for s in states.values()], pa.binary())
        columns = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*states, strict=True))]
        return pa.RecordBatch.from_arrays([*columns, raw], names=[*keys, "_state"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        for batch in batches:
            for key, part in groups_of(batch, len(keys)):
                held = states.setdefault(key, None) or [m.start() for m in named.values()]
                states[key] = [m.add(s, seen_by(m, part)) for m, s in zip(named.values(), held, strict=True)]
            if len(states) > GROUPS:
                yield sent(states, batch.schema)
                states = {}
        if states:
            yield sent(states, batch.schema)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        found = None
        for raw in frame["_state"]:
            own = pickle.loads(raw)
            found = own if found is None else [m.merge(a, b) for m, a, b in zip(named.values(), found, own, strict=True)]
        done = [m.finish(s) for m, s in zip(named.values(), found, strict=True)]
        values = {f"_m{i}": [np.nan if v is None else float(v)] for i, v in enumerate(done)}
        return pd.DataFrame({**{k: frame[k].iloc[:1].reset_index(drop=True) for k in keys}, **values, "_none": [[v is None for v in done]]})

    states = rows.mapInArrow(add, ", ".join([*kinds, "_state binary"]))
    columns = [f"_m{i} double" for i in range(len(named))]
    grouped = states.groupBy(*keys) if keys else states.withColumn("_all", F.lit(0)).groupBy("_all")
    out = grouped.applyInPandas(merge, ", ".join([*kinds, *columns, "_none array<boolean>"]))
    values = [F.when(~F.col("_none")[i], F.col(f"_m{i}")).alias(name) for i, name in enumerate(named)]
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *values)


class BinnedAuc(UserMetric):
    """Area under the curve of scores in equal bins from ``low`` to ``high``; scores of one bin count as tied.

    Scores beyond the ends go to the outer bins; rows without score or label do not count. Null where a class is missing.
    """

    def __init__(self, score: str = "score", label: str = "label", bins: int = 1024, low: float = 0.0, high: float = 1.0) -> None:
        self.columns = (score, label)
        self.bins, self.low, self.high = bins, low, high

    def start(self) -> np.ndarray:
        return np.zeros((2, self.bins), np.int64)

    def add(self, state: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        score = batch.column(0).cast(pa.float64()).to_numpy(zero_copy_only=False)
        label = batch.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
        whole = ~(np.isnan(score) | np.isnan(label))
        place = np.floor((score[whole] - self.low) * self.bins / (self.high - self.low))
        place = np.clip(place, 0, self.bins - 1).astype(np.int64)
        for side in (0, 1):
            state[side] += np.bincount(place[(label[whole] > 0) == side], minlength=self.bins)
        return state

    def merge(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return one + other

    def finish(self, state: np.ndarray) -> float | None:
        negative, positive = state.astype(object)
        pairs = 2 * int(negative.sum()) * int(positive.sum())
        if not pairs:
            return None
        below = np.cumsum(negative) - negative
        return int((positive * (2 * below + negative)).sum()) / pairs
