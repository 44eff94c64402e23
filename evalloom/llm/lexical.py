"""Ranked lexical search of many items at once, sharing what the items have in common.

1. A document's terms (maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased) are
   looked up among the items' terms once; what is found is written as postings (term numbers and counts by document).
2. Term sets that items share are mined by rounds: every item proposes pairs of its parts, pairs that two or more items
   settle on become a part of their own, and later rounds pair these again. Parts form a graph that the items share.
3. Tasks take documents in bunches. A bunch's accumulators are filled for single terms, then every shared
   part's accumulator is made once from its two parts, level by level, and an item sums the parts it is left with.
4. A task keeps ``k`` documents an item; a ranking over all tasks follows.

Scores are whole numbers, so the order of additions does not matter. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1)));
its count tf adds weight * (10^9 tf div (1000 tf + 8 m)) with m = 100 - 75 + 75 n N div L, once for every time the item holds it.

Items go in blocks of ``BLOCK_TERMS`` terms, which bounds what the driver and a task hold (one longer item is a block of its own).
Every block reads the texts once and its postings twice, and its result is written before the next one starts.

Defined cases: null and empty texts hold no terms, count in no statistic and are in no result; items without a
term of any document give no rows; rows with equal ids are rows (and items) of their own; null ids come last among equal
scores; empty tables give no rows; other columns are ignored. Two terms are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.llm.words import byte_slices, tidy, words_of
from evalloom.sources.scratch import settle

K = 10
#: Terms (distinct within an item) of the items that are searched together.
BLOCK_TERMS = 1 << 16
#: How far apart, in order of how many items hold them, two parts of an item may be to be paired.
SPAN = 8
ROUNDS = 24
SLICE_BYTES = 1 << 22
#: Bytes of one bunch's accumulators.
BUNCH_BYTES = 1 << 24


@dataclass
class Plan:
    """Single terms with the times they count, shared parts by level as (part, left, right), and the parts of every item."""

    terms: np.ndarray
    times: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    parts: np.ndarray
    starts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.terms) + sum(len(level[0]) for level in self.levels)


def shared_plan(items: list[list[tuple[int, int]]]) -> Plan:
    """Mine parts that items share; an item is a list of (term, times)."""
    singles = sorted({part for item in items for part in item})
    number = {part: i for i, part in enumerate(singles)}
    lists = [[number[part] for part in item] for item in items]
    children: dict[int, tuple[int, int]] = {}
    for _ in range(ROUNDS):
        held = Counter(part for parts in lists for part in parts)
        for parts in lists:
            parts.sort(key=lambda p: (-held[p], p))
        pairs = Counter(pair for parts in lists for pair in _pairs(parts, held))
        chosen = [_choose(parts, held, pairs) for parts in lists]
        common = sorted(pair for pair, n in Counter(pair for pairs in chosen for pair in pairs).items() if n > 1)
        if not common:
            break
        fresh = {pair: len(singles) + len(children) + i for i, pair in enumerate(common)}
        children |= {part: pair for pair, part in fresh.items()}
        for i, settled in enumerate(chosen):
            used = [pair for pair in settled if pair in fresh]
            gone = {part for pair in used for part in pair}
            lists[i] = [part for part in lists[i] if part not in gone] + [fresh[pair] for pair in used]
    depth = dict.fromkeys(range(len(singles)), 0)
    by_depth: dict[int, list[tuple[int, int, int]]] = {}
    for part, (left, right) in children.items():
        depth[part] = 1 + max(depth[left], depth[right])
        by_depth.setdefault(depth[part], []).append((part, left, right))
    sizes = [len(parts) for parts in lists]
    return Plan(
        np.array([t for t, _ in singles], np.int64),
        np.array([n for _, n in singles], np.int64),
        [tuple(np.array(column, np.int64) for column in zip(*by_depth[d], strict=True)) for d in sorted(by_depth)],
        np.array([part for parts in lists for part in parts], np.int64),
        np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64),
    )


def _pairs(parts: list[int], held: Counter) -> Iterator[tuple[int, int]]:
    """Pairs of parts that other items hold too, no further apart than ``SPAN``."""
    shared = [p for p in parts if held[p] > 1]
    for i, left in enumerate(shared):
        for right in shared[i + 1 : i + 1 + SPAN]:
            yield min(left, right), max(left, right)


def _choose(parts: list[int], held: Counter, pairs: Counter) -> list[tuple[int, int]]:
    """The item's most common pairs, each part in one of them at most."""
    out, used = [], set()
    for pair in sorted({p for p in _pairs(parts, held) if pairs[p] > 1}, key=lambda p: (-pairs[p], p)):
        if not used & set(pair):
            used |= set(pair)
            out.append(pair)
    return out


def item_scores(plan: Plan, singles: np.ndarray) -> np.ndarray:
    """Scores (items x documents) from what every single term adds to every document."""
    acc = np.empty((plan.size, singles.shape[1]), np.int64)
    np.multiply(singles[plan.terms], plan.times[:, None], out=acc[: len(plan.terms)])
    for part, left, right in plan.levels:
        acc[part] = acc[left] + acc[right]
    ends = np.append(plan.starts[1:], len(plan.parts))
    out, lo = [], 0
    while lo < len(plan.starts):
        most = plan.starts[lo] + max(1, BUNCH_BYTES // (8 * singles.shape[1]))
        hi = max(lo + 1, int(np.searchsorted(ends, most, "right")))
        base = plan.starts[lo]
        out.append(np.add.reduceat(acc[plan.parts[base : ends[hi - 1]]], plan.starts[lo:hi] - base, axis=0))
        lo = hi
    return np.concatenate(out)


class Best:
    """The ``k`` best documents of every item seen so far: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        fresh = [item, ids[doc], nameless[doc], scores[item, doc]]
        item, ids, nameless, score = (np.concatenate(pair) for pair in zip(self.rows, fresh, strict=True))
        order = np.lexsort((ids, nameless, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.k]
        self.rows = [column[kept] for column in (np.concatenate([self.rows[0], fresh[0]]), ids, nameless, score)]
        last = self.rows[0][self.k - 1 :] == self.rows[0][: max(0, len(self.rows[0]) - self.k + 1)]
        at = np.flatnonzero(last) + self.k - 1
        self.least[self.rows[0][at]] = self.rows[3][at]


def _postings(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with a term; term numbers and counts as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), SLICE_BYTES):
                _, _, _, hashes, text = words_of(batch.column(1).slice(lo, hi - lo), letters_only=True)
                total = np.bincount(text, minlength=hi - lo)
                at = np.minimum(np.searchsorted(vocab, hashes), max(0, len(vocab) - 1))
                hit = vocab[at] == hashes if len(vocab) else np.zeros(len(hashes), bool)
                key, counts = np.unique(text[hit] * max(1, len(vocab)) + at[hit], return_counts=True)
                owner, terms = np.divmod(key, max(1, len(vocab)))
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1)) * 4
                raw = [x.astype("<i4").tobytes() for x in (terms, counts)]
                own = np.flatnonzero(total)
                lists = [pa.array([r[bounds[i] : bounds[i + 1]] for i in own], pa.binary()) for r in raw]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([ids, pa.array(total[own], pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, n long, terms binary, counts binary")


def _document_counts(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, from one partial count per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(seen[terms])], names=["term", "df"])

    counted = postings.select("terms").mapInArrow(tidy(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for row in counted.toLocalIterator():  # one row per term of the block
        out[row["term"]] = row["df"]
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def term_parts(weight: np.ndarray, counts: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term found ``counts`` times adds to a document of ``length`` terms."""
    m = 25 + 75 * length * n // total
    return weight * (1_000_000_000 * counts // (1000 * counts + 8 * m))


def _search_block(docs: DataFrame, block: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> DataFrame | None:
    """(_i, doc_id, score) of one block: up to ``k`` documents an item from every task."""
    vocab = np.unique(np.concatenate([terms for _, terms, _ in block]))
    postings = settle(_postings(docs, vocab))
    n, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n:
        return None
    weight = weights(_document_counts(postings, len(vocab)), n)
    rows = np.array([i for i, _, _ in block], np.int64)
    plan = shared_plan([list(zip(np.searchsorted(vocab, terms).tolist(), times.tolist(), strict=True)) for _, terms, times in block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(rows), k)
        step = int(max(1, min(1024, BUNCH_BYTES // (8 * max(plan.size, len(rows), len(vocab))))))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                terms, counts = (part.column(i).to_pylist() for i in (2, 3))
                owner = np.repeat(np.arange(part.num_rows), [len(t) // 4 for t in terms])
                terms, counts = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (terms, counts))
                length = part.column(1).to_numpy()
                singles = np.zeros((len(vocab), part.num_rows), np.int64)
                singles[terms, owner] = term_parts(weight[terms], counts, length[owner], n, total)
                ids = part.column(0)
                best.add(item_scores(plan, singles), ids.fill_null(0).to_numpy(), np.array(ids.is_null()))
        item, ids, nameless, score = best.rows
        found = [pa.array(rows[item]), pa.array(ids, pa.int64(), mask=nameless), pa.array(score)]
        yield pa.RecordBatch.from_arrays(found, names=["_i", "doc_id", "score"])

    return postings.mapInArrow(tidy(run), "_i long, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """(_i, terms, times): hashes of an item's distinct terms and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), SLICE_BYTES):
                _, _, _, hashes, text = words_of(batch.column(1).slice(lo, hi - lo), letters_only=True)
                bounds = np.searchsorted(text, np.arange(hi - lo + 1))
                found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = [pa.array([x[j].astype(kind).tobytes() for x in found], pa.binary()) for j, kind in ((0, "<u8"), (1, "<i8"))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], names=["_i", "terms", "times"])

    return items.select("_i", "text").mapInArrow(tidy(run), "_i long, terms binary, times binary")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Items in blocks of about ``BLOCK_TERMS`` terms; the driver holds one block and one partition of items."""
    block, size = [], 0
    for row in _item_terms(items).filter(F.octet_length("terms") > 0).toLocalIterator():
        terms, times = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["times"], "<i8")
        if block and size + len(terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["_i"], terms, times))
        size += len(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents (``doc_id, text``) of every item (``item_id, text``)."""
    spark = docs.sparkSession
    named = settle(items.select("item_id", "text").withColumn("_i", F.monotonically_increasing_id()))
    first = W.partitionBy("_i").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], "_i long, doc_id long, score long, rank int")
    for block in _blocks(named):
        found = _search_block(docs, block, k)
        if found is not None:
            ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
            out = out.unionByName(settle(ranked))
    return out.join(named.select("_i", "item_id"), "_i").select("item_id", "rank", "doc_id", "score")
