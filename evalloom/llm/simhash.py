"""Near duplicates by 64-bit SimHash fingerprints, linked at ``BITS`` or fewer differing bits.

1. A fingerprint's bit is 1 where it is set in over half the XXH64 values (seed 42) of a text's ``SHINGLE``-word
   shingles, repeats counted. Rows of one fingerprint are one class from here on, so copies never meet.
2. Fingerprints are posted under their positional bytes. Three differing bits spoil three of eight bytes at most, so a
   linked pair shares ``SHARED`` = 5 bytes in place, and hence three bytes of its first four or of its last four:
   postings are kept for those eight triples of positions. A pair of a posting is tallied (bytes
   shared in place), kept from ``SHARED`` on, and verified bit by bit.
3. A posting above ``POSTING`` fingerprints is posted anew under the fives of positions that hold its triple. There every pair has
   reached the tally, and the three free bytes leave 2^24 fingerprints at most. Large ones look up
   every fingerprint's neighbours in a table of these 24 bits instead of comparing pairs.
4. A posting gives a spanning forest of its links, at most one row per fingerprint; components follow.

Nothing is capped: what a posting is too long for goes through step 3.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; with fewer than ``SHINGLE`` words the whole
sequence is one shingle; rows with equal doc_id are rows of their own; a null doc_id takes the smallest id of its
component, null where there is none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.components import connected
from evalloom.llm.words import byte_slices, tidy, words_of
from evalloom.operators.ranges import lookup
from evalloom.sources.scratch import settle

SHINGLE = 3
SEED = 42
BITS = 3
SHARED = 8 - BITS
POSTING = 512
SLICE_BYTES = 1 << 20
_SUMMED = 1 << 15

TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
FIVES = list(combinations(range(8), SHARED))


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, its text's number), in order."""
    import xxhash

    data, start, end, _, text = words_of(column)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # One space after every word, whatever stood there: a shingle is then one slice.
    sizes = end - start
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    joined = np.full(at[-1], 32, np.uint8)
    inside = np.repeat(start - at[:-1], sizes)
    places = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
    joined[places] = data[places + inside]
    raw = joined.tobytes()
    bounds = np.searchsorted(text, np.arange(len(column) + 1))
    counts = np.diff(bounds)
    runs = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(column)), runs)
    first = np.repeat(bounds[:-1], runs) + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    last = np.minimum(first + SHINGLE, bounds[1:][owner])
    digest = xxhash.xxh64_intdigest
    found = [digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)]
    return np.array(found, np.uint64), owner


def fingerprints(column: pa.Array) -> np.ndarray:
    """Signed 64-bit fingerprints of a string column."""
    out = np.zeros(len(column), np.int64)
    for lo, hi in byte_slices(column, SLICE_BYTES):
        hashes, owner = shingle_hashes(column.slice(lo, hi - lo))
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
        ones = np.zeros((hi - lo, 64), np.int64)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            for c in range(a, b, _SUMMED):
                part = hashes[c : min(b, c + _SUMMED)].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones[i] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        over = 2 * ones > np.diff(bounds)[:, None]
        out[lo:hi] = np.packbits(over, axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(fingerprints(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def _cells(fp: Column, numbered: list[tuple[int, tuple[int, ...]]]) -> Column:
    """Posting keys of a fingerprint: number of the choice of positions, then its bytes there."""

    def cell(number: int, places: tuple[int, ...]) -> Column:
        out = F.lit(number).cast("long")
        for place in places:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * place).bitwiseAND(F.lit(255)))
        return out

    return F.array(*[cell(number, places) for number, places in numbered])


def _finer(fp: Column, cell: Column) -> Column:
    """Keys of the fives that hold the triple of a posting."""
    out = F.array().cast("array<long>")
    for number, triple in enumerate(TRIPLES):
        fives = [(i, five) for i, five in enumerate(FIVES) if set(triple) <= set(five)]
        out = F.when(F.shiftright(cell, 24) == number, _cells(fp, fives)).otherwise(out)
    return out


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Bytes that are zero in an exclusive or: those a pair shares in place."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def union(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of ``a[i]`` and ``b[i]`` for all i; ``roots`` holds every element's smallest member so far."""
    while True:
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = roots[roots]
            if np.array_equal(up, roots):
                break
            roots[:] = up


def tally_postings(cells: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Root (position of a linked fingerprint) of every row of postings sorted by cell. Compares pairs by their distance in the order."""
    roots = np.arange(len(fps))
    left, step = np.arange(len(fps)), 1
    while True:
        left = left[left < len(fps) - step]
        left = left[cells[left] == cells[left + step]]
        if not len(left):
            return roots
        x = (fps[left] ^ fps[left + step]).astype(np.uint64)
        near = left[shared_bytes(x) >= SHARED]
        near = near[np.bitwise_count((fps[near] ^ fps[near + step]).astype(np.uint64)) <= BITS]
        if len(near):
            union(roots, near, near + step)
        step += 1


def _masks(width: int) -> np.ndarray:
    bits = [1 << i for i in range(width)]
    return np.array([sum(c) for k in range(1, BITS + 1) for c in combinations(bits, k)], np.int64)


def probe_posting(fps: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Roots within one posting of fives, by looking up all neighbours of its free bytes."""
    free = [p for p in range(8) if p not in places]
    code = np.zeros(len(fps), np.int64)
    for p in free:
        code = code << 8 | (fps >> (8 * p)) & 255
    where = np.full(1 << (8 * len(free)), -1, np.int32)
    where[code] = np.arange(len(fps), dtype=np.int32)
    roots = np.arange(len(fps))
    for mask in _masks(8 * len(free)):
        other = where[code ^ mask]
        hit = np.flatnonzero(other >= 0)
        if len(hit):
            union(roots, hit, other[hit].astype(np.int64))
            if not roots.any():
                break
    return roots


def _links(postings: DataFrame, fives: bool) -> DataFrame:
    """Spanning links (a, b) of every posting of (cell, fp), which one task holds at a time."""

    def emit(cells: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if fives and len(fps) > POSTING and cells[0] == cells[-1]:
            roots = probe_posting(fps, FIVES[int(cells[0]) >> 40])
        else:
            roots = tally_postings(cells, fps)
        own = np.flatnonzero(roots != np.arange(len(fps)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[roots[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            # Whole postings only: the last one of a batch may go on in the next.
            cut = int(np.searchsorted(cells, cells[-1]))
            first = int(np.searchsorted(cells, held[0][0][0], "right")) if held else 0
            if held and first:
                held.append((cells[:first], fps[:first]))
            if held and first < len(cells):
                yield from emit(np.concatenate([c for c, _ in held]), np.concatenate([f for _, f in held]))
                held = []
            if first < len(cells):
                if cut > first:
                    yield from emit(cells[first:cut], fps[first:cut])
                held = [(cells[cut:], fps[cut:])]
        if held:
            yield from emit(np.concatenate([c for c, _ in held]), np.concatenate([f for _, f in held]))

    return postings.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(tidy(run), "a long, b long")


def near_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` with ``BITS`` or fewer differing bits."""
    keyed = classes.select("fp", F.explode(_cells(F.col("fp"), list(enumerate(TRIPLES)))).alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    placed = settle(lookup(keyed, sizes, ["cell"], "n", "inner"))
    long = placed.filter(F.col("size") > POSTING).select("fp", F.explode(_finer(F.col("fp"), F.col("cell"))).alias("cell")).distinct()
    return _links(placed.filter(F.col("size") <= POSTING), fives=False).unionAll(_links(long, fives=True))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``doc_id, text``."""
    marked = settle(with_fingerprint(docs))
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    rooted = classes.join(connected(near_links(classes)).select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = lookup(marked, rooted.join(least, "root").select("fp", "component_id", "n"), ["fp"], "n")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
