"""Words of whole texts on Arrow buffers: offsets and 64-bit hashes without one Python object per word.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Nulls are empty texts.
Work goes through a batch in segments of about a megabyte that end between words, so
memory stays bounded for texts of any length (one single word may be longer than a segment).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


#: What a worker forgets when another operator's task starts in it.
FORGET: list[Callable[[], None]] = []
_last: list[str] = []


def _give_back() -> None:
    _tables.clear()
    pa.default_memory_pool().release_unused()
    # Where the C library can: freed blocks go back to the system.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _start(name: str) -> None:
    """Reached by name: a task's function is sent by value, so lists that it held itself would be new in every task."""
    if _last != [name]:
        for forget in FORGET:
            forget()
        _give_back()
        _last[:] = [name]


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's batch function that leaves its worker small, since Python workers live on between tasks and stages.

    Tables and freed memory go back at the end of a task; what an operator keeps for its own next task goes when another
    operator starts.
    """
    name = f"{work.__module__}.{work.__qualname__}"

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _start(name)
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, SEGMENT + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, U64(base))
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def _byte_codes() -> np.ndarray:
    if "codes" not in _tables:
        _tables["codes"] = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
    return _tables["codes"]


def byte_slices(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes at most, or one row."""
    column = column.cast(pa.large_string())
    if not len(column):
        return
    marks = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(marks, marks[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi
        lo = hi


def text_bytes(column: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, A-Z lower-cased; nulls are empty.

    ``letters_only`` turns ASCII other than letters and digits into spaces.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    data[(data >= 65) & (data <= 90)] += 32
    if letters_only:
        letter = (data >= 97) & (data <= 122) | (data >= 48) & (data <= 57) | (data >= 128)
        data[~letter] = 32
    return data, offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _pieces(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the segments: each ends at a space or at the start of a text."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:
            back = max(at, end - (1 << 16))
            space = np.flatnonzero(is_space(data[back:end]))
            cut = cuts[np.searchsorted(cuts, end, "right") - 1]
            found = max(int(back + space[-1] + 1) if len(space) else at, int(cut))
            if found > at:
                end = found
                break
            end = min(n, end + SEGMENT)
        yield at, end
        at = end


def words_of(column: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, hash, text number) of every word of a string column, in order."""
    data, offsets = text_bytes(column, letters_only)
    cuts = offsets[:-1]
    starts, ends, hashes = [], [], []
    for lo, hi in _pieces(data, cuts):
        part = data[lo:hi]
        word = ~is_space(part)
        first = np.zeros(len(part), bool)
        inside = cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi)] - lo
        first[inside] = True
        first[0] = True
        before = np.empty(len(part), bool)
        before[0], before[1:] = False, word[:-1]
        s = np.flatnonzero(word & (~before | first))
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = ~word[1:] | first[1:]
        e = np.flatnonzero(word & after) + 1
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_byte_codes()[part] * up[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s]
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(h + (e - s).astype(U64)))
    if not starts:
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(0, U64), none
    start = np.concatenate(starts)
    text = np.searchsorted(offsets, start, "right") - 1
    return data, start, np.concatenate(ends), np.concatenate(hashes), text


_PLACES = mix(np.arange(11, 11 + 64, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def chain_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (one result per start)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = np.zeros(count, U64)
    for i in range(n):
        out += hashes[i : i + count] * _PLACES[i % 64]
    return mix(out + U64(n))


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingle hashes of every text; a shorter text is one shingle, an empty one none."""
    _, _, _, hashes, text = words_of(column)
    bounds = np.searchsorted(text, np.arange(len(column) + 1))
    runs = chain_hash(hashes, n)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            own = np.sort(runs[lo : hi - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(chain_hash(hashes[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, U64))
    return out
