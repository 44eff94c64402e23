"""Grouping of spelling variants by composing finite-state machines.

A vocabulary's words are near when one inserted, deleted or replaced code point tells them apart: the pairs that
the machine (words) o (one edit) o (words) accepts. Every pair has one place, the length of its longest common prefix.

1. All pairs whose shorter word has L code points are one range of places, [0, L + 1). A range [lo, hi) is cut in
   halves: pairs of a half share their first ``lo`` code points and their last ``L - hi``, so
   words that share both are one partition, whose initial state is the one behind that prefix.
2. Partitions above ``PARTITION`` words are cut again, down to ranges of one place; there a partition's words
   differ in one or two code points, so that the alphabet bounds it.
3. A partition's words (between prefix and suffix) become a minimised acceptor, built from sorted words. The composition starts
   in its initial state, follows equal arcs, and takes one edit: two different arcs (a replacement) or one arc on the longer side
   (an insertion). From the two states reached it accepts what both accept; as the acceptor is
   minimised, that is worked out once for every pair of states. An edit outside the partition's range is left to
   the partition it belongs to, so every pair is accepted once.
4. A partition gives one row per word: its near words' number, and the best of them.

A word's form is the best near word (largest n, then smallest word) if that has ``RATIO`` times its n at least; the root follows forms to
the last. Forms grow by that ratio at every step, so roots are found in a few rounds of doubling.

Defined cases: null and empty texts hold no words; a null doc_id counts as empty text in the hash; rows with equal doc_id count
as they stand; words of any length are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.ranges import lookup
from evalloom.sources.scratch import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
SLIP = 199
PARTITION = 20_000


def words_of_texts(docs: DataFrame, slip: int = SLIP) -> DataFrame:
    """(word, n) of every run of letters; where ``slip`` divides a run's hash it loses one code point.

    Only runs that can still be long enough go on, and counts are added up before the shuffle.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    long = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"),
        F.explode(F.filter(runs, lambda r: F.length(r) >= MIN_LENGTH)).alias("_r"),
    )
    hashed = long.select("_r", F.crc32(F.concat("_d", F.lit(":"), "_r").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_r")).cast("int")
    cut = F.concat(F.substring("_r", F.lit(1), at), F.substring("_r", at + 2, F.length("_r")))
    word = F.when(F.col("_h") % slip == 0, cut).otherwise(F.col("_r"))
    counts = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.length("word") >= MIN_LENGTH)


# Acceptors --------------------------------------------------------------------------------------


class Acceptor:
    """Minimised acceptor of distinct sorted words: state 0 accepts only the empty word; arcs are label -> state."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [True]
        self._known: dict[tuple, int] = {(True,): 0}
        self._common: dict[tuple[int, int], tuple[str, ...]] = {}
        open_arcs: list[dict[str, int]] = [{}]
        open_final, last = [False], ""
        for word in [*words, None]:
            shared = 0
            if word is not None:
                while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                    shared += 1
            # What no later word can reach is settled, deepest state first.
            while len(open_arcs) > shared + 1:
                state = self._state(open_arcs.pop(), open_final.pop())
                open_arcs[-1][last[len(open_arcs) - 1]] = state
            if word is None:
                break
            for _ in word[shared:]:
                open_arcs.append({})
                open_final.append(False)
            open_final[-1] = True
            last = word
        self.start = self._state(open_arcs[0], open_final[0])

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def common(self, a: int, b: int, without: str | None = None) -> tuple[str, ...]:
        """Words that both states accept; none that start with ``without``."""
        key = (a, b) if a < b else (b, a)
        found = self._common.get(key)
        if found is None:
            found = self._common[key] = tuple(self._both(*key))
        return found if without is None else tuple(w for w in found if w[:1] != without)

    def _both(self, a: int, b: int) -> list[str]:
        out, left = [], [("", a, b)]
        while left:
            read, p, q = left.pop()
            if self.final[p] and self.final[q]:
                out.append(read)
            ours, theirs = self.arcs[p], self.arcs[q]
            left += [(read + c, ours[c], theirs[c]) for c in (ours if len(ours) < len(theirs) else theirs) if c in ours and c in theirs]
        return out


def near_pairs(words: list[str], last: int) -> Iterator[tuple[str, str]]:
    """Pairs (shorter or equally long, other) of sorted words one edit apart whose common prefix has less than ``last`` code points."""
    fsa = Acceptor(words)
    left = [("", fsa.start)]
    while left:
        read, state = left.pop()
        arcs = fsa.arcs[state]
        for (c, p), (d, q) in combinations(arcs.items(), 2):
            for rest in fsa.common(p, q):
                yield read + c + rest, read + d + rest
        for c, p in arcs.items():
            for rest in fsa.common(state, p, without=c):
                yield read + rest, read + c + rest
        if len(read) + 1 < last:
            left += [(read + c, p) for c, p in arcs.items()]


# Partitions -------------------------------------------------------------------------------------


def _halves(lo: Column, hi: Column) -> Column:
    """The two halves of a range of places, or the range itself where it holds one place."""
    mid = F.floor((lo + hi) / 2).cast("int")
    pair = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    return F.when(hi - lo <= 1, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, mid), pair(mid, hi)))


def _keyed(rows: DataFrame) -> DataFrame:
    """Partition key of (word, n, size, lo, hi): range, prefix and suffix; ``key`` is a hash that stands for them in shuffles."""
    prefix = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.greatest(F.col("size") - F.col("hi"), F.lit(0))
    suffix = F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise("")
    return rows.withColumn("tail", tail).withColumn("key", F.xxhash64("size", "lo", "hi", prefix, suffix))


def _cut(rows: DataFrame) -> DataFrame:
    halves = rows.select("word", "n", "size", F.explode(_halves(F.col("lo"), F.col("hi"))).alias("_h"))
    return _keyed(halves.select("word", "n", "size", "_h.lo", "_h.hi"))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of partitions that hold two words at least, with the number of words ``held``."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("w")).filter("w > 1").withColumn("held", F.col("w"))
    return settle(lookup(rows, sizes, ["key"], "w", "inner"))


def partitions(vocab: DataFrame) -> DataFrame:
    """(word, n, size, lo, hi, tail, key): every word in every partition where it may meet a near word."""
    length = F.length("word")
    sizes = F.array(*[F.when(length - i >= 1, length - i) for i in (0, 1)])
    start = vocab.select("word", "n", F.explode(F.array_compact(sizes)).alias("size")).withColumns({"lo": F.lit(0), "hi": F.col("size") + 1})
    out, left = None, start
    while True:
        placed = _sized(_cut(left))
        large = (F.col("held") > PARTITION) & (F.col("hi") - F.col("lo") > 1)
        done = placed.filter(~large)
        out = done if out is None else out.unionAll(done)
        left = placed.filter(large)
        if left.isEmpty():
            return out.drop("held")


def _best(a: tuple[int, str] | None, n: int, word: str) -> tuple[int, str]:
    return (n, word) if a is None or n > a[0] or (n == a[0] and word < a[1]) else a


def _near_rows(rows: list[tuple]) -> list[tuple[str, int, int, str]]:
    """(word, near words, best n, best word) within one partition, given as (word, n, size, lo, hi, tail)."""
    # One hash may stand for several partitions: words meet only where prefix and suffix agree.
    groups: dict[tuple, dict[str, int]] = {}
    for word, n, size, lo, hi, tail in rows:
        groups.setdefault((size, lo, hi, word[:lo], word[len(word) - tail :]), {})[word[lo : len(word) - tail]] = n
    out = []
    for (size, lo, hi, prefix, suffix), counts in groups.items():
        if len(counts) < 2:
            continue
        near: dict[str, list] = {}
        for a, b in near_pairs(sorted(counts), hi - lo):
            if len(a) + lo + len(suffix) != size:
                continue
            for own, other in ((a, b), (b, a)):
                seen = near.setdefault(own, [0, None])
                seen[0] += 1
                seen[1] = _best(seen[1], counts[other], prefix + other + suffix)
        out += [(prefix + own + suffix, count, *best) for own, (count, best) in near.items()]
    return out


def near_words(placed: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a near word in a partition, one row per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            out = []
            for *row, own in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if own != key:
                    if len(held) > 1:
                        out += _near_rows(held)
                    held, key = [], own
                held.append(tuple(row))
            yield _rows(out)
        yield _rows(_near_rows(held))

    spread = placed.select("word", "n", "size", "lo", "hi", "tail", "key").repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(run, "word string, n_near long, best_n long, best string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    names = ["word", "n_near", "best_n", "best"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form): doubling, so that a chain of 2^r forms takes r rounds.

    Joins go by words with a near word of ``RATIO`` times their n, few and with few words each: near words are bounded by a word's length.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = settle(at.join(ahead, "root", "left"))
        at = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.filter(F.col("_next").isNotNull()).isEmpty():
            return at


def variants(docs: DataFrame, slip: int = SLIP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences."""
    return group_variants(settle(words_of_texts(docs, slip).filter(F.col("n") >= MIN_COUNT)))


def group_variants(vocab: DataFrame) -> DataFrame:
    """Like :func:`variants`, for a written vocabulary (word, n) of distinct words."""
    found = near_words(partitions(vocab))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
    joined = vocab.join(near, "word", "left")
    good = -F.col("_b.m") >= RATIO * F.col("n")
    formed = settle(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(good, F.col("_b.w")).alias("form"), F.when(good, -F.col("_b.m")).alias("form_n"),
    ))
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    out = formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
