"""Benchmark decontamination: a BM25 index of test items, asked by every training passage.

For an item, documents are cut into passages of twice ``stride`` words, one every ``stride`` words, with ``stride`` the
power of two (32 at least) that reaches 1.25 times the item's own words: an item copied into a text (with up to a quarter of
words put in between) lies inside one passage, whatever other items there are. Items of one stride share an
index, and a text is looked up in all indexes of a part in one pass. A passage's distinct words are a query; items are the documents of the index.

Retrieval is block-max WAND on arrays. The sum of a passage's largest term impacts bounds every
score (WAND); the sum of the largest impacts inside a block of ``BLOCK_ITEMS`` items bounds the scores of that
block; what passes both is scored exactly. An item's threshold is the smallest score that a passage can
have which shares the verified part of the item: its own score less the largest impacts of as many words
as may be missing. Nothing that would be verified is therefore lost, and no result count is capped.

Verification counts the question's and the answer's five-word shingles in the passage: both
shares must reach ``OVERLAP``. A part with fewer words is one shingle; an empty part asks for nothing.
Where the answer is only derived from the item's text (``whole``), a passage that holds that share of the whole
item's shingles is accepted too: a word changed in a short last sentence does not hide the copy.

Words are runs of letters, digits and non-ASCII bytes with A-Z lower-cased, so case and punctuation do not matter.

The items come to the driver in index parts of up to ``PART_ITEMS`` items and ``PART_WORDS`` words (or one
item), each sent to all tasks on its own. The statistics of BM25 (items, mean length, document frequencies) are
counted over all items beforehand and come along with each item, so neither hits nor scores depend on the parts. With
several parts each one's hits are written before the next part is built: driver, plan and broadcast hold one
part, however many items there are.

Defined cases: null or empty texts have no passage; an item without any word, or with null text, is
ignored; repeated items each give rows of their own; rows with null or equal doc_id are looked at
one by one; empty tables give no rows; extra columns are ignored by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.words import U64, byte_slices, chain_hash, mix, tidy, words_of
from evalloom.operators.ranges import lookup
from evalloom.sources.scratch import settle

SHINGLE = 5
OVERLAP = 0.8
BLOCK_ITEMS = 16
PART_ITEMS = 512
PART_WORDS = 20_000
K1, B = 1.2, 0.75
SLACK = 1e-6


def _sequence(text: str | None) -> np.ndarray:
    return words_of(pa.array([text or ""]), letters_only=True)[3]


def _shingles(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(0, U64)
    return np.unique(chain_hash(words, min(SHINGLE, len(words))))


@dataclass
class Index:
    """The items of one stride in one part of the benchmark: terms, impacts by item (CSR), block maxima, thresholds and shingles to verify."""

    ids: list
    terms: np.ndarray
    hint: np.ndarray
    item_terms: list[np.ndarray]
    impacts: list[np.ndarray]
    thresholds: np.ndarray
    term_max: np.ndarray
    block_max: np.ndarray
    block_low: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    both: list[np.ndarray]
    parts: list[tuple[int, int]]
    stride: int

    def dense(self) -> np.ndarray:
        """Impacts as a matrix of terms by items, made once per task: within the bounds of a part."""
        if not hasattr(self, "_dense"):
            self._dense = np.zeros((len(self.terms), len(self.ids)), np.float32)
            for i, (at, impact) in enumerate(zip(self.item_terms, self.impacts, strict=True)):
                self._dense[at, i] = impact
        return self._dense


@dataclass
class Statistics:
    """What BM25 needs of all items: how many have words, their mean length, and items by term for the terms of a part."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def stride_of(words: int) -> int:
    """Words from one passage to the next for an item of so many words."""
    return max(32, 1 << int(np.ceil(1.25 * words) - 1).bit_length())


def build_indexes(rows: list[tuple], known: Statistics, overlap: float = OVERLAP, whole: bool = False) -> list[Index]:
    """Indexes of (item_id, question, answer) rows, one per stride; with ``whole`` an item's text as one also counts."""
    by_stride: dict[int, list] = {}
    for item_id, question, answer in rows:
        q, a = _sequence(question), _sequence(answer)
        if len(q) + len(a):
            by_stride.setdefault(stride_of(len(q) + len(a)), []).append((item_id, q, a))
    return [_build_index(items, stride, known, overlap, whole) for stride, items in sorted(by_stride.items())]


def _build_index(items: list[tuple], stride: int, known: Statistics, overlap: float, whole: bool) -> Index:
    sizes = np.array([len(q) + len(a) for _, q, a in items], float)
    counted = [np.unique(np.concatenate([q, a]), return_counts=True) for _, q, a in items]
    terms = np.unique(np.concatenate([t for t, _ in counted]))
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log1p((known.items - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * sizes / known.mean)
    item_terms, impacts, thresholds, question, answer, both, parts = [], [], [], [], [], [], []
    for i, ((_, q, a), (own, tf)) in enumerate(zip(items, counted, strict=True)):
        at = np.searchsorted(terms, own)
        impact = idf[at] * tf * (K1 + 1) / (tf + norm[i])
        may_miss, shingles = [], []
        for part in (q, a, np.concatenate([q, a]) if whole else q[:0]):
            found = _shingles(part)
            shingles.append(found)
            # Every missing word costs at least one shingle; a repeated shingle may cost several words.
            runs = max(0, len(part) - SHINGLE + 1)
            may_miss.append(int((1 - overlap) * len(found) + SLACK) + max(0, runs - len(found)))
        missing = max(may_miss[0] + may_miss[1], may_miss[2])
        item_terms.append(at)
        impacts.append(impact)
        thresholds.append(impact.sum() - np.sort(impact)[::-1][:missing].sum() - SLACK)
        question.append(shingles[0])
        answer.append(shingles[1])
        both.append(shingles[2])
        parts.append((len(q), len(a)))
    # Items of like vocabulary share a block: by their rarest words.
    order = sorted(range(len(items)), key=lambda i: (int(item_terms[i][np.argmax(impacts[i])]), i))
    pick = lambda x: [x[i] for i in order]
    item_terms, impacts, thresholds = pick(item_terms), pick(impacts), np.array(pick(thresholds))
    blocks = -(-len(items) // BLOCK_ITEMS)
    block_max = np.zeros((len(terms), blocks), np.float64)
    for i, (at, impact) in enumerate(zip(item_terms, impacts, strict=True)):
        column = block_max[:, i // BLOCK_ITEMS]
        column[at] = np.maximum(column[at], impact)
    hint = np.zeros(1 << 20, bool)
    hint[(terms >> U64(44)).astype(np.int64)] = True
    return Index(
        [items[i][0] for i in order], terms, hint, item_terms, impacts, thresholds, block_max.max(axis=1), block_max,
        np.minimum.reduceat(thresholds, np.arange(0, len(order), BLOCK_ITEMS)), pick(question), pick(answer), pick(both), pick(parts), stride,
    )


def hits(column: pa.Array, indexes: list[Index], overlap: float = OVERLAP) -> list[tuple]:
    """(row, item_id, score, question share, answer share, first word of the passage): best passage of each row and item."""
    _, _, _, hashes, row = words_of(column, letters_only=True)
    if not len(hashes):
        return []
    first = np.searchsorted(row, np.arange(len(column) + 1))
    return [(x[0], index.ids[x[1]], *x[2:]) for index in indexes for x in _hits(hashes, row, first, index, overlap)]


def _hits(hashes: np.ndarray, row: np.ndarray, first: np.ndarray, index: Index, overlap: float) -> list[tuple]:
    """Like :func:`hits` for one index, with item numbers. ``first`` is every text's first word."""
    maybe = np.flatnonzero(index.hint[(hashes >> U64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.terms, hashes[maybe]), len(index.terms) - 1)
    known = index.terms[place] == hashes[maybe]
    at, term = maybe[known], place[known]
    # Passages of a text are numbered from its base; a word lies in its own passage and the one before.
    counts = np.maximum(1, -(-np.diff(first) // index.stride))
    base = np.concatenate(([0], np.cumsum(counts)))
    own = base[row[at]] + (at - first[row[at]]) // index.stride
    before = own > base[row[at]]
    keys = np.concatenate([own, own[before] - 1]) * len(index.terms) + np.concatenate([term, term[before]])
    keys = np.unique(keys)
    passage, term = np.divmod(keys, len(index.terms))
    bound = np.bincount(passage, index.term_max[term], base[-1])
    alive = bound[passage] >= index.thresholds.min()
    passage, term = passage[alive], term[alive]
    if not len(passage):
        return []
    starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    ends = np.append(starts[1:], len(passage))
    dense = index.dense()
    best: dict[tuple[int, int], tuple] = {}
    for lo in range(0, len(starts), 2048):
        s, e = starts[lo : lo + 2048], ends[lo : lo + 2048]
        sums = np.add.reduceat(index.block_max[term[s[0] : e[-1]]], s - s[0], axis=0)
        passes = sums >= index.block_low
        for b in np.flatnonzero(passes.any(axis=0)):
            asked = np.flatnonzero(passes[:, b])
            size = e[asked] - s[asked]
            from_ = np.cumsum(size) - size
            rows = np.repeat(s[asked] - from_, size) + np.arange(size.sum())
            items = slice(b * BLOCK_ITEMS, (b + 1) * BLOCK_ITEMS)
            scores = np.add.reduceat(dense[term[rows], items], from_, axis=0)
            for w, i in zip(*np.nonzero(scores >= index.thresholds[items] - 1e-3), strict=True):
                w, i = asked[w], int(b * BLOCK_ITEMS + i)
                own = np.isin(index.item_terms[i], term[s[w] : e[w]], assume_unique=True)
                score = float(index.impacts[i][own].sum())
                if score < index.thresholds[i]:
                    continue
                number = int(passage[s[w]])
                text = int(np.searchsorted(base, number, "right")) - 1
                begin = int((number - base[text]) * index.stride)
                run = hashes[first[text] + begin : min(first[text + 1], first[text] + begin + 2 * index.stride)]
                shares = []
                for found, words in ((index.question[i], index.parts[i][0]), (index.answer[i], index.parts[i][1])):
                    there = chain_hash(run, min(SHINGLE, words)) if words else found
                    shares.append(float(np.isin(found, there).mean()) if words else 1.0)
                as_one = index.both[i]
                held = np.isin(as_one, chain_hash(run, min(SHINGLE, sum(index.parts[i])))).mean() if len(as_one) else 0.0
                if max(min(shares), held) >= overlap - 1e-9:
                    entry = (min(shares), sum(shares), score, -begin)
                    if (text, i) not in best or entry > best[text, i][0]:
                        best[text, i] = (entry, (text, i, score, *shares, begin))
    return [x for _, x in sorted(best.values(), key=lambda v: v[1][:2])]


def _counted(items: DataFrame) -> tuple[DataFrame, int, float]:
    """Items in their order with (term, df) lists of all items, the number of items with words, and their mean length."""
    rows = settle(items.select("item_id", "question", "answer").withColumn("_row", F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, question, answer in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = np.concatenate([_sequence(question), _sequence(answer)])
                own = np.unique(found).view(np.int64)
                if len(own):
                    columns = [pa.array(np.full(len(own), x, np.int64)) for x in (row, len(found))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(own)], names=["_row", "_size", "_term"])

    terms = settle(rows.select("_row", "question", "answer").mapInArrow(split, "_row long, _size long, _term long"))
    facts = terms.groupBy("_row").agg(F.first("_size").alias("s")).agg(F.count(F.lit(1)), F.avg("s")).first()
    df = terms.groupBy("_term").agg(F.count(F.lit(1)).alias("_df")).withColumn("_weight", F.col("_df"))
    lists = lookup(terms, df, ["_term"], "_weight").groupBy("_row").agg(F.collect_list(F.struct("_term", "_df")).alias("_terms"))
    return rows.join(lists, "_row").orderBy("_row"), int(facts[0]), float(facts[1] or 0.0)


def index_parts(items: DataFrame, overlap: float = OVERLAP, whole: bool = False) -> Iterator[tuple[list[Index], bool]]:
    """Index parts of ``item_id, question, answer`` and whether each is the only one; one part is at the driver at a time."""
    rows, n, mean = _counted(items)

    def made(waiting: list) -> list[Index]:
        pairs = dict(x for r in waiting for x in r["_terms"])
        terms = np.array(list(pairs), np.int64).view(U64)
        order = np.argsort(terms)
        known = Statistics(n, mean, terms[order], np.array(list(pairs.values()), np.int64)[order])
        return build_indexes([(r["item_id"], r["question"], r["answer"]) for r in waiting], known, overlap, whole)

    waiting: list = []
    words, alone = 0, True
    for r in rows.toLocalIterator():
        size = len((r["question"] or "").split()) + len((r["answer"] or "").split())
        if waiting and (len(waiting) == PART_ITEMS or words + size > PART_WORDS):
            alone = False
            yield made(waiting), alone
            waiting, words = [], 0
        waiting.append(r)
        words += size
    if waiting:
        yield made(waiting), alone


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_word long"


def find(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, whole: bool = False) -> DataFrame:
    """One row per contaminated document row and item; ``whole`` for derived answers. One pass over the texts per index part, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = None
    for index, alone in index_parts(items, overlap, whole):

        def run(batches: Iterator[pa.RecordBatch], index: list[Index] = index) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            names = [x.split()[0] for x in FOUND.split(", ")]
            for batch in batches:
                for lo, hi in byte_slices(batch.column(1)):
                    found = hits(batch.column(1).slice(lo, hi - lo), index, overlap)
                    if not found:
                        continue
                    ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                    columns = zip(*[(ids[x[0]], *x[1:]) for x in found], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        part = rows.mapInArrow(tidy(run), FOUND)
        part = part if alone else settle(part)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def clean(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, whole: bool = False) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns kept."""
    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    place = [n.lower() for n in names].index("text")
    bad_texts = None
    for index, alone in index_parts(items, overlap, whole):
        if not alone:
            # A text alone decides whether it goes, so the digests of those that do are enough, whatever the number of parts.
            part = settle(numbered.select(f"_{place}").mapInArrow(tidy(_leaking(index, overlap)), "_text string").select(F.sha2("_text", 256).alias("_digest")).distinct())
            bad_texts = part if bad_texts is None else bad_texts.unionByName(part)
            continue

        def run(batches: Iterator[pa.RecordBatch], index: list[Index] = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in byte_slices(batch.column(place)):
                    part = batch.slice(lo, hi - lo)
                    bad = {x[0] for x in hits(part.column(place), index, overlap)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)])) if bad else part

        numbered = numbered.mapInArrow(tidy(run), numbered.schema)
    if bad_texts is not None:
        numbered = numbered.join(bad_texts.distinct(), F.sha2(f"_{place}", 256) == F.col("_digest"), "left_anti")
    return numbered.toDF(*names)


def _leaking(index: list[Index], overlap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts with any hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(0)):
                texts = batch.column(0).slice(lo, hi - lo)
                bad = sorted({x[0] for x in hits(texts, index, overlap)})
                if bad:
                    yield pa.RecordBatch.from_arrays([texts.take(pa.array(bad))], names=["_text"])

    return run


def question_and_answer(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) of ``item_id, text``: the last sentence is the answer, what stands before it the question."""
    cut = r"(?s)^(.*[.?!\n])\s+(\S.*)$"
    question = F.regexp_extract("text", cut, 1)
    return benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.when(question != "", question).otherwise(F.col("text")).alias("question"),
        F.when(question != "", F.regexp_extract("text", cut, 2)).otherwise("").alias("answer"),
    )
