"""Language-model scores by subword lattices.

A text is words and one end. A word is drawn from the words of the training corpus or, with the
mass that absolute discounting takes from them, spelled from pieces of an existing public
vocabulary: its probability there is the sum over all ways to cut it into pieces, by a forward
recursion in log space. With N training tokens, c the word's count, D the discount and V the
number of training words,

    P(word) = (max(c - D, 0) + D * V * P(spelling)) / N        P(end) = c(end) / N

A text also draws on itself: after t words, k of them this one, a word's probability is
(A * P(word) + k) / (A + t), and the end's A * P(end) / (A + t). A text's score is the
mean of its probability over the weights A of ``PRIORS``, so nothing is chosen by hand.

The vocabulary's own scores (its ranks, read as a Zipf law) weight the pieces at first; expected
piece counts over all distinct training words (forward and backward recursion) then refit them.
The piece table is as large as the vocabulary, whatever the corpus; the counts follow the corpus.

Texts are read once, into bundles of about ``BUNDLE_BYTES``: a list of distinct words, and each text as
numbers into it. Only distinct words per bundle are shuffled, to be counted and scored; their
scores return to the bundle, where texts are added up.

Defined cases: null text is empty and scores its end alone; rows with null or repeated doc_id are
rows of their own (a null id counts as empty text for the fold); without training rows N is 0,
base_score is that of the formula, and the model halves its mass between end and spelling; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.words import U64, mix, words_of
from evalloom.sources.scratch import settle

BUNDLE_BYTES = 8 << 20
#: Bytes of a piece's lookup code. Longer pieces are looked up by their first bytes and then compared whole.
PIECE_BYTES = 8
FAR_STARTS = 1 << 14
ROUNDS = 3
CELLS = 1 << 20
#: Weights, in words, that the corpus may have against a text's own earlier words.
PRIORS = (20.0, 100.0, 500.0, 2500.0, 1e5)
LN10 = float(np.log(10))


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces (lower-cased, without white space, of any length, all single bytes) of a byte-level
    vocabulary file of the tokenizers library, with log weights from their ranks."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    weight: dict[bytes, float] = {bytes([b]): 1e-7 for b in range(256)}
    for piece, rank in vocab.items():
        if not all(c in letters for c in piece):
            continue
        raw = bytes(letters[c] for c in piece).lower().strip(b" \t\n\x0b\x0c\r")
        if raw and not any(b == 32 or 9 <= b <= 13 for b in raw):
            weight[raw] = weight.get(raw, 0.0) + 1.0 / (rank + 10)
    pieces = sorted(weight)
    found = np.array([weight[p] for p in pieces])
    return pieces, np.log(found / found.sum())


@dataclass
class Lattice:
    """Piece scores (natural logs) with the log chance to go on and to end a word, as lookup tables."""

    pieces: list[bytes]
    scores: np.ndarray
    go_on: float
    stop: float

    def __post_init__(self) -> None:
        self.tables = []
        for size in range(1, PIECE_BYTES + 1):
            own = [(int.from_bytes(p, "little"), i) for i, p in enumerate(self.pieces) if len(p) == size]
            own.sort()
            keys = np.array([k for k, _ in own], U64)
            hint = np.zeros(1 << 20, bool)
            hint[(mix(keys) >> U64(44)).astype(np.int64)] = True
            self.tables.append((keys, np.array([i for _, i in own], np.int64), hint))
        # Longer pieces by the code of their first bytes; all bytes of them one after another.
        far = sorted((int.from_bytes(p[:PIECE_BYTES], "little"), i) for i, p in enumerate(self.pieces) if len(p) > PIECE_BYTES)
        self.heads, self.head_first = np.unique(np.array([k for k, _ in far], U64), return_index=True)
        self.head_first = np.append(self.head_first, len(far))
        self.far = np.array([i for _, i in far], np.int64)
        self.far_sizes = np.array([len(self.pieces[i]) for i in self.far], np.int64)
        self.far_bytes = np.frombuffer(b"".join(self.pieces[i] for i in self.far), np.uint8)
        self.far_start = np.cumsum(self.far_sizes) - self.far_sizes
        self.head_hint = np.zeros(1 << 20, bool)
        self.head_hint[(mix(self.heads) >> U64(44)).astype(np.int64)] = True

    def _far_steps(self, cells: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Uses of pieces longer than ``PIECE_BYTES`` as (word, start, end, piece), by the codes of all starts."""
        row, col = np.nonzero(self.head_hint[(mix(code) >> U64(44)).astype(np.int64)] & (np.arange(code.shape[1]) + PIECE_BYTES < sizes[:, None]))
        asked = code[row, col]
        place = np.minimum(np.searchsorted(self.heads, asked), len(self.heads) - 1)
        hit = self.heads[place] == asked
        row, col, place = row[hit], col[hit], place[hit]
        found = [np.zeros((4, 0), np.int32)]
        # In steps, so that one very long word does not hold all its comparisons at once.
        for lo in range(0, len(row), FAR_STARTS):
            head = place[lo : lo + FAR_STARTS]
            n = self.head_first[head + 1] - self.head_first[head]
            r, c = np.repeat(row[lo : lo + FAR_STARTS], n), np.repeat(col[lo : lo + FAR_STARTS], n)
            own = np.repeat(self.head_first[head] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            fits = c + self.far_sizes[own] <= sizes[r]
            r, c, own = r[fits], c[fits], own[fits]
            same = np.zeros(len(own), bool)
            for size in np.unique(self.far_sizes[own]):
                at = np.flatnonzero(self.far_sizes[own] == size)
                rest = np.arange(PIECE_BYTES, size)
                same[at] = (cells[r[at, None], c[at, None] + rest] == self.far_bytes[self.far_start[own[at], None] + rest]).all(axis=1)
            r, c, own = r[same], c[same], own[same]
            found.append(np.stack([r, c, c + self.far_sizes[own], self.far[own]]).astype(np.int32))
        return tuple(np.concatenate(found, axis=1))

    def _steps(self, cells: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
        """For every length up to ``PIECE_BYTES``: piece numbers (-1: none) by word and start; and the uses of longer pieces."""
        n, width = cells.shape
        far = (np.zeros(0, np.int32),) * 4
        out = []
        code = np.zeros((n, width), U64)
        for size in range(1, min(PIECE_BYTES, width) + 1):
            span = width - size + 1
            code = code[:, :span] | (cells[:, size - 1 :].astype(U64) << U64(8 * (size - 1)))
            keys, numbers, hint = self.tables[size - 1]
            found = np.full((n, span), -1, np.int64)
            if len(keys):
                row, col = np.nonzero(hint[(mix(code) >> U64(44)).astype(np.int64)] & (np.arange(span) + size <= sizes[:, None]))
                asked = code[row, col]
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[place] == asked
                found[row[hit], col[hit]] = numbers[place[hit]]
            out.append(found)
        if len(self.far) and width > PIECE_BYTES:
            far = self._far_steps(cells, sizes, code)
        return out, far

    def forward(self, cells: np.ndarray, sizes: np.ndarray, steps: list[np.ndarray], far: tuple[np.ndarray, ...]) -> np.ndarray:
        n, width = cells.shape
        order = np.argsort(far[2], kind="stable")
        row, col, end, long = (x[order] for x in far)
        first = np.searchsorted(end, np.arange(width + 2))
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for at in range(1, width + 1):
            ways = []
            for size in range(1, min(len(steps), at) + 1):
                piece = steps[size - 1][:, at - size]
                ways.append(np.where(piece >= 0, self.scores[piece] + self.go_on, -np.inf) + alpha[:, at - size])
            ways = np.stack(ways)
            top = ways.max(axis=0)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[:, at] = np.log(np.exp(ways - safe).sum(axis=0)) + safe
            own = slice(first[at], first[at + 1])
            np.logaddexp.at(alpha[:, at], row[own], self.scores[long[own]] + self.go_on + alpha[row[own], col[own]])
        return alpha

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for rows, cells, sizes in _grids(words):
            alpha = self.forward(cells, sizes, *self._steps(cells, sizes))
            out[rows] = alpha[np.arange(len(rows)), sizes] + self.stop
        return out

    def expected_counts(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of every piece over words, each counted once."""
        total = np.zeros(len(self.pieces))
        for rows, cells, sizes in _grids(words):
            steps, far = self._steps(cells, sizes)
            alpha = self.forward(cells, sizes, steps, far)
            n, width = cells.shape
            order = np.argsort(far[1], kind="stable")
            row, col, end, long = (x[order] for x in far)
            first = np.searchsorted(col, np.arange(width + 1))
            beta = np.full((n, width + 1), -np.inf)
            beta[np.arange(n), sizes] = 0
            whole = alpha[np.arange(n), sizes]
            for at in range(width - 1, -1, -1):
                ways = [beta[:, at]]
                for size in range(1, min(len(steps), width - at) + 1):
                    piece = steps[size - 1][:, at]
                    arc = np.where(piece >= 0, self.scores[piece] + self.go_on, -np.inf) + beta[:, at + size]
                    ways.append(arc)
                    use = (piece >= 0) & np.isfinite(arc) & np.isfinite(alpha[:, at])
                    share = np.exp(alpha[use, at] + arc[use] - whole[use])
                    total += np.bincount(piece[use], share, len(total))
                ways = np.stack(ways)
                top = ways.max(axis=0)
                safe = np.where(np.isfinite(top), top, 0)
                with np.errstate(divide="ignore"):
                    beta[:, at] = np.log(np.exp(ways - safe).sum(axis=0)) + safe
                own = slice(first[at], first[at + 1])
                arc = self.scores[long[own]] + self.go_on + beta[row[own], end[own]]
                use = np.isfinite(arc) & np.isfinite(alpha[row[own], at])
                share = np.exp(alpha[row[own], at][use] + arc[use] - whole[row[own]][use])
                total += np.bincount(long[own][use], share, len(total))
                np.logaddexp.at(beta[:, at], row[own], arc)
            del rows
        return total


def _grids(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of like length as (word numbers, byte cells, sizes), at most about CELLS cells at once."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        # Lengths within a quarter of each other, so that little of a grid is empty.
        width = int(sizes[order[lo]]) + max(1, int(sizes[order[lo]]) // 4)
        hi = int(min(np.searchsorted(sizes[order], width, "right"), lo + max(1, CELLS // max(1, width))))
        rows = order[lo:hi]
        own = sizes[rows]
        cells = np.zeros((len(rows), max(1, int(own.max()))), np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
        cells[np.repeat(np.arange(len(rows)), own), np.arange(len(flat)) - np.repeat(np.cumsum(own) - own, own)] = flat
        yield rows, cells, own
        lo = hi


def bundles(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows of (bundle, doc_ids, held, ends, codes, words, train): see the module text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.col("text"))
    schema = "bundle long, doc_ids array<long>, held array<boolean>, ends binary, codes binary, words array<string>, train array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            text = batch.column(2).cast(pa.large_string())
            marks = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            lo = 0
            while lo < batch.num_rows:
                room = BUNDLE_BYTES - held
                hi = int(np.searchsorted(marks, marks[lo] + room, "right")) - 1
                hi = min(batch.num_rows, max(hi, lo + (0 if waiting else 1)))
                if hi > lo:
                    waiting.append(batch.slice(lo, hi - lo))
                    held += int(marks[hi] - marks[lo])
                if hi < batch.num_rows:
                    yield _bundle(number, waiting)
                    number, waiting, held = number + 1, [], 0
                lo = hi
        if waiting:
            yield _bundle(number, waiting)

    return rows.mapInArrow(run, schema)


def _bundle(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    ids, held = table.column(0).to_pylist(), np.array(table.column(1).to_pylist(), bool)
    text = table.column(2)
    text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
    data, start, end, hashes, row = words_of(text)
    distinct, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
    train = np.bincount(codes, (~held)[row], len(distinct)).astype(np.int64) if len(codes) else np.zeros(len(distinct), np.int64)
    raw = data.tobytes()
    words = [raw[start[i] : end[i]].decode("utf-8") for i in first]
    ends = np.searchsorted(row, np.arange(len(ids)), "right")
    return pa.RecordBatch.from_pydict(
        {
            "bundle": pa.array([number], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())),
            "held": pa.array([held.tolist()], pa.list_(pa.bool_())), "ends": pa.array([ends.astype("<i8").tobytes()], pa.binary()),
            "codes": pa.array([zlib.compress(codes.astype("<i4").tobytes(), 1)], pa.binary()), "words": pa.array([words], pa.list_(pa.string())),
            "train": pa.array([train.tolist()], pa.list_(pa.int64())),
        }
    )


def fit_lattice(words: DataFrame, path: str, rounds: int = ROUNDS) -> Lattice:
    """Refit the vocabulary's scores on ``words.word``, each row once."""
    pieces, scores = read_pieces(path)
    lattice = Lattice(pieces, scores, float(np.log(0.7)), float(np.log(0.3)))
    for _ in range(rounds):

        def count(batches: Iterator[pd.DataFrame], lattice: Lattice = lattice) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(len(lattice.pieces)), 0
            for batch in batches:
                total += lattice.expected_counts([w.encode() for w in batch["word"]])
                n += len(batch)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"piece": np.append(used, -1), "n": np.append(total[used], n)})

        # At most one row per piece of the vocabulary comes back.
        found = words.mapInPandas(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = {r["piece"]: r["n"] for r in found}
        n_words = counts.pop(-1, 0.0)
        weight = np.full(len(pieces), 1e-3)
        for piece, n in counts.items():
            weight[piece] += n
        uses = sum(counts.values())
        ending = (n_words + 1) / (n_words + uses + 2)
        lattice = Lattice(pieces, np.log(weight / weight.sum()), float(np.log1p(-ending)), float(np.log(ending)))
    return lattice


def seen_before(codes: np.ndarray) -> np.ndarray:
    """How often the same number stands earlier in the list, by place."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(codes) else np.zeros(0, np.int64)
    out = np.empty(len(codes), np.int64)
    out[order] = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    return out


def text_score(codes: np.ndarray, model: np.ndarray, end: float) -> float:
    """log10 probability of the words ``codes`` and one end, given the corpus model's log10 probabilities."""
    before, at = seen_before(codes), np.arange(len(codes))
    base = model[codes] * LN10
    with np.errstate(divide="ignore"):
        own = np.log(before)
    ways = []
    for prior in PRIORS:
        words = np.logaddexp(np.log(prior) + base, own) - np.log(prior + at)
        ways.append(float(words.sum()) + end * LN10 + np.log(prior) - np.log(prior + len(codes)))
    return float(np.logaddexp.reduce(ways) - np.log(len(PRIORS))) / LN10


def score(docs: DataFrame, held_out: Column, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learning where ``held_out`` is false."""
    packed = settle(bundles(docs, held_out))
    listed = packed.select("bundle", F.posexplode(F.arrays_zip("words", "train")).alias("pos", "w"))
    listed = listed.select("bundle", "pos", F.col("w.words").alias("word"), F.col("w.train").alias("n"))
    counted = settle(listed.groupBy("word").agg(F.sum("n").alias("c")))
    facts = counted.agg(
        F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"),
        F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"),
    ).first()
    texts = packed.select(F.explode("held").alias("h")).filter("not h").count()
    words_n, v, n1, n2 = (int(x or 0) for x in facts)
    total, kinds = words_n + texts, v + (texts > 0)
    discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    lattice = fit_lattice(counted.filter("c > 0").select("word"), vocabulary)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(spelling=lattice.log_probability([w.encode() for w in batch["word"]]))

    spelled = counted.mapInPandas(spell, "word string, c long, spelling double")
    back = listed.select("bundle", "pos", "word").join(spelled, "word").select(F.col("bundle").alias("of"), "pos", "c", "spelling")
    base_of = lambda c: np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    end_base = float(base_of(texts))
    end_score = float(np.log10(texts / total)) if texts else float(np.log10(0.5))

    def add_up(group: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame([], columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        row = group.iloc[0]
        c, spelling = np.zeros(len(scored)), np.zeros(len(scored))
        c[scored["pos"]] = scored["c"]
        spelling[scored["pos"]] = scored["spelling"]
        if total:
            with np.errstate(divide="ignore"):
                own = np.where(c > 0, np.log(np.maximum(c - discount, 1e-300)), -np.inf)
            spare = np.log(discount * v) + spelling if v else np.full(len(c), -np.inf)
            model = (np.logaddexp(own, spare) - np.log(total)) / LN10 if v else (spelling + np.log(0.5)) / LN10
        else:
            model = (spelling + np.log(0.5)) / LN10
        codes, ends = np.frombuffer(zlib.decompress(row["codes"]), "<i4"), np.frombuffer(row["ends"], "<i8")
        starts = np.concatenate(([0], ends[:-1]))
        sums = []
        for values in (base_of(c), (c > 0).astype(float)):
            run = values[codes] if len(codes) else np.zeros(0)
            # Text by text, so that a text's sum does not depend on its neighbours.
            sums.append(np.array([run[a:b].sum() for a, b in zip(starts, ends, strict=True)]))
        scores = [text_score(codes[a:b], model, end_score) for a, b in zip(starts, ends, strict=True)]
        held = np.array(list(row["held"]), bool)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row["doc_ids"]], "Int64"), "held_out": held,
                "n_tokens": ends - starts + 1, "n_known": sums[1].astype(np.int64) + int(texts > 0), "train_tokens": total,
                "base_score": sums[0] + end_base, "score": scores,
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    light = packed.select("bundle", "doc_ids", "held", "ends", "codes")
    return light.groupBy("bundle").cogroup(back.groupBy("of")).applyInPandas(add_up, schema)
