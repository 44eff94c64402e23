"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A text (A-Z lower-cased) is cut into windows of ``WINDOW`` bytes, the last padded; every window goes
through filters of several widths, a rectifier, the maximum over positions, and a softmax. A
text's probabilities are the mean over its windows, weighted by their letters; windows without
letters have no say. All windows of a text count.

Training takes a bounded sample: the rows with the smallest hashes of id and text, ``DOCS_PER_LANG`` of every
language, and of each ``WINDOWS_PER_DOC`` windows spread evenly over its whole text. Every language is learned: where
they are so many that this would exceed ``DOCS_IN_ALL`` documents, these are divided equally, one of each language at
least. These bounds and the number of languages, not the corpus, limit what reaches the driver.

Defined cases: a null text or one without any letter is ``und`` with score 0; without training rows
every text is ``und``; rows are kept as they are, repeated or not; rows with null or repeated doc_id are
learned from like others, rows with null language are not. A row's own language, source or id never enters its prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.llm.words import byte_slices, text_bytes, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DOCS_PER_LANG = 500
WINDOWS_PER_DOC = 4
DOCS_IN_ALL = 32_000
EPOCHS = 15
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def byte_codes() -> np.ndarray:
    """Code of every byte: 0 padding, letters and high bytes their own, space, digits and the rest one each."""
    codes = np.full(256, 2, np.int32)
    codes[[9, 10, 11, 12, 13, 32]] = 1
    codes[48:58] = 3
    codes[97:123] = np.arange(4, 30)
    codes[128:] = np.arange(30, 158)
    return codes


CODES = byte_codes()
N_CODES = 158


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of every window, text number, letters in it)."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(offsets[:-1], counts) + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    place = first[:, None] + np.arange(WINDOW)
    inside = place < offsets[1:][text][:, None]
    codes = np.where(inside, CODES[data[np.minimum(place, max(0, len(data) - 1))]] if len(data) else 0, 0).astype(np.int32)
    return codes, text, (codes >= 4).sum(axis=1)


class ByteNet:
    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (k, N_CODES, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        size = FILTERS * len(WIDTHS)
        self.dense = rng.normal(0, 0.2, (size, len(langs))).astype(np.float32)
        self.out = np.zeros(len(langs), np.float32)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.dense + self.out
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def tables(self) -> list[list[np.ndarray]]:
        """Filters by pairs of neighbouring codes: half as many lookups as one per code."""
        out = []
        for w in self.conv:
            steps = []
            for j in range(0, len(w) - 1, 2):
                steps.append((w[j][:, None, :] + w[j + 1][None, :, :]).reshape(N_CODES * N_CODES, FILTERS))
            if len(w) % 2:
                steps.append(w[-1])
            out.append(steps)
        return out

    def predict(self, codes: np.ndarray, tables: list[list[np.ndarray]], rows: int = 512) -> np.ndarray:
        parts = []
        for lo in range(0, len(codes), rows):
            own = codes[lo : lo + rows]
            pairs = own[:, :-1] * N_CODES + own[:, 1:]
            pooled = []
            for k, steps, bias in zip(WIDTHS, tables, self.bias, strict=True):
                n = WINDOW - k + 1
                total = steps[0][pairs[:, :n]]
                for s, step in enumerate(steps[1:], 1):
                    total += step[(pairs if 2 * s + 1 < k else own)[:, 2 * s : 2 * s + n]]
                pooled.append(np.maximum(total.max(axis=1) + bias, 0))
            parts.append(self._softmax(np.concatenate(pooled, axis=1)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11, batch: int = 64) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.conv, *self.bias, self.dense, self.out]
        first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                x, y = codes[rows], labels[rows]
                pooled, at = [], []
                for k, w, b in zip(WIDTHS, self.conv, self.bias, strict=True):
                    n = WINDOW - k + 1
                    total = sum(w[j][x[:, j : j + n]] for j in range(k))
                    where = total.argmax(axis=1)
                    pooled.append(np.take_along_axis(total, where[:, None, :], 1)[:, 0] + b)
                    at.append(where)
                raw = np.concatenate(pooled, axis=1)
                hidden = np.maximum(raw, 0)
                delta = self._softmax(hidden)
                delta[np.arange(len(rows)), y] -= 1
                delta /= len(rows)
                back = (delta @ self.dense.T) * (raw > 0)
                grads = []
                for i, (k, w) in enumerate(zip(WIDTHS, self.conv, strict=True)):
                    g = np.zeros_like(w)
                    own = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(k):
                        np.add.at(g[j], (np.take_along_axis(x, at[i] + j, 1), np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
                grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))]
                grads += [hidden.T @ delta + 1e-4 * self.dense, delta.sum(axis=0)]
                turn += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.005 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)


def _spread_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to WINDOWS_PER_DOC windows with letters of every text, evenly spread."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            data, offsets = text_bytes(part.column(1))
            codes, text, letters = windows_of(data, offsets)
            keep = []
            for i in range(part.num_rows):
                own = np.flatnonzero((text == i) & (letters >= 16))
                keep += list(own[np.linspace(0, len(own) - 1, min(len(own), WINDOWS_PER_DOC)).astype(int)]) if len(own) else []
            langs = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[text[i]] for i in keep], pa.string()), pa.array([codes[i].astype("<i4").tobytes() for i in keep], pa.binary())],
                names=["lang", "codes"],
            )


def train(docs: DataFrame, usable: Column) -> ByteNet | None:
    """Fit a network on rows of ``doc_id, text, lang`` where ``usable`` holds; None without any."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return None
    share = min(DOCS_PER_LANG, max(1, DOCS_IN_ALL // n_langs))
    # Sample by hashes only, then fetch the texts: the bound holds before any text moves. Equal rows have
    # equal hashes; they are fetched once and repeated as often as the sample holds them.
    keyed = rows.select("lang", F.col("doc_id").cast("string").alias("_id"), "text").select("lang", "text", F.xxhash64("_id", "text").alias("_h"))
    first = W.partitionBy("lang").orderBy("_h")
    ranked = keyed.select("lang", "_h").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= share)
    # DOCS_IN_ALL rows, or one a language, at most.
    sample = ranked.groupBy("lang", "_h").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    fetched = keyed.join(F.broadcast(sample), ["lang", "_h"]).groupBy("lang", "_h").agg(F.first("text").alias("text"), F.first("_copies").alias("_copies"))
    chosen = fetched.select("lang", "text", F.explode(F.sequence(F.lit(1), "_copies"))).select("lang", "text")
    found = chosen.mapInArrow(tidy(_spread_windows), "lang string, codes binary").collect()
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return None
    found.sort(key=lambda r: (r["lang"], bytes(r["codes"])))
    codes = np.stack([np.frombuffer(r["codes"], "<i4") for r in found]).astype(np.int32)
    net = ByteNet(langs)
    net.fit(codes, np.array([langs.index(r["lang"]) for r in found]))
    return net


def predict(docs: DataFrame, net: ByteNet | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the language and its probability, called ``names``. One pass, no shuffle."""
    # A kept text is sent once.
    sent = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*sent, *([] if "text" in keep else [F.col("text").alias("_text")]))
    at = keep.index("text") if "text" in keep else len(keep)
    fields = [f"_k{i} {rows.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    schema = ", ".join([*fields, "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for batch in batches:
            column = batch.column(at)
            for lo, hi in byte_slices(column, 1 << 20):
                lang, score = _predict_some(net, tables, column.slice(lo, hi - lo))
                own = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                fields = [*[f"_k{i}" for i in range(len(keep))], "lang_pred", "score"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=fields)

    out = rows.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def _predict_some(net: ByteNet | None, tables: list, column: pa.Array) -> tuple[list[str], list[float]]:
    lettered = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
    if net is None:
        return [UNKNOWN] * len(column), [0.0] * len(column)
    data, offsets = text_bytes(column)
    codes, text, letters = windows_of(data, offsets)
    seen = letters > 0
    codes, text, letters = codes[seen], text[seen], letters[seen]
    total = np.zeros((len(column), len(net.langs)))
    # In steps, so that one very long text does not hold all its windows' filters at once.
    for lo in range(0, len(codes), 4096):
        part = slice(lo, lo + 4096)
        np.add.at(total, text[part], net.predict(codes[part], tables) * letters[part][:, None].astype(np.float64))
    weight = total.sum(axis=1, keepdims=True)
    share = np.divide(total, weight, out=np.full_like(total, 1 / len(net.langs)), where=weight > 0)
    best = share.argmax(axis=1)
    lang = [net.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
    return lang, [float(min(1.0, share[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered, strict=True))]
