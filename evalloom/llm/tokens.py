"""Token-ID output as directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id; an id that
needs more has its bit set in the level's continuation bitmap and its next chunk in the level
above, at the rank of that bit. A rank directory (set bits before every 512th position) makes a
rank one lookup and one popcount of at most 64 bytes, so any token is read without decoding others.

A dataset is a folder of Parquet files in ascending document order. One row is one document:

    part, row      number of the range and place inside it; (part, row) is the document order
    doc_id         the caller's id
    offset         ids of the documents before it in the same part
    n_tokens       ids of the document, with the end id
    codes          the code bytes: level count, then per level: chunks, bitmap, directory

The first id of a document in the whole dataset is ``offset`` plus the sizes of earlier parts,
which come from one row per part. Spark's writer commits the files, so a lost executor repeats
its parts only.

Defined cases: a null or empty text is the end id alone; rows with equal or null doc_id are kept
(nulls first, then by id, then by a hash of the text); an empty table gives an empty dataset; other columns
are ignored, whatever their names. Special-token strings in a text are encoded as the library
does by default (as their ids).
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.words import FORGET, byte_slices, tidy

CHUNK_BITS = 8
SUPERBLOCK = 512
#: Pieces, words among them, whose ids a worker keeps at most: half of them new, half from before; those not met again go.
CACHE_PIECES = 1_200_000
#: Texts are encoded in slices of about this size (or one text).
SLICE_BYTES = 1 << 20
FILES_SCHEMA = "part int, row long, doc_id long, offset long, n_tokens long, codes binary"


def pack_codes(ids: np.ndarray) -> bytes:
    """Code bytes of a list of ids below 2**32."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        directory = np.zeros(max(1, -(-len(rest) // SUPERBLOCK)), dtype="<u4")
        if len(rest):
            directory[1:] = np.add.reduceat(more, np.arange(0, len(rest), SUPERBLOCK), dtype=np.uint32).cumsum()[:-1]
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            return struct.pack("<B", len(levels)) + b"".join(levels)


def _levels(codes: bytes) -> list[tuple[int, int, int, int]]:
    """(count, place of chunks, of bitmap, of directory) of every level."""
    out, at = [], 1
    for _ in range(codes[0]):
        (n,) = struct.unpack_from("<Q", codes, at)
        chunks = at + 8
        bits = chunks + n
        directory = bits + (n + 7) // 8
        out.append((n, chunks, bits, directory))
        at = directory + 4 * max(1, -(-n // SUPERBLOCK))
    return out


def unpack_codes(codes: bytes) -> np.ndarray:
    """All ids, in order."""
    out: np.ndarray | None = None
    place = None
    for level, (n, chunks, bits, _) in enumerate(_levels(codes)):
        values = np.frombuffer(codes, np.uint8, n, chunks).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(codes, np.uint8, (n + 7) // 8, bits), count=n, bitorder="little")
        if out is None:
            out, place = values, np.flatnonzero(more)
        else:
            out[place] |= values << np.uint32(CHUNK_BITS * level)
            place = place[more.astype(bool)]
    return out


def code_at(codes: bytes, i: int) -> int:
    """The ``i``-th id, by chunk lookups and ranks only."""
    value, i = 0, int(i)
    for level, (n, chunks, bits, directory) in enumerate(_levels(codes)):
        if not 0 <= i < n:
            raise IndexError(i)
        value |= codes[chunks + i] << (CHUNK_BITS * level)
        if not codes[bits + i // 8] >> (i % 8) & 1:
            break
        block = i // SUPERBLOCK
        (before,) = struct.unpack_from("<I", codes, directory + 4 * block)
        first = bits + block * SUPERBLOCK // 8
        run = int.from_bytes(codes[first : bits + i // 8 + 1], "little")
        i = before + (run & ((1 << (i - block * SUPERBLOCK)) - 1)).bit_count()
    return value


_PLAIN = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space beyond the four plain ones, and what may start a special token: such texts go to the library whole.
_ODD_SPACES = (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ODD = re.compile("[" + "".join(map(chr, _ODD_SPACES)) + "]")


#: White space next to a space: such texts are cut by ``_PLAIN`` instead of at every space.
_RUNS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
#: Stands for "no space before" in the memory's keys.
BARE = "\0"
#: A line feed between two non-spaces, as a piece of its own with the one after it bare, in a text that is cut at spaces.
_LINE = f" {BARE}\n {BARE}"
#: What may follow a word of letters as one word of marks; an apostrophe may be part of a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces of characters below this one are cut into words here, by the byte-level pre-tokenizer's rule.
LATIN_END = "\u0250"
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_WORDS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^ \n\t\r{_LETTERS}{_NUMBERS}]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+"
)
_encoders: dict[str, Encoder] = {}


def _forget() -> None:
    for encoder in _encoders.values():
        encoder.seen.clear()
    _encoders.clear()


FORGET.append(_forget)


def _byte_letters() -> str:
    """The characters that stand for the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    named = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return "".join(chr(named[b]) for b in range(256))


class Memory(dict):
    """Pieces and their ids as bytes; one that neither this nor the memory before it has is made."""

    def __init__(self, make: Callable[[str], bytes], before: dict[str, bytes] | None = None) -> None:
        super().__init__()
        self.make = make
        self.before = before or {}

    def __missing__(self, piece: str) -> bytes:
        raw = self.before.get(piece)
        if raw is None:
            raw = self.make(piece)
        self[piece] = raw
        return raw


class Encoder:
    """Ids of whole texts by the tokenizers library, with a memory of pieces.

    The byte-level pre-tokenizer never joins what stands before and after the end of a
    non-space run, so a text is the concatenation of its pieces "spaces, then
    non-spaces". Latin pieces are cut into words, which are kept as pieces of their own, and each new word goes to the
    library's merge model; other pieces go to the whole library. Texts with rare white space or special tokens, and all
    texts of a vocabulary with another pre-tokenizer or a normalizer, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model, cutter = self.whole.model, self.whole.pre_tokenizer
        self.by_piece = (
            isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space and self.whole.normalizer is None
        )
        self.letters = _byte_letters()
        self.marks = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.seen = Memory(self._piece)
        self.space = self.letters[ord(" ")]
        self.coded = [struct.pack("<I", i) for i in range(1 + max(self.whole.get_vocab().values(), default=0))]

    @staticmethod
    def of(path: str) -> Encoder:
        """One per worker process and file, so that later tasks find its memory."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _library(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces of a text, without their leading space or with ``BARE`` where there is none; None when only the library may cut it."""
        if not self.by_piece or _ODD.search(text) or BARE in text or any(m in text for m in self.marks):
            return None
        if text[0] == " " or text[-1] == " " or any(r in text for r in _RUNS):
            return [x[1:] if x[0] == " " else BARE + x for x in _PLAIN.findall(text)]
        if "\n" in text and not ("\n" in (text[0], text[-1]) or "\n\n" in text or "\t" in text or "\r" in text):
            text = text.replace("\n", _LINE)
        pieces = text.split(" ")
        pieces[0] = BARE + pieces[0]
        return pieces

    def _word(self, word: str) -> bytes:
        coded = self.coded
        return b"".join([coded[t.id] for t in self.model.tokenize(codecs.charmap_decode(word.encode(), "strict", self.letters)[0])])

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            # Of the bytes of such a word only the space has another character standing for it.
            if piece.isalpha():
                coded = self.coded
                return b"".join([coded[t.id] for t in self.model.tokenize(self.space + piece)])
            letters = piece.rstrip(_MARKS)
            if letters.isalpha():
                return self.seen[letters] + self.seen[BARE + piece[len(letters) :]]
        text = piece[1:] if piece[:1] == BARE else " " + piece
        if not (text.isascii() or max(text) < LATIN_END):
            return self._library(text)
        # Letters alone are one word; ``isalpha`` and ``_LETTERS`` agree below ``LATIN_END``.
        if piece.isalpha():
            return self._word(text)
        letters = piece.rstrip(_MARKS)
        if letters.isalpha():
            return self.seen[letters] + self.seen[BARE + piece[len(letters) :]]
        words = _WORDS.findall(text)
        if len(words) == 1:
            return self._word(text)
        return b"".join([self.seen[w[1:] if w[0] == " " else BARE + w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if len(self.seen) > CACHE_PIECES // 2:
            self.seen.before = {}
            self.seen = Memory(self._piece, self.seen)
        get, out = self.seen.__getitem__, []
        for text in texts:
            pieces = self._pieces(text) if text else []
            out.append(b"".join(map(get, pieces)) if pieces is not None else self._library(text))
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode ``doc_id, text`` and write a dataset in ascending doc_id order.

    One range shuffle of the texts by doc_id (a hash of the text splits a repeated id); the encoded ids are written where they are
    made. ``tokenizer`` is a file of the tokenizers library that every executor can read.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        part, offset, row = TaskContext.get().partitionId(), 0, 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), SLICE_BYTES):
                some = batch.slice(lo, hi - lo)
                out = []
                for doc_id, raw in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, "<u4")
                    out.append((part, row, doc_id, offset, len(ids), pack_codes(ids)))
                    offset, row = offset + len(ids), row + 1
                yield _batch(out)

    (
        rows.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie", "text")
        .select("doc_id", "text")
        .mapInArrow(tidy(encode), FILES_SCHEMA)
        .write.option("maxRecordsPerFile", 0)
        .parquet(path)
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ("part", "row", "doc_id", "offset", "n_tokens", "codes")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``, the number of ids of all documents before.

    Adds the sizes of earlier parts from a table of one row per part, which the broadcast
    below carries: its size is the number of write tasks, not of documents.
    """
    files = spark.read.schema(FILES_SCHEMA).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    bases = sizes.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "_n"))).alias("_p"))
    bases = bases.select(F.explode(F.transform("_p", lambda x, i: F.struct(
        x["part"].alias("part"),
        F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["_n"]).alias("_base"),
    ))).alias("_b")).select("_b.*")
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("_base") + F.col("offset")).drop("_base")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files."""

    @F.pandas_udf("array<long>")
    def decode(codes):
        return codes.map(lambda b: unpack_codes(b).astype(np.int64))

    return read_dataset(spark, path).select("doc_id", "start", "n_tokens", decode("codes").alias("ids"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): checksum of the ids decoded from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpack_codes(x.as_py()) for x in batch.column("codes")]
            sums = [zlib.crc32(x.astype("<u4", copy=False)) for x in found]
            counts = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), counts, pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = read_dataset(spark, path).select("doc_id", "start", "codes")
    return rows.mapInArrow(tidy(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(position, doc_id, token) for ``positions.position``, counted over the whole dataset; others give no row.

    Documents and positions meet in buckets of consecutive positions; each token is then read
    by rank lookups from its document's codes.
    """
    rows = read_dataset(spark, path)
    last = F.floor((F.col("start") + F.col("n_tokens") - 1) / bucket)
    spans = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), last)))
    asked = positions.select(F.col("position").cast("long").alias("position"))
    asked = asked.withColumn("_b", F.floor(F.col("position") / bucket))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))

    @F.pandas_udf("long")
    def at(codes, i):
        return codes.combine(i, code_at)

    found = asked.join(spans, "_b").filter(inside)
    return found.select("position", "doc_id", at("codes", F.col("position") - F.col("start")).alias("token"))
