"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of at least
``MIN_CHARS`` code points take part. The store keeps, as Parquet below one folder and hashed to shards:

    lines     (shard, key, doc_id, n): every key of every stored document
    counts    (shard, key, refs, first_doc): documents holding a key, and the smallest of their ids
    filters   (shard, filter, items): one cuckoo filter per shard over the keys of ``counts``

Inserting probes the filters first: keys that no filter knows are new and skip the exact table;
the others (seen before, or a false positive) are settled there. Removing documents subtracts
their references; keys without any left leave the table and the filter, so that a removal undoes
an insertion. Filters never answer "absent" for a stored key: what does not fit goes to a stash,
and an overfull filter is built anew from the exact table. Where the store outgrows its shards it is dealt
to more of them, so that a shard stays at about ``KEYS_PER_SHARD`` lines however often documents are added.

Defined cases: null or empty text is one empty line; rows with one doc_id are one document; a
null doc_id is a document of its own whose copies lose against any id; inserting a stored doc_id
again adds its lines to that document; removing an unknown id does nothing; empty tables are fine;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.sources.scratch import remove, settle

MIN_CHARS = 10
STRIPPED = " \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 200
KEYS_PER_SHARD = 50_000
LOAD = 0.85

LINES = "shard int, key binary, doc_id long, n long"
COUNTS = "shard int, key binary, refs long, first_doc long"
FILTERS = "shard int, filter binary, items long"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """16-byte digest of the key, None for lines that take no part."""
    key = line.strip(STRIPPED)
    return hashlib.md5(key.encode("utf-8").lower()).digest() if len(key) >= min_chars else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports deletion. Keys are 16-byte digests, each stored once."""

    def __init__(self, buckets: int) -> None:
        self.buckets = 1 << max(3, (max(1, buckets) - 1).bit_length())
        self.table = [[] for _ in range(self.buckets)]
        self.stash: dict[tuple[int, int], int] = {}
        self.items = 0

    @staticmethod
    def sized_for(keys: int) -> CuckooFilter:
        return CuckooFilter(int(keys / (SLOTS * LOAD * 0.75)) + 1)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:10], "little") & (self.buckets - 1)
        return fingerprint, one, self._other(one, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995 >> 3)) & (self.buckets - 1)

    @staticmethod
    def _stash_key(fingerprint: int, one: int, two: int) -> tuple[int, int]:
        return fingerprint, min(one, two)

    def __contains__(self, key: bytes) -> bool:
        f, one, two = self._places(key)
        return f in self.table[one] or f in self.table[two] or self._stash_key(f, one, two) in self.stash

    def add(self, key: bytes) -> None:
        f, one, two = self._places(key)
        self.items += 1
        for bucket in (one, two):
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(f)
                return
        bucket = one
        for turn in range(KICKS):
            place = (f + turn) % SLOTS
            f, self.table[bucket][place] = self.table[bucket][place], f
            bucket = self._other(bucket, f)
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(f)
                return
        spare = self._stash_key(f, bucket, self._other(bucket, f))
        self.stash[spare] = self.stash.get(spare, 0) + 1

    def discard(self, key: bytes) -> None:
        """Take out a key that was added."""
        f, one, two = self._places(key)
        spare = self._stash_key(f, one, two)
        if spare in self.stash:
            self.stash[spare] -= 1
            if not self.stash[spare]:
                del self.stash[spare]
        elif f in self.table[one]:
            self.table[one].remove(f)
        elif f in self.table[two]:
            self.table[two].remove(f)
        else:
            raise KeyError(key)
        self.items -= 1

    def overfull(self, more: int = 0) -> bool:
        return self.items + more > LOAD * SLOTS * self.buckets

    def to_bytes(self) -> bytes:
        cells = np.zeros((self.buckets, SLOTS), "<u2")
        for i, bucket in enumerate(self.table):
            cells[i, : len(bucket)] = bucket
        stash = np.array([(f, b, n) for (f, b), n in self.stash.items()], "<u8").reshape(-1, 3)
        head = np.array([self.buckets, self.items, len(stash)], "<u8")
        return head.tobytes() + cells.tobytes() + stash.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        buckets, items, spare = (int(x) for x in np.frombuffer(data, "<u8", 3))
        out = CuckooFilter(buckets)
        out.items = items
        cells = np.frombuffer(data, "<u2", buckets * SLOTS, 24).reshape(-1, SLOTS)
        out.table = [[f for f in row if f] for row in cells.tolist()]
        stash = np.frombuffer(data, "<u8", 3 * spare, 24 + 2 * buckets * SLOTS).reshape(-1, 3)
        out.stash = {(int(f), int(b)): int(n) for f, b, n in stash}
        return out


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter from all its keys."""
    made = CuckooFilter.sized_for(len(group))
    for key in group["key"]:
        made.add(key)
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "filter": [made.to_bytes()], "items": [made.items]})


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The keys of a shard with what its filter says."""
    known = CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else CuckooFilter(1)
    return keys.assign(maybe=[key in known for key in keys["key"]])


def _change(added: bool):
    def run(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters):
            return _build(keys)
        known = CuckooFilter.from_bytes(filters["filter"].iloc[0])
        for key in keys["key"]:
            (known.add if added else known.discard)(key)
        return filters.assign(filter=[known.to_bytes()], items=[known.items])

    return run


class LineStore:
    """The state below ``path`` (shared storage). Every change writes a new version and then switches to it."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None) -> None:
        self.spark, self.path, self.shards, self.version = spark, path.rstrip("/"), shards, 0

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{self.version}/{name}")

    def lines(self) -> DataFrame:
        return self._read("lines", LINES)

    def counts(self) -> DataFrame:
        return self._read("counts", COUNTS)

    def filters(self) -> DataFrame:
        return self._read("filters", FILTERS)

    def _write(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/v{self.version + 1}/{name}")

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def line_keys(self, docs: DataFrame) -> DataFrame:
        """(key, doc_id, n): a document's keys with how many of its lines have them."""

        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), 500):
                    out = []
                    part = batch.iloc[lo : lo + 500]
                    for doc_id, text in zip(part["id"], part["text"], strict=True):
                        out += [(key, doc_id) for line in text.split("\n") if (key := line_key(line)) is not None]
                    yield pd.DataFrame(out, columns=["key", "id"])

        # Ids travel as text, so that a null stays apart from every number.
        rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        found = rows.mapInPandas(keys, "key binary, id string")
        return found.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")).select(
            "key", F.when(F.col("id") != "", F.col("id").cast("long")).alias("doc_id"), "n"
        )

    def _switch(self) -> None:
        """Go to the version just written; the one before it stays, older ones go."""
        self.version += 1
        if self.version > 2:
            remove(self.spark, f"{self.path}/v{self.version - 2}")

    def _deal(self, shards: int) -> None:
        """The same state in more shards."""
        lines, counts = self.lines(), self.counts()
        self.shards = shards
        self._write("lines", lines.withColumn("shard", self._shard()))
        self._write("counts", counts.withColumn("shard", self._shard()))
        self._write("filters", self.counts_of(self.version + 1).groupBy("shard").applyInPandas(_build, FILTERS))
        self._switch()

    def insert(self, docs: DataFrame) -> None:
        found = settle(self.line_keys(docs))
        wanted = -(-(found.count() + self.lines().count()) // KEYS_PER_SHARD)
        if self.shards is None:
            self.shards = max(8, wanted)
        elif self.version and wanted > 2 * self.shards:
            self._deal(wanted)
        found = found.withColumn("shard", self._shard()).select("shard", "key", "doc_id", "n")
        if not self.version:
            self._write("lines", found)
            fresh = self._references(found)
            self._write("counts", fresh)
            self._write("filters", self.counts_of(self.version + 1).groupBy("shard").applyInPandas(_build, FILTERS))
            self._switch()
            return
        stored = self.lines()
        more = found.join(stored.select("key", F.col("doc_id").alias("_d")), (found["key"] == stored["key"]) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")
        added = settle(self._references(more))
        probed = settle(added.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_probe, COUNTS + ", maybe boolean").filter("refs > 0"))
        maybe, new = probed.filter("maybe"), probed.filter("not maybe").drop("maybe")
        old = self.counts()
        both = old.join(maybe.select("key", F.col("refs").alias("_r"), F.col("first_doc").alias("_f")), "key", "left").select(
            "shard", "key", (F.col("refs") + F.coalesce("_r", F.lit(0))).alias("refs"), F.least("first_doc", "_f").alias("first_doc")
        )
        false = maybe.drop("maybe").join(old.select("key"), "key", "left_anti").select("shard", "key", "refs", "first_doc")
        self._write("lines", stored.unionByName(found))
        self._write("counts", both.unionByName(new).unionByName(false))
        self._write("filters", self._updated(settle(new.unionByName(false)), added=True))
        self._switch()

    def remove(self, ids: DataFrame) -> None:
        """Take out the documents of ``ids.doc_id``."""
        gone_ids = ids.select(F.col("doc_id").cast("long").alias("_d")).distinct()
        stored = self.lines()
        same = F.col("doc_id").eqNullSafe(F.col("_d"))
        kept = stored.join(gone_ids, same, "left_anti")
        touched = settle(stored.join(gone_ids, same, "left_semi").select("key").distinct())
        left = settle(self._references(kept.join(touched, "key", "left_semi").select("shard", "key", "doc_id", "n")))
        old = self.counts()
        dead = settle(old.join(touched, "key", "left_semi").join(left.select("key"), "key", "left_anti").select(*old.columns))
        self._write("lines", kept)
        self._write("counts", old.join(touched, "key", "left_anti").select(*old.columns).unionByName(left))
        self._write("filters", self._updated(dead, added=False))
        self._switch()

    def _references(self, lines: DataFrame) -> DataFrame:
        """Counts per key, combined before the shuffle; lines hold a (key, doc_id) once per insertion."""
        return (
            lines.groupBy("shard", "key")
            .agg(
                (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("refs"),
                F.min("doc_id").alias("first_doc"),
            )
            .select("shard", "key", "refs", "first_doc")
        )

    def _updated(self, keys: DataFrame, added: bool) -> DataFrame:
        """Filters with keys added or taken out; built anew from the exact table when one would be overfull."""
        if added:
            growth = keys.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).join(self.filters(), "shard")
            room = F.floor(F.length("filter") / (2 * SLOTS)) * SLOTS * LOAD * 0.9
            if growth.filter(F.col("items") + F.col("_n") > room).limit(1).count():
                return self.counts_of(self.version + 1).groupBy("shard").applyInPandas(_build, FILTERS)
        return keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_change(added), FILTERS)

    def counts_of(self, version: int) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(f"{self.path}/v{version}/counts")

    def dropped_keys(self) -> DataFrame:
        """(doc_id, keys): the keys a document loses, as it is not the first that holds them."""
        repeated = self.counts().filter("refs > 1").select("key", "first_doc")
        rows = self.lines().join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        return rows.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, n_lines, n_dropped) of stored documents, one row per row of ``docs``."""
        drops = self.dropped_keys().withColumnRenamed("doc_id", "_d")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d")

        @F.pandas_udf("text string, n_lines long, n_dropped long")
        def cut(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
            out = []
            for text, own in zip(texts, keys, strict=True):
                lines = text.split("\n")
                kept = lines
                if own is not None and len(own):
                    gone = set(own)
                    kept = [line for line in lines if line_key(line) not in gone]
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

        return joined.select("doc_id", cut("text", "keys").alias("_c")).select("doc_id", "_c.*")
