"""N-gram Jaccard join of whole texts with signature trees; classes are connected components of links.

A text's set is its distinct ``SHINGLE``-word shingles, as 64-bit hashes (two shingles are taken for
equal when their hashes are). Two texts link when 100 * intersection >= PERCENT * union.

1. Equal sets are one node from here on (64-bit digest), so copies never meet each other.
2. A node whose least hashes share too little with every other node cannot link. Of a linked pair, the n -
   ceil(0.8 n) + k least hashes of each contain k common ones; nodes below that count are done.
3. The others are ordered by how many nodes hold a shingle, rarest first. Linked pairs share one
   of their first n - ceil(0.8 n) + 1 shingles; nodes connected through such shingles form a block, outside
   which they have no link.
4. In a block, a signature tree holds for every tree node the OR of its texts' token bitmaps and the range of
   their set sizes. Pairs of tree nodes are visited from the root and dropped when sizes
   or the largest possible overlap rule a link out, or when all texts below already belong to one
   component; pairs of texts that remain are compared exactly.
5. A block above ``CHUNK`` nodes is split into chunks by hash. Chunks are joined alone, then one hub of each of
   their components against the others, and then only those pairs of chunks that hold more
   than one component between them. So a huge group of near copies costs a pass over it, and no link between
   components is left out.

No pair list of a group is ever made: what leaves a task is at most one link per merged node.

Defined cases: null, empty or blank texts have an empty set, no link, and are their own component; rows with
equal doc_id are rows of their own; a null doc_id takes the smallest id of its component, null when
there is none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.components import connected
from evalloom.llm.words import U64, byte_slices, mix, shingle_sets, tidy
from evalloom.sources.scratch import settle

SHINGLE = 5
PERCENT = 80
CHUNK = 2000
BITS = 2048
LEAF = 16
FAN = 8
#: Share of a set by which the least hashes of step 2 reach beyond the shortest sound prefix.
EXTRA = 10
LINK = "a long, b long"
#: Up to this many ids (eight bytes each, some tens of megabytes as a table) are broadcast, so that texts stay where they are.
BROADCAST_IDS = 1_000_000


def at_least(n: int, percent: int = PERCENT) -> int:
    """Smallest overlap that a set of ``n`` can have with a linked one."""
    return -(-percent * n // 100)


def digest(own: np.ndarray) -> int:
    return int(mix(mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64, keepdims=True) + U64(len(own))).view(np.int64)[0])


class SignatureTree:
    """Tree over sets, most similar next to each other. Nodes of a level: OR bitmaps, size range, slack, row range."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: (sets[i][0], len(sets[i]), i))
        self.sizes = np.array([len(sets[i]) for i in self.order])
        self.signs = np.zeros((len(sets), BITS // 64), np.uint64)
        for row, i in enumerate(self.order):
            bits = np.zeros(BITS, bool)
            bits[(sets[i] & U64(BITS - 1)).astype(np.int64)] = True
            self.signs[row] = np.packbits(bits, bitorder="little").view(np.uint64)
        # Several tokens may share a bit: that many more than the common bits two sets may have in common.
        self.slack = self.sizes - np.bitwise_count(self.signs).sum(axis=1)
        self.levels = []
        starts = np.arange(0, len(sets), LEAF)
        while True:
            ends = np.append(starts[1:], len(sets))
            fold = lambda f, x, s=starts: f.reduceat(x, s, axis=0)
            self.levels.append(
                (starts, ends, fold(np.bitwise_or, self.signs), fold(np.minimum, self.sizes), fold(np.maximum, self.sizes), fold(np.maximum, self.slack))
            )
            if len(starts) == 1:
                break
            starts = starts[::FAN]


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, labels: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what linked sets there are: pairs of positions, into ``left + right``.

    Without ``right`` the sets of ``left`` among themselves, else those of ``left`` with those of ``right``. Sets
    with equal ``labels`` are connected already. Every link found joins two labels, and afterwards no linked
    pair has different ones.
    """
    if not left or right is not None and not right:
        return []
    sets = left if right is None else left + right
    one = SignatureTree(left)
    two = one if right is None else SignatureTree(right)
    shift = 0 if right is None else len(left)
    label_one = labels[one.order]
    label_two = label_one if right is None else labels[[shift + i for i in two.order]]
    links = []
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        s1, e1, or1, lo1, hi1, slack1 = (x[a] for x in one.levels[la])
        s2, e2, or2, lo2, hi2, slack2 = (x[b] for x in two.levels[lb])
        if 100 * hi2 < percent * lo1 or 100 * hi1 < percent * lo2:
            continue
        common = int(np.bitwise_count(or1 & or2).sum())
        if (100 + percent) * min(common + min(slack1, slack2), hi1, hi2) < percent * (lo1 + lo2):
            continue
        la_min, la_max = label_one[s1:e1].min(), label_one[s1:e1].max()
        if la_min == la_max == label_two[s2:e2].min() == label_two[s2:e2].max():
            continue
        if la or lb:
            deeper_a = [(la - 1, i) for i in range(a * FAN, min((a + 1) * FAN, len(one.levels[la - 1][0])))] if la and la >= lb else [(la, a)]
            deeper_b = [(lb - 1, i) for i in range(b * FAN, min((b + 1) * FAN, len(two.levels[lb - 1][0])))] if lb and lb >= la else [(lb, b)]
            for x in deeper_a:
                for y in deeper_b:
                    if one is not two or x[0] != y[0] or x[1] <= y[1]:
                        stack.append((*x, *y))
            continue
        n1, n2 = one.sizes[s1:e1, None], two.sizes[None, s2:e2]
        shared = np.bitwise_count(one.signs[s1:e1, None] & two.signs[None, s2:e2]).sum(axis=2, dtype=np.int64)
        most = np.minimum(shared + np.minimum(one.slack[s1:e1, None], two.slack[None, s2:e2]), np.minimum(n1, n2))
        maybe = (100 + percent) * most >= percent * (n1 + n2)
        for i, j in zip(*np.nonzero(maybe), strict=True):
            x, y = s1 + i, s2 + j
            if label_one[x] == label_two[y] or one is two and x >= y:
                continue
            first, second = one.order[x], shift + two.order[y]
            if linked(sets[first], sets[second], percent):
                links.append((first, second))
                old, new = label_two[y], label_one[x]
                label_one[label_one == old] = new
                label_two[label_two == old] = new
    return links


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    both = int((b[np.minimum(place, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _unsigned(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(x, np.int64).view(U64) for x in column]


def _inside(group: pd.DataFrame) -> pd.DataFrame:
    ids = group["g"].to_numpy()
    found = tree_links(_unsigned(group["own"]), None, np.arange(len(ids)))
    return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"], dtype="int64")


def _between(group: pd.DataFrame) -> pd.DataFrame:
    first = group["side"].to_numpy() == 0
    group = pd.concat([group[first], group[~first]])
    ids, sets = group["g"].to_numpy(), _unsigned(group["own"])
    labels = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
    n = int(first.sum())
    found = tree_links(sets[:n], sets[n:], labels)
    return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"], dtype="int64")


def text_mark() -> Column:
    """Hash of the text column; together with doc_id it names a row, up to equal rows."""
    return F.xxhash64(F.col("text"))


def summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, g, heads): set size, digest (null for an empty set) and the least hashes of step 2."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), text_mark().alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(lo, hi - lo), SHINGLE)
                heads = [own[: len(own) - at_least(len(own)) + max(1, len(own) // EXTRA)] if len(own) else own for own in sets]
                flat = np.concatenate(heads) if heads else np.zeros(0, U64)
                marks = np.concatenate(([0], np.cumsum([len(h) for h in heads])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(own) for own in sets], pa.int64()),
                        pa.array([digest(own) if len(own) else None for own in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(flat.view(np.int64))),
                    ],
                    names=["doc_id", "mark", "n", "g", "heads"],
                )

    return rows.mapInArrow(tidy(run), "doc_id long, mark long, n long, g long, heads array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(g, own): digest and whole set of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(0)):
                sets = [own for own in shingle_sets(batch.column(0).slice(lo, hi - lo), SHINGLE) if len(own)]
                if sets:
                    marks = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                    flat = pa.array(np.concatenate(sets).view(np.int64))
                    own = pa.ListArray.from_arrays(pa.array(marks, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.int64()), own], names=["g", "own"])

    return docs.select("text").mapInArrow(tidy(run), "g long, own array<long>")


def _alpha(n: str):
    return F.ceil(F.col(n) * PERCENT / 100)


def _survivors(rows: DataFrame) -> DataFrame:
    """Nodes of step 2 with the smallest doc_id that holds each: (g, n, first_id)."""
    post = rows.filter("g is not null").select("g", F.explode("heads").alias("h"))
    # A window moves the hashes once; counting them first and joining the counts back would move them twice.
    holders = Window.partitionBy("h")
    shared = post.select("g", (F.min("g").over(holders) < F.max("g").over(holders)).alias("shared")).filter("shared")
    counts = shared.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    nodes = rows.filter("g is not null").groupBy("g").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.min("doc_id").alias("first_id")
    )
    need = F.greatest(F.lit(1), F.floor(_alpha("n") / EXTRA))
    return counts.join(nodes, "g").filter(F.col("c") >= need * F.col("copies")).select("g", "n", "first_id")


def _blocks(sets: DataFrame) -> DataFrame:
    """(g, block) of nodes that share a rare shingle with another."""
    tokens = sets.select("g", "n", F.explode("own").alias("h"))
    common = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("df > 1")
    held = common.groupBy("g", "n").agg(F.collect_list(F.struct("df", "h")).alias("held"))
    # Shingles that no other node holds come first in the order and use up their share of the prefix.
    room = F.col("n") - _alpha("n") + 1 - (F.col("n") - F.size("held"))
    rare = held.withColumn("room", room.cast("int")).filter("room > 0").select("g", F.explode(F.slice(F.array_sort("held"), F.lit(1), F.col("room"))).alias("t"))
    post = settle(rare.select("g", F.col("t.h").alias("h")))
    hubs = post.groupBy("h").agg(F.min("g").alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    pairs = post.join(hubs, "h").filter("g != p").select(F.col("g").alias("a"), F.col("p").alias("b")).distinct()
    return connected(pairs).select(F.col("node").alias("g"), F.col("root").alias("block"))


def _large_links(rows: DataFrame, links: DataFrame, chunk: int) -> DataFrame:
    """Links across the chunks of large blocks, see step 5. ``rows``: g, block, chunk, own."""

    def label(found: DataFrame) -> DataFrame:
        roots = connected(found).select(F.col("node").alias("g"), F.col("root").alias("_r"))
        return settle(rows.select("g", "block", "chunk").join(roots, "g", "left").select("g", "block", "chunk", F.coalesce("_r", "g").alias("label")))

    first = label(links)
    hubs = first.groupBy("block", "chunk", "label").agg(F.min("g").alias("g")).select("block", "g")
    many = hubs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_n"))
    hubs = hubs.join(many, "block").select("g", F.col("block").alias("of"), F.pmod(F.xxhash64("g", F.lit(1)), F.col("_n")).alias("part"))
    second = settle(hubs.join(rows.select("g", "own"), "g").groupBy("of", "part").applyInPandas(_inside, LINK))
    known = links.unionAll(second)
    labels = label(known)
    sums = settle(labels.groupBy("block", "chunk").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    x, y = (sums.select("block", *[F.col(c).alias(f"{c}{i}") for c in ("chunk", "lo", "hi")]) for i in (1, 2))
    # Chunks that together hold one component need no look; there is one row per chunk here, not per text.
    pairs = x.join(y, "block").filter("chunk1 < chunk2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)").select("block", "chunk1", "chunk2")
    pairs = settle(pairs)
    data = settle(labels.join(rows.select("g", "own"), "g"))
    sides = [
        data.join(pairs, (data["block"] == pairs["block"]) & (data["chunk"] == pairs[f"chunk{i + 1}"])).select(
            pairs["block"].alias("of"), "chunk1", "chunk2", F.lit(i).alias("side"), "g", "label", "own"
        )
        for i in (0, 1)
    ]
    third = settle(sides[0].unionAll(sides[1]).groupBy("of", "chunk1", "chunk2").applyInPandas(_between, LINK))
    return second.unionAll(third)


def _classes(docs: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, mark, n, c) per row, stored; rows with equal ``c`` are one component, null: an empty set."""
    rows = settle(summaries(docs))
    nodes = settle(_survivors(rows))
    ids = settle(nodes.select(F.col("first_id").alias("_id")).distinct())
    if ids.count() <= BROADCAST_IDS:  # else a shuffle join, with the same rows
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(ids, F.col("_d").eqNullSafe(F.col("_id")), "left_semi")
    wanted = full_sets(texts).join(nodes.select(F.col("g").alias("_g")), F.col("g") == F.col("_g"), "left_semi")
    sets = settle(wanted.groupBy("g").agg(F.first("own").alias("own")).withColumn("n", F.size("own")))
    placed = settle(_blocks(sets))
    chunks = placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    members = placed.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("g"), F.col("chunks")))
    data = settle(members.join(sets.select("g", "own"), "g").select("g", "block", "chunks", "chunk", "own"))
    links = settle(data.groupBy("block", "chunk").applyInPandas(_inside, LINK))
    large = data.filter("chunks > 1")
    if large.limit(1).count():
        links = links.unionAll(_large_links(large.drop("chunks"), links, chunk))
    roots = connected(links).select(F.col("node").alias("_g"), F.col("root").alias("_root"))
    named = rows.select("doc_id", "mark", "n", "g").join(roots, F.col("g") == F.col("_g"), "left")
    return settle(named.select("doc_id", "mark", "n", F.coalesce("_root", "g").alias("c")))


def join(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``doc_id, text``."""
    named = _classes(docs, chunk)
    least = named.filter("c is not null").groupBy(F.col("c").alias("_c")).agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.join(least, F.col("c") == F.col("_c"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")
    )


def keep_one(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component (null ids last), all columns kept.

    Of equal rows (doc_id and text) one stays; rows with an empty set count as copies of one another
    only when they are such equal rows.
    """
    named = _classes(docs, chunk)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = named.filter("c is not null").groupBy("c").agg(F.min(row).alias("r")).select("r.doc_id", "r.mark")
    alone = named.filter("c is null").select("doc_id", "mark").distinct()
    kept = first.unionAll(alone).select(F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("doc_id").isNull().alias("_z"), F.col("mark").alias("_m"))
    own = F.col("doc_id").cast("long")
    keyed = docs.select("*", F.coalesce(own, F.lit(0)).alias("_i"), own.isNull().alias("_z"), text_mark().alias("_m"))
    return keyed.join(kept, ["_i", "_z", "_m"], "left_semi").dropDuplicates(["_i", "_z", "_m"]).select(*[F.col(f"`{c}`") for c in docs.columns])
