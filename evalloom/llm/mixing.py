"""Mixing sources to target weights, in fixed-length word blocks. DataFrame functions only.

The words of a source, documents in a fixed pseudorandom order, are one stream cut into blocks of
``block_words`` words. An output shard draws, for each of its slots, a source with probability
proportional to its target (multinomial counts per shard). A source's running counts are then
scaled so that its slots over all shards hit its target exactly. Slot ``t`` of a source belongs to pass
``t // blocks`` over the stream, and within a pass a keyed permutation of the block numbers says
which block it reads, so every pass reads every block once; the short last block is read last.
Blocks and documents meet by (source, block).

Targets: sources in code-point order (null last) have weights cycling through ``weights`` and
share ``share`` times all words; a target stops at ``limit`` times its source's words and the excess is
shared by weight among the others until none is above.

The permutation is the swap-or-not shuffle: each round pairs ``x`` with ``(k - x) mod n`` and a
hash of the larger one decides whether to swap. It permutes 0..n-1 for every n, with no table.

No group grows with a source: offsets are summed per (source, hash prefix of the id) with the
prefix length following the row count, and blocks are far smaller than that. Only tables of one row per
source, per (source, shard) and per (source, prefix) are put in order.

Defined cases: null or blank text has size 0 and takes nothing; null doc_id and repeated rows are
rows of their own; a null source is a source, after all others; a source without words has target 0;
an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.core import bind
from evalloom.sources.scratch import settle

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space after it: joined, these are the text from its first word on.
SPACED_WORD = WORD + r"[\x20\x09-\x0D]*"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
ROUNDS = 12
SEED = "mix"
ROWS_PER_PREFIX = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_number(text: Column) -> Column:
    """Non-negative 60-bit number from the MD5 of a text."""
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, sid, source_size, target) from (source, source_size): one row per source.

    With sources in ascending order of cap / weight, the level at which the sources from here on
    would share what the earlier ones leave is highest at the first one below its cap.
    """
    every = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("sid", F.row_number().over(every).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * limit).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("w"), "sid")
    from_here = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(W.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("w").over(from_here))
    level = level.withColumn("level", F.max("level").over(W.partitionBy(F.lit(0))))
    return level.select("source", "sid", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def permuted(x: Column, n: Column, key: Column, k0: Column, k1: Column, rounds: int = ROUNDS) -> Column:
    """Where the keyed permutation of 0..n-1 sends ``x``."""

    def swap(acc: Column, r: Column) -> Column:
        def choose(other: Column) -> Column:
            code = F.md5(F.concat_ws(":", key, r.cast("string"), F.greatest(acc, other).cast("string")).cast("binary"))
            return F.when(F.substr(code, F.lit(1), F.lit(1)) < "8", other).otherwise(acc)

        return bind(F.pmod(F.pmod(k0 + r * k1, n) - acc, n), choose)

    return F.aggregate(F.array(*[F.lit(i).cast("long") for i in range(1, rounds + 1)]), x, swap)


@dataclass
class Mix:
    """``docs``: row_id, doc_id, source, sid, size, start; ``sources``: see :func:`source_targets`, with the words to
    take; ``slots``: shard, sid, slot, epoch, block, words (a slot takes the first ``words`` words of its block)."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = SEED, row_id: str | None = None,
) -> Mix:
    """Plan a mix of ``doc_id, source, text``. ``row_id`` names a stored unique column, if there is one."""
    spark = docs.sparkSession
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    sized = settle(docs.select(rid.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")))
    n_rows = sized.count()
    digits = 0
    while n_rows > ROWS_PER_PREFIX << (4 * digits):
        digits += 1
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    words = F.least(F.round("target").cast("long"), F.col("source_size") * limit)
    full, tail = F.floor(F.col("source_size") / block_words), F.pmod(F.col("source_size"), F.lit(block_words))
    sources = sources.withColumn("words", words).withColumn("full", full).withColumn("blocks", full + F.when(tail > 0, 1).otherwise(0))
    whole = F.floor(F.try_divide(F.col("words"), F.col("source_size")))
    rest = F.col("words") - whole * F.col("source_size")
    sources = settle(sources.withColumn("n_slots", F.coalesce((whole * F.col("blocks") + F.ceil(rest / block_words)).cast("long"), F.lit(0).cast("long"))))

    # Where a document starts in its source's stream: order by (hash of the id, id, row).
    code = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = sized.withColumn("_h", code).withColumn("_p", F.substr("_h", F.lit(1), F.lit(digits)))
    heads = keyed.groupBy("source", "_p").agg(F.sum("size").alias("_s"))
    upto = W.partitionBy("source").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(F.col("source").alias("_src"), F.col("_p").alias("_pre"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source", "_p").orderBy("_h", "doc_id", "size", "row_id").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(heads, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_p") == F.col("_pre")))
    names = sources.select(F.col("source").alias("_src2"), "sid")
    placed = placed.join(names, F.col("source").eqNullSafe(F.col("_src2")))
    placed = placed.select("row_id", "doc_id", "source", "sid", "size", (F.col("_base") + F.col("_in")).alias("start"))

    return Mix(placed, sources, _slots(spark, sources, block_words, shard_slots, seed), block_words)


def _slots(spark, sources: DataFrame, block_words: int, shard_slots: int, seed: str) -> DataFrame:
    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    # One row: the sources' shares as running ends between 0 and 1.
    upto = W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = (
        sources.select("sid", (F.sum("n_slots").over(upto) / F.lit(max(1, total))).alias("end"))
        .agg(F.array_sort(F.collect_list(F.struct("end", "sid"))).alias("e"))
        .scalar()
    )
    coin = (hash_number(F.concat_ws(":", F.lit(seed), F.lit("draw"), F.col("id").cast("string"))) / F.lit(float(1 << 60)))
    drawn = spark.range(total).select("id", F.floor(F.col("id") / shard_slots).alias("shard"), ends.alias("e"))
    # The draw is bound to a variable, so that it is hashed once and not once per source.
    sid = bind(coin, lambda u: F.element_at(F.filter("e", lambda x: x["end"] > u), 1)["sid"])
    counts = drawn.select("shard", sid.alias("sid")).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    # One draw more for every source, so that none with a target goes without.
    last = max(1, -(-total // shard_slots))
    spare = sources.filter("n_slots > 0").select(F.pmod("sid", F.lit(last)).alias("shard"), "sid", F.lit(1).cast("long").alias("n"))
    counts = counts.unionByName(spare).groupBy("shard", "sid").agg(F.sum("n").alias("n"))
    run = W.partitionBy("sid").orderBy("shard")
    upto = run.rowsBetween(W.unboundedPreceding, W.currentRow)
    known = counts.join(sources.select("sid", "source_size", "words", "full", "blocks", "n_slots"), "sid")
    known = known.withColumn("_run", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(W.partitionBy("sid")))
    known = known.withColumn("_to", F.floor(F.col("n_slots") * F.col("_run") / F.col("_all")).cast("long"))
    known = known.withColumn("_from", F.coalesce(F.lag("_to").over(run), F.lit(0)))
    slots = known.filter("_to > _from").select("*", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("slot"))
    # The counts are few rows in few tasks; their slots are spread before each is permuted. A stated number of
    # partitions, since few bytes with much work would be coalesced to one task; the result is written, since a
    # join on the block would push its null check, and so the permutation, below the shuffle.
    columns = ["shard", "sid", "source_size", "words", "full", "blocks", "slot"]
    slots = slots.select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sid", "slot")
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks"))).withColumn("_j", F.pmod("slot", "blocks"))
    key = F.concat_ws(":", F.lit(seed), F.col("sid").cast("string"), F.col("epoch").cast("string"))
    slots = slots.withColumn("_key", key)
    n = F.greatest("full", F.lit(1))
    keys = F.struct(*[F.pmod(hash_number(F.concat_ws(":", "_key", F.lit(name))), n).alias(name) for name in ("first", "step")])
    inner = bind(keys, lambda k: permuted(F.col("_j"), n, F.col("_key"), k["first"], k["step"]))
    block = F.when(F.col("_j") < F.col("full"), inner).otherwise(F.col("full"))
    left = F.least(F.col("words") - F.col("epoch") * F.col("source_size"), F.col("source_size")) - F.col("_j") * block_words
    return settle(slots.select("shard", "sid", "slot", "epoch", block.alias("block"), F.least(F.lit(block_words), left).cast("long").alias("words")))


def pieces(plan: Mix) -> DataFrame:
    """(row_id, shard, slot, epoch, first, words): which words of a document which slot takes, counted from 0."""
    b = plan.block_words
    end = F.col("start") + F.col("size")
    spans = plan.docs.filter("size > 0").select(
        "row_id", "sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block")
    )
    met = spans.join(plan.slots, ["sid", "block"])
    lo = F.greatest(F.col("start"), F.col("block") * b)
    hi = F.least(end, F.col("block") * b + F.col("words"))
    return met.filter(hi > lo).select("row_id", "shard", "slot", "epoch", (lo - F.col("start")).alias("first"), (hi - lo).alias("words"))


def taken(plan: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per input row."""
    sums = pieces(plan).groupBy("row_id").agg(F.sum("words").alias("taken"))
    facts = plan.sources.select("sid", "source_size", "target")
    out = plan.docs.join(sums, "row_id", "left").join(facts, "sid")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_rows(rows: DataFrame, plan: Mix, row_id: str) -> DataFrame:
    """The mixed documents with all columns of ``rows``: one row per document and pass that takes words of it.

    A document taken whole keeps its text; of one cut by block borders the taken runs remain, each
    as it stands in the text from its first word to its last, joined by a line break.
    """
    per = pieces(plan).groupBy("row_id", "epoch").agg(
        F.sum("words").alias("_mix_n"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("_mix_runs")
    ).join(plan.docs.select("row_id", F.col("size").alias("_mix_size")), "row_id")
    per = per.select(F.col("row_id").alias("_mix_row"), "_mix_n", "_mix_runs", "_mix_size")
    met = rows.join(per, F.col(f"`{row_id}`") == F.col("_mix_row"))
    # Neighbouring runs become one: a run starts where the one before does not end.
    joined = F.aggregate(
        "_mix_runs", F.array().cast("array<struct<first:bigint,words:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["first"] + F.element_at(acc, -1)["words"] == x["first"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["first"].alias("first"), (F.element_at(acc, -1)["words"] + x["words"]).alias("words")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["first"].alias("first"), x["words"].alias("words"))))),
    )
    words = F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0))
    run = lambda x: F.array_join(F.slice(words, x["first"].cast("int") + 1, x["words"].cast("int")), "")
    part = F.array_join(F.transform(joined, lambda x: F.rtrim(run(x), F.lit(" \t\n\x0b\x0c\r"))), "\n")
    text = F.when(F.col("_mix_n") == F.col("_mix_size"), F.col("text")).otherwise(part)
    return met.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in rows.columns if c != row_id])
