"""The dealt operators over the driver tables: thin queries, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import chat, decontaminate, forest, jaccard, langid, lexical, linededup, lm, mixing, oracles, sharding, simhash, spelling, tokens
from evalloom.llm.registry import query, table
from evalloom.sources.scratch import scratch

#: Insertions that make up the line store of op5; together they hold every row.
INSERTIONS = 3
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_codes")
def token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.read_digests(spark, path)


@query("op3_slot_table_shards")
def slot_table_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.assign(docs, ["doc_id"], SHARDS)
    return placed.select("doc_id", "source", "slot", "shard", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


@query("op5_line_dedup", oracles.line_dedup())
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table comes in three insertions; the second one's documents are then taken out and put back.

    So filters are probed, filled, emptied and probed again with real lines. What is left is the whole table.
    """
    docs = table(spark, sf_dir, "documents")
    parts = [docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(INSERTIONS)) == i) for i in range(INSERTIONS)]
    store = linededup.LineStore(spark, scratch(spark))
    for part in parts:
        store.insert(part)
    store.remove(parts[1].select("doc_id"))
    store.insert(parts[1])
    return store.clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op6_source_mix", oracles.mixed())
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


@query("op10_perspectives", oracles.perspectives(chat.TURNS_PER_PART))
def perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.render(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.withColumn("spans", spans)


@query("op9_byte_langid")
def byte_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold_of(F.col("doc_id"), 5) == 0
    net = langid.train(docs, ~held_out)
    rows = docs.withColumn("held_out", held_out)
    return langid.predict(rows, net, ["doc_id", "held_out"])


@query("op8_lattice_scores")
def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, langid.fold_of(F.col("doc_id"), 10) == 0, tokenizer_path())


@query("op7_bm25_leaks")
def bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.question_and_answer(table(spark, sf_dir, "benchmark"))
    return decontaminate.find(table(spark, sf_dir, "documents"), items, whole=True)


@query("op4_signature_tree_join", oracles.jaccard_components())
def signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op1_prefix_forest")
def prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op13_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_shared_term_search", oracles.ranked())
def shared_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_spelling_variants", oracles.variants())
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
