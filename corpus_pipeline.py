"""From raw documents to token files: language, near duplicates, leaks, mix, codes.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before kept; :func:`run` writes each result to the
shared folder and reads it again. All stages but the last return the columns of ``documents``.

A stage begins by deleting the tables that earlier stages wrote for themselves, unless its own input still reads
them: a stage's result is to be written before the next stage is called.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import decontaminate, jaccard, langid, mixing, tokens
from evalloom.llm.queries import tokenizer_path
from evalloom.llm.registry import table
from evalloom.sources.scratch import made, remove, scratch, settle

#: A text stays when its most likely language has at least this mean probability.
MIN_SCORE = 0.4

#: Language ID is a trained network, which SQL does not express.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def _stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(spark.sparkContext.applicationId, [])
        read = docs.inputFiles() if left else []
        for path in list(left):
            name = path.rsplit("/", 1)[-1]
            if not any(name in file for file in read):
                remove(spark, path)
                left.remove(path)
        before = set(made(spark))
        out = work(spark, docs, sf_dir)
        left += [path for path in made(spark) if path not in before]
        return out

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters or without a clear language. Learns from the rows that have a language.

    Where there is nothing to learn from, every text with a letter stays.
    """
    net = langid.train(docs, F.lit(True))
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    known = langid.predict(docs, net, docs.columns, ("_lang_id", "_lang_share"))
    return known.filter((F.col("_lang_id") != langid.UNKNOWN) & (F.col("_lang_share") >= MIN_SCORE)).drop("_lang_id", "_lang_share")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every group of linked texts."""
    return jaccard.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a test item's question and answer, or most of the item as one."""
    return decontaminate.clean(docs, decontaminate.question_and_answer(table(spark, sf_dir, "benchmark")), whole=True)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or cut sources to their target words; a document comes once per pass that takes words of it."""
    rows = settle(docs.withColumn("_row", F.monotonically_increasing_id()))
    mixed = mixing.mixed_rows(rows, mixing.mix(rows, row_id="_row"), "_row")
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else mixed


@_stage
def token_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return their digests: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark)
    tokens.write_tokens(docs, path, tokenizer_path())
    return tokens.read_digests(spark, path)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_codes", token_codes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
