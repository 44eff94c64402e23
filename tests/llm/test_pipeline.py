"""Queries against their statements, the pipeline against its stages by brute force, and the guard."""

import collections

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from evalloom.llm import queries
from evalloom.llm.registry import ORACLES, QUERIES
from evalloom.sources.scratch import settle
from test_operators import brute_components, split

SF = "/root/testdata/sf0.001"
assert queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_statement(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare(connect(SF), df, ORACLES[name]) == ""


def test_all_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    for native in ("op6_source_mix", "op10_perspectives"):
        plan = names[native](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, after = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, after, SF))
        kept[name] = after
    first = {r["doc_id"]: r["text"] for r in kept["language_id"].collect()}
    assert len(first) >= 0.98 * docs.count()
    want = {c for _, c in brute_components(first).values()}
    second = {r["doc_id"]: r["text"] for r in kept["ngram_jaccard"].collect()}
    assert set(second) == want
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = {r["doc_id"]: r["text"] for r in kept["decontamination"].collect()}
    assert set(second) - set(third) == {d for d, t in second.items() if any(i in t for i in items)}
    mixed = kept["source_mix"].collect()
    assert kept["source_mix"].columns == docs.columns
    words = collections.Counter()
    for r in mixed:
        words[r["doc_id"]] += len(split(r["text"]))
    assert all(n <= 2 * len(split(third[d])) for d, n in words.items())
    assert abs(sum(words.values()) - 1.5 * sum(len(split(t)) for t in third.values())) <= 20
    assert kept["token_codes"].count() == len(mixed)


def test_language_stage_without_labels(spark, odd):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    lettered = [r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(r["text"] for r in kept.collect()) == sorted(lettered) and lettered


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "score", "start")
    for frame in (docs, docs.filter("false")):
        after = frame
        for name, stage in corpus_pipeline.STAGES:
            after = settle(stage(spark, after, SF))
            assert name == "token_codes" or after.columns == docs.columns
