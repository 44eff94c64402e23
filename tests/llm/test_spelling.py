"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest

from evalloom.llm import spelling

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def group_by_hand(counts):
    out = {}
    for w, n in counts.items():
        others = [(-counts[x], x) for x in counts if near(w, x)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = (form, n, len(others), -best[0] if form else None)
    roots = {}
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        roots[w] = at
    return {(w, f, roots[w], n, k, m) for w, (f, n, k, m) in out.items()}


def count_by_hand(docs, slip):
    counts = collections.Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % slip == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6}


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_words_of_texts(spark):
    rng = random.Random(6)
    pool = ["Straße", "ÀÉÎ", "naïvely", "abcdef", "ABCDEFG", "x×y÷zzz", "Ünder", "a" * 300, "grün-weißes", "l'été", "日本abcdefg"]
    docs = [(rng.choice([None, i, 5]), " ".join(rng.choice(pool) for _ in range(20))) for i in range(60)] + [(1, None), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    got = {r["word"]: r["n"] for r in spelling.words_of_texts(df, 7).collect()}
    assert got == count_by_hand(docs, 7)
    # Astral characters end a run and count as one.
    assert spelling.words_of_texts(spark.createDataFrame([(1, "abcdef𝒳abcdefg")], "doc_id long, text string")).count() == 2


def test_acceptor_is_minimal_and_pairs_are_found_once():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(500)})
    fsa = spelling.Acceptor(words)
    accepted, left = [], [("", fsa.start)]
    while left:
        read, state = left.pop()
        accepted += [read] * fsa.final[state]
        left += [(read + c, p) for c, p in fsa.arcs[state].items()]
    assert sorted(accepted) == words
    languages = [tuple(sorted(fsa.common(s, s))) for s in range(len(fsa.arcs))]
    assert len(set(languages)) == len(languages)
    found = list(spelling.near_pairs(words, 99))
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


@pytest.mark.parametrize("partition", [20_000, 3])
def test_group_variants(spark, monkeypatch, partition):
    """Also where all partitions are cut down to one place."""
    monkeypatch.setattr(spelling, "PARTITION", partition)
    rng = random.Random(partition)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["prefix" + c for c in "abcdefghijk"] + ["aaaaaa" * k for k in range(1, 4)]
    counts = {}
    for w in base:
        for _ in range(6):
            counts[w] = rng.choice([5, 6, 30, 31, 160, 900])
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            if len(w) < 6:
                break
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.group_variants(vocab)) == group_by_hand(counts)


def test_variants(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = count_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], 199)
    assert rows(spelling.variants(docs)) == group_by_hand({w: n for w, n in counts.items() if n >= 5})
    assert rows(spelling.variants(none)) == set()
    assert rows(spelling.variants(odd.selectExpr("*", "1 AS word"))) == set()
    chain = {"aaaaaaa": 5, "aaaaaaab": 25, "aaaaaaabc": 125, "aaaaaaabcd": 625, "aaaaaaabcde": 3125}
    got = rows(spelling.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {r[2] for r in got} == {"aaaaaaabcde"}
