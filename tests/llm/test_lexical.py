"""Ranked search against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from evalloom.llm import lexical

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(ASCII))


def by_hand(docs, items, k=10):
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(terms(text))
        scored = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked if t in c}
            score = sum(times * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("block", "bunch"), [(1 << 16, 1 << 24), (12, 1 << 10)])
def test_search(spark, monkeypatch, block, bunch):
    """Also in many blocks of few items and bunches of few documents."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "BUNCH_BYTES", bunch)
    rng = random.Random(block)
    pool = [rng.choice(["Ab", "né", "日本", "x9", "q", "the"]) + str(rng.randint(0, 9)) for _ in range(40)]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, n)))
    docs = [(i, text(30)) for i in range(150)]
    # Copies make ties; ids are repeated or missing, texts empty or missing.
    docs += [(500 - i, docs[3][1]) for i in range(14)] + [(7, docs[9][1]), (None, docs[3][1]), (None, None), (600, ""), (601, "...")]
    docs.append((602, "the0 " * 3000))
    items = [(i, text(12)) for i in range(9)] + [(3, text(12)), (None, "ab1 ab1 né2 x91"), (20, None), (21, "unheard"), (22, docs[3][1])]
    got = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS _i", "3 AS n"),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 AS rank", "5 AS terms"),
    )
    assert rows(got) == by_hand(docs, items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_plan_shares_parts_and_keeps_sums():
    rng = np.random.default_rng(1)
    items = [[(int(t), int(rng.integers(1, 3))) for t in rng.permutation(30)[: rng.integers(1, 20)]] for _ in range(40)]
    items += [[(t, 1) for t in range(12)] for _ in range(5)]
    plan = lexical.shared_plan([list(i) for i in items])
    singles = rng.integers(0, 1000, (30, 7))
    want = np.array([sum(n * singles[t] for t, n in item) for item in items])
    assert np.array_equal(lexical.item_scores(plan, singles), want)
    additions = sum(len(level[0]) for level in plan.levels) + len(plan.parts) - len(items)
    assert additions < sum(len(i) - 1 for i in items)
    # Five equal items end in one part each.
    ends = np.append(plan.starts[1:], len(plan.parts))
    assert len({tuple(plan.parts[a:b]) for a, b in zip(plan.starts[-5:], ends[-5:])}) == 1


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "word same text")], "item_id long, text string")
    assert rows(lexical.search(none, items)) == []
    assert rows(lexical.search(odd, items.filter("false"))) == []
    assert rows(lexical.search(odd, items)) == by_hand([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "word same text")])
