"""SimHash near duplicates against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from evalloom.llm import simhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components(values):
    """Smallest position reachable, by comparing all pairs."""
    roots = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= 3:
                x, y = roots[i], roots[j]
                roots = [min(x, y) if r in (x, y) else r for r in roots]
    return roots


def test_fingerprints_of_odd_texts():
    rng = random.Random(2)
    texts = [None, "", " \t\x0b", "One", "one  TWO", "É è A\nb\r\nC", "a b c", "a  b\tc"]
    texts += [" ".join(rng.choice(["A", "bb", "ñandú", "日本", "\n"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts.append("word " * 40_000)
    got = simhash.fingerprints(pa.array(texts, pa.string())).view(np.uint64).tolist()
    assert got == [by_hand(t) for t in texts]
    assert got[:3] == [0, 0, 0] and got[6] == got[7]


def variants(rng, n):
    """Fingerprints in clusters around a few centres, chained by small steps, and lone ones."""
    values = {rng.getrandbits(64) for _ in range(n // 3)}
    for centre in [0, (1 << 64) - 1, *[rng.getrandbits(64) for _ in range(4)]]:
        at = centre
        for _ in range(n // 9):
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
            values.add(at)
    return sorted(values)


@pytest.mark.parametrize("posting", [512, 2])
def test_links_give_all_components(spark, monkeypatch, posting):
    """Also where every posting is too long and goes through the finer ones and the neighbour tables."""
    monkeypatch.setattr(simhash, "POSTING", posting)
    rng = random.Random(posting)
    values = variants(rng, 240)
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    at = {v: i for i, v in enumerate(values)}
    roots = list(range(len(values)))
    for a, b in simhash.near_links(rows).collect():
        a, b = at[a % (1 << 64)], at[b % (1 << 64)]
        assert bin(values[a] ^ values[b]).count("1") > 0
        x, y = roots[a], roots[b]
        roots = [min(x, y) if r in (x, y) else r for r in roots]
    assert roots == components(values)


def test_probe_and_tally_agree():
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 24, 3000) | (7 << 40))
    probed = simhash.probe_posting(fps, (3, 4, 5, 6, 7))
    assert np.array_equal(probed, simhash.tally_postings(np.zeros(len(fps), np.int64), fps))


def test_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints = [by_hand(t) for _, t in rows]
    roots = components(prints)
    got = simhash.near_duplicates(docs).collect()
    want = {d: (f"{p:016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    empty = [r for r in found if r["fingerprint"] == "0" * 16]
    assert {(r["doc_id"], r["component_id"]) for r in empty} == {(0, 0), (1, 0), (2, 0), (None, 0)}
    copies = [r["component_id"] for r in found if r["doc_id"] in (7, 8)]
    assert copies == [7, 7, 7]
    assert simhash.near_duplicates(none).collect() == []
    nameless = spark.createDataFrame([(None, "only one text here")], "doc_id long, text string")
    assert simhash.near_duplicates(nameless).first()["component_id"] is None
