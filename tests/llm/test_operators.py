"""The ten operators against brute force on small tables, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.llm import chat, components, decontaminate, forest, jaccard, langid, linededup, lm, mixing, sharding, tokens, words
from evalloom.llm.queries import line_dedup, tokenizer_path
from evalloom.sources.scratch import made, scratch

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_words_and_segments(monkeypatch):
    rng = random.Random(3)
    cases = ["".join(rng.choice(["a", "Bc", " ", "\n", "\t", "é", "  ", "\x0b", "日"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    cases += [None, ""]
    for segment in (1 << 22, 16):
        monkeypatch.setattr(words, "SEGMENT", segment)
        data, start, end, hashes, text = words.words_of(pa.array(cases))
        got = [(int(t), data[a:b].tobytes().decode()) for a, b, t in zip(start, end, text)]
        assert got == [(i, w) for i, c in enumerate(cases) for w in split(c)]
        one = {}
        assert all(one.setdefault(w, h) == h for (_, w), h in zip(got, hashes.tolist()))
        assert len(set(one.values())) == len(one)


# 1 ---------------------------------------------------------------------------------------------


def test_forest_recall_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELL_ROWS", 64)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 12)) * rng.uniform(0.5, 2, (600, 1))
    x[100:250] = x[7]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    odd = [(600, None), (601, []), (602, [0.0] * 12), (603, [float("nan")] * 12), (604, [None] + [1.0] * 11), (605, [1.0, 2.0]), (None, [1.0] * 12), (20, rows[20][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("gid", F.lit("x"))
    found = collections.defaultdict(list)
    for r in forest.search(frame, F.col("vec_id") % 20 == 0, 20).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 600, 20):
        scores = x @ x[q]
        want = [i for i in np.lexsort((np.arange(600), -np.round(scores, 12))) if i != q][:20]
        got = sorted(found.pop(q))
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        assert np.allclose([g[2] for g in got], scores[[g[1] for g in got]], rtol=1e-12)
        hit += len(set(want) & {g[1] for g in got})
    assert not found and hit / 600 >= 0.9
    assert forest.search(frame.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


# 2 ---------------------------------------------------------------------------------------------


def test_codes_round_trip_and_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([0]), np.array([2**32 - 1, 255, 256, 65536]), rng.integers(0, 70000, 5000), rng.integers(0, 300, 1025)):
        codes = tokens.pack_codes(ids)
        assert tokens.unpack_codes(codes).tolist() == ids.tolist()
        assert [tokens.code_at(codes, i) for i in range(len(ids))] == ids.tolist()
    with pytest.raises(IndexError):
        tokens.code_at(tokens.pack_codes(np.array([1])), 1)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path(), random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "!", "'s", "é", "1", "\xa0", " ", "\x1c", "\r", "<|", "<|endoftext|>", "word", "日", ".", ",", "a.", "\0", "\n\n", "b.\nC", "²", "½", "×", "ª", "\u01c5", "\u024f", "\u0250", "\xad", "'ll", "'S", "ab12", "#$"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(cases, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(path).encode(cases)] == want


def check_files(spark, frame, n_parts=3):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    path = scratch(spark)
    tokens.write_tokens(frame, path, tokenizer_path(), parts=n_parts)
    rows = sorted(tokens.read_digests(spark, path).collect(), key=lambda r: r["start"])
    key = lambda i: (i is not None, i or 0)
    assert [key(r["doc_id"]) for r in rows] == sorted(key(r["doc_id"]) for r in frame.select("doc_id").collect())
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    want = collections.Counter()
    for r in frame.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    return path, at


def test_token_files(spark, docs, odd, none):
    check_files(spark, odd)
    check_files(spark, none)
    path, total = check_files(spark, docs)
    whole = {}
    for r in tokens.read_ids(spark, path).collect():
        whole |= {r["start"] + i: (r["doc_id"], t) for i, t in enumerate(r["ids"])}
    asked = [0, 1, total - 1, total, -1, *random.Random(2).sample(range(total), 40)]
    got = tokens.tokens_at(spark, path, spark.createDataFrame([(i,) for i in asked], "position long"), bucket=1000).collect()
    assert {r["position"]: (r["doc_id"], r["token"]) for r in got} == {i: whole[i] for i in asked if i in whole}


def test_words_are_kept_once():
    """Line ends and marks after words make no pieces of their own in the memory; ids are the library's."""
    encoder = tokens.Encoder(tokenizer_path())
    names = [f"{a}{b}" for a in ("andon", "Reina", "él", "ß") for b in ("aea", "schen", "ü", "x", "our")]
    texts = [" ".join(f"{x}{end}{y}" for y in names) for x in names for end in (",\n", ".\n", "\n", "!'\n")]
    odd = ["a\n", "\na", "a\n\nb", "a \n b", "a\tb\nc", "a\r\nb", "\n", " ", "it's,\nwe'll", "x'd.\n's", "1,\n2²", "×÷\nª", "ж,\nж", "a,語\nb"]
    assert encoder.encode(texts + odd) == [encoder._library(t) for t in texts + odd]
    encoder.seen.clear()
    encoder.encode(texts)
    assert len(encoder.seen) < 10 * len(names)


# 3 ---------------------------------------------------------------------------------------------


def test_slot_table():
    names = [f"s{i}" for i in range(11)]
    table = sharding.fill_table(names, 1009)
    sizes = collections.Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    # The turns, replayed by their definition.
    free, want, turn = set(range(1009)), [None] * 1009, 0
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        o, k = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:16], "big") % 1008 + 1
        orders.append([(o + j * k) % 1009 for j in range(1009)])
    while free:
        slot = next(x for x in orders[turn % 11] if x in free)
        want[slot] = turn % 11
        free.discard(slot)
        turn += 1
    assert table == want
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 10)
    assert moved < 1009 * 0.12
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_assign_and_write(spark, docs, odd, none):
    names = [f"s{i}" for i in range(4)]
    got = sharding.assign(odd, ["doc_id", "source"], names, 1009)
    assert got.count() == odd.count() and got.columns == [*odd.columns, "slot", "shard"]
    table = sharding.fill_table(names, 1009)
    assert all(table[r["slot"]] == r["shard"] for r in got.collect())
    assert sharding.assign(none, ["doc_id"], names, 1009).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(got, ["doc_id"], names, 1009)
    path = scratch(spark)
    sharding.write_shards(docs, path, ["source"], names, 1009, files_per_shard=3)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.groupBy("source").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0
    assert sum(r["n_rows"] for r in sharding.shard_sizes(sharding.assign(docs, ["doc_id"], names, 1009)).collect()) == docs.count()


# 4 ---------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, text in rows.items():
        w = split(text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(rows, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in rows}


def near_copies(n=60):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    out = {}
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out[i] = " ".join(copy)
    for i in range(n, 2 * n):  # share a passage only
        out[i] = " ".join([*(f"y{rng.randrange(10**6)}" for _ in range(60)), *base[:50], *(f"y{rng.randrange(10**6)}" for _ in range(60))])
    out |= {2 * n: "", 2 * n + 1: None, 2 * n + 2: "one two", 2 * n + 3: "ONE  two\n", 2 * n + 4: "one two three"}
    return out


@pytest.mark.parametrize("chunk", [2000, 8])
def test_jaccard_components(spark, chunk):
    rows = near_copies()
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame, chunk).collect()}
    assert got == brute_components(rows)
    kept = {r["doc_id"] for r in jaccard.keep_one(frame, chunk).collect()}
    assert kept == {c for _, c in got.values()}


def test_jaccard_odd_rows(odd, none):
    got = jaccard.join(odd)
    assert got.count() == odd.count() and got.columns == ["doc_id", "n_shingles", "component_id"]
    found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert found[8] == 7 and found[0] == 0 and found[1] == 1 and found[None] is None
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(["0", "1", "2", "3", "4", "5", "6", "7", "None", "None"])
    assert jaccard.join(none).count() == 0


def test_tree_links_and_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(50)[:47]], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(150)]
    want = [(i, j) for i, j in itertools.combinations(range(150), 2) if jaccard.linked(sets[i], sets[j])]

    def classes(links):
        label = list(range(150))
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k in range(150) if label[k] == x) for x in label}

    assert classes(jaccard.tree_links(sets, None, np.arange(150))) == classes(want)
    cross = jaccard.tree_links(sets[:70], sets[70:], np.arange(150))
    assert classes(cross) == classes([(i, j) for i, j in want if i < 70 <= j])
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (5, 5)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_few_links_need_no_rounds(spark, monkeypatch):
    """One stored table and one pass however long the chain; rounds give the same, repeated and turned links included."""
    rng = random.Random(3)
    chain = [(i, i + 1) if i % 2 else (i + 1, i) for i in range(60)]
    pairs = chain + chain[:9] + [(7, 7), (-5, 2**62), (2**62, 900)] + [(500, 500 + i) for i in range(1, 30)]
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a long, b long")
    before = len(made(spark))
    found = components.connected(links)
    assert len(made(spark)) == before + 1
    got = sorted(map(tuple, found.collect()))
    want = [(i, 0) for i in range(61)] + [(x, -5) for x in (-5, 900, 2**62)] + [(500 + i, 500) for i in range(30)]
    assert got == sorted(want)
    assert components.connected(links.filter("false")).collect() == []
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    assert sorted(map(tuple, components.connected(links).collect())) == got


# 5 ---------------------------------------------------------------------------------------------


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    made = linededup.CuckooFilter.sized_for(400)
    for k in keys[:2000]:  # far above its size: the stash takes the rest
        made.add(k)
    made = linededup.CuckooFilter.from_bytes(made.to_bytes())
    assert all(k in made for k in keys[:2000]) and made.overfull()
    for k in keys[:1000]:
        made.discard(k)
    assert all(k in made for k in keys[1000:2000]) and made.items == 1000
    roomy = linededup.CuckooFilter.sized_for(2000)
    for k in keys[:2000]:
        roomy.add(k)
    assert sum(k in roomy for k in keys[2000:]) < 20


def brute_clean(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    first, held = {}, collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
            first[key(line)] = min(first.get(key(line), i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or first[key(x)] == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_store_is_reversible(spark):
    rng = random.Random(7)
    pool = ["short", "  A line that many hold ", "a LINE that many hold", "another line of text", "ünïcödé line", "only ten!!", ""] + [f"line number {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) if i % 9 else None) for i in range(60)]
    one, two = rows[:35], rows[35:]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    store = linededup.LineStore(spark, scratch(spark), shards=3)
    store.insert(make(one))
    before = sorted(map(tuple, store.counts().collect()))
    assert {r["doc_id"]: tuple(r)[1:] for r in store.clean(make(one)).collect()} == brute_clean(one)
    store.insert(make(two))
    assert {r["doc_id"]: tuple(r)[1:] for r in store.clean(make(rows)).collect()} == brute_clean(rows)
    gone = [r for r in rows if r[0] % 2]
    kept = [r for r in rows if not r[0] % 2]
    store.remove(make(gone))
    assert {r["doc_id"]: tuple(r)[1:] for r in store.clean(make(kept)).collect()} == brute_clean(kept)
    store.insert(make([r for r in gone if r[0] < 35]))
    store.remove(make(two))
    assert sorted(map(tuple, store.counts().collect())) == before
    known = {r["shard"]: linededup.CuckooFilter.from_bytes(bytes(r["filter"])) for r in store.filters().collect()}
    assert all(bytes(r["key"]) in known[r["shard"]] for r in store.counts().collect())
    assert sum(f.items for f in known.values()) == store.counts().count()


def test_line_store_odd_rows(spark, odd, none):
    store = linededup.LineStore(spark, scratch(spark))
    store.insert(odd)
    out = store.clean(odd)
    assert out.count() == odd.count()
    assert {r["doc_id"]: r["n_dropped"] for r in out.collect()}[8] == 1
    empty = linededup.LineStore(spark, scratch(spark))
    empty.insert(none)
    assert empty.clean(none).count() == 0


def test_line_store_is_dealt_to_more_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 4)
    rows = [(i, "\n".join(f"a line with number {(i * 7 + j) % 90}" for j in range(i % 6))) for i in range(60)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    store = linededup.LineStore(spark, scratch(spark))
    store.insert(make(rows[:10]))
    few = store.shards
    store.insert(make(rows[10:]))
    assert store.shards > 2 * few
    assert {r["doc_id"]: tuple(r)[1:] for r in store.clean(make(rows)).collect()} == brute_clean(rows)
    known = {r["shard"]: linededup.CuckooFilter.from_bytes(bytes(r["filter"])) for r in store.filters().collect()}
    assert all(bytes(r["key"]) in known[r["shard"]] for r in store.counts().collect()) and max(known) >= few


def test_line_query_goes_through_its_filters(spark, docs, monkeypatch):
    """Three insertions, a removal and another insertion, of which three probe the filters; the rows are those of one insertion."""
    changes, probed = [], []
    switch, updated = linededup.LineStore._switch, linededup.LineStore._updated
    monkeypatch.setattr(linededup.LineStore, "_switch", lambda self: (changes.append(self.version), switch(self)) and None)
    monkeypatch.setattr(linededup.LineStore, "_updated", lambda self, keys, added: (probed.append((added, keys.count())), updated(self, keys, added))[1])
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup(spark, SF).collect()}
    assert len(changes) == 5 and [added for added, _ in probed] == [True, True, False, True] and all(n for _, n in probed)
    want = brute_clean([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == {d: (n, dropped, hashlib.sha256(text.encode()).hexdigest()) for d, (text, n, dropped) in want.items()}


# 6 ---------------------------------------------------------------------------------------------


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        x = mixing.permuted(F.col("id"), F.lit(n), F.lit("k"), F.lit(3 % n), F.lit(5 % n)).alias("y")
        got = [r["y"] for r in spark.range(n).select(x).collect()]
        assert sorted(got) == list(range(n)) and (n < 7 or got != list(range(n)))


def test_mix(spark, odd, none):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), f"s{min(rng.randrange(9), 4)}" if i % 11 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    plan = mixing.mix(frame, block_words=16, shard_slots=64)
    out = mixing.taken(plan).collect()
    by = collections.defaultdict(list)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(split(rows[r["doc_id"]][1]))
        by[r["source"]].append(r)
    total = sum(r["size"] for r in out)
    assert math.isclose(sum(g[0]["target"] for g in by.values()), 1.5 * total)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(by)
    while True:  # the excess is shared again until none is above
        left = 1.5 * total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * by[s][0]["source_size"]}
        if not above:
            target |= share
            break
        target |= {s: 2.0 * by[s][0]["source_size"] for s in above}
        open_ -= above
    for s, g in by.items():
        assert math.isclose(g[0]["target"], target[s], rel_tol=1e-9)
        assert sum(r["taken"] for r in g) == round(g[0]["target"])
    shards = plan.slots.groupBy("shard").agg(F.sum("words").alias("n")).collect()
    assert len(shards) > 3
    again = mixing.taken(mixing.mix(frame.repartition(7), block_words=16, shard_slots=64)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)
    assert mixing.taken(mixing.mix(odd)).count() == odd.count()
    assert mixing.taken(mixing.mix(none)).count() == 0


def test_mixed_rows(spark):
    rows = [(i, i, " ".join(f"d{i}w{j}" for j in range(50)), "ab"[i % 2], i) for i in range(12)]
    frame = spark.createDataFrame(rows, "_row long, doc_id long, text string, source string, n_chars long")
    plan = mixing.mix(frame, block_words=8, row_id="_row")
    out = mixing.mixed_rows(frame, plan, "_row")
    assert out.columns == ["doc_id", "text", "source", "n_chars"]
    sums = collections.Counter()
    for r in out.collect():
        w = split(r["text"])
        assert w == sorted(w, key=lambda x: int(x.split("w")[1])) and set(w) <= set(split(rows[r["doc_id"]][2]))
        sums[r["doc_id"]] += len(w)
    assert {r["doc_id"]: r["taken"] for r in mixing.taken(plan).collect() if r["taken"]} == dict(sums)


def test_mixed_rows_keep_white_space(spark):
    gaps = [" ", "\n", "\t", "  ", "\n\n\t", " \x0b\r\n"]
    rows = [(i, i, "\n " + "".join(f"d{i}w{j}{gaps[(i + j) % 6]}" for j in range(50)), "abc"[i % 3]) for i in range(12)]
    frame = spark.createDataFrame(rows, "_row long, doc_id long, text string, source string")
    cut = 0
    for r in mixing.mixed_rows(frame, mixing.mix(frame, block_words=8, row_id="_row"), "_row").collect():
        whole, w = rows[r["doc_id"]][2], split(r["text"])
        if r["text"] == whole:
            continue
        place = {m.group(): m.span() for m in re.finditer(r"\S+", whole)}
        number = lambda x: int(x.split("w")[1])
        starts = [i for i in range(len(w)) if i == 0 or number(w[i]) != number(w[i - 1]) + 1]
        runs = [w[i:j] for i, j in zip(starts, [*starts[1:], len(w)])]
        assert r["text"] == "\n".join(whole[place[x[0]][0] : place[x[-1]][1]] for x in runs)
        cut += 1
    assert cut


# 7 ---------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, texts, odd, none):
    items = decontaminate.question_and_answer(spark.read.parquet(f"{SF}/benchmark.parquet"))
    plain = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", (t or "").translate(ASCII)).split()
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    listed = [(r["item_id"], plain(r["question"]), plain(r["answer"])) for r in items.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect()}
    strides = {i: next(s for s in (32 << k for k in range(20)) if s >= 1.25 * (len(q) + len(a))) for i, q, a in listed}
    assert len(set(strides.values())) > 1
    want = set()
    for (d, t), stride in itertools.product(texts.items(), set(strides.values())):
        w = plain(t)
        for at in range(0, max(1, len(w)), stride):
            window = w[at : at + 2 * stride]
            sizes = {n: grams(window, n) for n in range(1, 6)}
            for i, q, a in listed:
                if strides[i] != stride:
                    continue
                share = [len(grams(p, min(5, len(p))) & sizes[min(5, len(p))]) / len(grams(p, min(5, len(p)))) for p in (q, a) if p]
                if share and min(share) >= 0.8:
                    want.add((d, i))
    assert got == want and got
    kept = decontaminate.clean(docs, items)
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {d for d, _ in got} and kept.columns == docs.columns
    assert decontaminate.find(odd, items).count() == 0 and decontaminate.clean(odd, items).count() == odd.count()
    assert decontaminate.find(none, items).count() == 0 and decontaminate.find(docs, items.filter("false")).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", " "), (3, "same text of seven words is here", None), (3, "same text of seven words is here", None)], items.schema)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(odd, blank).collect()} == {(7, 3), (8, 3)}


def test_one_word_edits_of_derived_answers(spark):
    words_ = [f"w{i}" for i in range(60)]
    listed = [(1, " ".join(words_[:30]) + ". " + " ".join(words_[30:34]) + "."), (2, " ".join(words_[34:48]) + "? " + " ".join(words_[48:]) + ".")]
    items = decontaminate.question_and_answer(spark.createDataFrame(listed, "item_id long, text string"))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want = [], set()
    for item, text in listed:
        w = text.split()
        for at in range(len(w)):
            edited = [*w[:at], "other", *w[at + 1 :]]
            rows.append((100 * item + at, " ".join(edited)))
            if len(grams(w) & grams(edited)) >= 0.8 * len(grams(w)):
                want.add((100 * item + at, item))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(frame, items, whole=True).collect()}
    # The last sentence of item 1 has four words: none of them may differ where it must hold on its own.
    assert {(100 + at, 1) for at in range(30, 34)} <= want and want <= got
    parts = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(frame, items).collect()}
    assert got == want | parts and not parts & {(100 + at, 1) for at in range(30, 34)}
    assert {r["doc_id"] for r in decontaminate.clean(frame, items, whole=True).collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_scores_do_not_depend_on_parts(spark, docs, none, monkeypatch):
    items = decontaminate.question_and_answer(spark.read.parquet(f"{SF}/benchmark.parquet"))
    found = lambda: {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find(docs, items, whole=True).collect()}
    one, kept = found(), {r["doc_id"] for r in decontaminate.clean(docs, items, whole=True).collect()}
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 7)
    many = found()
    assert one and set(many) == set(one) and all(math.isclose(many[k], one[k], rel_tol=1e-9) for k in one)
    assert {r["doc_id"] for r in decontaminate.clean(docs, items, whole=True).collect()} == kept
    nulls = docs.unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    assert decontaminate.clean(nulls, items, whole=True).filter("text is null").count() == 2


@pytest.mark.parametrize("items_in_part", [512, 1])
def test_hits_do_not_depend_on_the_other_items(spark, monkeypatch, items_in_part):
    """A short item whose two parts stand 40 or 300 words apart, beside an item of 640 words."""
    monkeypatch.setattr(decontaminate, "PART_ITEMS", items_in_part)
    short = ([f"s{i}" for i in range(9)], [f"t{i}" for i in range(5)])
    long = [f"l{i}" for i in range(640)]
    listed = [(1, " ".join(short[0]), " ".join(short[1])), (2, " ".join(long[:600]), " ".join(long[600:]))]
    apart = lambda n: " ".join([*short[0], *[f"x{i}" for i in range(n)], *short[1]])
    spread = [w for i, w in enumerate(long) for w in ([w, f"y{i}"] if 594 <= i < 606 else [w])]
    rows = [(0, apart(0)), (1, apart(20)), (2, apart(300)), (3, " ".join(long)), (4, " ".join(spread)), (5, " ".join(long[:500]))]
    items = spark.createDataFrame(listed, "item_id long, question string, answer string")
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 1), (1, 1), (3, 2), (4, 2)}


# 8 ---------------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    pieces = sorted([b"a", b"b", b"ab", b"aba", b"ba"])
    p = np.array([0.3, 0.2, 0.25, 0.15, 0.1])
    lattice = lm.Lattice(pieces, np.log(p), math.log(0.6), math.log(0.4))
    prob = dict(zip(pieces, p))

    def all_ways(w):
        return 1.0 if not w else sum(prob[w[:k]] * 0.6 * all_ways(w[k:]) for k in range(1, len(w) + 1) if w[:k] in prob)

    cases = [b"a", b"ab", b"abab", b"bbbb", b"ababab" * 3, b"x"]
    got = lattice.log_probability(cases)
    for w, g in zip(cases, got):
        want = all_ways(w) * 0.4
        assert (want == 0 and g == -np.inf) or math.isclose(math.exp(g), want, rel_tol=1e-9)
    counts = lattice.expected_counts([b"abab"])
    ways = [x for x in itertools.chain.from_iterable(itertools.product(pieces, repeat=n) for n in range(1, 5)) if b"".join(x) == b"abab"]
    weight = [np.prod([prob[y] * 0.6 for y in x]) for x in ways]
    want = [sum(w * x.count(q) for w, x in zip(weight, ways)) / sum(weight) for q in pieces]
    assert np.allclose(counts, want)


def test_lattice_keeps_pieces_over_eight_bytes():
    pieces = sorted([b"a", b"b", b"ab", b"abababab", b"ababababa", b"abababababab", b"bababababa" * 2])
    prob = dict(zip(pieces, (0.2, 0.15, 0.25, 0.1, 0.1, 0.1, 0.1)))
    lattice = lm.Lattice(pieces, np.log(list(prob.values())), math.log(0.6), math.log(0.4))

    def ways(w):
        return [[]] if not w else [[p, *rest] for p in pieces if w.startswith(p) for rest in ways(w[len(p) :])]

    cases = [b"ababababa", b"abababab", b"abababababab", b"b" + b"ababababa" * 2, b"bababababa" * 2 + b"a", b"ababababx"]
    weights = [[math.prod(prob[p] * 0.6 for p in way) for way in ways(w)] for w in cases]
    got = np.exp(lattice.log_probability(cases))
    assert np.allclose(got, [sum(x) * 0.4 for x in weights], rtol=1e-9, atol=0)
    want = [sum(x * way.count(p) / sum(own) for w, own in zip(cases, weights) for way, x in zip(ways(w), own)) for p in pieces]
    assert np.allclose(lattice.expected_counts(cases[:-1]), want)
    assert {b"government", b"information", b"different", b"community"} <= set(lm.read_pieces(tokenizer_path())[0])


def test_text_score_draws_on_earlier_words():
    rng = random.Random(3)
    model = np.log10([0.4, 0.3, 0.2])
    for n in (0, 1, 7, 40):
        codes = np.array([rng.randrange(3) for _ in range(n)], np.int64)
        ways = []
        for prior in lm.PRIORS:
            p = 1.0
            for t, w in enumerate(codes):
                p *= (prior * 10 ** model[w] + list(codes[:t]).count(w)) / (prior + t)
            ways.append(p * prior * 0.1 / (prior + n))
        assert math.isclose(lm.text_score(codes, model, -1.0), math.log10(sum(ways) / len(ways)), rel_tol=1e-9)
    assert lm.seen_before(np.array([0, 1, 1, 2, 0, 1])).tolist() == [0, 0, 1, 0, 1, 2]


def test_scores(spark, docs, texts, odd, none):
    held = langid.fold_of(F.col("doc_id"), 10) == 0
    rows = {r["doc_id"]: r for r in lm.score(docs, held, tokenizer_path()).collect()}
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        w = [*split(t), None]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    got = lm.score(odd, held, tokenizer_path())
    assert got.count() == odd.count() and all(math.isfinite(r["score"]) for r in got.collect())
    assert lm.score(none, held, tokenizer_path()).count() == 0
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 for r in lm.score(odd, F.lit(True), tokenizer_path()).collect())


# 9 ---------------------------------------------------------------------------------------------


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.fold_of(F.col("doc_id"), 5) == 0
    net = langid.train(docs, ~held)
    rows = langid.predict(docs.withColumn("held", held), net, ["doc_id", "lang", "held"]).filter("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    got = langid.predict(odd, net, ["doc_id", "score", "text"]).collect() if False else langid.predict(odd.drop("score"), net, ["doc_id", "text"]).collect()
    for r in got:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters)
    assert langid.predict(none.drop("score"), net, ["doc_id"]).count() == 0
    assert langid.train(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(odd.drop("score"), None, ["doc_id"]).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"l{i:02d}" for i in range(70)]
    word = {n: [chr(0x4E00 + 300 * i + j) for j in range(4)] for i, n in enumerate(names)}
    rows = [(100 * i + k, " ".join(rng.choice(word[n]) * 3 for _ in range(60)), n) for i, n in enumerate(names) for k in range(5 if i < 64 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, F.lit(True))
    assert net.langs == names
    got = langid.predict(docs, net, ["lang"]).filter("lang >= 'l64'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.5
    # A total below the languages' full samples is shared by all of them.
    seen = []
    monkeypatch.setattr(langid, "DOCS_IN_ALL", 140)
    monkeypatch.setattr(langid.ByteNet, "fit", lambda self, codes, labels: seen.append(np.bincount(labels)))
    per_doc = langid.WINDOWS_PER_DOC
    assert langid.train(docs, F.lit(True)).langs == names and max(seen[0]) <= 2 * per_doc and len(seen[0]) == 70


def test_language_sample_takes_rows_not_ids(spark, monkeypatch):
    text = lambda i, s: " ".join(f"{s}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for _ in range(10))
    seen = []
    monkeypatch.setattr(langid.ByteNet, "fit", lambda self, codes, labels: seen.append(np.bincount(labels).tolist()))
    monkeypatch.setattr(langid, "DOCS_PER_LANG", 5)
    # One id for all rows, no id at all, and equal rows: as many rows of each language as its share, or all it has.
    for ids in (lambda i: 1, lambda i: None, lambda i: i):
        rows = [(ids(i), text(i, "x"), "a") for i in range(40)] + [(ids(40 + i), text(i, "y"), "b") for i in range(3)]
        net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
        assert net.langs == ["a", "b"] and seen.pop() == [5, 3]
    equal = spark.createDataFrame([(1, text(0, "x"), "a")] * 40, "doc_id long, text string, lang string")
    assert langid.train(equal, F.lit(True)).langs == ["a"] and seen.pop() == [5]


def test_network_tables_equal_filters():
    net = langid.ByteNet(["a", "b"])
    codes = np.random.default_rng(1).integers(0, langid.N_CODES, (5, langid.WINDOW)).astype(np.int32)
    pooled = []
    for k, w, b in zip(langid.WIDTHS, net.conv, net.bias):
        total = sum(w[j][codes[:, j : j + langid.WINDOW - k + 1]] for j in range(k))
        pooled.append(np.maximum(total.max(axis=1) + b, 0))
    assert np.allclose(net.predict(codes, net.tables()), net._softmax(np.concatenate(pooled, axis=1)), atol=1e-5)


# 10 --------------------------------------------------------------------------------------------


def test_perspectives(spark):
    rows = [(1, i, ["user", "assistant", "system", "tool", None][i % 5], None if i == 3 else f"text {i} é") for i in range(150)]
    rows += [(2, 0, "system", "alone"), (None, None, "user", "x"), (1, 5, "user", "tie"), (1, 5, "user", "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0)).withColumn("perspective", F.lit(""))
    parts = collections.defaultdict(list)
    for r in chat.render(frame, 16).collect():
        parts[r["conv_id"], r["perspective"]].append(r)
    assert set(parts) == {(1, "user"), (1, "assistant"), (1, "tool"), (1, "unknown"), (None, "user")}
    digest = lambda r: hashlib.md5(f"{r[2] or 'unknown'}\n{r[3] or ''}".encode()).hexdigest()
    ordered = sorted([r for r in rows if r[0] == 1], key=lambda r: (r[1], digest(r)))
    for side in ("user", "assistant", "tool", "unknown"):
        want, said = "", []
        for _, _, role, text in ordered:
            who = role or "unknown"
            head = "<|system|>" if who == "system" else "<|assistant|>" if who == side else f"<|user:{who}|>"
            want += f"{head}\n{text or ''}<|end|>\n"
            if who == side:
                said.append(f"{text or ''}<|end|>")
        own = sorted(parts[1, side], key=lambda r: r["part"])
        assert "".join(r["rendered"] for r in own) == want and max(r["n_turns"] for r in own) <= 16
        assert [r["rendered"][s["start"] : s["end"]] for r in own for s in r["spans"]] == said
    assert chat.render(frame.filter("false")).count() == 0


def test_parts_are_bounded_whatever_the_turns(spark):
    """Null conversations, null turns, one turn number for many rows, and copies of one row."""
    rows = [(None, None, "user", f"t{i % 50}") for i in range(300)] + [(None, 7, "tool", "same") for _ in range(200)]
    rows += [(5, 3, "user", f"u{i}") for i in range(120)] + [(5, None, None, None)] * 70
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.render(frame, 16).collect()
    assert max(r["n_turns"] for r in found) <= 16
    count = collections.Counter()
    for r in found:
        count[r["conv_id"], r["perspective"]] += r["n_turns"]
    assert count == {(None, "user"): 500, (None, "tool"): 500, (5, "user"): 190, (5, "unknown"): 190}
    parts = sorted((r for r in found if r["conv_id"] is None and r["perspective"] == "tool"), key=lambda r: r["part"])
    whole = "".join(r["rendered"] for r in parts)
    assert whole.index("<|assistant|>") > whole.rindex("<|user:user|>") and whole.count("same") == 200
    pos = sorted(tuple(r) for r in chat.with_position(chat._turns(frame)).select(F.coalesce("conv_id", F.lit(-1)), "pos").collect())
    assert pos == [(-1, i) for i in range(500)] + [(5, i) for i in range(190)]
