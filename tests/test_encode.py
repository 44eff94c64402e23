import pytest
from pyspark.sql import functions as F

from evalloom.functions import arrays, text
from evalloom.operators import collate, encode


def test_assemble_cases(spark):
    # (prompt, target, max length, eos, prompt first, from end) -> input ids, labels
    cases = [
        ([1, 2, 3], [4, 5], 10, 9, True, True, [1, 2, 3, 4, 5, 9], [-100, -100, -100, 4, 5, 9]),
        ([1, 2, 3], [4, 9], 10, 9, True, True, [1, 2, 3, 4, 9], [-100, -100, -100, 4, 9]),
        ([1, 2, 3], [4, 5], 4, 9, True, True, [3, 4, 5, 9], [-100, 4, 5, 9]),
        ([1], [4, 5, 6], 2, 9, True, True, [4, 5], [4, 5]),
        ([1], [4, 5, 6], 2, 9, True, False, [6, 9], [6, 9]),
        ([1, 2], [], 10, 9, True, True, [1, 2, 9], [-100, -100, 9]),
        ([1, 2], [4], 1, None, False, True, None, None),
        ([1, 2], [4, 5], 3, None, False, True, [1, 2, 4], [-100, -100, 4]),
        ([1, 2], [4, 5], 3, None, False, False, [1, 2, 5], [-100, -100, 5]),
    ]
    for prompt, target, size, eos, first, end, ids, labels in cases:
        df = spark.createDataFrame([(0, prompt, target)], "idx long, prompt_ids array<int>, target_ids array<int>")
        out = encode.assemble_pair(df, size, eos, None, first, end).collect()
        assert [(r["input_ids"], r["labels"]) for r in out] == ([] if ids is None else [(ids, labels)])
        if out:
            assert out[0]["attention_mask"] == [1] * len(ids)


def test_fit_longest_first(spark):
    for n1 in range(6):
        for n2 in range(6):
            a, b = list(range(n1)), list(range(10, 10 + n2))
            while len(a) + len(b) > 5:
                (a if len(a) > len(b) else b).pop()
            df = spark.createDataFrame([(list(range(n1)), list(range(10, 10 + n2)))], "a array<int>, b array<int>")
            got = df.select(arrays.fit_longest_first(F.col("a"), F.col("b"), 5).alias("f")).first()["f"]
            assert (got["first"], got["second"]) == (a, b)


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(
        [
            (0, "train", "GSM_SV", " what {query} is x ", None, " it is x "),
            (1, "train", "other", "b a a", None, ""),
            (2, "train", None, None, None, None),
        ],
        "idx long, split string, type string, query string, original_question string, response string",
    )


def test_render(examples):
    out = encode.render_examples(examples).orderBy("idx").collect()
    assert out[0]["prompt"].startswith("You are a careful math solver.\nSolve for the unknown")
    assert out[0]["prompt"].endswith("Problem:\n what {query} is x") and out[0]["target"] == "it is x"
    assert out[1]["prompt"] == text.DEFAULT_TEMPLATE.format(query="b a a").strip()
    assert out[2]["prompt"] == text.DEFAULT_TEMPLATE.format(query="").strip() and out[2]["target"] == ""
    loose = encode.render_examples(examples, strip=False).orderBy("idx").collect()
    assert loose[1]["prompt"] == text.DEFAULT_TEMPLATE.format(query="b a a")


def test_attach_template(spark, examples):
    templates = spark.createDataFrame(list(text.PROMPT_TEMPLATES.items()), "type string, template string")
    out = {r["idx"]: r["template"] for r in encode.attach_template(examples, templates).collect()}
    assert out == {0: text.PROMPT_TEMPLATES["GSM_SV"], 1: text.DEFAULT_TEMPLATE, 2: text.DEFAULT_TEMPLATE}


def test_vocab_and_custom_tokenizer_agree(spark, examples):
    vocab = encode.build_vocab(encode.render_examples(examples).select(F.concat_ws(" ", "prompt", "target").alias("t")), "t", 10)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert sorted(ids, key=lambda t: t.encode()) == [t for t, _ in sorted(ids.items(), key=lambda p: p[1])]
    assert min(ids.values()) == 10 and len(set(ids.values())) == len(ids)

    def load():
        return lambda texts: [[ids.get(w, 0) for w in t.split()] for t in texts]

    table = encode.VocabTokenizer(vocab, eos_id=9, pad_id=0)
    custom = encode.ArrowTokenizer(load, eos_id=9, pad_id=0)
    results = []
    for tokenizer in (table, custom):
        out = encode.encode_sft(examples, tokenizer, max_length=20).orderBy("idx").collect()
        assert all(len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) <= 20 for r in out)
        results.append([tuple(map(tuple, (r["input_ids"], r["labels"]))) for r in out])
    assert results[0] == results[1] and len(results[0]) == 3
    pairs = examples.withColumn("label", F.lit(1))
    for columns in (["query", "response"], ["query"], "query"):
        both = [
            [tuple(map(tuple, (r["input_ids"], r["attention_mask"]))) for r in encode.encode_pair(pairs, t, columns, 6).orderBy("idx").collect()]
            for t in (table, custom)
        ]
        assert both[0] == both[1] and all(len(x) == 6 for row in both[0] for x in row)


def test_processors():
    assert encode.processor_for("glue") is encode.encode_pair
    with pytest.raises(ValueError, match="glue, meta-math/MetaMathQA"):
        encode.processor_for("x")


def test_collate(spark):
    rows = [(0, 0, list(range(1, 4)), list(range(1, 4))), (1, 0, list(range(1, 10)), None), (2, 1, [7], None)]
    df = spark.createDataFrame(rows, "idx long, batch_id long, input_ids array<int>, labels array<int>")
    out = collate.collate(df, 0).orderBy("idx").collect()
    assert [len(r["input_ids"]) for r in out] == [16, 16, 8]
    assert out[0]["input_ids"] == [1, 2, 3] + [0] * 13 and out[0]["attention_mask"] == [1] * 3 + [0] * 13
    assert out[0]["labels"] == [1, 2, 3] + [-100] * 13 and out[1]["labels"] == [-100] * 16
    assert out[2]["labels"] == out[2]["input_ids"] == [7] + [0] * 7
    masked = df.withColumn("attention_mask", F.when(F.col("idx") != 1, F.array(F.lit(0), F.lit(1))))
    masks = [r["attention_mask"] for r in collate.collate(masked, None, None, eos_id=5).orderBy("idx").collect()]
    assert masks == [[1] * 3 + [0] * 6, [1] * 9, [0, 1]]
    plain = collate.collator_for(df.drop("labels"), "CAUSAL_LM", 0)(df.drop("labels")).orderBy("idx").collect()
    assert plain[0]["labels"] == [1, 2, 3] + [-100] * 13
    classes = df.withColumn("labels", F.lit(1))
    got = collate.collator_for(classes, "SEQ_CLS", 0)(classes).orderBy("idx").collect()
    assert got[0]["labels"] == 1 and len(got[0]["input_ids"]) == 16
    assert collate.collator_for(df, "causal_lm", 0).func is collate.collate


def test_text_functions(spark):
    def one(value, make):
        return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]

    assert one("abc Question: x USER", text.cut_at_stop) == "abc " and one(None, text.cut_at_stop) == ""
    assert one("a.b*c", lambda c: text.cut_at_stop(c, [".b*"])) == "a"
    assert one("Hello 1234324asdasd 123 0001234 00000", text.group_digits) == "Hello 1,234,324asdasd 123 1,234 0"
    assert one("1, 2,,3 ", text.int_list) == [1, 2, 3]
    assert one("a/b/c", text.last_segment) == "c" and one("a/b", text.path_safe) == "a-b"
    assert one("x{query}$1\\", lambda c: text.fill_template(F.lit("{{q}} {instruction}-{query}"), c)) == "{q} x{query}$1\\-x{query}$1\\"
    assert one("Q", text.instruction_prompt) == text.INSTRUCTION_HEAD + "Q" + text.INSTRUCTION_TAIL
    assert one("Q", text.classic_prompt).count("### Instruction:\nQ\n\n### Response:\n    ") == 1
    none = F.lit(None).cast("string")
    order = [
        ("A{query}", "B", "metamath", "d", "C", "AQ"), (None, "B{query}", "metamath", "d", "C", "BQ"),
        ("", "", " MetaMath ", "d", "C", None), (None, None, None, text.MATH_DATASET, "C", None),
        (None, None, "x", "d", "C{instruction}", "CQ"), (None, None, None, None, None, "Q"),
    ]
    for *given, want in order:
        cols = [none if g is None else F.lit(g) for g in given]
        got = one("Q", lambda c: text.choose_prompt(c, *cols))
        assert got == (want or text.INSTRUCTION_HEAD + "Q" + text.INSTRUCTION_TAIL)
    tokens = F.array(*[F.lit(t) for t in ("ab", "cd", "\\boxed", "{1}")])
    cut = lambda c: text.tokens_before_boxed(c, tokens)
    assert one("abcd\\boxed{1}", cut) == ["ab"] and one("none", cut) is None


WORDS = ["a", "b", "c", "dd", "e"]
SPECIAL = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}


def library_tokenizer(single, pair, length):
    """A tokenizer of the library with a given word list: its layout, cutting and padding are what is compared."""
    tokenizers = pytest.importorskip("tokenizers")
    words = {w: i + len(SPECIAL) for i, w in enumerate(WORDS)}
    out = tokenizers.Tokenizer(tokenizers.models.WordLevel({**SPECIAL, **words}, unk_token="[UNK]"))
    out.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    marks = [("[CLS]", 2), ("[SEP]", 3)]
    out.post_processor = tokenizers.processors.TemplateProcessing(single=single, pair=pair, special_tokens=marks)
    out.enable_truncation(length, strategy="longest_first")
    out.enable_padding(length=length, pad_id=0, pad_token="[PAD]")
    return out


LAYOUTS = {
    "two_segments": ("[CLS] $A [SEP]", "[CLS] $A [SEP] $B:1 [SEP]:1"),
    "one_segment": ("[CLS] $A [SEP]", "[CLS] $A [SEP] [SEP] $B [SEP]"),
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("length", [5, 8, 11])
def test_pairs_as_a_real_tokenizer_lays_them_out(spark, layout, length):
    ids = {w: i + len(SPECIAL) for i, w in enumerate(WORDS)}
    template = getattr(encode.PairTemplate, layout)(2, 3)
    texts = [" ".join(WORDS[(i + j) % 5] for j in range(i)) for i in range(10)] + ["x a", None]
    rows = [(i * 100 + j, a, b, i) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(rows, "idx long, a string, b string, label int")
    library = library_tokenizer(*LAYOUTS[layout], length)
    vocab = spark.createDataFrame([(w, i, 1) for w, i in ids.items()], "token string, id int, n long")
    custom = encode.ArrowTokenizer(lambda: lambda ts: [[ids.get(w, 1) for w in t.split()] for t in ts], pad_id=0)
    for tokenizer in (encode.VocabTokenizer(vocab, unk_id=1, pad_id=0), custom):
        for columns in (["a", "b"], "a"):
            got = encode.encode_pair(df, tokenizer, columns, length, keep=["idx"], template=template)
            for r in got.collect():
                a, b = texts[r["idx"] // 100] or "", texts[r["idx"] % 100] or ""
                want = library.encode(a, b) if columns != "a" else library.encode(a)
                found = (r["input_ids"], r["token_type_ids"], r["attention_mask"], r["special_tokens_mask"])
                assert found == (want.ids, want.type_ids, want.attention_mask, want.special_tokens_mask), (a, b, columns)
                assert r["labels"] == r["idx"] // 100


def test_templates_are_checked(spark):
    with pytest.raises(ValueError, match="each of"):
        encode.PairTemplate([("A", 0)], [("A", 0), ("A", 1)])
    template = encode.PairTemplate.one_segment(1, 2)
    df = spark.createDataFrame([(0, "a", "b")], "idx long, a string, b string")
    with pytest.raises(ValueError, match="special ids"):
        encode.encode_pair(df, encode.ArrowTokenizer(list), ["a", "b"], 3, keep=["idx"], template=template)


def test_first_words_are_cut_without_splitting_the_rest(spark):
    texts = [None, "", " ", "a", " a b", "a b ", "a b c d e", "\ta\n\nb  c d", "a b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (0, 1, 2, 3, 9):
        got = [r[0] for r in rows.select(encode.split_words(F.col("t"), most)).collect()]
        assert got == [(t or "").split()[:most] for t in texts]
