"""Split, prompt, encoding and collation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text
from evalloom.functions.core import STRIP_CHARS
from evalloom.operators import collate as col
from evalloom.operators import encode, splits
from evalloom.plans.jobs import prepare_dataset
from evalloom.queries.registry import joined, query, sql_text, table
from evalloom.sources.readers import load_splits
from evalloom.sources.scratch import settle

INDEXED = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, n_chars, source FROM documents"


def _documents(spark, sf_dir, *columns):
    return splits.with_index(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


@query(
    "split_slice",
    f"""
    WITH d AS ({INDEXED})
    SELECT 'train' AS split, idx, doc_id, n_chars FROM d WHERE idx >= 100
    UNION ALL SELECT 'validation', idx, doc_id, n_chars FROM d WHERE idx < 100
    UNION ALL SELECT 'test', idx, doc_id, n_chars FROM d WHERE idx = 7
    """,
)
def split_slice(spark, sf_dir):
    docs = _documents(spark, sf_dir, "n_chars")
    return load_splits(docs, "train[100:]", "train[:100]", "train[7]").select("split", "idx", "doc_id", "n_chars")


@query(
    "batch_tail_merge",
    f"""
    WITH b AS (SELECT *, least(idx // 32, greatest((SELECT count(*) FROM documents) // 32 - 1, 0)) AS batch_id FROM ({INDEXED}))
    SELECT batch_id, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM b GROUP BY 1
    """,
)
def batch_tail_merge(spark, sf_dir):
    total = splits.row_total(table(spark, sf_dir, "documents"))
    batches = splits.batch_id(_documents(spark, sf_dir), 32, total=total)
    return batches.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query(
    "round_robin_shards",
    f"SELECT CAST(idx % 7 AS INTEGER) AS shard, count(*) AS rows FROM ({INDEXED}) GROUP BY 1",
)
def round_robin_shards(spark, sf_dir):
    return splits.shard_sizes(_documents(spark, sf_dir), 7)


@query(
    "even_chunks",
    """
    SELECT chunk, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc
    FROM (SELECT doc_id, ntile(13) OVER (ORDER BY doc_id) - 1 AS chunk FROM documents) GROUP BY 1
    """,
)
def even_chunks(spark, sf_dir):
    total = splits.row_total(table(spark, sf_dir, "documents"))
    chunks = splits.even_chunks(_documents(spark, sf_dir), 13, total=total)
    return chunks.groupBy("chunk").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query(
    "seeded_sample",
    "SELECT doc_id, n_chars, text FROM documents ORDER BY md5('85:' || doc_id), doc_id LIMIT 150",
)
def seeded_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return splits.seeded_sample(docs, 150, splits.default_seed(42), "doc_id")


@query("ordered_distinct", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    return splits.ordered_distinct(table(spark, sf_dir, "documents"), "source", "doc_id")


@query(
    "map_batches",
    "SELECT doc_id, n_chars * 2 AS twice FROM documents WHERE n_chars % 2 = 0",
)
def map_batches(spark, sf_dir):
    def even(frame):
        kept = frame[frame.n_chars % 2 == 0]
        return kept.assign(twice=kept.n_chars * 2)[["doc_id", "twice"]]

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return splits.map_batches(docs, even, "doc_id long, twice long")


@query(
    "set_operators",
    """
    SELECT 'difference' AS op, p_type AS k, 1::BIGINT AS n FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 48
        EXCEPT SELECT p_type FROM part WHERE p_size < 2)
    UNION ALL SELECT 'kept', o_orderpriority, count(*) FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 2
    UNION ALL SELECT 'union', CAST(l AS VARCHAR), count(*) FROM (
        SELECT l_linenumber AS l FROM lineitem WHERE l_discount > 0.05
        UNION ALL SELECT l_linenumber FROM lineitem WHERE l_discount <= 0.05) GROUP BY 2
    """,
)
def set_operators(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    difference = splits.name_difference(
        part.filter("p_size < 48").select("p_type"), part.filter("p_size < 2").select("p_type")
    ).select(F.lit("difference").alias("op"), F.col("p_type").alias("k"), F.lit(1).cast("long").alias("n"))
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    kept = splits.keep_keys(table(spark, sf_dir, "orders"), rich, "o_custkey")
    counted = kept.groupBy(F.lit("kept").alias("op"), F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem")
    union = splits.union_shards(lines.filter("l_discount > 0.05"), lines.filter("l_discount <= 0.05"))
    united = union.groupBy(F.lit("union").alias("op"), F.col("l_linenumber").cast("string").alias("k")).agg(
        F.count("*").alias("n")
    )
    return splits.union_shards(difference, counted, united)


# --- prompts ----------------------------------------------------------------------------------------------

KINDS = [*text.PROMPT_TEMPLATES, "other"]
CHARS = "'" + STRIP_CHARS.replace("'", "''") + "'"

TEMPLATE_SQL = "CASE c.conv_id % 10 " + " ".join(
    f"WHEN {i} THEN {sql_text(t)}" for i, t in enumerate(text.PROMPT_TEMPLATES.values())
) + f" ELSE {sql_text(text.DEFAULT_TEMPLATE)} END"

PAIRS = """
    SELECT u.conv_id, u.turn, u.text AS query, a.text AS response FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
"""
RENDERED = f"""
    SELECT conv_id, turn, trim(replace({TEMPLATE_SQL}, '{{query}}', query), {CHARS}) AS prompt,
           trim(response, {CHARS}) AS target FROM ({PAIRS}) c
"""


def _examples(spark, sf_dir):
    """User turns with the assistant turn that follows, typed by conversation; every tenth has no type."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    kind = F.try_element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("conv_id") % 10 + 1).cast("int"))
    return user.join(reply, ["conv_id", "turn"]).withColumn("type", kind)


@query("typed_prompts", RENDERED)
def typed_prompts(spark, sf_dir):
    return encode.render_examples(_examples(spark, sf_dir)).select("conv_id", "turn", "prompt", "target")


@query(
    "template_join",
    f"SELECT conv_id, turn, {TEMPLATE_SQL} AS template FROM ({PAIRS}) c",
)
def template_join(spark, sf_dir):
    templates = spark.createDataFrame(list(text.PROMPT_TEMPLATES.items()), "type string, template string")
    return encode.attach_template(_examples(spark, sf_dir), templates).select("conv_id", "turn", "template")


@query(
    "fixed_prompts",
    f"""
    SELECT conv_id, turn, {sql_text(text.INSTRUCTION_HEAD)} || text || {sql_text(text.INSTRUCTION_TAIL)} AS instruction,
           {sql_text(text.CLASSIC_HEAD)} || text || {sql_text(text.CLASSIC_TAIL)} AS classic FROM conversations
    """,
)
def fixed_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text.instruction_prompt(F.col("text")).alias("instruction"),
        text.classic_prompt(F.col("text")).alias("classic"),
    )


@query(
    "prompt_precedence",
    f"""
    SELECT conv_id, turn, CASE
        WHEN conv_id % 5 = 0 THEN 'Q: ' || text || ' A:' WHEN conv_id % 5 = 1 THEN text || ' {{x}} ' || text
        WHEN turn % 3 = 0 OR conv_id % 7 = 0 THEN {sql_text(text.INSTRUCTION_HEAD)} || text || {sql_text(text.INSTRUCTION_TAIL)}
        WHEN conv_id % 2 = 0 THEN 'T ' || text ELSE text END AS prompt
    FROM conversations
    """,
)
def prompt_precedence(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    prompt = text.choose_prompt(
        F.col("text"),
        F.when(conv % 5 == 0, "Q: {instruction} A:").when(conv % 5 == 2, ""),
        F.when(conv % 5 == 1, "{query} {{x}} {instruction}"),
        F.when(turn % 3 == 0, " MetaMath "),
        F.when(conv % 7 == 0, text.MATH_DATASET).otherwise("other"),
        F.when(conv % 2 == 0, "T {query}"),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query(
    "stop_cut",
    """
    SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN text ELSE text || ' ' END AS cut FROM conversations
    """,
)
def stop_cut(spark, sf_dir):
    body = F.col("text")
    spliced = (
        F.when(F.col("turn") % 4 == 0, F.concat(body, F.lit(" Question: "), body, F.lit(" USER")))
        .when(F.col("turn") % 4 == 1, F.concat(body, F.lit(" Response"), body))
        .when(F.col("turn") % 4 == 2, F.concat(body, F.lit(" ASSISTANT: Instruction "), body))
        .otherwise(body)
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cut_at_stop(spliced).alias("cut"))


# --- encoding ---------------------------------------------------------------------------------------------

EOS, UNK, FIRST_ID = 1, 2, 3
WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')"


def _vocab_sql(texts: str) -> str:
    return f"""
        SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 + {FIRST_ID} AS INTEGER) AS id, n FROM (
            SELECT token, count(*) AS n FROM (SELECT unnest({WORDS.format("txt")}) AS token FROM ({texts})) GROUP BY 1)
    """


def _ids_sql(rows: str, vocab: str, key: str, column: str, most: int | None = None) -> str:
    """Id list per row key, empty where there are no tokens; of the first ``most`` tokens if given."""
    words = WORDS.format(column) if most is None else f"list_slice({WORDS.format(column)}, 1, {most})"
    return f"""
        SELECT {key}, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []::INTEGER[]) AS ids FROM (
            SELECT r.{key}, r.pos, v.id FROM (
                SELECT {key}, unnest(w) AS token, generate_subscripts(w, 1) AS pos
                FROM (SELECT {key}, {words} AS w FROM ({rows}))) r
            JOIN ({vocab}) v ON v.token = r.token) GROUP BY 1
    """


CONVERSATION_VOCAB = _vocab_sql("SELECT text AS txt FROM conversations")


@query("vocab_build", CONVERSATION_VOCAB)
def vocab_build(spark, sf_dir):
    return encode.build_vocab(table(spark, sf_dir, "conversations"), "text", FIRST_ID)


@query(
    "vocab_encode",
    f"""
    WITH r AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations)
    SELECT r.k, coalesce(array_to_string(i.ids, ','), '') AS ids
    FROM r LEFT JOIN ({_ids_sql("SELECT * FROM r", CONVERSATION_VOCAB, "k", "text")}) i ON i.k = r.k
    """,
)
def vocab_encode(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    vocab = encode.build_vocab(turns, "text", FIRST_ID)
    keyed = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    out = encode.VocabTokenizer(vocab, unk_id=UNK).encode(keyed, {"ids": "text"}, ["k"])
    return out.select("k", joined(F.col("ids")).alias("ids"))


def length_tokenizer():
    """A tokenizer whose ids are word lengths."""
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


@query(
    "custom_tokenizer",
    f"""
    SELECT conv_id, turn, coalesce(array_to_string(list_transform({WORDS.format("text")}, lambda w: length(w)), ','), '') AS ids
    FROM conversations
    """,
)
def custom_tokenizer(spark, sf_dir):
    tokenizer = encode.ArrowTokenizer(length_tokenizer)
    out = tokenizer.encode(table(spark, sf_dir, "conversations"), {"ids": "text"}, ["conv_id", "turn"])
    return out.select("conv_id", "turn", joined(F.col("ids")).alias("ids"))


MAX_LENGTH = 160
KEYED = f"SELECT conv_id * 1000 + turn AS k, prompt, target FROM ({RENDERED})"
SFT_VOCAB = _vocab_sql(f"SELECT prompt || ' ' || target AS txt FROM ({RENDERED})")
SFT = f"""
    WITH r AS ({KEYED}), v AS ({SFT_VOCAB}),
    e AS (
        SELECT r.k, coalesce(p.ids, []::INTEGER[]) AS p, list_append(coalesce(t.ids, []::INTEGER[]), {EOS}) AS t
        FROM r LEFT JOIN ({_ids_sql("SELECT * FROM r", "SELECT * FROM v", "k", "prompt")}) p ON p.k = r.k
        LEFT JOIN ({_ids_sql("SELECT * FROM r", "SELECT * FROM v", "k", "target")}) t ON t.k = r.k),
    o AS (SELECT *, greatest(len(p) + len(t) - {MAX_LENGTH}, 0) AS over FROM e),
    f AS (
        SELECT k, list_slice(p, least(len(p), over) + 1, len(p)) AS p,
               list_slice(t, 1, len(t) - (over - least(len(p), over))) AS t FROM o)
    SELECT k, list_concat(p, t) AS ids, list_concat(list_transform(p, lambda x: -100), t) AS labels,
           len(p) + len(t) AS n FROM f WHERE len(t) > 0
"""


def _sft(spark, sf_dir):
    examples = _examples(spark, sf_dir).withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    texts = encode.render_examples(examples).select(F.concat_ws(" ", "prompt", "target").alias("txt"))
    tokenizer = encode.VocabTokenizer(encode.build_vocab(texts, "txt", FIRST_ID), unk_id=UNK, eos_id=EOS, pad_id=0)
    return encode.encode_sft(examples, tokenizer, max_length=MAX_LENGTH, keep=["k"])


@query(
    "sft_encode",
    f"""
    SELECT k, array_to_string(ids, ',') AS input_ids, array_to_string(labels, ',') AS labels, n AS n FROM ({SFT})
    """,
)
def sft_encode(spark, sf_dir):
    return _sft(spark, sf_dir).select(
        "k",
        joined(F.col("input_ids")).alias("input_ids"),
        joined(F.col("labels")).alias("labels"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
    )


def _padded_sql(columns: str) -> str:
    return f"""
    WITH s AS ({SFT}),
    b AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS idx FROM s),
    c AS (SELECT *, least(idx // 16, greatest((SELECT count(*) FROM s) // 16 - 1, 0)) AS batch_id FROM b),
    l AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch_id) / 8.0) * 8 AS BIGINT) AS len FROM c)
    SELECT k, batch_id, {columns} FROM l
    """


IDS_PADDED = "array_to_string(list_concat(ids, list_transform(range(len - n), lambda x: 0)), ',') AS input_ids"
MASK_PADDED = "repeat('1,', n - 1) || '1' || repeat(',0', len - n) AS attention_mask"


def _batched(spark, sf_dir):
    encoded = settle(_sft(spark, sf_dir))
    return splits.batch_id(splits.with_index(encoded, "k"), 16, total=splits.row_total(encoded))


def _as_text(df, labels=True):
    columns = ["input_ids", "attention_mask", *(["labels"] if labels else [])]
    return df.select("k", "batch_id", *[joined(F.col(c)).alias(c) for c in columns])


@query(
    "collate_padded",
    _padded_sql(
        f"{IDS_PADDED}, {MASK_PADDED}, "
        "array_to_string(list_concat(labels, list_transform(range(len - n), lambda x: -100)), ',') AS labels"
    ),
)
def collate_padded(spark, sf_dir):
    batched = _batched(spark, sf_dir)
    return _as_text(col.collator_for(batched, "CAUSAL_LM", 0)(batched))


@query(
    "collate_plain",
    _padded_sql(
        f"{IDS_PADDED}, {MASK_PADDED}, "
        "array_to_string(list_concat(ids, list_transform(range(len - n), lambda x: -100)), ',') AS labels"
    ),
)
def collate_plain(spark, sf_dir):
    batched = _batched(spark, sf_dir).drop("labels")
    return _as_text(col.collator_for(batched, "CAUSAL_LM", 0)(batched))


@query(
    "collate_partial_labels",
    _padded_sql(
        f"{IDS_PADDED}, {MASK_PADDED}, array_to_string(CASE "
        "WHEN batch_id % 3 = 0 THEN list_concat(ids, list_transform(range(len - n), lambda x: 0)) "
        "WHEN k // 1000 % 2 = 0 AND batch_id % 3 = 1 THEN list_transform(range(len), lambda x: -100) "
        "ELSE list_concat(labels, list_transform(range(len - n), lambda x: -100)) END, ',') AS labels"
    ),
)
def collate_partial_labels(spark, sf_dir):
    """Batches 0, 3, … have no labels at all, batches 1, 4, … none in even conversations, and no row has a mask."""
    batched = _batched(spark, sf_dir).drop("attention_mask")
    gone = (F.col("batch_id") % 3 == 0) | ((F.col("batch_id") % 3 == 1) & (F.floor(F.col("k") / 1000) % 2 == 0))
    return _as_text(col.collate(batched.withColumn("labels", F.when(~gone, F.col("labels"))), 0))


PAIR_LENGTH = 96
PAIR_ROWS = """
    SELECT d.doc_id, d.text AS a, b.text AS b, d.n_chars AS labels
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
"""
START, SEPARATOR = 3, 4
PAIR_FIRST = 5
PAIR_TEXTS = "SELECT text AS txt FROM documents UNION ALL SELECT text FROM benchmark"


def _pair_sql(first_id: int, budget: int) -> str:
    """Relation ``e``: id lists ``p`` and ``t`` of both texts, cut to ``budget``, and the texts' full lengths."""
    return f"""
    WITH r AS MATERIALIZED ({PAIR_ROWS}),
    w AS MATERIALIZED (SELECT doc_id, labels, {WORDS.format("a")} AS wa, {WORDS.format("b")} AS wb FROM r),
    v AS MATERIALIZED (SELECT token, CAST(id - {FIRST_ID} + {first_id} AS INTEGER) AS id FROM ({_vocab_sql(PAIR_TEXTS)})),
    s AS (SELECT doc_id, 0 AS side, list_slice(wa, 1, {budget}) AS l FROM w UNION ALL SELECT doc_id, 1, list_slice(wb, 1, {budget}) FROM w),
    m AS MATERIALIZED (
        SELECT doc_id, list(id ORDER BY pos) FILTER (side = 0) AS p, list(id ORDER BY pos) FILTER (side = 1) AS t
        FROM (SELECT doc_id, side, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM s) JOIN v USING (token) GROUP BY doc_id),
    e AS MATERIALIZED (
        SELECT w.doc_id, labels, len(wa) AS n1, len(wb) AS n2, coalesce(p, []::INTEGER[]) AS p, coalesce(t, []::INTEGER[]) AS t
        FROM w LEFT JOIN m ON m.doc_id = w.doc_id)"""


PAIR_PLAIN = f"""
    {_pair_sql(FIRST_ID, PAIR_LENGTH)},
    n AS (
        SELECT *, CASE WHEN len(p) + len(t) <= {PAIR_LENGTH} THEN len(p) WHEN len(t) <= {PAIR_LENGTH // 2} THEN {PAIR_LENGTH} - len(t)
                       ELSE least(len(p), {(PAIR_LENGTH + 1) // 2}) END AS np FROM e),
    f AS (SELECT doc_id, labels, list_concat(list_slice(p, 1, np), list_slice(t, 1, {PAIR_LENGTH} - np)) AS ids FROM n)
    SELECT doc_id, labels, array_to_string(list_concat(ids, list_transform(range({PAIR_LENGTH} - len(ids)), lambda x: 0)), ',') AS input_ids,
           len(ids) AS kept FROM f
"""
PAIR_BUDGET = PAIR_LENGTH - 3
PAIR = f"""
    {_pair_sql(PAIR_FIRST, PAIR_BUDGET)},
    n AS (
        SELECT *, CASE WHEN n1 + n2 <= {PAIR_BUDGET} THEN n1 WHEN n1 <= n2 THEN least(n1, {PAIR_BUDGET // 2})
                       ELSE {PAIR_BUDGET} - least(n2, {PAIR_BUDGET // 2}) END AS k FROM e),
    f AS (
        SELECT doc_id, labels, list_concat(list_concat([{START}]::INTEGER[], list_slice(p, 1, k)), [{SEPARATOR}]::INTEGER[]) AS a,
               list_concat(list_slice(t, 1, {PAIR_BUDGET} - k), [{SEPARATOR}]::INTEGER[]) AS b FROM n)
    SELECT doc_id, labels, len(a) + len(b) AS kept,
           array_to_string(list_concat(list_concat(a, b), list_transform(range({PAIR_LENGTH} - len(a) - len(b)), lambda x: 0)), ',') AS input_ids,
           array_to_string(list_transform(range({PAIR_LENGTH}), lambda i: CASE WHEN i >= len(a) AND i < len(a) + len(b) THEN 1 ELSE 0 END), ',') AS segments
    FROM f
"""


def _pairs(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").withColumn("_n", splits.row_total(items))
    picked = docs.select("doc_id", F.col("text").alias("a"), F.col("n_chars").alias("label"), (F.col("doc_id") % F.col("_n")).alias("item_id"))
    return picked.join(items.select("item_id", F.col("text").alias("b")), "item_id")


def _pair_tokenizer(spark, sf_dir, first_id):
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    return encode.VocabTokenizer(encode.build_vocab(texts, "text", first_id), unk_id=UNK, pad_id=0)


def _pair_columns(out):
    kept = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "doc_id", "labels", joined(F.col("input_ids")).alias("input_ids"), kept.alias("kept"),
        *([joined(F.col("token_type_ids")).alias("segments")] if "token_type_ids" in out.columns else []),
    )


@query("pair_encode", PAIR)
def pair_encode(spark, sf_dir):
    """Text pairs with start, separator and end ids and segments."""
    template = encode.PairTemplate.two_segments(START, SEPARATOR)
    tokenizer = _pair_tokenizer(spark, sf_dir, PAIR_FIRST)
    return _pair_columns(encode.encode_pair(_pairs(spark, sf_dir), tokenizer, ["a", "b"], PAIR_LENGTH, keep=["doc_id"], template=template))


@query("pair_encode_plain", PAIR_PLAIN)
def pair_encode_plain(spark, sf_dir):
    """Text pairs without special ids."""
    return _pair_columns(encode.encode_pair(_pairs(spark, sf_dir), _pair_tokenizer(spark, sf_dir, FIRST_ID), ["a", "b"], PAIR_LENGTH, keep=["doc_id"]))


@query(
    "single_encode",
    f"""
    SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(64 - len(ids)), lambda x: 0)), ',') AS input_ids,
           len(ids) AS kept
    FROM (SELECT doc_id, list_slice(list_transform({WORDS.format("text")}, lambda w: length(w)), 1, 64) AS ids FROM documents)
    """,
)
def single_encode(spark, sf_dir):
    tokenizer = encode.ArrowTokenizer(length_tokenizer, pad_id=0)
    out = encode.encode_pair(table(spark, sf_dir, "documents"), tokenizer, "text", 64, keep=["doc_id"])
    return out.select(
        "doc_id", joined(F.col("input_ids")).alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"),
    )


@query(
    "collate_classes",
    f"""
    WITH d AS (
        SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS idx,
               list_transform({WORDS.format("text")}, lambda w: length(w)) AS ids FROM documents),
    b AS (SELECT *, least(idx // 8, greatest((SELECT count(*) FROM d) // 8 - 1, 0)) AS batch_id FROM d),
    l AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 8.0) * 8 AS BIGINT) AS width FROM b)
    SELECT doc_id, batch_id, n_chars AS labels, width, md5(array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ',')) AS digest,
           len(ids) AS kept FROM l
    """,
)
def collate_classes(spark, sf_dir):
    tokenizer = encode.ArrowTokenizer(length_tokenizer, pad_id=0)
    ids = settle(tokenizer.encode(table(spark, sf_dir, "documents"), {"input_ids": "text"}, ["doc_id", "n_chars"]))
    indexed = splits.with_index(encode.rename_label(ids, "n_chars"), "doc_id")
    rows = splits.batch_id(indexed, 8, total=splits.row_total(ids))
    out = col.collator_for(rows, "SEQ_CLS", 0)(rows)
    return out.select(
        "doc_id", "batch_id", "labels", F.size("input_ids").cast("long").alias("width"),
        F.md5(joined(F.col("input_ids"))).alias("digest"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"),
    )


@query(
    "processor_dispatch",
    f"""
    WITH d AS ({INDEXED.replace("source", "source, text")}),
    s AS (SELECT 'train' AS split, * FROM d WHERE idx >= 50 UNION ALL SELECT 'validation', * FROM d WHERE idx < 50),
    w AS (SELECT split, idx, n_chars, list_slice(list_transform({WORDS.format("text")}, lambda w: length(w)), 1, 48) AS ids FROM s)
    SELECT split, idx, n_chars AS labels, array_to_string(list_concat(ids, list_transform(range(48 - len(ids)), lambda x: 0)), ',') AS input_ids FROM w
    """,
)
def processor_dispatch(spark, sf_dir):
    """Splits encoded by the processor that the dataset's name stands for."""
    rows = _documents(spark, sf_dir, "n_chars", "text")
    tokenizer = encode.ArrowTokenizer(length_tokenizer, pad_id=0)
    out = prepare_dataset(rows, "glue", tokenizer, "train[50:]", "train[:50]", text_column="text", label_column="n_chars", max_length=48)
    return out.select("split", "idx", "labels", joined(F.col("input_ids")).alias("input_ids"))


@query(
    "split_names",
    "SELECT o_orderpriority AS split, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1",
)
def split_names(spark, sf_dir):
    """Rows of the splits that a comma list names, checked against those there are."""
    orders = table(spark, sf_dir, "orders")
    there = [r[0] for r in orders.select("o_orderpriority").distinct().collect()]
    wanted = splits.parse_splits(" 1-URGENT, ,3-MEDIUM ")
    splits.check_splits(wanted, there)
    return orders.filter(F.col("o_orderpriority").isin(wanted)).groupBy(F.col("o_orderpriority").alias("split")).agg(F.count("*").alias("n"))
