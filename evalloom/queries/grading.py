"""Grading queries. Completions and gold answers are composed from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import grading as g
from evalloom.functions import text
from evalloom.operators import grade as ops
from evalloom.operators.predict import batch_predict
from evalloom.queries.registry import query, table

PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)"
WHOLE = "CAST(o_custkey AS VARCHAR)"

# The same texts on both sides: eight completion forms by order key.
NUMERIC_ROWS = f"""
    SELECT o_orderkey AS idx, 'gsm8k' AS split, o_orderpriority AS instruction,
           CASE o_orderkey % 3 WHEN 0 THEN 'work #### ' || {WHOLE} WHEN 1 THEN '####' || {WHOLE} || ' ' ELSE 'none' END AS reference,
           CASE o_orderkey % 8
             WHEN 0 THEN 'The answer is: ' || {WHOLE}
             WHEN 1 THEN 'The answer is: $' || {PRICE} || '.'
             WHEN 2 THEN 'The answer is: 1. The answer is: ' || {WHOLE} || '/1'
             WHEN 3 THEN 'The answer is: ' || {WHOLE} || '/0 Question: The answer is: 5'
             WHEN 4 THEN 'The answer is:' || {WHOLE}
             WHEN 5 THEN 'The answer is: ' || {WHOLE} || '.50 apples'
             WHEN 6 THEN 'The answer is: none'
             ELSE 'The answer is: /' || {WHOLE} END AS prediction_raw
    FROM orders
"""


def _numeric(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    whole = F.col("o_custkey").cast("string")
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind, gold = F.col("o_orderkey") % 8, F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"),
        F.lit("gsm8k").alias("split"),
        F.col("o_orderpriority").alias("instruction"),
        F.when(gold == 0, form("work #### ", whole)).when(gold == 1, form("####", whole, " ")).otherwise("none").alias(
            "reference"
        ),
        F.when(kind == 0, form("The answer is: ", whole))
        .when(kind == 1, form("The answer is: $", price, "."))
        .when(kind == 2, form("The answer is: 1. The answer is: ", whole, "/1"))
        .when(kind == 3, form("The answer is: ", whole, "/0 Question: The answer is: 5"))
        .when(kind == 4, form("The answer is:", whole))
        .when(kind == 5, form("The answer is: ", whole, ".50 apples"))
        .when(kind == 6, "The answer is: none")
        .otherwise(form("The answer is: /", whole))
        .alias("prediction_raw"),
    )


def _graded_numeric(spark, sf_dir, debug=False):
    rows = _numeric(spark, sf_dir)
    items = rows.select("idx", "split", "instruction", "reference")
    return ops.grade(items, rows.select("idx", "split", "prediction_raw"), "numeric", debug=debug)


NUMERIC_GRADED = f"""
    WITH cut AS (
        SELECT *, regexp_replace(prediction_raw, '(?s)(Question|USER|ASSISTANT|Instruction|Response).*', '') AS prediction
        FROM ({NUMERIC_ROWS})),
    field AS (
        SELECT *, CASE WHEN contains(prediction, 'The answer is: ')
                       THEN trim(string_split(prediction, 'The answer is: ')[-1]) END AS field FROM cut),
    token AS (SELECT *, nullif(regexp_extract(field, '[-+]?\\d*[.,/]?\\d+'), '') AS token FROM field),
    parts AS (
        SELECT *, replace(split_part(token, '/', 1), ',', '') AS num, split_part(token, '/', 2) AS den FROM token),
    answer AS (
        SELECT *, CASE WHEN token IS NULL THEN NULL
                       WHEN contains(token, '/') AND NOT regexp_matches(num, '\\d') THEN NULL
                       WHEN den = '0' THEN round_even(CAST(num AS DOUBLE), 0)
                       WHEN contains(token, '/') THEN round_even(CAST(num AS DOUBLE) / CAST(den AS DOUBLE), 0)
                       ELSE round_even(TRY_CAST(replace(token, ',', '') AS DOUBLE), 0) END AS number,
               CASE WHEN contains(reference, '####')
                    THEN TRY_CAST(replace(trim(split_part(reference, '####', 2)), ',', '') AS DOUBLE) END AS gold
        FROM parts)
    SELECT *, coalesce(number = gold, false) AS correct FROM answer
"""


@query(
    "grade_numeric",
    f"""
    SELECT idx, split, instruction, reference, prediction, correct,
           CAST(CAST(gold AS BIGINT) AS VARCHAR) AS expected_answer, CAST(CAST(number AS BIGINT) AS VARCHAR) AS answer
    FROM ({NUMERIC_GRADED})
    """,
)
def grade_numeric(spark, sf_dir):
    return _graded_numeric(spark, sf_dir)


@query(
    "grade_numeric_debug",
    f"""
    SELECT idx, 'gsm8k' AS task, CASE WHEN contains(reference, '####') THEN trim(split_part(reference, '####', 2)) END AS expected_raw,
           gold AS expected_number, number AS pred_number, field IS NOT NULL AS found_answer_prefix, field AS answer_field,
           token AS matched_token,
           CASE WHEN contains(token, '/') AND NOT regexp_matches(num, '\\d') THEN 'non_numeric_fraction' END AS parse_error,
           {"'" + text.INSTRUCTION_HEAD.replace("'", "''") + "'"} || instruction || {"'" + text.INSTRUCTION_TAIL.replace("'", "''") + "'"} AS prompt
    FROM ({NUMERIC_GRADED})
    """,
)
def grade_numeric_debug(spark, sf_dir):
    out = _graded_numeric(spark, sf_dir, debug=True)
    return out.select("idx", "prompt", "judge.*").select(
        "idx", "prompt", "task", "expected_raw", "expected_number", "pred_number", "extraction.*"
    )


@query(
    "grade_accuracy",
    f"""
    SELECT instruction, avg(CAST(correct AS INTEGER)) AS accuracy, count(*) AS total
    FROM ({NUMERIC_GRADED}) GROUP BY 1
    """,
)
def grade_accuracy(spark, sf_dir):
    return ops.accuracy(_graded_numeric(spark, sf_dir), ["instruction"])


@query("invalid_outputs", f"SELECT idx, prediction, reference FROM ({NUMERIC_GRADED}) WHERE number IS NULL")
def invalid_outputs(spark, sf_dir):
    return ops.invalid_outputs(_graded_numeric(spark, sf_dir)).select("idx", "prediction", "reference")


@query(
    "gold_numbers",
    f"""
    SELECT o_orderkey, CAST({WHOLE} AS DOUBLE) AS strict, CAST(o_orderkey * 1000 + 7 AS DOUBLE) AS grouped,
           NULL::DOUBLE AS wordy FROM orders
    """,
)
def gold_numbers(spark, sf_dir):
    whole = F.col("o_custkey").cast("string")
    grouped = text.group_digits((F.col("o_orderkey") * 1000 + 7).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        g.gold_number(F.concat(F.lit("so #### "), whole, F.lit("#### 9")), "vllm").alias("strict"),
        g.gold_number(F.concat(F.lit("x####\t"), grouped, F.lit("\n"))).alias("grouped"),
        g.gold_number(F.concat(F.lit("#### "), whole, F.lit(" apples"))).alias("wordy"),
    )


# Symbolic answers: seven completion forms of a fraction by part key.
SYMBOLIC_ROWS = r"""
    SELECT p_partkey AS idx, 'math' AS split, p_name AS instruction,
           'Thus ' || CASE WHEN p_partkey % 5 = 0 THEN '\fbox{' WHEN p_partkey % 5 = 1 THEN 'boxed{' ELSE '\boxed{' END
               || '\frac{' || p_size || '}{' || (p_partkey + 1) || '}}.' AS reference,
           'So. The answer is: ' || CASE p_partkey % 7
               WHEN 0 THEN '\frac{' || p_size || '}{' || (p_partkey + 1) || '}'
               WHEN 1 THEN '\dfrac{' || p_size || '}{' || (p_partkey + 1) || '}.'
               WHEN 2 THEN p_size || '/' || (p_partkey + 1) || '. '
               WHEN 3 THEN 'x = \left\tfrac{' || p_size || '}{' || (p_partkey + 1) || '}\right.' || chr(10) || 'Done.'
               WHEN 4 THEN ' ' || p_size || ' / ' || (p_partkey + 1) || '\%'
               WHEN 5 THEN p_size || '/n'
               ELSE '' END AS prediction_raw
    FROM part
"""


def _symbolic(spark, sf_dir):
    size, key, kind = F.col("p_size").cast("string"), (F.col("p_partkey") + 1).cast("string"), F.col("p_partkey") % 7
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    box = F.when(F.col("p_partkey") % 5 == 0, "\\fbox{").when(F.col("p_partkey") % 5 == 1, "boxed{").otherwise("\\boxed{")
    answer = (
        F.when(kind == 0, form("\\frac{", size, "}{", key, "}"))
        .when(kind == 1, form("\\dfrac{", size, "}{", key, "}."))
        .when(kind == 2, form(size, "/", key, ". "))
        .when(kind == 3, form("x = \\left\\tfrac{", size, "}{", key, "}\\right.\nDone."))
        .when(kind == 4, form(" ", size, " / ", key, "\\%"))
        .when(kind == 5, form(size, "/n"))
        .otherwise("")
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"),
        F.lit("math").alias("split"),
        F.col("p_name").alias("instruction"),
        form("Thus ", box, "\\frac{", size, "}{", key, "}}.").alias("reference"),
        form("So. The answer is: ", answer).alias("prediction_raw"),
    )


def _graded_symbolic(spark, sf_dir, profile, debug=False):
    rows = _symbolic(spark, sf_dir)
    items = rows.select("idx", "split", "instruction", "reference")
    return ops.grade(items, rows.select("idx", "split", "prediction_raw"), "symbolic", profile, debug)


def _sql_normal(column: str) -> str:
    """The normaliser on the forms above, as nested replacements."""
    out = column
    for old in (r"\left", r"\right", r"\%"):
        out = f"replace({out}, '{old}', '')"
    out = f"replace(replace({out}, 'tfrac', 'frac'), 'dfrac', 'frac')"
    out = f"regexp_replace({out}, '^x ?=', '')"
    out = f"replace({out}, ' ', '')"
    return f"regexp_replace({out}, '^(0|[1-9][0-9]*)/(0|[1-9][0-9]*)$', '\\\\frac{{\\1}}{{\\2}}')"


def _sql_symbolic(strict: bool) -> str:
    empty = "a" if strict else "nullif(a, '')"
    failed = "regexp_matches(answer, '^[0-9]+/n$')" if strict else "false"
    return rf"""
    WITH field AS (
        SELECT *, trim(split_part(string_split(prediction_raw, 'The answer is: ')[-1], '.' || chr(10), 1)) AS temp,
               nullif(regexp_extract(reference, '\\(?:boxed|fbox)\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}'), '') AS boxed
        FROM ({SYMBOLIC_ROWS})),
    cleaned AS (
        SELECT *, trim(regexp_replace(temp, '\.$', '')) AS a,
               CASE WHEN starts_with(boxed, '\boxed') THEN substr(boxed, 8, length(boxed) - 8) END AS expected_answer FROM field),
    answered AS (SELECT *, {empty} AS answer FROM cleaned),
    normal AS (
        SELECT *, {_sql_normal("answer")} AS na, {_sql_normal("expected_answer")} AS ne FROM answered)
    SELECT idx, split, instruction, reference, prediction_raw AS prediction, answer, expected_answer,
           coalesce(CASE WHEN {failed} THEN answer = expected_answer ELSE na = ne END, false) AS correct,
           boxed, na, ne, temp
    FROM normal
    """


SYMBOLIC_COLUMNS = "idx, split, instruction, reference, prediction, answer, expected_answer, correct"


@query("grade_symbolic", f"SELECT {SYMBOLIC_COLUMNS} FROM ({_sql_symbolic(False)})")
def grade_symbolic(spark, sf_dir):
    return _graded_symbolic(spark, sf_dir, "accelerate")


@query("grade_symbolic_strict", f"SELECT {SYMBOLIC_COLUMNS} FROM ({_sql_symbolic(True)})")
def grade_symbolic_strict(spark, sf_dir):
    return _graded_symbolic(spark, sf_dir, "vllm")


@query(
    "grade_symbolic_debug",
    f"""
    SELECT idx, 'math' AS task, boxed AS expected_boxed, expected_answer, ne AS expected_normalized,
           answer AS pred_answer, na AS pred_normalized, temp AS extracted_temp
    FROM ({_sql_symbolic(False)})
    """,
)
def grade_symbolic_debug(spark, sf_dir):
    out = _graded_symbolic(spark, sf_dir, "accelerate", debug=True)
    return out.select("idx", "judge.*").select(
        "idx", "task", "expected_boxed", "expected_answer", "expected_normalized", "pred_answer", "pred_normalized",
        "extraction.extracted_temp",
    )


@query(
    "latex_normal_forms",
    r"""
    SELECT p_partkey, CASE p_partkey % 6
        WHEN 0 THEN '\frac{' || (p_size % 10) || '}{' || (p_partkey % 10) || '}'
        WHEN 1 THEN '\sqrt{' || (p_size % 10) || '}' || p_partkey
        WHEN 2 THEN p_size || ''
        WHEN 3 THEN CASE WHEN p_size = 5 THEN '\frac{1}{2}' ELSE '0.' || p_size END
        WHEN 4 THEN '' || p_size
        ELSE '\frac{' || (p_size % 10) || '}{' || p_partkey || '}' END AS value
    FROM part
    """,
)
def latex_normal_forms(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    digit = lambda c: (c % 10).cast("string")
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    raw = (
        F.when(key % 6 == 0, form("\\frac", digit(size), digit(key)))
        .when(key % 6 == 1, form("\\sqrt", digit(size), key.cast("string")))
        .when(key % 6 == 2, form("k = ", size.cast("string"), "\\text{ cm}"))
        .when(key % 6 == 3, form(".", size.cast("string")))
        .when(key % 6 == 4, form("\\$", size.cast("string"), "^{\\circ}\\!"))
        .otherwise(form("\\dfrac", digit(size), "{", key.cast("string"), "}"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", g.normalise_latex(raw)["value"].alias("value"))


@query(
    "boxed_extract",
    r"""
    WITH t AS (
        SELECT p_partkey, CASE p_partkey % 4
            WHEN 0 THEN 'a \boxed{1} b \boxed{\frac{' || p_size || '}{x^{2}}} c}'
            WHEN 1 THEN '\fbox{' || p_name || '}'
            WHEN 2 THEN '\boxed{' || p_size
            ELSE p_name || ' \boxed{{' || p_size || '}}' END AS txt FROM part),
    b AS (
        SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE nullif(regexp_extract(txt,
            '.*(\\(?:boxed|fbox)\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})', 1), '') END AS boxed FROM t)
    SELECT p_partkey, boxed, CASE WHEN starts_with(boxed, '\boxed{') THEN substr(boxed, 8, length(boxed) - 8) END AS inside FROM b
    """,
)
def boxed_extract(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    txt = (
        F.when(kind == 0, form("a \\boxed{1} b \\boxed{\\frac{", size, "}{x^{2}}} c}"))
        .when(kind == 1, form("\\fbox{", F.col("p_name"), "}"))
        .when(kind == 2, form("\\boxed{", size))
        .otherwise(form(F.col("p_name"), " \\boxed{{", size, "}}"))
    )
    out = table(spark, sf_dir, "part").select("p_partkey", g.last_boxed(txt).alias("boxed"))
    return out.withColumn("inside", g.strip_boxed(F.col("boxed")))


@query(
    "boxed_tokens",
    r"""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL
        ELSE array_to_string(list_slice(string_split(p_name, ' '), 1, len(string_split(p_name, ' ')) - 1), ',') END AS before
    FROM part
    """,
)
def boxed_tokens(spark, sf_dir):
    words = F.split("p_name", " ")
    box = F.when(F.col("p_partkey") % 3 == 0, "none").otherwise("\\boxed")
    tokens = F.concat(words, F.array(box, F.lit("{1}")))
    rows = table(spark, sf_dir, "part").select("p_partkey", tokens.alias("tokens"))
    before = text.tokens_before_boxed(F.array_join("tokens", ""), F.col("tokens"))
    return rows.select("p_partkey", F.array_join(before, ",").alias("before"))


@query(
    "thousands",
    """
    SELECT o_orderkey, 'order ' || format('{:,}', o_orderkey) || ' of '
        || format('{:,}', o_custkey * 100003) || ' at ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.25x12' AS txt
    FROM orders
    """,
)
def thousands(spark, sf_dir):
    raw = F.concat(
        F.lit("order 000"), F.col("o_orderkey").cast("string"),
        F.lit(" of "), (F.col("o_custkey") * 100003).cast("string"),
        F.lit(" at "), F.floor("o_totalprice").cast("string"), F.lit(".25x12"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.group_digits(raw).alias("txt"))


def answer_with_length():
    """A predictor that answers every prompt with its length."""
    return lambda prompts: [f"The answer is: {len(p)}. Question: next" for p in prompts]


@query(
    "batch_predict",
    f"""
    SELECT conv_id, turn, 'The answer is: ' || (length(text) + {len(text.INSTRUCTION_HEAD) + len(text.INSTRUCTION_TAIL)}) || '. ' AS prediction
    FROM conversations
    """,
)
def batch_predict_answers(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.instruction_prompt(F.col("text")).alias("prompt")
    )
    out = batch_predict(asked, "prompt", answer_with_length, 128)
    return out.select("conv_id", "turn", text.cut_at_stop(F.col("prediction_raw")).alias("prediction"))
