import random
import re

import pytest
from pyspark.sql import functions as F

from evalloom.functions import grading
from evalloom.operators.grade import accuracy, grade, invalid_outputs


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


NUMBERS = [
    ("The answer is: 42", 42.0, None),
    ("The answer is:42", None, None),
    ("The answer is: 4 The answer is: 5", 5.0, None),
    ("The answer is: $1,234.", 1234.0, None),
    ("The answer is: 1,234,567", 1234.0, None),
    ("The answer is: 2.5", 2.0, None),
    ("The answer is: 3.5", 4.0, None),
    ("The answer is: -.5", 0.0, None),
    ("The answer is: 3/4", 1.0, None),
    ("The answer is: -7/2", -4.0, None),
    ("The answer is: 7/0", 7.0, None),
    ("The answer is: 1/00", None, "zero_denominator"),
    ("The answer is: /5", None, "non_numeric_fraction"),
    ("The answer is: -/5", None, "non_numeric_fraction"),
    ("The answer is: none", None, None),
    ("The answer is: \u0663\u0664", 34.0, None),
    ("The answer is: " + "9" * 400, None, "inf"),
    ("", None, None),
    (None, None, None),
]


def test_extract_number(spark):
    got = column(spark, [n[0] for n in NUMBERS], grading.extract_number)
    assert [(g["value"], g["parse_error"]) for g in got] == [n[1:] for n in NUMBERS]
    assert got[1]["found_answer_prefix"] is False and got[2]["matched_token"] == "5"
    assert got[14]["answer_field"] == "none" and got[14]["matched_token"] is None


def test_gold_number(spark):
    refs = ["a #### 1,000", "a ####5", "a #### 5 apples", "no marker", "#### 1_000", "a\n#### -7\n", "", None]
    assert column(spark, refs, grading.gold_number) == [1000.0, 5.0, None, None, 1000.0, -7.0, None, None]
    strict = lambda c: grading.gold_number(c, "vllm")
    assert column(spark, ["a #### 1,000", "x #### 3 #### 4"], strict) == [1000.0, 3.0]
    for bad in ("a ####5", "a #### 5 apples", "no marker"):
        with pytest.raises(Exception, match="no integer"):
            column(spark, [bad], strict)


def test_boxed(spark):
    texts = [r"\boxed{1} then \boxed{\frac{1}{2}}", r"\fbox{3}", r"\boxed 5", r"\boxed{1", "no box", r"\boxed} {x}", None]
    assert column(spark, texts, grading.last_boxed) == [r"\boxed{\frac{1}{2}}", r"\fbox{3}", None, None, None, None, None]
    assert column(spark, texts, lambda c: grading.strip_boxed(grading.last_boxed(c)))[:3] == [r"\frac{1}{2}", None, None]


def boxed_by_hand(s):
    at = max(s.rfind("\\boxed"), -1)
    at = at if at >= 0 else s.rfind("\\fbox")
    depth = 0
    for i in range(at if at >= 0 else len(s), len(s)):
        depth += {"{": 1, "}": -1}.get(s[i], 0)
        if s[i] == "}" and depth == 0:
            return s[at : i + 1]
    return None


def test_boxed_random(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["\\boxed", "\\fbox", "{", "}", "a", "1", " "]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    assert column(spark, texts, grading.last_boxed) == [boxed_by_hand(t) for t in texts]


NORMAL = [
    (r"\dfrac12", r"\frac{1}{2}", False), (r"\frac1{72}", r"\frac{1}{72}", False), ("0.5", r"\frac{1}{2}", False),
    (".5", r"\frac{1}{2}", False), ("1/2", r"\frac{1}{2}", False), ("x = 3", "3", False), ("abc=3", "abc=3", False),
    (r"\sqrt3", r"\sqrt{3}", False), (r"90^\circ", "90", False), (r"50\%", "50", False), (r"5\text{ cm}", "5", False),
    (r"1\text{ a}\text{ b}", r"1\text{a}\text{b}", True), ("a/b", "a/b", True), (r"2\sqrt", r"2\sqrt", True),
    (r"\frac", r"\frac", True), (r"\frac1", r"\frac1", False), ("", "", False), ("01/2", "01/2", False),
]


def test_normalise(spark):
    texts = [n[0] for n in NORMAL]
    soft = column(spark, texts, grading.normalise_latex)
    assert [(s["value"], s["failed"]) for s in soft] == [(n[1], False) for n in NORMAL]
    hard = column(spark, texts, lambda c: grading.normalise_latex(c, "vllm"))
    assert [(h["value"], h["failed"]) for h in hard] == [(None if n[2] else n[1], n[2]) for n in NORMAL]
    assert column(spark, [None], grading.normalise_latex) == [None]


class Failed(Exception):
    pass


def normal_by_hand(s, strict):
    """Our own statement of the rules, one character at a time where the columns use patterns."""
    for old, new in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""),
                     ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        s = s.replace(old, new)
    units = s.count("\\text{ ")
    if units == 1:
        s = s.partition("\\text{ ")[0]
    elif units > 1 and strict:
        raise Failed
    s = s.replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if s[:1] == ".":
        s = "0" + s
    left, eq, right = s.partition("=")
    if eq and "=" not in right and len(left) <= 2:
        s = right
    out, i = "", 0
    while i < len(s):
        if s.startswith("\\sqrt", i):
            rest = s[i + 5 :]
            if rest == "" or rest.startswith("\\sqrt"):
                if strict:
                    raise Failed
                out, i = out + "\\sqrt", i + 5
            elif rest[0] == "{":
                out, i = out + "\\sqrt", i + 5
            else:
                out, i = out + "\\sqrt{" + rest[0] + "}", i + 6
        else:
            out, i = out + s[i], i + 1
    s = out.replace(" ", "")
    head, *pieces = re.split(r"\\frac", s)
    fixed = head
    for piece in pieces:
        if piece[:1] == "{":
            fixed += "\\frac" + piece
        elif piece == "" and strict:
            raise Failed
        elif len(piece) < 2:
            fixed = s
            break
        elif piece[1] == "{":
            fixed += "\\frac{" + piece[0] + "}" + piece[1:]
        else:
            fixed += "\\frac{" + piece[0] + "}{" + piece[1] + "}" + piece[2:]
    s = "\\frac{1}{2}" if fixed == "0.5" else fixed
    if s.count("/") == 1:
        a, b = s.split("/")
        try:
            if s == f"{int(a)}/{int(b)}":
                return f"\\frac{{{int(a)}}}{{{int(b)}}}"
        except ValueError:
            if strict:
                raise Failed
    return s


def test_normalise_random(spark):
    rng = random.Random(5)
    parts = ["\\frac", "\\sqrt", "{", "}", "1", "2", "a", "/", " ", ".", "=", "\\text{ ", "\\left", "\\$", "\\%", "x", "-", "0", "\\", "^\\circ", "\n", "\\dfrac", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    for profile in grading.PROFILES:
        got = column(spark, texts, lambda c: grading.normalise_latex(c, profile))
        for text, g in zip(texts, got):
            try:
                want = (normal_by_hand(text, profile == "vllm"), False)
            except Failed:
                want = (None, True)
            assert (g["value"], g["failed"]) == want, repr(text)


def test_symbolic_and_equivalence(spark):
    texts = ["The answer is: x. The answer is: \\frac{1}{2}.\nmore", "The answer is:  5. ", "The answer is: ", "none", None]
    assert column(spark, texts, grading.extract_symbolic) == ["\\frac{1}{2}", "5", None, None, None]
    assert column(spark, texts, lambda c: grading.extract_symbolic(c, "vllm")) == ["\\frac{1}{2}", "5", "", None, None]
    pairs = spark.createDataFrame(
        [(0, None, None), (1, "1", None), (2, "1/2", "0.5"), (3, "a/b", "a / b"), (4, "a/b", "a/b")], "i int, a string, b string"
    )
    for profile, want in (("accelerate", [True, False, True, True, True]), ("vllm", [True, False, True, False, True])):
        out = pairs.select("i", grading.equivalent(F.col("a"), F.col("b"), profile).alias("e")).orderBy("i").collect()
        assert [r["e"] for r in out] == want


def test_grade_end_to_end(spark):
    items = spark.createDataFrame(
        [(0, "gsm8k", "q", "x #### 5"), (1, "gsm8k", "q", "#### 1,000"), (2, "gsm8k", "q", "none")],
        "idx long, split string, instruction string, reference string",
    )
    done = spark.createDataFrame(
        [(0, "gsm8k", "The answer is: 5 Question: The answer is: 6"), (1, "gsm8k", "The answer is: 10"), (2, "gsm8k", None)],
        "idx long, split string, prediction_raw string",
    )
    graded = grade(items, done, "numeric", debug=True).orderBy("idx").collect()
    assert [r["correct"] for r in graded] == [True, False, False]
    assert graded[0]["prediction"] == "The answer is: 5 " and graded[0]["expected_answer"] == "5"
    assert graded[1]["judge"]["expected_raw"] == "1,000" and graded[1]["judge"]["extraction"]["matched_token"] == "10"
    plain = grade(items, done, "numeric")
    assert [tuple(r) for r in accuracy(plain).collect()] == [("gsm8k", pytest.approx(1 / 3), 3)]
    assert [r["idx"] for r in invalid_outputs(plain).collect()] == [2]
    assert accuracy(plain.filter("idx > 9"), []).collect()[0]["accuracy"] == 0.0
    maths = items.withColumn("reference", F.lit("so \\boxed{\\frac{1}{2}}"))
    answers = done.withColumn("prediction_raw", F.element_at(F.array(F.lit("The answer is: 0.5"), F.lit("The answer is: 1/3"), F.lit("?")), (F.col("idx") + 1).cast("int")))
    out = grade(maths, answers, "symbolic", debug=True).orderBy("idx").collect()
    assert [r["correct"] for r in out] == [True, False, False]
    assert out[0]["judge"]["pred_normalized"] == "\\frac{1}{2}" == out[0]["judge"]["expected_normalized"]
    with pytest.raises(ValueError):
        grade(items, done, "other")
