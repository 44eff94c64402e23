r"""Answer extraction, LaTeX normalisation and equivalence.

Two profiles differ at the edges: ``accelerate`` (lenient, the default) and
``vllm`` (strict: a failed normalisation falls back to comparing raw text).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.core import bind, or_empty, strip_ws

# The answer marker, the gold marker and the box commands.
ANSWER_MARKER = "The answer is: "
GOLD_MARKER = "####"
BOXED = "\\boxed"
FBOX = "\\fbox"
PROFILES = ("accelerate", "vllm")

NUMBER_PATTERN = r"(?U)[\-+]?\d*[.,/]?\d+"
INTEGER_PATTERN = r"(?U)\A\s*[+-]?\d+(?:_\d+)*\s*\z"


def check_profile(profile: str) -> None:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known: {', '.join(PROFILES)}")


@cache
def _digit_tables() -> tuple[str, str]:
    digits = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.digit(d)) for d in digits)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9; plain ASCII text is passed through."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *_digit_tables()))


def _as_double(text: Column) -> Column:
    plain = F.translate(text, ",_", "")
    return bind(plain, lambda t: ascii_digits(t).try_cast("double"))


def _rounded(value: Column) -> Column:
    # Adding zero turns -0.0 into 0.0.
    return F.rint(value) + F.lit(0.0)


# --- numeric answers --------------------------------------------------------------------------------------


def extract_number(text: Column) -> Column:
    """Struct (value, found_answer_prefix, answer_field, matched_token, parse_error) of a completion."""

    def judge(field: Column, token: Column) -> Column:
        def number(num: Column, den: Column, whole: Column) -> Column:
            slash = F.contains(token, F.lit("/"))
            error = (
                F.when(token.isNull(), F.lit(None))
                .when(slash & ~F.rlike(F.substring_index(token, "/", 1), F.lit(r"(?U)\d")), "non_numeric_fraction")
                .when(slash & (F.substring_index(token, "/", -1) != "0") & (den == 0.0), "zero_denominator")
                .when(~slash & (F.abs(whole) == float("inf")), "inf")
            )
            value = (
                F.when(~slash, whole)
                .when(F.substring_index(token, "/", -1) == "0", num)
                .otherwise(F.try_divide(num, den))
            )
            return F.struct(
                F.when(token.isNotNull() & error.isNull(), _rounded(value)).alias("value"),
                field.isNotNull().alias("found_answer_prefix"),
                field.alias("answer_field"),
                token.alias("matched_token"),
                error.cast("string").alias("parse_error"),
            )

        parts = F.struct(
            _as_double(F.substring_index(token, "/", 1)).alias("num"),
            _as_double(F.substring_index(token, "/", -1)).alias("den"),
            _as_double(token).alias("whole"),
        )
        return bind(parts, lambda p: number(p["num"], p["den"], p["whole"]))

    field = F.when(F.contains(text, F.lit(ANSWER_MARKER)), strip_ws(F.substring_index(text, ANSWER_MARKER, -1)))
    matched = bind(
        field,
        lambda f: F.struct(f.alias("field"), F.nullif(F.regexp_extract(f, NUMBER_PATTERN, 0), F.lit("")).alias("token")),
    )
    return bind(matched, lambda m: judge(m["field"], m["token"]))


def gold_text(reference: Column) -> Column:
    """Raw gold text after the first gold marker."""
    return F.when(
        F.contains(reference, F.lit(GOLD_MARKER)),
        strip_ws(F.substr(reference, F.instr(reference, GOLD_MARKER) + len(GOLD_MARKER))),
    )


def _integer(text: Column) -> Column:
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(F.rlike(plain, F.lit(INTEGER_PATTERN)), _as_double(strip_ws(plain)))


def gold_number(reference: Column, profile: str = "accelerate") -> Column:
    """Numeric gold answer; ``vllm`` fails the job where there is none."""
    check_profile(profile)
    if profile == "accelerate":
        return bind(gold_text(reference), _integer)
    marker = GOLD_MARKER + " "
    after = F.when(
        F.contains(reference, F.lit(marker)),
        F.substring_index(F.substr(reference, F.instr(reference, marker) + len(marker)), marker, 1),
    )
    return bind(
        after,
        lambda t: F.coalesce(
            bind(t, _integer),
            F.raise_error(F.concat(F.lit("no integer after '#### ' in: "), or_empty(reference))).cast("double"),
        ),
    )


# --- boxed answers ----------------------------------------------------------------------------------------


def last_boxed(text: Column) -> Column:
    r"""Last ``\boxed…`` expression (else last ``\fbox…``) with balanced braces, or null."""

    def closed(tail: Column) -> Column:
        # One step per closing brace: the box ends at the first one that brings the depth to zero.
        pieces = F.split(tail, r"\}", -1)
        opened = lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))
        walked = F.aggregate(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1),
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(False).alias("done")),
            lambda s, p: F.when(s["done"], s).otherwise(
                F.struct(
                    (s["depth"] + opened(p) - 1).alias("depth"),
                    (s["seen"] + 1).alias("seen"),
                    (s["depth"] + opened(p) - 1 == 0).alias("done"),
                )
            ),
        )
        return bind(
            walked,
            lambda w: F.when(
                w["done"], F.concat(F.array_join(F.slice(pieces, F.lit(1), w["seen"]), "}"), F.lit("}"))
            ),
        )

    def tail(t: Column) -> Column:
        return (
            F.when(F.contains(t, F.lit(BOXED)), F.concat(F.lit(BOXED), F.substring_index(t, BOXED, -1)))
            .when(F.contains(t, F.lit(FBOX)), F.concat(F.lit(FBOX), F.substring_index(t, FBOX, -1)))
        )

    return bind(bind(text, tail), closed)


def strip_boxed(text: Column) -> Column:
    r"""Inside of ``\boxed{…}``; anything else is null."""
    left = BOXED + "{"
    return F.when(
        F.startswith(text, F.lit(left)) & F.endswith(text, F.lit("}")) & (F.length(text) > len(left)),
        F.substr(text, F.lit(len(left) + 1), F.length(text) - len(left) - 1),
    )


def symbolic_parts(text: Column) -> Column:
    """Struct (answer_field, extracted_temp, extracted) of a completion, null without the marker."""
    field = F.when(F.contains(text, F.lit(ANSWER_MARKER)), F.substring_index(text, ANSWER_MARKER, -1))
    temp = bind(
        field,
        lambda f: F.struct(f.alias("field"), strip_ws(F.substring_index(f, ".\n", 1)).alias("temp")),
    )
    return bind(
        temp,
        lambda t: F.when(
            t["field"].isNotNull(),
            F.struct(
                t["field"].alias("answer_field"),
                t["temp"].alias("extracted_temp"),
                F.regexp_replace(t["temp"], r"\.\z", "").alias("extracted"),
            ),
        ),
    )


def extract_symbolic(text: Column, profile: str = "accelerate") -> Column:
    """Symbolic prediction; an empty one is null (accelerate) or stays empty (vllm)."""
    check_profile(profile)
    answer = strip_ws(symbolic_parts(text)["extracted"])
    return F.nullif(answer, F.lit("")) if profile == "accelerate" else answer


# --- LaTeX normaliser -------------------------------------------------------------------------------------

# Plain replacements in their required order, before and after the unit is cut.
BEFORE_UNIT = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"),
    ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)
AFTER_UNIT = (("\\%", ""), (" .", " 0."), ("{.", "{0."))
UNIT = "\\text{ "

# A root or fraction command with nothing behind it; a fraction with at most one character behind it.
BARE_ROOT = r"\\sqrt(?=\\sqrt|\z)"
SHORT_FRACTION = r"\\frac((?:(?!\{)(?s:.))?)(?=\\frac|\z)"
CANONICAL_QUOTIENT = r"\A(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z"
INTEGER_QUOTIENT = r"(?U)\A\s*[+-]?\d+(?:_\d+)*\s*/\s*[+-]?\d+(?:_\d+)*\s*\z"


def _replace_all(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _count(text: Column, part: str) -> Column:
    return F.try_divide(F.length(text) - F.length(F.replace(text, F.lit(part), F.lit(""))), F.lit(len(part)))


def _cut_unit(text: Column) -> Column:
    return bind(text, lambda t: F.when(_count(t, UNIT) == 1, F.substring_index(t, UNIT, 1)).otherwise(t))


def _drop_left_side(text: Column) -> Column:
    return bind(
        text,
        lambda t: F.when(
            (_count(t, "=") == 1) & (F.length(F.substring_index(t, "=", 1)) <= 2), F.substring_index(t, "=", -1)
        ).otherwise(t),
    )


def _brace_roots(text: Column) -> Column:
    return F.regexp_replace(text, r"\\sqrt(?!\\sqrt)([^{])", r"\\sqrt{$1}")


def _brace_fractions(text: Column) -> Column:
    def fixed(t: Column) -> Column:
        two = F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
        return F.regexp_replace(two, r"\\frac([^{])(?=\{)", r"\\frac{$1}")

    return bind(text, lambda t: F.when(F.rlike(t, F.lit(SHORT_FRACTION)), t).otherwise(fixed(t)))


def normalise_latex(text: Column, profile: str = "accelerate") -> Column:
    """Struct (value, failed). Under ``accelerate`` it never fails."""
    check_profile(profile)

    def last_steps(rooted: Column) -> Column:
        half = bind(_brace_fractions(rooted), lambda t: F.when(t == "0.5", F.lit("\\frac{1}{2}")).otherwise(t))
        return half

    def quotient(t: Column) -> Column:
        return F.regexp_replace(t, CANONICAL_QUOTIENT, r"\\frac{$1}{$2}")

    def pointed(unit_cut: Column) -> Column:
        return _drop_left_side(F.regexp_replace(_replace_all(unit_cut, AFTER_UNIT), r"\A\.", "0."))

    strict = profile == "vllm"
    start = _replace_all(text, BEFORE_UNIT)

    def finish(raw: Column) -> Column:
        def ended(sided: Column) -> Column:
            spaceless = F.replace(_brace_roots(sided), F.lit(" "), F.lit(""))

            def closed(rooted: Column) -> Column:
                def result(t: Column) -> Column:
                    failed = F.lit(False)
                    if strict:
                        short = F.rlike(rooted, F.lit(SHORT_FRACTION)) & (
                            F.regexp_extract(rooted, SHORT_FRACTION, 1) == ""
                        )
                        slash = (_count(t, "/") == 1) & ~F.rlike(t, F.lit(INTEGER_QUOTIENT))
                        failed = (_count(raw, UNIT) > 1) | F.rlike(sided, F.lit(BARE_ROOT)) | short | slash
                    return F.struct(F.when(~failed, quotient(t)).alias("value"), failed.alias("failed"))

                return bind(last_steps(rooted), result)

            return bind(spaceless, closed)

        return bind(pointed(_cut_unit(raw)), ended)

    return F.when(text.isNotNull(), bind(start, finish))


def equivalent(a: Column, b: Column, profile: str = "accelerate") -> Column:
    """Same answer after normalising; two nulls agree, one null does not."""
    both = F.struct(
        a.alias("a"),
        b.alias("b"),
        normalise_latex(a, profile).alias("na"),
        normalise_latex(b, profile).alias("nb"),
    )
    return bind(
        both,
        lambda s: F.when(s["a"].isNull() & s["b"].isNull(), True)
        .when(s["a"].isNull() | s["b"].isNull(), False)
        .when(s["na"]["failed"] | s["nb"]["failed"], s["a"] == s["b"])
        .otherwise(s["na"]["value"] == s["nb"]["value"]),
    )
