"""Prompt, stop-string, number and name text functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.core import bind, or_empty, strip_ws

# --- Fixed values: prompt texts, to be reproduced to the letter -------------------------------------------

PROMPT_TEMPLATES: dict[str, str] = {
    "GSM_AnsAug": "You are a careful math solver.\n"
    "Solve the following word problem step by step.\n"
    "Write the final numeric answer on the last line in the format:\n#### <answer>\n\nProblem:\n{query}\n",
    "MATH_AnsAug": "You are a careful math solver.\n"
    "Solve the following math problem step by step.\n"
    "If the answer should be in terms of symbols (e.g., pi), keep exact form.\n"
    "Write the final answer on the last line.\n\nProblem:\n{query}\n",
    "GSM_Rephrased": "You are a careful math solver.\n"
    "The problem may be rephrased but is mathematically equivalent to a standard question.\n"
    "Solve step by step and output the final answer as:\n#### <answer>\n\nProblem:\n{query}\n",
    "MATH_Rephrased": "You are a careful math solver.\n"
    "The problem may be rephrased but is mathematically equivalent to a standard question.\n"
    "Solve step by step and give the final answer on the last line.\n\nProblem:\n{query}\n",
    "GSM_SV": "You are a careful math solver.\n"
    "Solve for the unknown variable specified in the problem.\n"
    "Show algebraic steps briefly and output the value as:\n#### <answer>\n\nProblem:\n{query}\n",
    "MATH_SV": "You are a careful math solver.\n"
    "Solve for the unknown variable specified in the problem.\n"
    "Show algebraic steps briefly and write the final value on the last line.\n\nProblem:\n{query}\n",
    "GSM_FOBAR": "You are a careful math solver.\n"
    "This is a backward reasoning problem: the final answer to an original version is given.\n"
    "Use that given answer as a constraint to infer the unknown variable.\n"
    "Show key steps and output the inferred value as:\n#### <answer>\n\nProblem:\n{query}\n",
    "MATH_FOBAR": "You are a careful math solver.\n"
    "This is a backward reasoning problem: the final answer to an original version is given.\n"
    "Use that given answer as a constraint to infer the unknown variable.\n"
    "Show key steps and write the inferred value on the last line.\n\nProblem:\n{query}\n",
}
DEFAULT_TEMPLATE = (
    "You are a careful math solver.\n"
    "Solve the problem step by step and provide the final answer on the last line.\n\nProblem:\n{query}\n"
)
INSTRUCTION_HEAD = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n### Instruction:\n"
)
INSTRUCTION_TAIL = "\n\n### Response: Let's think step by step."
CLASSIC_HEAD = (
    "\n        Below is an instruction that describes a task, paired with an input that provides further context. "
    "\n        Write a response that appropriately completes the request.\n\n\n        ### Instruction:\n"
)
CLASSIC_TAIL = "\n\n### Response:\n    "
MATH_DATASET = "meta-math/MetaMathQA"
MATH_STYLE = "metamath"
STOP_STRINGS = (
    "Question:", "Question", "USER:", "USER", "ASSISTANT:",
    "ASSISTANT", "Instruction:", "Instruction", "Response:", "Response",
)

# --- prompts ----------------------------------------------------------------------------------------------


def template_for(kind: Column, templates: dict[str, str] = PROMPT_TEMPLATES, default: str = DEFAULT_TEMPLATE) -> Column:
    """Prompt template of a row type; unknown and null types take the default."""
    pairs = [F.lit(part) for item in templates.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), or_empty(kind)), F.lit(default))


def render_prompt(template: Column, query: Column, strip: bool = True) -> Column:
    """Put the query in place of ``{query}``; braces inside the query stay as they are."""
    text = F.replace(template, F.lit("{query}"), or_empty(query))
    return strip_ws(text) if strip else text


def instruction_prompt(instruction: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION_HEAD), or_empty(instruction), F.lit(INSTRUCTION_TAIL))


def classic_prompt(query: Column) -> Column:
    return F.concat(F.lit(CLASSIC_HEAD), or_empty(query), F.lit(CLASSIC_TAIL))


def fill_template(template: Column, value: Column, names: Sequence[str] = ("instruction", "query")) -> Column:
    """Bind every named placeholder to one value, ``{{`` and ``}}`` meaning plain braces.

    The template is cut at the placeholders and joined with the value, so text
    that looks like a placeholder inside the value is left alone.
    """
    marked = F.regexp_replace(F.replace(template, F.lit("{{"), F.lit("\x01")), r"\}\}(?!\})", "\x02")
    pieces = F.split(marked, r"\{(?:" + "|".join(map(re.escape, names)) + r")\}", -1)
    plain = F.transform(
        pieces, lambda p: F.replace(F.replace(p, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))
    )
    return F.call_function("array_join", plain, value)


def choose_prompt(
    instruction: Column, infer_t: Column, eval_t: Column, style: Column, dataset: Column, prompt_t: Column
) -> Column:
    """Prompt by precedence: inference or evaluation template, math prompt, training template, raw text.

    Blank templates count as absent.
    """
    explicit = F.coalesce(F.nullif(infer_t, F.lit("")), F.nullif(eval_t, F.lit("")))
    is_math = (strip_ws(F.lower(or_empty(style))) == MATH_STYLE) | (or_empty(dataset) == MATH_DATASET)
    training = F.nullif(prompt_t, F.lit(""))
    return (
        F.when(explicit.isNotNull(), fill_template(explicit, instruction))
        .when(is_math, instruction_prompt(instruction))
        .when(training.isNotNull(), fill_template(training, instruction))
        .otherwise(instruction)
    )


def cut_at_stop(text: Column, stops: Sequence[str] = STOP_STRINGS) -> Column:
    """Text before the earliest stop string; null gives an empty string."""
    if not stops:
        return or_empty(text)
    # A stop that begins with another one can never be reached first.
    heads = [s for s in dict.fromkeys(stops) if not any(s != o and s.startswith(o) for o in stops)]
    return F.split(or_empty(text), "|".join(r"\Q" + s + r"\E" for s in heads), 2).getItem(0)


# --- numbers and tokens -----------------------------------------------------------------------------------


def group_digits(text: Column) -> Column:
    """Thousands separators in every run of more than three digits, leading zeros of such a run dropped."""
    no_zeros = F.regexp_replace(text, r"(?<![0-9])(?=[0-9]{4})0+(?=[0-9])", "")
    return F.regexp_replace(no_zeros, r"(?<=[0-9])(?=([0-9]{3})+(?![0-9]))", ",")


def tokens_before_boxed(text: Column, tokens: Column) -> Column:
    r"""Leading tokens up to the first ``\boxed`` (or ``\fbox``), by added token length."""
    at = F.when(F.contains(text, F.lit("\\boxed")), F.instr(text, "\\boxed")).when(
        F.contains(text, F.lit("\\fbox")), F.instr(text, "\\fbox")
    )

    def count(start: Column) -> Column:
        # Tokens whose running length stays short of the start come before the box; without any
        # token reaching it, the last one is still dropped.
        walked = F.aggregate(
            tokens,
            F.struct(F.lit(0).alias("length"), F.lit(0).alias("taken"), F.lit(False).alias("done")),
            lambda s, t: F.when(s["done"], s).otherwise(
                F.struct(
                    (s["length"] + F.length(t)).alias("length"),
                    F.when(s["length"] + F.length(t) >= start - 1, s["taken"]).otherwise(s["taken"] + 1).alias("taken"),
                    (s["length"] + F.length(t) >= start - 1).alias("done"),
                )
            ),
        )
        return bind(walked, lambda w: F.when(w["done"], w["taken"]).otherwise(F.greatest(w["taken"] - 1, F.lit(0))))

    return F.when(at.isNotNull(), F.slice(tokens, F.lit(1), count(at)))


# --- names ------------------------------------------------------------------------------------------------


def last_segment(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def path_safe(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("-"))


def int_list(text: Column) -> Column:
    """``"1, 2,,3"`` to ``[1, 2, 3]``; a part that is no integer is an error."""
    return F.transform(
        F.filter(F.transform(F.split(text, ","), strip_ws), lambda p: p != ""), lambda p: p.cast("int")
    )
