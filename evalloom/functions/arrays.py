"""Token-list, logit and scale functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: label of positions that carry no loss.
LABEL_MASK = -100


def append_special(ids: Column, eos: int | None = None, bos: int | None = None) -> Column:
    """End id appended unless it is already last (also on an empty list); start id put in front."""
    if eos is not None:
        last = F.try_element_at(ids, F.lit(-1))
        ids = F.when(last == eos, ids).otherwise(F.array_append(ids, F.lit(eos)))
    if bos is not None:
        ids = F.array_prepend(ids, F.lit(bos))
    return ids


def fit_pair(
    prompt: Column, target: Column, max_length: int | None, prompt_first: bool = True, from_end: bool = True
) -> Column:
    """Struct (prompt, target) cut to ``max_length`` tokens together.

    With ``prompt_first`` the front of the prompt goes first; what is still too
    long comes off the end (or the front) of the target.
    """
    if not max_length:
        return F.struct(prompt.alias("prompt"), target.alias("target"))
    over = F.greatest(F.size(prompt) + F.size(target) - max_length, F.lit(0))
    from_prompt = F.least(F.size(prompt), over) if prompt_first else F.lit(0)
    rest = over - from_prompt
    kept = F.greatest(F.size(target) - rest, F.lit(0))
    start = F.lit(1) if from_end else F.size(target) - kept + 1
    return F.struct(
        F.slice(prompt, from_prompt + 1, F.size(prompt) - from_prompt).alias("prompt"),
        F.slice(target, start, kept).alias("target"),
    )


def mask_labels(prompt: Column, target: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(LABEL_MASK), F.size(prompt)), target)


def fit_longest_first(first: Column, second: Column, budget: int) -> Column:
    """Struct (first, second) cut to ``budget`` tokens, always taking from the longer list, the second on ties."""
    n1, n2 = F.size(first), F.size(second)
    half_up, half_down = (budget + 1) // 2, budget // 2
    keep1 = F.when(n1 + n2 <= budget, n1).when(n2 <= half_down, budget - n2).otherwise(F.least(n1, F.lit(half_up)))
    keep2 = F.when(n1 + n2 <= budget, n2).otherwise(budget - keep1)
    return F.struct(F.slice(first, F.lit(1), keep1).alias("first"), F.slice(second, F.lit(1), keep2).alias("second"))


def fit_halves(first: Column, second: Column, n1: Column, n2: Column, budget: int) -> Column:
    """Struct (first, second) cut to ``budget`` tokens: the shorter list keeps half of them at most, the other the rest.

    ``n1`` and ``n2`` are the lists' full lengths, in case they come cut already. Of two equally long lists the first counts as shorter.
    """
    shorter = F.least(n1, n2, F.lit(budget // 2))
    keep1 = F.when(n1 + n2 <= budget, n1).when(n1 <= n2, shorter).otherwise(budget - shorter)
    keep2 = F.when(n1 + n2 <= budget, n2).when(n1 <= n2, budget - shorter).otherwise(shorter)
    return F.struct(F.slice(first, F.lit(1), keep1).alias("first"), F.slice(second, F.lit(1), keep2).alias("second"))


def pad_to(ids: Column, length: Column | int, value: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def ones_like(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def argmax(logits: Column) -> Column:
    """Position of the first maximum, counted from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def last_position(logits: Column) -> Column:
    """Logits of the last sequence position."""
    return F.element_at(logits, -1)


def above_zero(logit: Column) -> Column:
    return (logit > 0).cast("int")


def power_scale(ratio: Column, beta_pos: Column, beta_neg: Column, tau: float = 0.4, eps: float = 1e-12) -> Column:
    """Smooth factor that is 1 at ratio 1, near ``ratio^beta_pos`` above and ``ratio^beta_neg`` below."""
    x = F.ln(F.greatest(ratio, F.lit(eps)))
    mix = (F.lit(1.0) + F.tanh(x / tau)) / 2
    return F.exp((beta_neg + (beta_pos - beta_neg) * mix) * x)
