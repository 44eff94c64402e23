"""Cell and path formats of the result tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evalloom.functions.core import or_empty

RESULT_FILE = "eval_results.csv"


def _python_format(spec: str):
    """Python number formatting. Java rounds halves of the shortest decimal, Python the exact binary value."""

    @F.pandas_udf(StringType())
    def formatted(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else format(v, spec))

    return formatted


_ten_digits, _five_places, _one_digit = (_python_format(spec) for spec in (".10g", ".5f", ".0e"))


def format_10g(value: Column) -> Column:
    """Ten significant digits without trailing zeros. Like the two below for small tables at sinks only."""
    return _ten_digits(value.cast("double"))


def format_5f(value: Column) -> Column:
    return _five_places(value.cast("double"))


def format_0e(value: Column) -> Column:
    """One significant digit in scientific form, ``4e-04``."""
    return _one_digit(value.cast("double"))


def init_label(value: Column) -> Column:
    """Name of an initialisation: null is empty, any spelling of true is ``kaiming``."""
    text = value.cast("string")
    return F.when(F.lower(text) == "true", F.lit("kaiming")).otherwise(or_empty(text))


def cell_json(value: Column) -> Column:
    """List cell as JSON text, ``["a", "b"]``."""

    def item(v: Column) -> Column:
        wrapped = F.to_json(F.array(v))
        return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)

    inside = F.array_join(F.transform(value, item), ", ")
    return F.when(value.isNotNull(), F.concat(F.lit("["), inside, F.lit("]")))


def record_json(value: Column) -> Column:
    """Map or struct cell as JSON text."""
    return F.to_json(value)


def resolve_output_path(path: Column, file_name: str = RESULT_FILE) -> Column:
    """No path gives the current folder, a path with an extension its folder, other paths themselves."""
    tail = F.substring_index(path, "/", -1)
    # An extension is a dot with something other than leading dots in front of it.
    has_ext = F.rlike(tail, F.lit(r"\A\.*[^.].*\.[^.]*\z"))
    parent = F.regexp_extract(path, r"\A(.*?)/*[^/]*\z", 1)
    root = F.when(F.startswith(path, F.lit("/")), "/").otherwise(".")
    folder = F.when(has_ext, F.when(parent == "", root).otherwise(parent)).otherwise(path)
    base = F.when(or_empty(path) == "", ".").otherwise(folder)
    return F.concat(base, F.when(F.endswith(base, F.lit("/")), "").otherwise("/"), F.lit(file_name))
