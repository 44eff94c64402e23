"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character a Python ``str.strip()`` removes. Spark's own ``trim`` removes only spaces.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_ws(text: Column) -> Column:
    """Trim all Unicode white space on both sides."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Columns are trees, so a chain of steps that each mention their input three
    times would grow as 3^n; a one-element ``transform`` keeps it linear.
    """
    return F.transform(F.array(value), body).getItem(0)
