"""Evaluate a column once and use it many times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A lambda variable stands for the value, so the expression stays small where
    plain nesting would repeat it at every use.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
