"""Helpers for building expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column that only a lambda refers to gets inlined into it and is then computed per element.
    Bound as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]
