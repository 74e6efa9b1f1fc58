"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, where it would else be computed again for every element of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bind_list(value: Column, use: Callable[[Column], Column]) -> Column:
    """:func:`bind` where ``use`` gives an array."""
    return F.flatten(F.transform(F.array(value), use))
