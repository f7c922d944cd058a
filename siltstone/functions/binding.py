"""Evaluate an expression once, whatever number of times it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once for each row.

    Branches of a CASE are no common subexpressions for the optimiser, so an expensive value
    that several of them read would be computed in each; a lambda variable is computed once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
