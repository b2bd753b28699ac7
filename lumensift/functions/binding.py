"""Binding of an expression's value, for expressions that use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and hand it to body."""
    return F.element_at(F.transform(F.array(value), body), 1)
