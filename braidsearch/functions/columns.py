"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Higher-order functions re-evaluate a captured expression for every element;
    binding it as a lambda variable keeps row-local work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def run_starts(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """0-based positions at which a new run of equal elements begins in a sorted array."""
    last = F.size(ordered) - 1
    positions = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        positions, lambda i: (i == 0) | ~same(F.get(ordered, i), F.get(ordered, i - 1))
    )
