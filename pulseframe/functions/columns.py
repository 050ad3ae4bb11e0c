"""Small helpers to build column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluated_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that ``use`` may mention it repeatedly."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rows_where(value: Column, keep: Callable[[Column], Column]) -> Column:
    """Generator that gives ``value`` where ``keep`` holds and no row elsewhere.

    A filter on a computed column is pushed below its projection, which then
    computes the value twice; a parsed message is worth computing once.
    """
    return F.explode(F.filter(F.array(value), keep))


def has_items(value: Column) -> Column:
    """True for an array with at least one item."""
    return F.size(value) > 0
