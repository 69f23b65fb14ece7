"""Small helpers for building larger column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    An expression named several times inside a lambda would otherwise be worked
    out again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(mapping: Mapping[str, object], key: Column) -> Column:
    """Value of a small literal map, null where the key is unknown or null."""
    if not mapping:
        return F.lit(None)
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
