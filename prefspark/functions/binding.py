"""Evaluate once inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda of ``transform``/``aggregate`` re-evaluates every outer expression
    it mentions for each element; a bound value is a plain variable there.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
