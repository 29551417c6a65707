"""Helpers for long column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """The same for several values, as fields of a struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)
