"""Column helpers that the other functions build on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def no_strings() -> Column:
    return F.filter(F.array(F.lit("")), lambda x: x != "")
