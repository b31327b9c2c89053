"""Naming a value inside an expression, so that it is evaluated once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """As let, with several values as the fields of one struct."""
    return let(F.struct(*(v.alias(k) for k, v in values.items())), body)
