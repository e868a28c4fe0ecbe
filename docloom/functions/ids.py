"""Ids on their way through Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def carried(c: Column, kind: str) -> Column:
    """An id for a batch: integers as strings, since beside nulls a batch would hold them as inexact floats."""
    return c.cast("string") if kind in _INTEGRAL else c


def carried_type(kind: str) -> str:
    return "string" if kind in _INTEGRAL else kind
