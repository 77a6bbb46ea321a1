"""Whole rows through a join or a projection, whatever their columns are called."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of exactly this name: dots and backticks in it mean nothing."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(columns: Iterable[str]) -> Column:
    """The columns as one struct ``row``, to be unpacked by ``row.*``."""
    return F.struct(*(named(c) for c in columns)).alias("row")
