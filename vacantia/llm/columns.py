"""Whole rows as one column, so that an input's column names can't clash with an operator's own."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrapped(docs: DataFrame, *own: Column) -> DataFrame:
    """The ``own`` columns and the row."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(*own, row.alias("_row"))


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(columns)])
