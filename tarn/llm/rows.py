"""Columns that pass through an Arrow function under names of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def passing(keep: Sequence[str]) -> list[Column]:
    """The columns named in keep as k0, k1, ...; no name of the input can clash with another's."""
    return [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]


def schema(table: DataFrame, keep: Sequence[str], more: str) -> StructType:
    """k0, k1, ... with the types of the table's columns, then the columns of ``more`` (DDL)."""
    return StructType([*(StructField(f"k{i}", table.schema[c].dataType) for i, c in enumerate(keep)), *StructType.fromDDL(more).fields])
