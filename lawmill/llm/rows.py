"""Carrying the other columns of a row through an operator, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "_rest"


def pack(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, so that no name can clash."""
    others = [c for c in df.columns if c not in needed]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias(REST)] if others else []
    return df.select(*needed, *rest)


def unpack(packed: DataFrame, columns: list[str], *needed: str, **added: Column) -> DataFrame:
    """The columns in their first order, ``added`` ones put in place or behind."""
    kept = [added.get(c, F.col(c) if c in needed else F.col(f"{REST}.`{c}`")).alias(c) for c in columns]
    return packed.select(*kept, *(v.alias(k) for k, v in added.items() if k not in columns))
