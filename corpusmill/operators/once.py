"""Columns that are costly to compute and must be computed once.

The optimizer moves a filter below the projection that defines its column and
copies the definition into it, so a costly column with a filter on it runs
twice, possibly before the rows were spread. A generator with one element is
not looked through: what it yields is an ordinary column afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _others(df: DataFrame, dropped: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c not in dropped]


def with_once(df: DataFrame, name: str, value: Column, drop: Sequence[str] = ()) -> DataFrame:
    """Add one computed column."""
    return df.select(*_others(df, [name, *drop]), F.explode(F.array(value)).alias(name))


def with_text_once(df: DataFrame, name: str, value: Column, drop: Sequence[str] = ()) -> DataFrame:
    """Add one computed text column and leave out the rows where it is null or empty."""
    return df.select(*_others(df, [name, *drop]), F.explode(F.filter(F.array(value), lambda t: t != "")).alias(name))
