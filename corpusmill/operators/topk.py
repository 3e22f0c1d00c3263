"""Ranking shared by the retrieval operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 6
MAX_TOP_K = 20
DEFAULT_TOP_K = 5


def check_k(k: int, upper: int | None = None) -> int:
    if k < 1 or (upper is not None and k > upper):
        raise ValueError(f"k must be in 1..{upper or 'n'}, got {k}")
    return k


def top_k(df: DataFrame, by: str, score: Column, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group, numbered from 1.

    ``row_number() <= k`` makes Spark keep only k rows per group and task before
    the shuffle, so a group never travels whole.
    """
    w = Window.partitionBy(by).orderBy(score.desc(), F.col(tie).asc())
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
