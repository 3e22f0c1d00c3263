"""Corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.pii import PII_PATTERNS, contains_pii, redact_pii


def pii_report(df: DataFrame, col: str = "text", by: tuple[str, ...] = (), mode: str = "compat") -> DataFrame:
    """Documents, documents with personal data, and redactions per type, by group.

    The replace chain only runs on texts in which some pattern matches.
    """
    flagged = df.select(*by, F.col(col).alias("text"), contains_pii(F.col(col)).alias("has_pii"))
    counted = redact_pii(flagged.withColumn("text", F.when(F.col("has_pii"), F.col("text")).otherwise(F.lit(""))), "text", mode=mode)
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("has_pii").alias("documents_with_pii"),
        *[F.coalesce(F.sum(F.col("redactions")[kind]), F.lit(0)).alias(f"{kind}_count") for kind in PII_PATTERNS],
    )
