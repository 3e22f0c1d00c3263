"""Manifest and registry of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.schemas import MANIFEST, REGISTRY
from corpusmill.sources.files import path_exists, read_json


def read_manifest(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Manifest records of either form. A missing path means there is no history: no rows.

    Whether a file is one JSON array or JSON lines is seen in the file; ``multi_line`` says it for all files.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return read_json(spark, path, MANIFEST, multi_line)


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    df.write.mode("overwrite").json(path)


# How official documents are named and where they are published.
OFFICIAL_SOURCE_SYSTEM = "EUR-Lex"
OFFICIAL_URL = "https://eur-lex.europa.eu/legal-content/EN/TXT/PDF/?uri=CELEX:"


def corpus_registry(official: DataFrame, web: DataFrame) -> DataFrame:
    """One registry from official documents (celex, short_title, category) and complete web entries."""
    celex = F.col("celex")
    expanded = official.select(
        celex.alias("document_id"),
        "celex",
        "short_title",
        F.lit(None).cast("string").alias("title"),
        "category",
        F.lit(OFFICIAL_SOURCE_SYSTEM).alias("source_system"),
        F.concat(F.lit(OFFICIAL_URL), celex).alias("source_url"),
        F.lit("pdf").alias("file_format"),
        F.concat(celex, F.lit("_EN_"), F.col("short_title"), F.lit(".pdf")).alias("file_name"),
    )
    return expanded.unionByName(web, allowMissingColumns=True).select(*REGISTRY.names)
