"""Pages to overlapping chunks with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.split import SEPARATORS, recursive_chunks, windows
from corpusmill.functions.text import chunk_id

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200


def _column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _explode(pages: DataFrame, chunks: Column, text_col: str) -> DataFrame:
    """One row per chunk; every other column of the page is kept."""
    parents = [F.col(f"`{c}`") for c in pages.columns if c != text_col]
    trimmed = F.transform(chunks, lambda c: F.trim(c))
    cut = pages.select(*parents, F.posexplode(trimmed).alias("chunk_index", "chunk_text")).filter(F.length("chunk_text") > 0)
    return cut.withColumn("chunk_length", F.length("chunk_text")).withColumn(
        "chunk_id",
        chunk_id(
            F.col("document_id"),
            _column_or_null(pages, "page_number", "int"),
            _column_or_null(pages, "section_number", "int"),
            F.col("chunk_index"),
        ),
    )


def chunk_pages(
    pages: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
    text_col: str = "text",
) -> DataFrame:
    """Separator-aware chunks. A narrow projection: rows stay in their partition, nothing is shuffled."""
    return _explode(pages, recursive_chunks(F.col(text_col), size, overlap, separators), text_col)


def chunk_fixed(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text_col: str = "text") -> DataFrame:
    """Fixed windows without regard to separators."""
    return _explode(pages, windows(F.col(text_col), size, overlap), text_col)
