"""Index rows: projection, eligibility, de-duplication, upsert, filters, samples, facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import preview

# Fields of the index and what each may be used for.
INDEX_FIELDS = (
    "chunk_id", "chunk_text", "embedding", "short_title", "regulation_title", "source_url", "page_number", "file_name",
)
SEARCHABLE = ("chunk_text", "regulation_title")
FILTERABLE = ("chunk_id", "short_title", "regulation_title", "page_number", "file_name")
SORTABLE = ("chunk_id", "page_number")
FACETABLE = ("short_title",)
SAMPLE_PREVIEW = 500


def to_index_rows(gold: DataFrame) -> DataFrame:
    """The eight index fields, id as string and page as int; absent fields are null."""
    kinds = {"embedding": "array<float>", "page_number": "int"}
    return gold.select(
        *[(F.col(f) if f in gold.columns else F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in INDEX_FIELDS]
    )


def index_eligible(rows: DataFrame) -> DataFrame:
    """Rows with an id, a text that is not only spaces, and a vector."""
    return rows.filter(
        F.col("chunk_id").isNotNull()
        & F.col("chunk_text").isNotNull()
        & (F.length(F.trim("chunk_text")) > 0)
        & F.col("embedding").isNotNull()
    )


def dedupe(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in the given order. Each task keeps one row per key before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def upsert_index(current: DataFrame, updates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``updates`` replace rows with the same key; all others stay."""
    return current.join(updates.select(key), key, "left_anti").select(current.columns).unionByName(updates)


def where_fields(index: DataFrame, **equals: object) -> DataFrame:
    """Keep rows whose filterable fields have the given values; sits right on the scan."""
    for field, value in equals.items():
        if field not in FILTERABLE:
            raise ValueError(f"{field} is not filterable")
        index = index.filter(F.col(field) == F.lit(value))
    return index


def order_fields(index: DataFrame, field: str, ascending: bool = True) -> DataFrame:
    if field not in SORTABLE:
        raise ValueError(f"{field} is not sortable")
    return index.orderBy(F.col(field).asc() if ascending else F.col(field).desc())


def sample_index(index: DataFrame, k: int = 5) -> DataFrame:
    """The first k rows by id with a preview of the text."""
    return index.select("chunk_id", preview(F.col("chunk_text"), SAMPLE_PREVIEW).alias("chunk_preview")).orderBy("chunk_id").limit(k)


def facets(index: DataFrame, field: str = "short_title") -> DataFrame:
    if field not in FACETABLE:
        raise ValueError(f"{field} is not facetable")
    return index.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("count"))
