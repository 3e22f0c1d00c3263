"""Re-chunking and re-embedding of changed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusmill.operators.chunk import chunk_pages
from corpusmill.operators.embed import DEFAULT_DIMS, embed
from corpusmill.sources.layers import upsert_layer


def refresh(changed_pages: DataFrame, changed_ids: DataFrame, chunks: DataFrame, dims: int = DEFAULT_DIMS) -> DataFrame:
    """Re-chunk and re-embed the changed documents only; chunks of all other documents are kept as they are.

    Replacement is by document, so chunks that a shorter text no longer has go away too.
    """
    ids = changed_ids.select("document_id").distinct()
    todo = changed_pages.join(ids, "document_id", "left_semi")
    fresh = embed(chunk_pages(todo), "chunk_text", dims)
    kept = chunks.join(ids, "document_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def refresh_layer(changed_pages: DataFrame, changed_ids: DataFrame, name: str, dims: int = DEFAULT_DIMS) -> dict[str, int]:
    """As ``refresh``, written back to a layer of chunks that is keyed by document_id: only the buckets of changed documents are read and rewritten."""
    ids = changed_ids.select("document_id").distinct()
    todo = changed_pages.join(ids, "document_id", "left_semi")
    return upsert_layer(embed(chunk_pages(todo), "chunk_text", dims), name, removed=ids)
