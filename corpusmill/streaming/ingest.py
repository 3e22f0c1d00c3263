"""File-arrival ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusmill.functions.text import clean_text
from corpusmill.operators.chunk import chunk_pages
from corpusmill.operators.index import dedupe
from corpusmill.operators.once import with_text_once
from corpusmill.session import materialize
from corpusmill.sources.layers import DEFAULT_BUCKETS, layer_of, merge_layer, write_layer


def document_stream(
    spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", glob: str = "*", files_per_trigger: int = 1000
) -> DataFrame:
    """New files of a folder, a bounded number per micro-batch."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )


def stream_ingest(docs: DataFrame, out: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Clean and chunk arriving documents into ``out`` and stop when all waiting files are done.

    Stateless and append-only; the checkpoint makes every file count exactly once.
    """
    pages = with_text_once(docs, text_col, clean_text(F.col(text_col)))
    return (
        chunk_pages(pages, text_col=text_col)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_replace(docs: DataFrame, name: str, checkpoint: str, order: str, text_col: str = "text", buckets: int = DEFAULT_BUCKETS, path: str | None = None) -> StreamingQuery:
    """Chunks of arriving documents in a layer keyed by document_id: a document that arrives again replaces its chunks.

    Each micro-batch is one generation of the layer and is put beside its
    buckets; what it replaces is left out when the layer is read
    (``merge_layer``). Of several versions in a batch the last by ``order`` counts.
    The layer knows the last batch it holds, so a batch that is sent again
    changes nothing. A document whose text became blank loses its chunks.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = layer_of(spark, name)
        if now is not None and number <= now.batch:
            return
        latest = materialize(dedupe(batch, "document_id", [F.col(order).desc(), F.xxhash64(text_col)]), "arrived")
        pages = with_text_once(latest.drop(order), text_col, clean_text(F.col(text_col)))
        chunks = chunk_pages(pages, text_col=text_col)
        if now is None:
            write_layer(chunks.limit(0), name, key="document_id", buckets=buckets, path=path, allow_empty=True)
        merge_layer(chunks, name, removed=latest.select("document_id"), batch=number)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
