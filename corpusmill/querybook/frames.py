"""Frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_text
from corpusmill.operators.chunk import chunk_pages
from corpusmill.operators.keyword import KeywordIndex, build_postings, keyword_index
from corpusmill.operators.once import with_text_once
from corpusmill.querybook.registry import spread, table
from corpusmill.session import materialize


def pages_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as pages of clean text."""
    doc = F.col("doc_id").cast("string")
    docs = spread(table(spark, sf_dir, "documents")).select(
        doc.alias("document_id"),
        F.col("source").alias("short_title"),
        F.col("lang").alias("language"),
        F.lit(None).cast("string").alias("regulation_title"),
        F.concat(F.lit("https://corpus.example/"), "source", F.lit("/"), doc).alias("source_url"),
        F.lit(1).alias("page_number"),
        F.concat("source", F.lit("_"), doc, F.lit(".txt")).alias("file_name"),
        "text",
    )
    return with_text_once(docs, "text", clean_text(F.col("text")))


def chunks_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_pages(pages_of_text(spark, sf_dir))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk layer, written once, for queries that read it more than once."""
    return materialize(chunks_of_text(spark, sf_dir), "chunks")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def stored_postings(chunks: DataFrame, *args: object) -> KeywordIndex:
    """The keyword index, written once with its statistics."""
    return keyword_index(build_postings(chunks, *args))
