"""Layer tables, incremental refresh, file stream and saved evaluations."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_text
from corpusmill.operators.chunk import chunk_pages
from corpusmill.operators.embed import embed
from corpusmill.operators.evaluate import summarize
from corpusmill.plans.refresh import refresh, refresh_layer
from corpusmill.plans.run import RunConfig, run_corpus
from corpusmill.querybook import sql
from corpusmill.querybook.answer_queries import _LABEL_RESULTS, _SUMMARY, _label_results
from corpusmill.querybook.frames import pages_of_text
from corpusmill.querybook.registry import query, spread, table, vector_cells
from corpusmill.session import materialize, scratch_path
from corpusmill.sources.evaluation import read_questions, write_evaluation
from corpusmill.sources.layers import read_layer, upsert_layer, with_metrics, write_layer
from corpusmill.streaming.ingest import document_stream, stream_ingest, stream_replace


@query("layer_round_trip", f"SELECT doc_id, lang, {sql.clean('text')} AS text FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"bronze_{uuid.uuid4().hex}"
    cleaned = table(spark, sf_dir, "documents").select("doc_id", "lang", clean_text(F.col("text")).alias("text"))
    write_layer(cleaned, name, "bronze", path=scratch_path(spark, name))
    return read_layer(spark, name).drop("bronze_loaded_at")


@query(
    "stage_row_counts",
    f"WITH {sql.PAGES} SELECT 'pages' AS stage, count(*) AS rows FROM pages_of_text WHERE text <> '' UNION ALL SELECT 'documents', count(*) FROM documents",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted while each stage is written.
    counts = []
    for stage, df in (("documents", table(spark, sf_dir, "documents").select("doc_id")), ("pages", pages_of_text(spark, sf_dir))):
        observed, seen = with_metrics(df, stage)
        observed.write.parquet(scratch_path(spark, stage))
        counts.append((stage, seen.get["rows"]))
    return spark.createDataFrame(counts, "stage string, rows long")


@query(
    "incremental_refresh",
    f"""WITH {sql.CHUNKED},\n{sql.vectors('chunked', 'chunk_id', 'chunk_text', 64, 'cv')}
SELECT document_id, chunk_index, chunk_id, md5(chunk_text) AS chunk_md5, {sql.cells('embedding')} AS cells FROM chunked LEFT JOIN cv USING (chunk_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Before: German documents had a longer text, Spanish ones did not exist. After the refresh it must equal a full rebuild.
    pages = pages_of_text(spark, sf_dir)
    old_text = F.when(F.col("language") == "de", F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    before = materialize(embed(chunk_pages(pages.filter("language <> 'es'").withColumn("text", old_text))), "gold")
    changed = pages.filter("language IN ('de', 'es')").select("document_id")
    out = refresh(pages, changed, before)
    return out.select(
        "document_id", "chunk_index", "chunk_id", F.md5("chunk_text").alias("chunk_md5"), vector_cells(F.col("embedding")).alias("cells")
    )


@query(
    "stream_ingest",
    f"WITH {sql.CHUNKED} SELECT document_id, chunk_index, chunk_id, chunk_length FROM chunked",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    arriving = document_stream(spark, f"{sf_dir}/documents.parquet*", schema).select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text"
    )
    out = scratch_path(spark, "streamed")
    stream_ingest(arriving, out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("document_id", "chunk_index", "chunk_id", "chunk_length")


@query(
    "layer_guard",
    "SELECT doc_id, CASE lang WHEN 'es' THEN 'es, again' ELSE lang END AS lang, md5(text) AS text_md5, true AS loaded, 2::BIGINT AS refused FROM documents WHERE lang IS DISTINCT FROM 'fr'",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two replacements fail, one without rows and one in a task; then an upsert changes one language and removes another.
    name = f"guarded_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("text_md5"))
    write_layer(rows, name, "bronze", key="doc_id", buckets=8, path=scratch_path(spark, name))
    broken = F.when(F.col("lang") == "de", F.raise_error(F.lit("a bad record"))).otherwise(F.col("lang"))
    refused = 0
    for frame in (rows.where("doc_id IS NULL AND lang = 'none'"), rows.withColumn("lang", broken)):
        try:
            write_layer(frame, name, "bronze")
        except (ValueError, PySparkException):
            refused += 1
    changed = rows.where("lang = 'es'").withColumn("lang", F.lit("es, again"))
    upsert_layer(changed, name, removed=rows.where("lang = 'fr'"), layer="bronze")
    loaded = F.col("bronze_loaded_at").isNotNull() & (F.col("bronze_loaded_at") <= F.current_timestamp())
    return read_layer(spark, name).select("doc_id", "lang", "text_md5", loaded.alias("loaded"), F.lit(refused).cast("long").alias("refused"))


@query(
    "refresh_write_back",
    f"""WITH {sql.CHUNKED},\n{sql.vectors('chunked', 'chunk_id', 'chunk_text', 64, 'cv')}
SELECT document_id, chunk_index, chunk_id, md5(chunk_text) AS chunk_md5, {sql.cells('embedding')} AS cells FROM chunked LEFT JOIN cv USING (chunk_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As incremental_refresh, but the layer itself is changed, bucket by bucket.
    pages, name = pages_of_text(spark, sf_dir), f"gold_{uuid.uuid4().hex}"
    old_text = F.when(F.col("language") == "de", F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    before = embed(chunk_pages(pages.filter("language <> 'es'").withColumn("text", old_text)))
    write_layer(before, name, key="document_id", buckets=16, path=scratch_path(spark, name))
    refresh_layer(pages, pages.filter("language IN ('de', 'es')").select("document_id"), name)
    return read_layer(spark, name).select(
        "document_id", "chunk_index", "chunk_id", F.md5("chunk_text").alias("chunk_md5"), vector_cells(F.col("embedding")).alias("cells")
    )


@query(
    "gated_run",
    f"""WITH {sql.CHUNKED},\n{sql.vectors('chunked', 'chunk_id', 'chunk_text', 64, 'cv')}
SELECT document_id, chunk_id, short_title, md5(chunk_text) AS chunk_md5, {sql.cells('embedding')} AS cells, 0::BIGINT AS idle_stages FROM chunked LEFT JOIN cv USING (chunk_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A first run, an idle one, and one in which a language changed and another one is new: together they equal a full build.
    database, root = f"run_{uuid.uuid4().hex}", "/landing"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, database)}'")
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("document_id"), "source", "lang", "text")

    def manifest(changed: Column) -> DataFrame:
        return docs.select(
            "document_id", F.lit("pdf").alias("file_format"), F.concat("document_id", F.lit(".pdf")).alias("file_name"), F.lit("downloaded").alias("ingestion_status"),
            F.col("source").alias("short_title"), changed.alias("changed"),
        )

    def files(text: Column) -> DataFrame:
        return docs.select(F.concat(F.lit(f"file:{root}/pdf/"), "document_id", F.lit(".pdf")).alias("path"), F.encode(text, "UTF-8").alias("content"))

    cfg = RunConfig(raw_root=root, database=database, buckets=8)
    before = F.when(F.col("lang") == "de", F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    run_corpus(spark, manifest(F.col("lang") != "es"), cfg, files=files(before))
    idle = run_corpus(spark, manifest(F.lit(False)), cfg, files=files(before))
    run_corpus(spark, manifest(F.col("lang").isin("de", "es")), cfg, files=files(F.col("text")))
    rows = read_layer(spark, cfg.table("index_chunks"))
    return rows.select(
        "document_id", "chunk_id", "short_title", F.md5("chunk_text").alias("chunk_md5"), vector_cells(F.col("embedding")).alias("cells"), F.lit(len(idle)).cast("long").alias("idle_stages")
    )


@query("stream_replace", f"WITH {sql.CHUNKED} SELECT document_id, chunk_index, chunk_id, chunk_length FROM chunked")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # German documents arrive in a longer version first; the second one replaces their chunks.
    arrived, name = scratch_path(spark, "arrived"), f"streamed_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "lang", "text")
    longer = F.when(F.col("lang") == "de", F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    docs.withColumn("text", longer).withColumn("version", F.lit(1)).drop("lang").write.parquet(arrived)
    docs.where("lang = 'de'").withColumn("version", F.lit(2)).drop("lang").write.mode("append").parquet(arrived)
    schema = docs.drop("lang").withColumn("version", F.lit(1)).schema
    arriving = document_stream(spark, arrived, schema, glob="*.parquet", files_per_trigger=1)
    stream_replace(arriving, name, scratch_path(spark, "progress"), "version", buckets=8, path=scratch_path(spark, name)).awaitTermination()
    return read_layer(spark, name).select("document_id", "chunk_index", "chunk_id", "chunk_length")


@query("evaluation_items", "SELECT item_id::VARCHAR AS id, text AS question, 'src' || item_id AS expected_regulation, 'a,b' AS keywords FROM benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "questions")
    table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.concat(F.lit("src"), "item_id").alias("expected_regulation"),
        F.array(F.lit("a"), F.lit("b")).alias("expected_keywords"),
    ).write.json(path)
    items = read_questions(spark, path)
    return items.select("id", "question", "expected_regulation", F.array_join("expected_keywords", ",").alias("keywords"))


@query(
    "saved_evaluation",
    f"SELECT 5 AS top_k, (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS saved_results, * FROM ({_SUMMARY.format('(' + _LABEL_RESULTS.format('true') + ')')})",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _label_results(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"))
    path, summary = scratch_path(spark, "evaluation"), summarize(results)
    write_evaluation(results, summary, path, 5)
    saved = spark.read.schema(results.schema).json(f"{path}/results").agg(F.count(F.lit(1)).alias("saved_results"))
    kept = spark.read.json(f"{path}/summary").drop("evaluation_timestamp")
    return kept.withColumn("saved_results", saved.scalar()).withColumn("top_k", F.col("top_k").cast("int"))
