"""Documents with content to pages of clean text; failures set aside per document."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.base import let
from corpusmill.functions.html import main_text
from corpusmill.functions.text import byte_size, clean_text, decode_utf8, file_error, sha256_hex
from corpusmill.functions.xml import fx_rates, fx_struct, rdf_expression_id, rdf_modified, rdf_title, xml_text_or_tags_removed
from corpusmill.operators.manifest import RAW_FOLDERS, raw_path, raw_path_error
from corpusmill.operators.once import with_once, with_text_once
from corpusmill.schemas import BRONZE_PAGES, LINEAGE
from corpusmill.session import broadcast_if_bounded
from corpusmill.sources.layers import utc_text

PAGE_BREAK = "\f"


def _path_key(path: Column) -> Column:
    """A path without its scheme and host, so that one store's spellings of it are equal."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/")


def _wanted(manifest: DataFrame, root: str) -> DataFrame:
    fmt, name = F.col("file_format"), F.col("file_name")
    return manifest.withColumn("source_file", raw_path(fmt, name, root)).withColumn("error", raw_path_error(fmt, name))


def _missing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The records of ``wanted`` without a file; only paths are read."""
    keyed = wanted.withColumn("_key", _path_key(F.col("source_file")))
    missing = keyed.join(files.select(_path_key(F.col("path")).alias("_key")), "_key", "left_anti").drop("_key")
    return missing.withColumn("error", F.coalesce(F.col("error"), F.concat(F.lit("File not found: "), F.col("source_file"))))


def attach_content(manifest: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Manifest rows with the bytes of their landed file; ``error`` says why there are none.

    A manifest that is proven small is broadcast to the files, so the bytes stay
    in the task that read them. The files are looked at a second time for the
    documents without one, by path only.
    """
    wanted = _wanted(manifest, root)
    records, _ = broadcast_if_bounded(wanted.withColumn("_key", _path_key(F.col("source_file"))))
    found = files.select(_path_key(F.col("path")).alias("_key"), "content").join(records, "_key").select(*wanted.columns, "content")
    missing = _missing(wanted, files)
    return found.unionByName(missing.select(*wanted.columns, F.lit(None).cast("binary").alias("content")))


def extract_landed(manifest: DataFrame, files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(bronze pages, quarantine) of manifest records and landed files; file contents are never shuffled.

    A manifest proven small is broadcast to the scan, and only its files are
    read. For a larger one the format is seen in the file's folder, the task
    that read a file extracts it, and the records meet its pages.
    """
    wanted = _wanted(manifest, root)
    quarantine = _missing(wanted, files)
    good = wanted.where("error IS NULL").drop("error").withColumn("_key", _path_key(F.col("source_file")))
    records, small = broadcast_if_bounded(good)
    landed = files.select(_path_key(F.col("path")).alias("_key"), "content")
    if small:
        return extract_text(landed.join(records, "_key").drop("_key")), quarantine
    folder = F.regexp_extract("_key", r"([^/]+)/[^/]+$", 1)
    formats = F.create_map(*[F.lit(x) for fmt, name in RAW_FOLDERS.items() for x in (name, fmt)])
    pages = extract_text(landed.select("_key", F.try_element_at(formats, folder).alias("file_format"), "content").withColumnRenamed("_key", "source_file"))
    pages = pages.select(F.col("source_file").alias("_key"), "page_number", "section_number", "text", "extracted_at_utc")
    joined = pages.join(good, "_key")
    kinds = {f.name: f.dataType for f in BRONZE_PAGES.fields}
    return joined.select(*[(F.col(c) if c in joined.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in BRONZE_PAGES.names]), quarantine


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): one bad document never stops the others."""
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())


def validate_files(df: DataFrame) -> DataFrame:
    """Add ``ok`` and ``file_error`` from the leading bytes."""
    return df.withColumn("file_error", file_error(F.col("content"), F.col("file_format"))).withColumn(
        "ok", F.col("file_error").isNull()
    )


def file_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("sha256", sha256_hex(F.col("content"))).withColumn("file_size_bytes", byte_size(F.col("content")))


def _pages(text: Column, delimiter: str) -> Column:
    return F.transform(
        F.split(text, re.escape(delimiter)),
        lambda p, i: F.struct((i + 1).alias("page_number"), F.lit(None).cast("int").alias("section_number"), clean_text(p).alias("text")),
    )


def _section(text: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast("int").alias("page_number"), F.lit(1).alias("section_number"), text.alias("text")))


def explode_pages(docs: DataFrame, delimiter: str = PAGE_BREAK, text_col: str = "text") -> DataFrame:
    """One row per page with text; page numbers count from 1 and skip nothing."""
    parents = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    raw = docs.select(*parents, F.posexplode(F.split(F.col(text_col), re.escape(delimiter))).alias("_i", "_t"))
    numbered = raw.select(*parents, (F.col("_i") + 1).alias("page_number"), "_t")
    return with_text_once(numbered, "text", clean_text(F.col("_t")), drop=["_t"])


def extract_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Main text of each page as section 1; pages without text are left out."""
    return with_text_once(pages.withColumn("section_number", F.lit(1)), "text", main_text(F.col(html_col)), drop=[html_col])


def extract_fx_rates(docs: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Long table: one row per currency with the document's date."""
    parents = [F.col(f"`{c}`") for c in docs.columns if c != xml_col]

    def rows(fx: Column) -> Column:
        day = fx["rate_date"].try_cast("date").alias("rate_date")
        return F.transform(
            fx["rates"], lambda r: F.struct(day, r["currency"].alias("currency"), r["rate"].try_cast("double").alias("rate"))
        )

    return docs.select(*parents, F.inline(let(F.col(xml_col), lambda x: let(fx_rates(x), rows))))


def fx_text(docs: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Readable text of each XML document; without rates, its text with the tags removed."""
    text = let(F.col(xml_col), lambda x: let(fx_struct(x), lambda fx: xml_text_or_tags_removed(fx, x)))
    return with_text_once(docs.withColumn("section_number", F.lit(1)), "text", text, drop=[xml_col])


def parse_rdf(df: DataFrame, rdf_col: str = "rdf") -> DataFrame:
    """Expression id, modification date and title; ``error`` where no English expression is named."""
    out = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != rdf_col],
        rdf_expression_id(F.col(rdf_col)).alias("expression_id"),
        rdf_modified(F.col(rdf_col)).alias("modified"),
        rdf_title(F.col(rdf_col)).alias("title"),
    )
    return out.withColumn("error", F.when(F.col("expression_id").isNull(), F.lit("No English expression identifier in RDF")))


def with_document_metadata(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the ten lineage columns of the document to each page."""
    own = [c for c in pages.columns if c not in LINEAGE]
    return pages.select("document_id", *own).join(docs.select(*LINEAGE), "document_id").select(*LINEAGE, *own)


def extract_text(docs: DataFrame, page_break: str = PAGE_BREAK) -> DataFrame:
    """Bronze pages of documents with ``content``, routed by file format in one pass over the bytes.

    The stand-in for PDF is text with page breaks. Formats outside pdf, html
    and xml give no rows. Rows stay where they are: no join, no shuffle.
    """
    fmt = F.col("file_format")
    xml = let(F.col("_text"), lambda t: let(fx_struct(t), lambda fx: xml_text_or_tags_removed(fx, t)))
    pages = (
        F.when(fmt == "pdf", _pages(F.col("_text"), page_break))
        .when(fmt == "html", _section(main_text(F.col("_text"))))
        .when(fmt == "xml", _section(xml))
    )
    keep = [c for c in ("document_id", "source_file", "file_name", *LINEAGE[1:]) if c in docs.columns]
    out = (
        with_once(docs.select(*keep, "file_format", "content"), "_text", decode_utf8(F.col("content")), drop=["content"])
        .select(*keep, "file_format", F.inline(pages))
        .filter(F.col("text") != "")
        .withColumn("extracted_at_utc", utc_text())
    )
    kinds = {f.name: f.dataType for f in BRONZE_PAGES.fields}
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in BRONZE_PAGES.names])
