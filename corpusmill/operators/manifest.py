"""Manifest records: normalisation, derived labels, paths, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.base import blank_to_null, first_present
from corpusmill.operators.index import dedupe
from corpusmill.schemas import BRONZE_DOCUMENTS, MANIFEST
from corpusmill.sources.layers import utc_text

# Labels and status words.
DOCUMENT_TYPES = {"pdf": "regulatory_document", "html": "regulatory_web_page", "xml": "api_xml_response"}
EXTERNAL_DOCUMENT_TYPE = "external_source_document"
COMPLIANCE_DOMAINS = {
    "Data Protection": "Data protection and privacy",
    "Digital Finance": "Digital operational resilience",
    "Payments": "Payment services",
    "Financial Markets": "Financial markets",
    "Artificial Intelligence": "AI governance",
    "Credit Risk": "Credit risk",
}
DOWNLOADED, FAILED = "downloaded", "failed"
DEFAULT_LANGUAGE = "EN"
RAW_FOLDERS = {"pdf": "pdf", "html": "html", "xml": "xml"}


def infer_document_type(file_format: Column, source_system: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for fmt, label in DOCUMENT_TYPES.items():
        out = out.when(file_format == fmt, label)
    return out.when(blank_to_null(source_system).isNotNull(), EXTERNAL_DOCUMENT_TYPE)


def infer_compliance_domain(category: Column) -> Column:
    """Known categories get their domain, others stand for themselves, blank gives null."""
    out = F.when(blank_to_null(category).isNull(), F.lit(None).cast("string"))
    for name, domain in COMPLIANCE_DOMAINS.items():
        out = out.when(category == name, domain)
    return out.otherwise(category)


def normalize_manifest(df: DataFrame) -> DataFrame:
    """Fixed bronze columns; an empty string counts as missing wherever there is a substitute."""
    kinds = {f.name: f.dataType for f in MANIFEST.fields}
    have = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in MANIFEST.names])
    category = first_present(F.col("regulation_category"), F.col("category"))
    derived = {
        "regulation_title": first_present(F.col("regulation_title"), F.col("title")),
        "issuing_authority": first_present(F.col("issuing_authority"), F.col("source_system")),
        "regulation_category": category,
        "compliance_domain": first_present(F.col("compliance_domain"), infer_compliance_domain(category)),
        "document_type": first_present(F.col("document_type"), infer_document_type(F.col("file_format"), F.col("source_system"))),
        "language": first_present(F.col("language"), F.lit(DEFAULT_LANGUAGE)),
    }
    return have.select(*[derived.get(c, F.col(c)).alias(c) for c in BRONZE_DOCUMENTS.names])


def successful(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("ingestion_status") == DOWNLOADED)


def raw_path(file_format: Column, file_name: Column, root: str) -> Column:
    """Landed path, or null when the name is missing or the format unknown."""
    folder = F.when(F.lit(False), F.lit(None).cast("string"))
    for fmt, name in RAW_FOLDERS.items():
        folder = folder.when(file_format == fmt, f"{root.rstrip('/')}/{name}/")
    return F.concat(folder, blank_to_null(file_name))


# Fixed value: how a downloaded record was acquired.
ACQUIRED_BY = "automatic_download"


def raw_path_error(file_format: Column, file_name: Column) -> Column:
    return F.when(blank_to_null(file_name).isNull(), F.lit("Missing file_name")).when(
        ~F.coalesce(file_format.isin(*RAW_FOLDERS), F.lit(False)),
        F.concat(F.lit("Unsupported file format: "), F.coalesce(file_format, F.lit("None"))),
    )


def _latest_first(previous: DataFrame, marker: str) -> list[Column]:
    """Order of a document's records: the latest first, then whatever else tells records of the same time apart."""
    first = [F.col("downloaded_at_utc").desc_nulls_last()]
    return first + [F.col(c).desc_nulls_last() for c in ("ingestion_status", marker, "file_name", "error") if c in previous.columns]


def detect_changes(
    current: DataFrame, previous: DataFrame, marker: str = "cellar_last_modified", need_downloaded: bool = True, raw_root: str | None = None
) -> DataFrame:
    """Manifest rows of this run with ``changed``.

    ``current`` holds what the source offers now: registry columns, the change
    marker and ``error`` for documents that could not be fetched. A document is
    unchanged when its previous record was downloaded and has the same marker;
    a null marker is never the same. Unchanged rows carry the previous record
    with a new time, failed ones become failed records and count as changed.
    ``need_downloaded=False`` is the rule for web documents: the marker alone.
    With ``raw_root`` a downloaded record says where its file was landed (volume_path).
    """
    wide = [c for c in MANIFEST.names if c != "document_id"]
    latest = dedupe(previous, "document_id", _latest_first(previous, marker))
    kinds = {f.name: f.dataType for f in MANIFEST.fields}
    old = latest.select(
        "document_id",
        F.struct(*[(F.col(c) if c in latest.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in wide]).alias("_old"),
    )
    now = current.select(*[(F.col(c) if c in current.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in MANIFEST.names])
    same = F.col(marker) == F.col(f"_old.{marker}")
    if need_downloaded:
        same = same & (F.col("_old.ingestion_status") == DOWNLOADED)
    failed = F.col("error").isNotNull()
    joined = now.join(old, "document_id", "left").withColumn("_same", ~failed & F.coalesce(same, F.lit(False)))
    fresh = {
        "downloaded_at_utc": utc_text(),
        "ingestion_status": F.when(failed, FAILED).otherwise(DOWNLOADED),
        "acquisition_method": F.when(~failed, ACQUIRED_BY),
        "language": F.when(~failed, DEFAULT_LANGUAGE),
        "file_name": F.when(~failed, F.col("file_name")),
        marker: F.when(~failed, F.col(marker)),
    }
    if raw_root is not None:
        fresh["volume_path"] = F.when(~failed, raw_path(F.col("file_format"), F.col("file_name"), raw_root))

    def pick(c: str) -> Column:
        new = fresh.get(c, F.col(c))
        if c == "downloaded_at_utc":
            return new.alias(c)
        return F.when(F.col("_same"), F.col(f"_old.{c}")).otherwise(new).alias(c)

    return joined.select("document_id", *[pick(c) for c in wide], (~F.col("_same")).alias("changed"))


def changes_detected(df: DataFrame) -> DataFrame:
    """One row: did anything change or fail? False without rows."""
    return df.agg(F.coalesce(F.bool_or("changed"), F.lit(False)).alias("changes_detected"))


def concat_records(*parts: DataFrame) -> DataFrame:
    """Ragged record sets under the union of their columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
