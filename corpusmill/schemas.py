"""Schemas of the records that move between the layers. Every field is nullable."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(strings: str, **others: T.DataType) -> T.StructType:
    fields = [T.StructField(n, others.get(n, T.StringType())) for n in strings.split()]
    return T.StructType(fields)


# Both the current form (volume_path, change markers) and the older one (local_path, size, hash).
MANIFEST = _schema(
    "document_id celex short_title title regulation_title description issuing_authority category regulation_category "
    "compliance_domain document_type language source_system source_url file_format file_name volume_path local_path "
    "file_size_bytes sha256 cellar_last_modified last_modified_header downloaded_at_utc content_type ingestion_status "
    "acquisition_method error",
    file_size_bytes=T.LongType(),
)

BRONZE_DOCUMENTS = _schema(
    "document_id celex short_title regulation_title description issuing_authority regulation_category compliance_domain "
    "document_type language source_system source_url file_format local_path file_name file_size_bytes sha256 "
    "downloaded_at_utc content_type ingestion_status acquisition_method error",
    file_size_bytes=T.LongType(),
)

LINEAGE = (
    "document_id", "celex", "short_title", "regulation_title", "regulation_category", "compliance_domain",
    "document_type", "language", "source_system", "source_url",
)

BRONZE_PAGES = _schema(
    " ".join(LINEAGE) + " file_format source_file file_name page_number section_number text extracted_at_utc",
    page_number=T.IntegerType(),
    section_number=T.IntegerType(),
)

REGISTRY = _schema("document_id celex short_title title category source_system source_url file_format file_name")

QUESTIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected_regulation", T.StringType()),
        T.StructField("expected_keywords", T.ArrayType(T.StringType())),
    ]
)
