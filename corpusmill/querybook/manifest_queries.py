"""Manifest, registry, change detection, landed files and extraction over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.extract import (
    attach_content, extract_fx_rates, extract_text, fx_text, parse_rdf, split_quarantine, with_document_metadata,
)
from corpusmill.operators.manifest import (
    changes_detected, concat_records, detect_changes, infer_compliance_domain, infer_document_type, normalize_manifest,
    raw_path, raw_path_error, successful,
)
from corpusmill.querybook import sql
from corpusmill.querybook.registry import ORACLES, query, spread, table
from corpusmill.session import scratch_path
from corpusmill.sources.files import read_raw_files, with_fallback
from corpusmill.sources.manifest import corpus_registry, read_manifest, write_manifest

# Documents as manifest records. The expressions read the same in both engines.
_MANIFEST = {
    "document_id": "cast(doc_id AS string)",
    "celex": "CASE WHEN lang = 'en' THEN concat('C', cast(doc_id AS string)) END",
    "short_title": "source",
    "title": "CASE WHEN source = 'src1' THEN '' ELSE concat('Title of ', source) END",
    "regulation_title": "CASE lang WHEN 'fr' THEN '' WHEN 'de' THEN concat('Regulation ', source) END",
    "category": "CASE lang WHEN 'en' THEN 'Data Protection' WHEN 'fr' THEN 'Payments' WHEN 'de' THEN 'Credit Risk' ELSE 'Other' END",
    "regulation_category": "CASE WHEN source = 'src2' THEN 'Digital Finance' ELSE '' END",
    "issuing_authority": "CASE WHEN lang = 'de' THEN 'Authority' ELSE '' END",
    "compliance_domain": "CASE WHEN source = 'src3' THEN 'Own domain' END",
    "document_type": "CASE WHEN source = 'src4' THEN 'own_type' ELSE '' END",
    "language": "CASE WHEN lang = 'en' THEN '' ELSE lang END",
    "source_system": "CASE WHEN lang = 'es' THEN '' ELSE 'SYS' END",
    "source_url": "concat('https://corpus.example/', cast(doc_id AS string))",
    "file_format": "CASE WHEN substr(md5(cast(doc_id AS string)), 1, 1) < '4' THEN 'pdf' WHEN substr(md5(cast(doc_id AS string)), 1, 1) < '8' THEN 'html' WHEN substr(md5(cast(doc_id AS string)), 1, 1) < 'c' THEN 'xml' ELSE 'docx' END",
    "file_name": "CASE WHEN source = 'src5' THEN '' WHEN source <> 'src6' THEN concat(source, '_', cast(doc_id AS string)) END",
    "file_size_bytes": "n_chars",
    "cellar_last_modified": "CASE WHEN source <> 'src7' THEN substr(md5(text), 1, 10) END",
    "downloaded_at_utc": "'2026-01-05T00:00:00+00:00'",
    "ingestion_status": "CASE WHEN n_chars > 500 THEN 'downloaded' ELSE 'failed' END",
}
_MANIFEST_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _MANIFEST.items()) + " FROM documents"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in _MANIFEST.items()])


_NORMALIZED = """SELECT document_id, celex, short_title, coalesce(nullif(regulation_title, ''), title) AS regulation_title,
  coalesce(nullif(issuing_authority, ''), source_system) AS issuing_authority, cat AS regulation_category,
  coalesce(nullif(compliance_domain, ''), CASE cat WHEN 'Data Protection' THEN 'Data protection and privacy'
    WHEN 'Digital Finance' THEN 'Digital operational resilience' WHEN 'Payments' THEN 'Payment services'
    WHEN 'Credit Risk' THEN 'Credit risk' WHEN '' THEN NULL ELSE cat END) AS compliance_domain,
  coalesce(nullif(document_type, ''), CASE file_format WHEN 'pdf' THEN 'regulatory_document' WHEN 'html' THEN 'regulatory_web_page'
    WHEN 'xml' THEN 'api_xml_response' ELSE CASE WHEN source_system <> '' THEN 'external_source_document' END END) AS document_type,
  coalesce(nullif(language, ''), 'EN') AS language, source_system, source_url, file_format, file_name, file_size_bytes,
  downloaded_at_utc, ingestion_status
FROM (SELECT *, coalesce(nullif(regulation_category, ''), category) AS cat FROM m)"""
_NORMALIZED_COLUMNS = (
    "document_id celex short_title regulation_title issuing_authority regulation_category compliance_domain document_type "
    "language source_system source_url file_format file_name file_size_bytes downloaded_at_utc ingestion_status"
).split()


@query("normalize_manifest", f"WITH m AS ({_MANIFEST_SQL}) {_NORMALIZED}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_manifest(_manifest(spark, sf_dir)).select(*_NORMALIZED_COLUMNS)


@query(
    "manifest_round_trip",
    f"SELECT document_id, celex, title, category, file_format, file_name, file_size_bytes, cellar_last_modified, ingestion_status FROM ({_MANIFEST_SQL})",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    write_manifest(_manifest(spark, sf_dir), path)
    return read_manifest(spark, path).select(
        "document_id", "celex", "title", "category", "file_format", "file_name", "file_size_bytes", "cellar_last_modified", "ingestion_status"
    )


@query(
    "document_labels",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'regulatory_document' WHEN 'fr' THEN 'regulatory_web_page' WHEN 'de' THEN 'api_xml_response'
  ELSE 'external_source_document' END AS document_type, source AS compliance_domain FROM documents""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "fr", "html").when(F.col("lang") == "de", "xml")
    return table(spark, sf_dir, "documents").select(
        "doc_id", infer_document_type(fmt, F.col("source")).alias("document_type"), infer_compliance_domain(F.col("source")).alias("compliance_domain")
    )


@query("successful_records", f"SELECT document_id, ingestion_status FROM ({_MANIFEST_SQL}) WHERE ingestion_status = 'downloaded'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successful(_manifest(spark, sf_dir)).select("document_id", "ingestion_status")


@query(
    "raw_paths",
    f"""SELECT document_id, CASE WHEN file_format IN ('pdf', 'html', 'xml') AND file_name <> '' THEN '/landing/' || file_format || '/' || file_name END AS path,
  CASE WHEN coalesce(file_name, '') = '' THEN 'Missing file_name' WHEN file_format NOT IN ('pdf', 'html', 'xml') THEN 'Unsupported file format: ' || file_format END AS error
FROM ({_MANIFEST_SQL})""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt, name = F.col("file_format"), F.col("file_name")
    return _manifest(spark, sf_dir).select(
        "document_id", raw_path(fmt, name, "/landing").alias("path"), raw_path_error(fmt, name).alias("error")
    )


@query(
    "corpus_registry",
    """SELECT 'C' || doc_id AS document_id, 'C' || doc_id AS celex, source AS short_title, NULL AS title, lang AS category, 'EUR-Lex' AS source_system,
  'https://eur-lex.europa.eu/legal-content/EN/TXT/PDF/?uri=CELEX:C' || doc_id AS source_url, 'pdf' AS file_format, 'C' || doc_id || '_EN_' || source || '.pdf' AS file_name
FROM documents UNION ALL
SELECT 'web_' || page_id, NULL, 'page_' || page_id, 'Page ' || page_id, 'Web', 'WEB', url, 'html', 'web_' || page_id || '.html' FROM pages""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = table(spark, sf_dir, "documents").selectExpr("concat('C', doc_id) AS celex", "source AS short_title", "lang AS category")
    web = table(spark, sf_dir, "pages").selectExpr(
        "concat('web_', page_id) AS document_id", "concat('page_', page_id) AS short_title", "concat('Page ', page_id) AS title", "'Web' AS category",
        "'WEB' AS source_system", "url AS source_url", "'html' AS file_format", "concat('web_', page_id, '.html') AS file_name",
    )
    return corpus_registry(official, web)


@query(
    "ragged_union",
    """SELECT doc_id::VARCHAR AS document_id, source AS short_title, 'downloaded' AS ingestion_status, n_chars AS file_size_bytes, NULL AS error FROM documents
UNION ALL SELECT 'web_' || page_id, NULL, 'failed', NULL, 'HTTP error for ' || url FROM pages""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id AS string) AS document_id", "source AS short_title", "'downloaded' AS ingestion_status", "n_chars AS file_size_bytes"
    )
    failed = table(spark, sf_dir, "pages").selectExpr(
        "concat('web_', page_id) AS document_id", "'failed' AS ingestion_status", "concat('HTTP error for ', url) AS error"
    )
    return concat_records(fetched, failed)


# The state before this run: Spanish documents unknown, some markers and states
# different, and a second, older record for every French document.
_PREVIOUS = dict(
    _MANIFEST,
    title="concat('Old title of ', source)",
    cellar_last_modified="CASE WHEN source = 'src8' THEN 'older' WHEN source <> 'src7' THEN substr(md5(text), 1, 10) END",
    ingestion_status="CASE WHEN source = 'src9' THEN 'failed' ELSE 'downloaded' END",
)
_OLDER = dict(_PREVIOUS, cellar_last_modified="'oldest'", downloaded_at_utc="'2025-01-01T00:00:00+00:00'")
_CURRENT = dict(_MANIFEST, error="CASE WHEN source = 'src10' THEN 'HTTP 503' END")
_DETECTED_COLUMNS = "document_id title file_name volume_path cellar_last_modified ingestion_status acquisition_method error changed".split()


def _select(source: dict[str, str], where: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in source.items()) + f" FROM documents WHERE {where}"


_DETECTED = f"""WITH cur AS ({_select(_CURRENT, 'true')}), prev AS ({_select(_PREVIOUS, "lang <> 'es'")} UNION ALL {_select(_OLDER, "lang = 'fr'")}),
latest AS (SELECT * FROM prev QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY downloaded_at_utc DESC) = 1),
j AS (SELECT c.*, p.title AS p_title, p.file_name AS p_file, p.ingestion_status AS p_status,
  c.error IS NULL AND coalesce(p.ingestion_status = 'downloaded' AND p.cellar_last_modified = c.cellar_last_modified, false) AS same
  FROM cur c LEFT JOIN latest p USING (document_id))
SELECT document_id, CASE WHEN same THEN p_title ELSE title END AS title,
  CASE WHEN same THEN p_file WHEN error IS NULL THEN file_name END AS file_name,
  CASE WHEN NOT same AND error IS NULL AND file_format IN ('pdf', 'html', 'xml') AND file_name <> '' THEN '/landing/' || file_format || '/' || file_name END AS volume_path,
  CASE WHEN error IS NULL THEN cellar_last_modified END AS cellar_last_modified,
  CASE WHEN same THEN p_status WHEN error IS NULL THEN 'downloaded' ELSE 'failed' END AS ingestion_status,
  CASE WHEN NOT same AND error IS NULL THEN 'automatic_download' END AS acquisition_method, error, NOT same AS changed
FROM j"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def build(source: dict[str, str]) -> list[str]:
        return [f"{e} AS {c}" for c, e in source.items()]

    previous = docs.filter("lang <> 'es'").selectExpr(*build(_PREVIOUS)).unionByName(docs.filter("lang = 'fr'").selectExpr(*build(_OLDER)))
    return detect_changes(docs.selectExpr(*build(_CURRENT)), previous, raw_root="/landing")


@query("detect_changes", _DETECTED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select(*_DETECTED_COLUMNS)


@query("changes_detected", f"SELECT coalesce(bool_or(changed), false) AS changes_detected FROM ({_DETECTED})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_detected(_detected(spark, sf_dir))


# Orders as web documents: the last-modified marker decides, the earlier state does not.
_WEB_NOW = {
    "document_id": "cast(o_orderkey AS string)",
    "short_title": "o_orderpriority",
    "file_name": "concat(cast(o_orderkey AS string), '.html')",
    "last_modified_header": "CASE WHEN o_orderstatus <> 'P' THEN substr(cast(o_orderdate AS string), 1, 10) END",
}
_WEB_BEFORE = {
    "document_id": "cast(o_orderkey AS string)",
    "ingestion_status": "CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'downloaded' END",
    "last_modified_header": "CASE WHEN o_orderpriority = '2-HIGH' THEN '1990-01-01' WHEN o_orderstatus <> 'P' THEN substr(cast(o_orderdate AS string), 1, 10) END",
    "downloaded_at_utc": "'2026-01-05T00:00:00+00:00'",
}


@query(
    "detect_web_changes",
    f"""WITH c AS (SELECT {', '.join(f'{e} AS {k}' for k, e in _WEB_NOW.items())} FROM orders),
p AS (SELECT {', '.join(f'{e} AS {k}' for k, e in _WEB_BEFORE.items())} FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT document_id, c.last_modified_header, NOT coalesce(c.last_modified_header = p.last_modified_header, false) AS changed,
  CASE WHEN coalesce(c.last_modified_header = p.last_modified_header, false) THEN p.ingestion_status ELSE 'downloaded' END AS ingestion_status
FROM c LEFT JOIN p USING (document_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    now = orders.selectExpr(*[f"{e} AS {k}" for k, e in _WEB_NOW.items()])
    before = orders.filter("o_orderpriority <> '1-URGENT'").selectExpr(*[f"{e} AS {k}" for k, e in _WEB_BEFORE.items()])
    out = detect_changes(now, before, "last_modified_header", need_downloaded=False)
    return out.select("document_id", "last_modified_header", "changed", "ingestion_status")


@query(
    "fallback_sets",
    """SELECT 'primary present' AS run, doc_id FROM documents WHERE lang = 'en'
UNION ALL SELECT 'primary empty', doc_id FROM documents WHERE lang <> 'en'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    english, other, none = docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), docs.filter("lang = 'no such language'")
    present = with_fallback(english, other).select(F.lit("primary present").alias("run"), "doc_id")
    return present.unionByName(with_fallback(none, other).select(F.lit("primary empty").alias("run"), "doc_id"))


_LANDING = "/landing"


@query(
    "attach_content",
    """SELECT 'web_' || page_id AS document_id, '/landing/html/web_' || page_id || '.html' AS source_file, NULL AS error, octet_length(encode(html))::INT AS n_bytes FROM pages
UNION ALL SELECT doc_id::VARCHAR, CASE WHEN lang = 'en' THEN '/landing/pdf/' || doc_id || '.pdf' END,
  CASE WHEN lang = 'en' THEN 'File not found: /landing/pdf/' || doc_id || '.pdf' ELSE 'Unsupported file format: ' || lang END, NULL FROM documents""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = pages.select(
        F.concat(F.lit(f"file:{_LANDING}/html/web_"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content")
    )
    manifest = pages.selectExpr("concat('web_', page_id) AS document_id", "'html' AS file_format", "concat('web_', page_id, '.html') AS file_name").unionByName(
        table(spark, sf_dir, "documents").selectExpr(
            "cast(doc_id AS string) AS document_id", "CASE WHEN lang = 'en' THEN 'pdf' ELSE lang END AS file_format", "concat(doc_id, '.pdf') AS file_name"
        )
    )
    return attach_content(manifest, files, _LANDING).select("document_id", "source_file", "error", F.octet_length("content").alias("n_bytes"))


@query(
    "quarantine",
    f"""SELECT document_id, 'quarantine' AS side, CASE WHEN coalesce(file_name, '') = '' THEN 'Missing file_name' ELSE 'Unsupported file format: ' || file_format END AS error
FROM ({_MANIFEST_SQL}) WHERE coalesce(file_name, '') = '' OR file_format = 'docx'
UNION ALL SELECT document_id, 'good', NULL FROM ({_MANIFEST_SQL}) WHERE file_name <> '' AND file_format <> 'docx'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _manifest(spark, sf_dir).withColumn("error", raw_path_error(F.col("file_format"), F.col("file_name")))
    good, bad = split_quarantine(checked)
    return good.select("document_id", F.lit("good").alias("side"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("document_id", F.lit("quarantine").alias("side"), "error")
    )


@query("raw_file_bytes", "SELECT page_id, sha256(html) AS sha256, length(html)::INT AS n_chars FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Landed as JSON lines, read back as whole files of bytes.
    path = scratch_path(spark, "landing")
    table(spark, sf_dir, "pages").select("page_id", "html").write.json(path)
    lines = read_raw_files(spark, path, "*.json").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    page = F.from_json("line", "page_id long, html string")
    return lines.filter(F.col("line") != "").select(page.alias("p")).select(
        "p.page_id", F.sha2("p.html", 256).alias("sha256"), F.length("p.html").alias("n_chars")
    )


# One rate document per line item; returned items get a document with its last tag cut off.
_RATE = "cast(cast({c} AS decimal(18, 2)) AS {s})"
_RATE_FIELDS = (("QTY", "l_quantity"), ("EXT", "l_extendedprice"), ("TAX", "l_tax"))


def _rate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lit(text: str) -> Column:
        return F.lit(text)

    cubes = [
        x for code, c in _RATE_FIELDS for x in (lit(f"<Cube currency='{code}' rate=\""), F.expr(_RATE.format(c=c, s="string")), lit('"/>\n'))
    ]
    xml = F.concat(
        lit("<?xml version='1.0' encoding='UTF-8'?>\n<g:Envelope xmlns:g='urn:g' xmlns='urn:v'><!-- <g:subject>no</g:subject> -->"),
        lit("<g:subject>Rates &amp; prices "), F.col("l_linestatus"), lit("</g:subject><g:Sender><g:name>First</g:name><g:name>Bank "),
        F.col("l_suppkey").cast("string"), lit("</g:name></g:Sender><Cube><Cube time='"), F.date_format("l_shipdate", "yyyy-MM-dd"), lit("'>"),
        *cubes, lit("<Cube currency='NONE'/></Cube></Cube>"), F.when(F.col("l_returnflag") == "R", lit("")).otherwise(lit("</g:Envelope>")),
    )
    return spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", xml.alias("xml"))


_RATE_LINES = " || chr(10) || ".join(f"'{code}: ' || {_RATE.format(c=c, s='varchar')}" for code, c in _RATE_FIELDS)
_SHIPPED = "strftime(l_shipdate, '%Y-%m-%d')"
_RATE_TEXT = f"""CASE WHEN l_returnflag = 'R' THEN 'no --> Rates &amp; prices ' || l_linestatus || ' First Bank ' || l_suppkey
  ELSE 'Subject: Rates & prices ' || l_linestatus || chr(10) || 'Sender: Bank ' || l_suppkey || chr(10) || 'Date: ' || {_SHIPPED} || chr(10)
    || 'Euro foreign exchange reference rates:' || chr(10) || {_RATE_LINES} END"""


@query(
    "fx_rates",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS rate_date, '{code}' AS currency, {_RATE.format(c=c, s='varchar')}::DOUBLE AS rate FROM lineitem WHERE l_returnflag <> 'R'"
        for code, c in _RATE_FIELDS
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_fx_rates(_rate_documents(spark, sf_dir))


@query("fx_text", f"SELECT l_orderkey, l_linenumber, 1 AS section_number, {_RATE_TEXT} AS text FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_text(_rate_documents(spark, sf_dir))


@query(
    "rdf_metadata",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN substr(md5(o_orderkey::VARCHAR), 1, 8) || '-' || substr(md5(o_orderkey::VARCHAR), 9, 4) || '.0006' END AS expression_id,
  CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS modified, 'Order ' || o_orderkey AS title,
  CASE WHEN o_orderstatus = 'P' THEN 'No English expression identifier in RDF' END AS error FROM orders""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = '<rdf:Description rdf:about="http://publications.europa.eu/resource/cellar/'
    digest = F.md5(F.col("o_orderkey").cast("string"))
    rdf = F.concat(
        F.lit("<rdf:RDF>"), F.lit(about), F.lit('00000000-0000.0001"><j.0:lang>fr</j.0:lang></rdf:Description>'), F.lit(about),
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit('.0006"><j.0:lang>'),
        F.when(F.col("o_orderstatus") == "P", "de").otherwise(F.when(F.col("o_orderstatus") == "F", "en").otherwise("eng")), F.lit("</j.0:lang>"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(
            F.concat(F.lit('<j.0:lastModificationDate type="d"> '), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" </j.0:lastModificationDate>"))
        ),
        F.lit("<j.0:title> Order "), F.col("o_orderkey").cast("string"), F.lit("</j.0:title></rdf:Description></rdf:RDF>"),
    )
    return parse_rdf(table(spark, sf_dir, "orders").select("o_orderkey", rdf.alias("rdf")))


@query(
    "document_lineage",
    f"""WITH m AS ({_MANIFEST_SQL}), n AS ({_NORMALIZED}), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS page_number FROM documents)
SELECT document_id, celex, short_title, regulation_title, regulation_category, compliance_domain, document_type, language, source_system, source_url,
  page_number, {sql.clean('t')} AS text FROM lines JOIN n ON document_id = doc_id::VARCHAR WHERE {sql.clean('t')} <> ''""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.operators.extract import explode_pages

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return with_document_metadata(explode_pages(docs, "\n"), normalize_manifest(_manifest(spark, sf_dir)))


def _mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with page breaks as pdf, web pages as html, rate documents as xml, and one format nothing can read."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("document_id"),
        F.when(F.col("lang") == "es", "docx").otherwise("pdf").alias("file_format"),
        F.encode(F.translate("text", "\n", "\f"), "UTF-8").alias("content"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("web_"), "page_id").alias("document_id"), F.lit("html").alias("file_format"), F.encode("html", "UTF-8").alias("content")
    )
    rates = _rate_documents(spark, sf_dir).select(
        F.concat_ws("_", F.lit("fx"), "l_orderkey", "l_linenumber").alias("document_id"), F.lit("xml").alias("file_format"), F.encode("xml", "UTF-8").alias("content")
    )
    return spread(docs.unionByName(pages)).unionByName(rates)


@query(
    "extract_text",
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS page_number FROM documents WHERE lang <> 'es')
SELECT 'doc_' || doc_id AS document_id, 'pdf' AS file_format, page_number, NULL::INT AS section_number, {sql.clean('t')} AS text FROM lines WHERE {sql.clean('t')} <> ''
UNION ALL SELECT 'web_' || page_id, 'html', NULL, 1, text FROM ({ORACLES.get('html_main_text', '')})
UNION ALL SELECT 'fx_' || l_orderkey || '_' || l_linenumber, 'xml', NULL, 1, {_RATE_TEXT} FROM lineitem""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_mixed_documents(spark, sf_dir)).select("document_id", "file_format", "page_number", "section_number", "text")
