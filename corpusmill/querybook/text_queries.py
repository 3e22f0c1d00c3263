"""Text, personal data, chunks and page extraction over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.pii import PII_PATTERNS, PII_REPLACEMENTS, contains_pii, redact_pii
from corpusmill.functions.text import byte_size, clean_text, decode_utf8, norm_key, preview, sha256_hex, strip_tags
from corpusmill.functions.tokens import term_counts, tokens
from corpusmill.operators.chunk import chunk_fixed
from corpusmill.operators.embed import embed
from corpusmill.operators.extract import explode_pages, extract_html, validate_files
from corpusmill.operators.reports import pii_report
from corpusmill.querybook import sql
from corpusmill.querybook.frames import chunks_of_text, pages_of_text
from corpusmill.querybook.registry import query, spread, table


@query("clean_text", f"SELECT doc_id, {sql.clean('text')} AS text FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


@query(
    "comparison_keys",
    f"SELECT page_id, {sql.norm('url')} AS url_key, length({sql.norm('html')})::INT AS html_key_chars FROM pages",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", norm_key(F.col("url")).alias("url_key"), F.length(norm_key(F.col("html"))).alias("html_key_chars")
    )


@query("previews", "SELECT doc_id, left(text, 1200) AS source_preview, left(text, 700) AS answer_preview, left(text, 500) AS sample_preview FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", preview(text, 1200).alias("source_preview"), preview(text, 700).alias("answer_preview"), preview(text, 500).alias("sample_preview")
    )


# The library's patterns without the flag that tells Java to read \\b, \\d and \\s by Unicode; RE2 has no such flag.
_PII_SQL = {kind: pattern.replace("(?U)", "").replace("(?iU)", "(?i)") for kind, pattern in PII_PATTERNS.items()}


def _redaction_sql(source: str, key: str, order: tuple[str, ...]) -> str:
    ctes, prev = [], source
    for i, kind in enumerate(order):
        ctes.append(
            f"r{i} AS (SELECT * REPLACE (regexp_replace(t, '{_PII_SQL[kind]}', '{PII_REPLACEMENTS[kind]}', 'g') AS t), "
            f"len(regexp_extract_all(t, '{_PII_SQL[kind]}'))::INT AS n_{kind} FROM {prev})"
        )
        prev = f"r{i}"
    counts = ", ".join(f"n_{k} AS {k}_count" for k in ("email", "phone", "iban", "credit_card"))
    return f"WITH {', '.join(ctes)} SELECT {key}, t AS redacted_text, {counts} FROM {prev}"


def _redacted(df: DataFrame, key: str, mode: str) -> DataFrame:
    return redact_pii(df.select(key, "text"), mode=mode).select(
        *[F.col(c) for c in (key, "redacted_text")], *[F.col("redactions")[k].alias(f"{k}_count") for k in PII_PATTERNS]
    )


_COMPAT = ("email", "phone", "iban", "credit_card")
_SPECIFIC = ("iban", "credit_card", "email", "phone")


@query("pii_redaction", _redaction_sql("(SELECT doc_id, text AS t FROM documents)", "doc_id", _COMPAT))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(table(spark, sf_dir, "documents"), "doc_id", "compat")


@query("pii_redaction_specific_first", _redaction_sql("(SELECT doc_id, text AS t FROM documents)", "doc_id", _SPECIFIC))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(table(spark, sf_dir, "documents"), "doc_id", "specific_first")


@query(
    "pii_redaction_turns",
    _redaction_sql("(SELECT conv_id || ':' || turn AS turn_key, text AS t FROM conversations)", "turn_key", _COMPAT),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("turn_key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return _redacted(turns, "turn_key", "compat")


_ANY_PII = " OR ".join(f"regexp_matches(text, '{p}')" for p in _PII_SQL.values())


@query("contains_pii", f"SELECT doc_id, ({_ANY_PII}) AS has_pii FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", contains_pii(F.col("text")).alias("has_pii"))


@query(
    "pii_report",
    "SELECT lang, source, count(*) AS documents, count(*) FILTER (email_count + phone_count + iban_count + credit_card_count > 0) AS documents_with_pii, "
    "sum(email_count)::BIGINT AS email_count, sum(phone_count)::BIGINT AS phone_count, sum(iban_count)::BIGINT AS iban_count, "
    f"sum(credit_card_count)::BIGINT AS credit_card_count FROM documents JOIN ({_redaction_sql('(SELECT doc_id, text AS t FROM documents)', 'doc_id', _COMPAT)}) USING (doc_id) GROUP BY lang, source",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"), by=("lang", "source"))


@query(
    "chunk_pages",
    f"WITH {sql.CHUNKED} SELECT document_id, page_number, chunk_index, chunk_text, chunk_length, chunk_id, short_title FROM chunked",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of_text(spark, sf_dir).select(
        "document_id", "page_number", "chunk_index", "chunk_text", "chunk_length", "chunk_id", "short_title"
    )


@query(
    "chunk_pages_small",
    f"WITH {sql.PAGES},\n{sql.chunks('pages_of_text', 300, 60)} SELECT document_id, chunk_index, chunk_length, chunk_id, md5(chunk_text) AS chunk_md5 FROM chunked",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.operators.chunk import chunk_pages

    return chunk_pages(pages_of_text(spark, sf_dir), 300, 60).select(
        "document_id", "chunk_index", "chunk_length", "chunk_id", F.md5("chunk_text").alias("chunk_md5")
    )


@query(
    "chunk_fixed",
    f"""WITH {sql.PAGES},
w AS (SELECT document_id, page_number, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::BIGINT)))::INT AS chunk_index FROM pages_of_text WHERE text <> '')
SELECT document_id, chunk_index, trim(substr(text, 1 + chunk_index * 800, 1000), ' ') AS chunk_text,
  length(trim(substr(text, 1 + chunk_index * 800, 1000), ' '))::INT AS chunk_length,
  sha256(document_id || '_1_no_section_' || chunk_index) AS chunk_id
FROM w WHERE trim(substr(text, 1 + chunk_index * 800, 1000), ' ') <> ''""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fixed(pages_of_text(spark, sf_dir)).select("document_id", "chunk_index", "chunk_text", "chunk_length", "chunk_id")


@query(
    "explode_pages",
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS page_number FROM documents)
SELECT doc_id, page_number, {sql.clean('t')} AS text FROM lines WHERE {sql.clean('t')} <> ''""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return explode_pages(docs, "\n")


def _html_sql() -> str:
    html = r"regexp_replace(html, '(?s)<!--.*?-->', '<gap>', 'g')"
    for name in ("script", "style", "noscript", "svg", "header", "footer", "nav"):
        html = rf"regexp_replace({html}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', '<gap>', 'g')"
    root = (
        r"CASE WHEN regexp_matches(h, '(?i)<article\b[^>]*>') THEN regexp_extract(h, '(?is)<article\b[^>]*>(.*?)(?:</article\s*>|$)', 1) "
        r"WHEN regexp_matches(h, '(?i)<main\b[^>]*>') THEN regexp_extract(h, '(?is)<main\b[^>]*>(.*?)(?:</main\s*>|$)', 1) "
        r"WHEN regexp_matches(h, '(?i)<body\b[^>]*>') THEN regexp_extract(h, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)', 1) ELSE h END"
    )
    text = r"regexp_replace(c, '(?:<[a-zA-Z/!?][^>]*>)+', chr(10), 'g')"
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        # The semicolon may be missing, as in HTML.
        text = rf"regexp_replace({text}, '{ref[:-1]}(?:;|([^a-zA-Z0-9;])|$)', '{char}\1', 'g')"
    return (
        f"SELECT page_id, url, 1 AS section_number, {sql.clean('t')} AS text FROM (SELECT page_id, url, {text} AS t FROM "
        f"(SELECT page_id, url, {root} AS c FROM (SELECT page_id, url, {html} AS h FROM pages))) WHERE {sql.clean('t')} <> ''"
    )


@query("html_main_text", _html_sql())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(spread(table(spark, sf_dir, "pages")).select("page_id", "url", "html"))


@query("strip_tags", f"SELECT page_id, {sql.clean(chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))} AS text FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


@query("decode_bytes", "SELECT page_id, html AS decoded, length(html)::INT AS n_chars FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An invalid byte goes in at the front and must come out again.
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8"))
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", decode_utf8(raw).alias("decoded"))
        .withColumn("n_chars", F.length("decoded"))
    )


@query(
    "file_validation",
    """SELECT page_id, file_format, (file_format = 'html') AS ok,
  CASE file_format WHEN 'pdf' THEN 'Invalid PDF file' WHEN 'xml' THEN 'Invalid XML file' END AS file_error
FROM (SELECT page_id, CASE WHEN substr(md5(url), 1, 1) < '6' THEN 'html' WHEN substr(md5(url), 1, 1) < 'b' THEN 'pdf' ELSE 'xml' END AS file_format FROM pages)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.substring(F.md5("url"), 1, 1)
    fmt = F.when(digit < "6", "html").when(digit < "b", "pdf").otherwise("xml")
    files = table(spark, sf_dir, "pages").select("page_id", fmt.alias("file_format"), F.encode("html", "UTF-8").alias("content"))
    return validate_files(files).select("page_id", "file_format", "ok", "file_error")


@query("file_fingerprint", "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS file_size_bytes FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("html", "UTF-8")
    return table(spark, sf_dir, "pages").select(
        "page_id", sha256_hex(content).alias("sha256"), byte_size(content).alias("file_size_bytes")
    )


@query(
    "term_counts",
    f"SELECT doc_id, term, count(*)::INT AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY ALL",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.inline(term_counts(tokens(F.col("text"))))
    )


@query(
    "chunk_vectors",
    f"""WITH {sql.CHUNKED},
{sql.vectors('chunked', 'chunk_id', 'chunk_text', 64, 'v')},
cells AS (SELECT chunk_id, unnest(embedding) AS x, unnest(range(0, 64))::INT AS position FROM v)
SELECT chunk_id, position, round(x::DOUBLE, 6) AS value FROM cells WHERE x <> 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embed(chunks_of_text(spark, sf_dir))
    return vectors.select("chunk_id", F.posexplode("embedding").alias("position", "x")).filter(F.col("x") != 0).select(
        "chunk_id", "position", F.round(F.col("x").cast("double"), 6).alias("value")
    )
