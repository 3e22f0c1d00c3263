"""Text cleaning, comparison keys, previews, hashes and file checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.base import let, strip, where_it_has


def clean_text(col: Column) -> Column:
    """Null becomes ""; NUL, NBSP, space runs, blanks after newlines and long newline runs are normalised."""
    spaced = F.coalesce(col, F.lit(""))
    for char in ("\x00", "\xa0", "\t"):
        spaced = where_it_has(char, spaced, lambda c, char=char: F.replace(c, F.lit(char), F.lit(" ")))
    single = where_it_has("  ", spaced, lambda c: F.regexp_replace(c, " {2,}", " "))
    dedented = where_it_has("\n ", single, lambda c: F.replace(c, F.lit("\n "), F.lit("\n")))
    return strip(where_it_has("\n\n\n", dedented, lambda c: F.regexp_replace(c, "\n{3,}", "\n\n")))


def norm_key(col: Column) -> Column:
    """Key for loose comparison: lower case, "-" and "_" read as spaces, ends stripped, null as ""."""
    lowered = F.lower(F.coalesce(col, F.lit("")))
    return strip(F.replace(F.replace(lowered, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")))


def preview(col: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.left(col, F.lit(n))


def strip_tags(col: Column) -> Column:
    """Every tag becomes a space, then the text is cleaned."""
    return clean_text(F.regexp_replace(col, "<[^>]+>", " "))


def decode_utf8(col: Column) -> Column:
    """Bytes to text without the invalid bytes.

    Invalid sequences turn into U+FFFD and are removed, which also removes a
    U+FFFD that was really in the text.
    """
    return where_it_has("\ufffd", F.make_valid_utf8(col.cast("string")), lambda c: F.replace(c, F.lit("\ufffd"), F.lit("")))


def chunk_id(document_id: Column, page_number: Column, section_number: Column, chunk_index: Column) -> Column:
    """Stable SHA-256 id of a chunk; a null document id is left out of the key."""
    return F.sha2(
        F.concat_ws(
            "_",
            document_id.cast("string"),
            F.coalesce(page_number.cast("string"), F.lit("no_page")),
            F.coalesce(section_number.cast("string"), F.lit("no_section")),
            chunk_index.cast("string"),
        ),
        256,
    )


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def byte_size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


# Whitespace bytes that may precede a file's magic bytes.
_LEADING_BYTES = "\t\n\x0b\x0c\r "
HEAD_BYTES = 2000


def file_error(content: Column, file_format: Column) -> Column:
    """Null when the leading bytes fit the format, else a message."""

    # The messages and the marks that a format begins with.
    def check(head: Column) -> Column:
        return (
            F.when((file_format == "pdf") & ~head.startswith("%PDF"), F.lit("Invalid PDF file"))
            .when((file_format == "html") & ~F.lower(head).contains("<html"), F.lit("Invalid HTML file"))
            .when((file_format == "xml") & ~head.startswith("<?xml"), F.lit("Invalid XML file"))
        )

    # Only the head is decoded; ISO-8859-1 maps every byte to one character, so positions stay byte positions.
    head = F.substring(F.ltrim(content.cast("string"), F.lit(_LEADING_BYTES)).cast("binary"), 1, HEAD_BYTES)
    return let(F.decode(head, "ISO-8859-1"), check)
