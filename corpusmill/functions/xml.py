"""Exchange-rate XML and RDF metadata with native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.base import blank_to_null, let, strip
from corpusmill.functions.text import strip_tags

# Line labels of the rate text.
SUBJECT_LABEL = "Subject: "
SENDER_LABEL = "Sender: "
DATE_LABEL = "Date: "
RATES_HEADING = "Euro foreign exchange reference rates:"

# Any well-formed document fits; only the parser's verdict and stray text are wanted.
_PROBE_SCHEMA = "struct<_VALUE string, _corrupt_record string>"
_ATTR = r"""\s{name}\s*=\s*("[^"]*"|'[^']*')"""
# The same without the quotes.
_ATTR_VALUE = r"""\s{name}\s*=\s*["']((?<=")[^"]*+(?=")|(?<=')[^']*+(?='))"""


# A tag's inside, quoted values with a ">" in them included. Nothing is given back, so a tag is gone through once.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


# A first element that isn't empty and the only end tag of whose name is the last tag.
_ENDS_ONCE = r"\A\s*<([^\s/>]+)(?=[\s>])" + _INSIDE + r"(?<!/)>[^<]*+(?:<(?!/\1[\s>])[^<]*+)*+</\1\s*>\s*\z"


def _has_one_root(body: Column) -> Column:
    """Whether a well-formed run of elements is a single one: its first element closes only once, and nothing follows.

    Mostly no other element has the name of the first one, which one search shows; else the tags of that name are counted.
    """
    bare = F.when(body.rlike(r"<[!?]"), F.regexp_replace(body, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", F.lit(""))).otherwise(body)

    def check(doc: Column) -> Column:
        name = F.concat(F.lit(r"\Q"), F.regexp_extract(doc, r"\A\s*<([^\s/>]+)", 1), F.lit(r"\E"))
        tags = F.regexp_extract_all(doc, F.concat(F.lit("(</?"), name, F.lit(r"(?=[\s/>])" + _INSIDE + ">)")), F.lit(1))
        steps = F.transform(tags, lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))
        walked = F.aggregate(
            steps, start, lambda at, x: F.struct((at["depth"] + x).alias("depth"), (at["closed"] + F.when((at["depth"] + x == 0), 1).otherwise(0)).alias("closed"))
        )
        ends = doc.rlike(r"\A\s*<" + _INSIDE + r"(?<=/)>\s*\z") | F.call_function("regexp_like", doc, F.concat(F.lit("</"), name, F.lit(r"\s*>\s*\z")))
        return F.when(doc.rlike(_ENDS_ONCE), F.lit(True)).otherwise((walked["closed"] == 1) & ends)

    return let(bare, check)


def is_well_formed(xml: Column) -> Column:
    """False for text the XML parser rejects; such rows never fail the job.

    The parser stops at the end of the first element. Wrapping the document
    makes it read everything, and text next to the root element shows up as the
    wrapper's own value. Several elements next to each other are no document.
    """
    body = F.when(xml.startswith("<?xml"), F.regexp_replace(xml, r"(?s)\A<\?xml\s.*?\?>", F.lit(""))).otherwise(xml)
    body = let(body, lambda b: F.when(b.contains("<!DOCTYPE"), F.regexp_replace(b, r"(?s)\A\s*<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", F.lit(""))).otherwise(b))

    def check(body: Column) -> Column:
        probe = F.from_xml(F.concat(F.lit("<whole_document>"), body, F.lit("</whole_document>")), _PROBE_SCHEMA, {"mode": "PERMISSIVE"})
        return let(probe, lambda p: p["_corrupt_record"].isNull() & p["_VALUE"].isNull()) & body.rlike(r"\A\s*<") & _has_one_root(body)

    return F.coalesce(let(body, check), F.lit(False))


def _without_comments(xml: Column) -> Column:
    return F.when(xml.contains("<!--"), F.regexp_replace(xml, r"(?s)<!--.*?-->", F.lit(""))).otherwise(xml)


def _unescape_xml(col: Column) -> Column:
    """The five predefined entities, "&amp;" last."""
    out = col
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(col.contains("&"), out).otherwise(col)


def _last_text(xml: Column, name: str) -> Column:
    """Text of the last element of that local name that has any text."""
    found = F.regexp_extract_all(xml, F.lit(rf"<(?:[\w.-]++:)?+{name}(?:\s[^>]*+)?+>([^<]++)<"), F.lit(1))
    return let(F.try_element_at(found, F.lit(-1)), lambda t: strip(_unescape_xml(t)))


def _attr(tag: Column, name: str) -> Column:
    """Attribute value with either kind of quote; null when absent."""

    def value(quoted: Column) -> Column:
        return F.when(quoted != "", let(F.substr(quoted, F.lit(2), F.length(quoted) - 2), _unescape_xml))

    return F.when(tag.contains(name), let(F.regexp_extract(tag, _ATTR.format(name=name), 1), value))


def _cube_tags(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"""<(?:[\w.-]++:)?+Cube((?:\s++[\w.:-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'))*+)\s*+/?>"""), F.lit(1))


def _rates(cubes: Column) -> Column:
    """rate_date and the rates in document order, of the attributes of all Cube tags."""
    dates = F.transform(F.filter(cubes, lambda c: c.rlike(_ATTR.format(name="time"))), lambda c: _attr(c, "time"))

    def both(raw: Callable[[Column, str], Column]) -> Callable[[Column], Column]:
        return lambda c: F.struct(*[raw(c, name).alias(name) for name in ("currency", "rate")])

    # An attribute that is not there reads as an empty one, and neither makes a rate.
    found = F.filter(
        F.transform(cubes, both(lambda c, name: F.regexp_extract(c, _ATTR_VALUE.format(name=name), 1))), lambda r: (r["currency"] != "") & (r["rate"] != "")
    )
    rates = F.transform(found, both(lambda r, name: _unescape_xml(r[name])))
    return F.struct(F.try_element_at(dates, F.lit(-1)).alias("rate_date"), rates.alias("rates"))


def fx_rates(xml: Column) -> Column:
    """rate_date and rates alone, as in ``fx_struct``; null for malformed text."""
    return F.when(is_well_formed(xml), let(_cube_tags(_without_comments(xml)), _rates))


def fx_struct(xml: Column) -> Column:
    """subject, sender, rate_date and the rates in document order; null for malformed text."""

    def read(doc: Column) -> Column:
        def fields(found: Column) -> Column:
            return F.struct(
                _last_text(doc, "subject").alias("subject"),
                _last_text(doc, "name").alias("sender"),
                found["rate_date"].alias("rate_date"),
                found["rates"].alias("rates"),
            )

        return let(let(_cube_tags(doc), _rates), fields)

    return F.when(is_well_formed(xml), let(_without_comments(xml), read))


def fx_lines(fx: Column) -> Column:
    """Readable lines for one parsed rate document; "" when nothing was found."""

    def labelled(label: str, col: Column) -> Column:
        return F.concat(F.lit(label), blank_to_null(col))

    return F.concat_ws(
        "\n",
        labelled(SUBJECT_LABEL, fx["subject"]),
        labelled(SENDER_LABEL, fx["sender"]),
        labelled(DATE_LABEL, fx["rate_date"]),
        F.when(F.size(fx["rates"]) > 0, F.lit(RATES_HEADING)),
        F.transform(fx["rates"], lambda r: F.concat(r["currency"], F.lit(": "), r["rate"])),
    )


def xml_text_or_tags_removed(fx: Column, xml: Column) -> Column:
    """Rate lines, or the text without tags when the document holds none."""
    return F.coalesce(let(fx_lines(fx), blank_to_null), strip_tags(xml))


# Shape of the publisher's RDF metadata.
_RDF_BLOCK = "<rdf:Description"
_RDF_ENGLISH = ">en<|>eng<"
_RDF_EXPRESSION = r'rdf:about="http://publications\.europa\.eu/resource/cellar/([a-f0-9-]+\.\d+)"'
_RDF_MODIFIED = r"lastModificationDate[^>]*>([^<]+)</j"
_RDF_TITLE = r"<j\.0:title>([^<]+)</j\.0:title>"


def rdf_expression_id(rdf: Column) -> Column:
    """Id in the first English block that names one; null when there is none."""
    ids = F.transform(F.split(rdf, _RDF_BLOCK), lambda b: F.when(b.rlike(_RDF_ENGLISH), blank_to_null(F.regexp_extract(b, _RDF_EXPRESSION, 1))))
    return F.try_element_at(F.array_compact(ids), F.lit(1))


def _rdf_value(rdf: Column, pattern: str) -> Column:
    return F.when(rdf.rlike(pattern), strip(F.regexp_extract(rdf, pattern, 1)))


def rdf_modified(rdf: Column) -> Column:
    return _rdf_value(rdf, _RDF_MODIFIED)


def rdf_title(rdf: Column) -> Column:
    return _rdf_value(rdf, _RDF_TITLE)
