"""Text functions on hand-made rows."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import html, pii, text, xml
from corpusmill.functions.base import strip
from corpusmill.functions import xml as xml_functions
from corpusmill.functions.base import WHITESPACE, strip
from corpusmill.functions.tokens import hashing_vector, term_counts, tokens
from corpusmill.operators.extract import explode_pages, extract_fx_rates, fx_text, parse_rdf, split_quarantine, validate_files


def values(spark, inputs, expr, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v")).alias("out")).collect()]


CLEANED = {
    None: "", "": "", " ": "", "a\x00b": "a b", "a\xa0\xa0b": "a b", "a\t \tb": "a b", "a\n   b": "a\nb", "a\n\n\n\nb": "a\n\nb", "a\n \n \n b": "a\n\nb",
    "\u2003x\u3000": "x", "\x1ca\x1f": "a", "\n\n\n": "", "a \n b\t\n\tc": "a \nb \nc",
}


def test_clean_text(spark):
    assert values(spark, list(CLEANED), text.clean_text) == list(CLEANED.values())


def test_strip_knows_every_blank(spark):
    assert sorted(WHITESPACE) == sorted(c for c in map(chr, range(0x110000)) if c.isspace())
    assert values(spark, [WHITESPACE + "a b" + WHITESPACE, WHITESPACE], strip) == ["a b", ""]


def test_norm_key(spark):
    assert values(spark, [None, " AI_Act ", "MiFID-II", "É_"], text.norm_key) == ["", "ai act", "mifid ii", "é"]


def test_decode_utf8_drops_invalid_bytes(spark):
    cases = [b"ab\xff\xc3\xa9c", b"\xe2\x82", "日本".encode(), b""]
    assert values(spark, cases, text.decode_utf8, "binary") == [c.decode("utf-8", errors="ignore") for c in cases]


def test_chunk_id(spark):
    df = spark.createDataFrame([("d", 3, None, 0), ("d", None, 1, 2), (None, None, None, 1)], "d string, p int, s int, i int")
    got = [r[0] for r in df.select(text.chunk_id(*[F.col(c) for c in "dpsi"])).collect()]
    keys = ["d_3_no_section_0", "d_no_page_1_2", "no_page_no_section_1"]
    assert got == [hashlib.sha256(k.encode()).hexdigest() for k in keys]


def test_validate_files(spark):
    rows = [
        (b" \n%PDF-1.7", "pdf", True), (b"PDF", "pdf", False), (b"<!doctype html><HTML>", "html", True), (b"x" * 2000 + b"<html", "html", False),
        (b"\n<?xml version", "xml", True), (b"<a/>", "xml", False), (b"anything", "doc", True),
    ]
    df = spark.createDataFrame(rows, "content binary, file_format string, want boolean")
    assert all(r.ok == r.want and (r.file_error is None) == r.ok for r in validate_files(df).collect())


# text: (redacted with the phone before the rest, e-mail / phone / IBAN / card counts, redacted with IBAN and card first, counts)
REDACTED = {
    "": ("", (0, 0, 0, 0), "", (0, 0, 0, 0)),
    "nothing here 12": ("nothing here 12", (0, 0, 0, 0), "nothing here 12", (0, 0, 0, 0)),
    "mail a.b@c.org": ("mail [EMAIL_REDACTED]", (1, 0, 0, 0), "mail [EMAIL_REDACTED]", (1, 0, 0, 0)),
    "ends with x@y.eu": ("ends with [EMAIL_REDACTED]", (1, 0, 0, 0), "ends with [EMAIL_REDACTED]", (1, 0, 0, 0)),
    "call 6912 3456 now": ("call [PHONE_REDACTED] now", (0, 1, 0, 0), "call [PHONE_REDACTED] now", (0, 1, 0, 0)),
    "IBAN GR1601101250000000012300695.": ("IBAN GR160110125[PHONE_REDACTED].", (0, 1, 0, 0), "IBAN [IBAN_REDACTED].", (0, 0, 1, 0)),
    "iban gr1601101250000000012300695": ("iban gr160110125[PHONE_REDACTED]", (0, 1, 0, 0), "iban [IBAN_REDACTED]", (0, 0, 1, 0)),
    "card 4111-1111-1111-1111": ("card [PHONE_REDACTED]-1111", (0, 1, 0, 0), "card [CARD_REDACTED]", (0, 0, 0, 1)),
    "a@b.co b@c.co": ("[EMAIL_REDACTED] [EMAIL_REDACTED]", (2, 0, 0, 0), "[EMAIL_REDACTED] [EMAIL_REDACTED]", (2, 0, 0, 0)),
}


@pytest.mark.parametrize("mode", ["compat", "specific_first"])
def test_redaction(spark, mode):
    df = spark.createDataFrame([(c,) for c in REDACTED], "text string")
    for row in pii.redact_pii(df, mode=mode).collect():
        want, counts = REDACTED[row.text][:2] if mode == "compat" else REDACTED[row.text][2:]
        got = tuple(row.redactions[k] for k in ("email", "phone", "iban", "credit_card"))
        assert (row.text, row.redacted_text, got) == (row.text, want, counts)


def test_contains_pii(spark):
    assert values(spark, [None, *REDACTED], pii.contains_pii) == [False] + [c not in ("", "nothing here 12") for c in REDACTED]


def test_null_text_is_redacted_to_null(spark):
    row = pii.redact_pii(spark.createDataFrame([(None,)], "text string")).first()
    assert row.redacted_text is None and set(row.redactions.values()) == {0}


HTML_CASES = {
    "<body><article>a" + "<br>" * 20_000 + "b</article></body>": "a\nb",
    "<body><article><p " + " ".join(f'x{i}="y"' for i in range(10_000)) + ">t</p></article></body>": "t",
    "<html><body><article><p>a</p>\n<p>b &amp; c&lt;</p><nav>x<nav>y</nav>z</nav>tail</article><p>out</p></body></html>": "a\n\nb & c<\ntail",
    "<body><main>m<article>first</article></main></body>": "first",
    "<body><main>only main</main>rest</body>": "only main",
    '<body><div id="block-eba-theme-content"><div>in<div>n</div></div>still</div>no</body>': "in\nn\nstill",
    "<body>pre<!-- <article>no</article> -->post&#169;&#x41;&foo;&eacute;&amp;lt; a < b <b title='a>b'>bold</b></body>": "pre\npost©A&fooé&lt; a < b \nbold",
    "no body <header>h</header>text": "no body \ntext",
    "<article>unclosed <script>var x='</p>';": "unclosed",
    "<article><SCRIPT>var a='<p>';</SCRIPT>x<svg><g><svg>q</svg></g>r</svg>y</article>": "x\ny",
    "<article>a<article>b</article>c</article>d": "a\nb\nc",
    "<main></main><p>x</p>": "",
    "<nav>x</nav>": "",
    "<nav>x</nav>y<footer>z</footer>": "y",
    "<script>x</script>": "",
    "": "",
}


def test_main_text(spark):
    assert values(spark, list(HTML_CASES), html.main_text) == list(HTML_CASES.values())


RATES = (
    "<?xml version='1.0' encoding='UTF-8'?><g:E xmlns:g='u' xmlns='v'><g:subject>S &amp; t</g:subject><g:Sender><g:name>A</g:name><g:name> B </g:name></g:Sender>"
    "<Cube><Cube time='2026-01-02'><Cube currency='USD' rate='1.5'/><Cube currency=\"JPY\" rate='2'/><Cube currency='X'/><Cube currency='' rate='3'/></Cube></Cube></g:E>"
)
RATES_TEXT = "Subject: S & t\nSender: B\nDate: 2026-01-02\nEuro foreign exchange reference rates:\nUSD: 1.5\nJPY: 2"


def test_fx_text(spark):
    cases = {
        RATES: RATES_TEXT, RATES[:-6]: "S &amp; t A B", RATES + "junk": "S &amp; t A B junk", "<a>no cube</a>": "no cube", "nope": "nope",
        "<a><subject>x</subject><subject> </subject></a>": "x", "<a/>": None,
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, xml string")
    got = {r.i: r.text for r in fx_text(df).collect()}
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())


def test_fx_rates(spark):
    got = extract_fx_rates(spark.createDataFrame([(RATES,), (RATES[:-6],), (None,)], "xml string")).collect()
    assert [(str(r.rate_date), r.currency, r.rate) for r in got] == [("2026-01-02", "USD", 1.5), ("2026-01-02", "JPY", 2.0)]


@pytest.mark.parametrize(
    ("doc", "ok"),
    [("<a>x</a>", True), ("<a>", False), ("<a></b>", False), ("text", False), (" <?xml version='1.0'?><a/>", False), ("<?xml version='1.0'?>\n<!DOCTYPE a>\n<a/>", True)],
)
def test_well_formed(spark, doc, ok):
    assert values(spark, [doc], xml.is_well_formed) == [ok]


def test_parse_rdf(spark):
    about = '<rdf:Description rdf:about="http://publications.europa.eu/resource/cellar/{}"><l>{}</l>'
    good = about.format("aa-0.1", "fr") + about.format("bb-1.0006", "eng") + "<j.0:lastModificationDate t='x'> 2026-01-01 </j.0:l><j.0:title>T </j.0:title>"
    none = about.format("aa-0.1", "fr")
    ok, bad = split_quarantine(parse_rdf(spark.createDataFrame([(good,), (none,)], "rdf string")))
    assert [tuple(r) for r in ok.collect()] == [("bb-1.0006", "2026-01-01", "T")]
    assert bad.count() == 1


def test_pages_keep_their_numbers(spark):
    docs = spark.createDataFrame([("d", "one\f \f\fthree\x00"), ("e", None)], "id string, text string")
    assert [tuple(r) for r in explode_pages(docs).collect()] == [("d", 1, "one"), ("d", 4, "three")]


def test_term_counts_and_vector(spark):
    got = values(spark, ["the Cat the dog, a-1"], lambda c: term_counts(tokens(c)))[0]
    assert [(r.term, r.tf) for r in got] == [("1", 1), ("a", 1), ("cat", 1), ("dog", 1), ("the", 2)]
    vectors = values(spark, ["the cat the dog", "", None, "..."], lambda c: hashing_vector(tokens(c), 8))
    assert vectors[1:] == [[0.0] * 8] * 3
    want = [0.0] * 8
    for w in "the cat the dog".split():
        h = hashlib.md5(w.encode()).hexdigest()
        want[int(h[:8], 16) % 8] += 1 if h[8] < "8" else -1
    norm = sum(x * x for x in want) ** 0.5
    assert vectors[0] == pytest.approx([x / norm for x in want], abs=1e-6)


@pytest.mark.parametrize(
    "xml, whole",
    [
        ("<a/>", True), ("<a/><b/>", False), ("<a></a><a></a>", False), ("<a></a><b></b>", False), ("<a><a/></a>", True), ("<a><a></a><a/></a>", True), ("<a/><!-- x -->", True),
        ("<?xml version='1.0'?><!DOCTYPE a><a x='>'>t</a>\n", True), ("<a><![CDATA[</a><a>]]></a>", True), ("<a></a>text", False), ("<a></a><b></b><a></a>", False), ("<a.b></a.b>", True),
        ("<a><ab></ab></a>", True), ("<a></ab>", False), ("", False),
    ],
)
def test_a_document_has_one_root(spark, xml, whole):
    assert spark.createDataFrame([(xml,)], "x string").select(xml_functions.is_well_formed(F.col("x"))).first()[0] is whole


def test_cubes_are_looked_for_once(spark):
    doc = "<a:E xmlns:a='u'><a:name>x</a:name><Cube time=\"2024-01-02\"><Cube currency='A&amp;B' rate = \"1.5\"/><Cube currency='' rate='2'/><Cube rate='3'/></Cube></a:E>"
    docs = spark.createDataFrame([(doc,), (doc.replace("</a:E>", ""),), (None,)], "x string")
    found = docs.select(xml_functions.fx_struct(F.col("x")).alias("v"), xml_functions.fx_rates(F.col("x")).alias("r"))
    plan = docs.select(xml_functions.fx_struct(F.col("x")).alias("v"))._jdf.queryExecution().analyzed().toString()
    # One search for the tags serves the date and the rates.
    assert plan.count("Cube((?:") == 1
    rows = found.collect()
    assert [(r.v.sender, r.v.rate_date, [tuple(x) for x in r.v.rates]) for r in rows[:1]] == [("x", "2024-01-02", [("A&B", "1.5")])]
    assert (rows[0].r.rate_date, rows[0].r.rates) == (rows[0].v.rate_date, rows[0].v.rates)
    assert [(r.v, r.r) for r in rows[1:]] == [(None, None)] * 2


def test_words_are_counted_in_batches_of_rows(spark, monkeypatch):
    monkeypatch.setattr("corpusmill.functions.tokens._ROWS_COUNTED", 3)
    lists = [["b", "a", "b"], [], None, ["é", "z", "Z", "é", "é"], ["𝒜", "ﬀ", "a"], ["a"], ["b"] * 5]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, w array<string>").coalesce(1)
    counted = df.select("i", term_counts(F.col("w")).alias("c"))
    assert counted.schema["c"].dataType.simpleString() == "array<struct<term:string,tf:int>>"
    assert "ArrowEvalPython" in counted._jdf.queryExecution().executedPlan().toString()
    got = {r.i: [tuple(x) for x in r.c] for r in counted.collect()}
    assert got == {i: sorted((w, words.count(w)) for w in set(words or [])) if words else [] for i, words in enumerate(lists)}


def test_rate_lines_are_made_once_and_ends_are_looked_at_before_they_are_trimmed(spark):
    docs = spark.createDataFrame([("<a/>",)], "x string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(fx_text(docs, "x")).count(xml.SUBJECT_LABEL) == 1
    assert "CASE WHEN" in plan(docs.select(strip(F.col("x")))) and "CASE WHEN" in plan(docs.select(text.decode_utf8(F.encode("x", "UTF-8"))))


def test_texts_that_need_no_cleaning_and_those_that_do(spark):
    cases = ["", " ", "x", " x", "x ", "　x y\x85", "a  b", "a\x00b", "a\xa0\tb", "a\n b", "a\n\n\n\nb", "\n\n\n", "é  \n\n\n ü ", None]
    white = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
    assert values(spark, cases, strip) == [c if c is None else c.strip(white) for c in cases]

    def cleaned(c):
        for char in "\x00\xa0\t":
            c = c.replace(char, " ")
        return re.sub("\n{3,}", "\n\n", re.sub(" {2,}", " ", c).replace("\n ", "\n")).strip(white)

    assert values(spark, cases, text.clean_text) == [cleaned(c or "") for c in cases]
    raw = spark.createDataFrame([(b"a\xc3(\xff",), (b"ok",), ("x�y".encode(),), (None,)], "b binary")
    assert [r[0] for r in raw.select(text.decode_utf8(F.col("b"))).collect()] == ["a(", "ok", "xy", None]


@pytest.mark.parametrize(
    ("doc", "whole"),
    [("<a/><a></a>", False), ("<a x='/'></a>", True), ("<a><b></b></a >\n", True), ("<a></a><a/>", False), ("<a x='</a>'/>", False), ("<n:a xmlns:n='u'><a></a></n:a>", True), ("<a><!-- </a> --></a>", True), ("<a></a><!-- <a> --></a>", False)],
)
def test_the_end_of_the_first_element_is_the_end_of_the_document(spark, doc, whole):
    assert values(spark, [doc], xml.is_well_formed) == [whole]


def test_values_of_attributes_in_either_quote(spark):
    doc = "<r><Cube currency='\"q\"' rate=\"'\"/><Cube x=' rate=' rate='7' currency='Z'/><Cube xrate='1' currency='N'/><Cube time=''/><Cube currency='A&lt;' rate = '2'/></r>"
    found = values(spark, [doc], xml.fx_rates)[0]
    assert (found.rate_date, [tuple(r) for r in found.rates]) == ("", [('"q"', "'"), ("Z", " rate="), ("A<", "2")])
