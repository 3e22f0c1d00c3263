"""Main-content text of HTML pages with native string expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.base import let
from corpusmill.functions.text import clean_text

# Elements that never carry content, and the preferred content roots.
DROPPED_RAW_ELEMENTS = ("script", "style")
DROPPED_ELEMENTS = ("noscript", "svg", "header", "footer", "nav")
CONTENT_DIV_ID = "block-eba-theme-content"

_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"""<[a-zA-Z/!?](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*>"""
# Stands for a removed element: it still separates the texts around it.
_GAP = "<gap>"


def _drop_raw(html: Column, name: str) -> Column:
    """Script and style hold raw text up to their end tag."""
    return F.regexp_replace(html, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)", F.lit(_GAP))


def _drop_balanced(html: Column, name: str) -> Column:
    """Remove an element together with elements of the same name nested in it.

    The text is cut before each start or end tag of that name, so the fold runs
    over a handful of parts; a part is kept only outside of the element. The gap
    in front keeps a tag at the very start from being taken for text.
    """

    def fold(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.array(F.get(parts, F.lit(0))).alias("kept"))

        def step(st: Column, part: Column) -> Column:
            closing = part.startswith("</")
            depth = F.when(closing, F.greatest(st["depth"] - 1, F.lit(0))).otherwise(st["depth"] + 1)
            outside = closing & (st["depth"] <= 1)
            rest = F.regexp_replace(part, r"(?s)\A[^>]*>", F.lit(_GAP))
            return F.struct(
                depth.alias("depth"),
                F.when(outside, F.concat(st["kept"], F.array(rest))).otherwise(st["kept"]).alias("kept"),
            )

        return F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda st: st["kept"]), "")

    return F.when(
        html.rlike(rf"(?i)<{name}\b"), let(F.split(F.concat(F.lit(_GAP), html), rf"(?i)(?=</?{name}\b)"), fold)
    ).otherwise(html)


def _inner(html: Column, name: str, open_tag: str) -> Column:
    """Content of the first element that starts with ``open_tag``, up to its own end tag."""

    def fold(pieces: Column) -> Column:
        # Piece i ends at the i-th end tag; the element ends where all starts are closed.
        opened = F.transform(pieces, lambda p: F.regexp_count(p, F.lit(rf"(?i)<{name}\b")))
        zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

        def step(st: Column, o: Column) -> Column:
            depth = st["depth"] + o - 1
            return F.when(st["done"], st).otherwise(
                F.struct(depth.alias("depth"), (st["n"] + 1).alias("n"), (depth <= 0).alias("done"))
            )

        taken = F.aggregate(opened, zero, step, lambda st: st["n"])
        return F.array_join(F.slice(pieces, F.lit(1), taken), f"</{name}>")

    rest = F.get(F.split(html, open_tag, 2), F.lit(1))
    return let(F.split(rest, rf"(?i)</{name}\s*>"), fold)


def _content_root(html: Column) -> Column:
    article, main, body = (rf"(?i)<{n}\b[^>]*>" for n in ("article", "main", "body"))
    div = rf"""(?i)<div\b[^>]*\bid\s*=\s*["']?{CONTENT_DIV_ID}["'\s>][^>]*>?"""
    return (
        F.when(html.rlike(article), _inner(html, "article", article))
        .when(html.rlike(main), _inner(html, "main", main))
        .when(html.rlike(div), _inner(html, "div", div))
        .when(html.rlike(body), _inner(html, "body", body))
        .otherwise(html)
    )


def _entity_table() -> Column:
    """Named character references of HTML 5, taken from the Python standard library."""
    names = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
    # One constant that the optimizer folds into a map literal.
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def unescape(col: Column) -> Column:
    """Replace character references once, left to right; unknown names keep their "&name"."""
    # The names that nearly every page is limited to.
    common = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "middot": "·"}
    common_map = F.create_map(*[F.lit(x) for pair in common.items() for x in pair])

    def decode(part: Column, i: Column) -> Column:
        ref = F.regexp_extract(part, r"\A(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?", 1)
        rest = F.regexp_replace(part, r"\A(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?", F.lit(""))
        hexa = F.regexp_extract(ref, r"\A#[xX](.+)", 1)
        digits = F.when(hexa != "", F.lpad(hexa, 8, "0")).otherwise(
            F.lpad(F.hex(F.regexp_extract(ref, r"\A#([0-9]{1,9})", 1).try_cast("long")), 8, "0")
        )
        number = F.when(F.length(hexa) <= 8, F.decode(F.unhex(digits), "UTF-32"))
        named = F.coalesce(F.try_element_at(common_map, ref), F.try_element_at(_entity_table(), ref), F.concat(F.lit("&"), ref))
        value = F.when(ref == "", F.lit("&")).when(ref.startswith("#"), F.coalesce(number, F.lit("\ufffd"))).otherwise(named)
        return F.when(i == 0, part).otherwise(F.concat(value, rest))

    return F.when(col.contains("&"), F.array_join(F.transform(F.split(col, "&"), decode), "")).otherwise(col)


def text_nodes(html: Column) -> Column:
    """Texts between tags, one per line; a node of blanks only shrinks to one blank or newline."""
    nodes = F.filter(F.split(html, _TAG), lambda t: t != "")
    ascii_blank = F.lit("\t\n\x0b\x0c\r ")
    shrunk = F.transform(
        nodes,
        lambda t: F.when(F.trim(t, ascii_blank) != "", t).when(t.contains("\n"), F.lit("\n")).otherwise(F.lit(" ")),
    )
    return F.array_join(F.transform(shrunk, unescape), "\n")


def main_text(html: Column) -> Column:
    """Readable text of the page's main content, cleaned; "" when nothing is left."""
    out = F.regexp_replace(html, _COMMENT, F.lit(_GAP))
    for name in DROPPED_RAW_ELEMENTS:
        out = _drop_raw(out, name)

    def balanced(col: Column, names: tuple[str, ...]) -> Column:
        return let(_drop_balanced(col, names[0]), lambda c: balanced(c, names[1:])) if names else _finish(col)

    def _finish(col: Column) -> Column:
        return clean_text(text_nodes(_content_root(col)))

    return let(out, lambda c: balanced(c, DROPPED_ELEMENTS))
