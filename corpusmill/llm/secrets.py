"""Secret scans: strong findings by pattern, weak ones by linking the parts of a credential. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from operator import eq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import col
from corpusmill.session import materialize

#: A scope is this many characters of one paragraph; the next one begins half of that later.
SCOPE_CHARS = 1000
#: Matches whose places are summed up together, so that a text of very many matches stays cheap.
SUM_CHUNK = 64

#: Kinds in the order in which they are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = 3
#: What a kind is part of: 1 identifier, 2 secret, 4 endpoint.
PART = {"assign": 2, "access": 1, "hex": 2, "identifier": 1, "secret": 2, "endpoint": 4}
#: A scope links a credential when it holds these parts.
COMPLETE = 3


def any_case(words: str) -> str:
    """The pattern with each ASCII letter in either case and no others."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
#: No letter, digit or underscore stands before.
BEGIN = r"(?<![A-Za-z0-9_])"
ASSIGN = f"({any_case('password|passwd|secret|token|api_?key')}){_NAMED}([A-Za-z0-9+/_.=-]+)"
IDENTIFIER = f"({any_case('user_?name|user|login|account|client_?id|access_?key_?id|key_?id')}){_NAMED}([A-Za-z0-9+/_.=@-]+)"
SECRET = f"({any_case('pass_?phrase|pass|pwd|pin|private_?key|access_?key|secret_?key|key|credentials?|credential|signature|auth')}){_NAMED}([A-Za-z0-9+/_.=@!#$%-]+)"
ENDPOINT = f"({any_case('host_?name|host|server|endpoint')}){_NAMED}([A-Za-z0-9_.-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
URL = r"""[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9_.:/@%?&=#-]+"""
BLANK_LINE = r"\n[\x20\t\r]*\n"

_SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def spans(text: Column, pattern: str, kind: int, may_hold: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """(start, kind, stop) of the leftmost non-overlapping matches, in code points; those that ``keep`` refuses are dropped afterwards.

    What lies between the matches and the matches themselves are cut out; their
    lengths sum up to the places, within chunks and then over the chunks.
    """
    zero = F.lit(0).cast("long")
    steps = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        # There is one more piece between than there are matches.
        lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), (keep(hit) if keep else F.lit(True)).alias("keep")),
    )

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda n, s: n + s["gap"] + F.coalesce(s["size"], zero))

    def chunk(steps: Column, c: Column) -> Column:
        return F.slice(steps, c * SUM_CHUNK + 1, F.lit(SUM_CHUNK))

    def places(steps: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / SUM_CHUNK).cast("int"))
        sums = F.transform(chunks, lambda c: total(chunk(steps, c)))
        return F.flatten(
            bound(
                sums,
                lambda sums: F.transform(
                    chunks,
                    lambda c: bound(
                        F.struct(chunk(steps, c).alias("part"), F.aggregate(F.slice(sums, F.lit(1), c), zero, lambda n, x: n + x).alias("before")),
                        lambda b: F.transform(
                            b["part"],
                            lambda s, i: bound(
                                b["before"] + total(F.slice(b["part"], F.lit(1), i)) + s["gap"],
                                lambda at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + s["size"]).alias("stop"), s["keep"].alias("keep")),
                            ),
                        ),
                    ),
                ),
            )
        )

    found = F.filter(bound(steps, places), lambda s: s["stop"].isNotNull() & s["keep"])
    return F.when(may_hold & text.rlike(pattern), F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["stop"]))).otherwise(F.array().cast(_SPAN))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _named(pattern: str, least: int, most: int = 1 << 30) -> Callable[[Column], Column]:
    return lambda hit: F.length(F.regexp_extract(hit, pattern, 2)).between(least, most)


def _told(found: Column) -> Column:
    """``kind:start:stop`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, weak, borders) of every row: strong and weak spans, and blank lines where both an identifier and a secret are there."""
    text = F.col("text")
    rows = docs.select(col("doc_id").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    named = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    mixed = lambda hit: hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")
    base = F.array_sort(
        F.concat(
            spans(text, ASSIGN, 0, named, _named(ASSIGN, 8)),
            spans(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))),
            spans(text, HEX, 2, F.lit(True)),
        )
    )
    identifier = spans(text, BEGIN + IDENTIFIER, 3, named, _named(IDENTIFIER, 3))
    rows = rows.select("doc_id", "text", base.alias("base"), identifier.alias("identifier"))
    # Without an identifier no scope is complete, and the other parts need not be looked for.
    linked = (F.size("identifier") > 0) | F.exists("base", lambda s: s["kind"] == 1)
    secret = F.concat(spans(text, BEGIN + SECRET, 4, linked & named, _named(SECRET, 4)), spans(text, ASSIGN, 4, linked & named, _named(ASSIGN, 4, 7)), spans(text, TOKEN, 4, linked, mixed))
    endpoint = F.concat(spans(text, URL, 5, linked & F.contains(text, F.lit("://"))), spans(text, BEGIN + ENDPOINT, 5, linked & named, _named(ENDPOINT, 3)))
    borders = spans(text, BLANK_LINE, -1, linked)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.concat("identifier", secret, endpoint).alias("weak"), borders.alias("borders"))


def linked(found: DataFrame, scope_chars: int = SCOPE_CHARS) -> DataFrame:
    """(row, start, kind, stop) of the weak spans that lie in a scope with an identifier and a secret.

    A weak span that overlaps an earlier one or a strong one is none. Parts and
    scopes are joined by cells: a part lies in at most two of the overlapping
    scopes of its paragraph, and only one number per scope is gathered.
    """
    events = found.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak", "borders")).alias("s")).select("row", "s.start", "s.kind", "s.stop")
    strong = F.col("kind").between(0, STRONG - 1)
    order = Window.partitionBy("row").orderBy("start", (~strong).cast("int"), F.col("stop").desc(), "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.col("start").desc(), strong.cast("int"), "stop", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    told = events.select(
        "*",
        F.sum((F.col("kind") < 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("paragraph"),
        F.max(F.when(F.col("kind") >= 0, F.col("stop"))).over(before).alias("reached"),
        F.min(F.when(strong, F.col("start"))).over(after).alias("next"),
    )
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("stop"), F.lit(True))
    parts = told.where((F.col("kind") >= 0) & (strong | free)).select("row", "paragraph", "start", "kind", "stop")
    half = scope_chars // 2
    cell = F.floor(F.col("start") / half)
    inside = parts.select("*", F.explode(F.array(cell, cell - 1)).alias("scope")).where(F.col("stop") <= F.col("scope") * half + scope_chars)
    roles = F.get(F.array(*[F.lit(PART[k]) for k in KINDS]), F.col("kind"))
    whole = inside.groupBy("row", "paragraph", "scope").agg(F.bit_or(roles).alias("parts")).where(F.col("parts").bitwiseAND(COMPLETE) == COMPLETE)
    return inside.where(F.col("kind") >= STRONG).join(whole, ["row", "paragraph", "scope"]).select("row", "start", "kind", "stop").distinct()


def secrets(docs: DataFrame, scope_chars: int = SCOPE_CHARS) -> DataFrame:
    """What ``docs`` (doc_id, text) hold of secrets, per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    Strong: an assignment to a secret's name, an access identifier, a long hex
    string. Weak: an account or key name with a value, a secret's name with a
    shorter value or a long mixed string, an address; they count only where a
    scope of one paragraph holds an identifier and a secret, strong or weak,
    that don't overlap. ``spans`` lists all by start and kind as
    ``kind:start:stop`` in code points, ``found`` holds them as structs.

    Null text counts as empty and gives no spans; null doc_ids and repeated
    rows are rows of their own. Texts are read whole, however long, and are
    neither shuffled nor written; only places are. Other columns are ignored.
    """
    found = materialize(scanned(docs), "secret-spans")
    kept = linked(found, scope_chars).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more"))
    joined = found.drop("weak", "borders").join(kept, F.col("row") == F.col("_row"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), partial(eq, i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(STRONG)]
    return joined.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(every).alias("spans"), every.alias("found"))
