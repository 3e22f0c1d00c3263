"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def where_it_has(part: str, col: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that contain ``part``; the others, which are only looked through, stay as they are."""
    return let(col, lambda c: F.when(c.contains(part), change(c)).otherwise(c))


def strip(col: Column) -> Column:
    """Remove Unicode whitespace at both ends, in one linear pass; a text without any there is only looked at."""

    def ends(c: Column) -> Column:
        white = F.lit(WHITESPACE)
        # An empty end is in every text, so an empty text counts as one to trim.
        return F.when(white.contains(F.left(c, F.lit(1))) | white.contains(F.right(c, F.lit(1))), F.trim(c, white)).otherwise(c)

    return let(col, ends)


def blank_to_null(col: Column) -> Column:
    """Empty string counts as missing."""
    return F.nullif(col, F.lit(""))


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor empty; the last one is taken as it is."""
    return F.coalesce(*[blank_to_null(c) for c in cols[:-1]], cols[-1])
