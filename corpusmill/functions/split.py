"""Overlapping chunks of a text with native array expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.base import let, strip

# Separators in order of preference; the hard cut comes after the last.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters that advance by ``size - overlap``.

    The text is cut into strides once; a window is a stride plus the ones that
    follow, so the cost stays linear in the length of the text.
    """
    stride = size - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than size")
    span = math.ceil(size / stride)

    def build(blocks: Column) -> Column:
        # The last window is the first one that reaches the end of the text.
        length = (F.size(blocks) - 1) * stride + F.length(F.get(blocks, F.size(blocks) - 1))
        count = F.greatest(F.lit(1), F.ceil((length - overlap) / F.lit(stride)).cast("int"))
        return F.transform(
            F.slice(blocks, F.lit(1), count),
            lambda b, i: F.left(F.array_join(F.slice(blocks, i + 1, F.lit(span)), ""), F.lit(size)),
        )

    return F.when(F.length(text) > 0, let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{stride}}}"), F.lit(0)), build))


def _pieces(text: Column, separator: str) -> Column:
    """Cut before every separator; a separator stays at the head of its piece."""
    parts = F.split(text, re.sub(r"([.])", r"\\\1", separator))
    return F.filter(
        F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p))), lambda p: p != ""
    )


def _atom(text: Column, long: Column, opens: Column) -> Column:
    return F.struct(text.alias("t"), long.alias("long"), opens.alias("opens"))


def _any_long(atoms: Column) -> Column:
    """Most texts are short enough after one or two separators; their atoms are not gone through for each further one."""
    return F.exists(atoms, lambda a: a["long"])


def _refine(atoms: Column, separator: str, size: int) -> Column:
    """Cut the atoms that are still too long at one separator.

    ``opens`` marks an atom that must not be packed with the one before it:
    the first piece of a cut, a long piece, and the piece after a long one.
    """

    def cut(atom: Column) -> Column:
        def label(pieces: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                long = F.length(p) >= size
                after_long = F.coalesce(F.length(F.get(pieces, i - 1)) >= size, F.lit(True))
                return _atom(p, long, long | after_long)

            return F.transform(pieces, one)

        return F.when(atom["long"], let(_pieces(atom["t"], separator), label)).otherwise(F.array(atom))

    return F.when(_any_long(atoms), F.flatten(F.transform(atoms, cut))).otherwise(atoms)


def _hard_cut(atoms: Column, size: int, overlap: int) -> Column:
    """What no separator could shorten becomes fixed windows, each a chunk of its own."""
    cut = F.flatten(
        F.transform(
            atoms,
            lambda a: F.when(
                a["long"], F.transform(windows(a["t"], size, overlap), lambda w: _atom(w, F.lit(False), F.lit(True)))
            ).otherwise(F.array(a)),
        )
    )
    return F.when(_any_long(atoms), cut).otherwise(atoms)


def _tail(pieces: Column, limit: Column) -> Column:
    """Longest run of trailing pieces whose total length is within ``limit``."""
    zero = F.struct(F.lit(0).alias("len"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(st: Column, p: Column) -> Column:
        total = st["len"] + F.length(p)
        done = st["done"] | (total > limit)
        return F.when(done, F.struct(st["len"].alias("len"), st["n"].alias("n"), F.lit(True).alias("done"))).otherwise(
            F.struct(total.alias("len"), (st["n"] + 1).alias("n"), F.lit(False).alias("done"))
        )

    return F.aggregate(F.reverse(pieces), zero, step)


def _pack(atoms: Column, size: int, overlap: int) -> Column:
    """Fill chunks greedily; a chunk that follows within the same run starts with the tail of the last one."""
    no_text = F.array().cast("array<string>")
    zero = F.struct(no_text.alias("done"), no_text.alias("cur"), F.lit(0).alias("len"))

    def closed(st: Column) -> Column:
        return F.concat(st["done"], F.array(F.array_join(st["cur"], "")))

    def step(st: Column, a: Column) -> Column:
        n = F.length(a["t"])

        def carry(tail: Column) -> Column:
            kept = F.when(tail["n"] > 0, F.slice(st["cur"], -tail["n"], tail["n"])).otherwise(no_text)
            return F.struct(
                closed(st).alias("done"), F.concat(kept, F.array(a["t"])).alias("cur"), (tail["len"] + n).alias("len")
            )

        return (
            F.when(a["opens"], F.struct(closed(st).alias("done"), F.array(a["t"]).alias("cur"), n.alias("len")))
            .when(st["len"] + n > size, let(_tail(st["cur"], F.least(F.lit(overlap), size - n)), carry))
            .otherwise(
                F.struct(st["done"].alias("done"), F.concat(st["cur"], F.array(a["t"])).alias("cur"), (st["len"] + n).alias("len"))
            )
        )

    return F.aggregate(atoms, zero, step, closed)


def recursive_chunks(text: Column, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Chunks of at most ``size`` characters, cut at the most preferred separator that is good enough.

    A text is cut at one separator; pieces below ``size`` are packed together
    with up to ``overlap`` characters carried over, longer pieces are cut again
    at the next separator and packed on their own. Chunks are stripped, empty
    ones left out. Null or blank text gives an empty array.
    """

    def levels(atoms: Column, rest: tuple[str, ...]) -> Column:
        if rest:
            return let(_refine(atoms, rest[0], size), lambda a: levels(a, rest[1:]))
        return _pack(_hard_cut(atoms, size, overlap), size, overlap)

    def split_long(t: Column) -> Column:
        return levels(F.array(_atom(t, F.lit(True), F.lit(True))), separators)

    stripped = strip(text)
    chunks = F.when(F.length(text) < size, F.array(text)).otherwise(let(text, split_long))
    return F.when(F.length(stripped) > 0, F.filter(F.transform(chunks, strip), lambda c: c != "")).otherwise(
        F.array().cast("array<string>")
    )
