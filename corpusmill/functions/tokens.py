"""Tokens, per-text term counts and the hashing vector."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(col: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(col), TOKEN_BREAK), "")


def term_counts(toks: Column) -> Column:
    """array<struct<term, tf>> sorted by term; empty for null. Row-local: the words of many rows are numbered in their order and counted as numbers."""

    def part(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        words, order = coded.dictionary, pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        at = np.repeat(np.arange(len(lists)) * len(words), lengths) + place[coded.indices.to_numpy()]
        at.sort()
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        counts = np.diff(starts, append=len(at)).astype(np.int32)
        row, word = np.divmod(at[starts], max(1, len(words)))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lists)))]).astype(np.int32)
        terms = pa.StructArray.from_arrays([words.take(pa.array(order[word])), pa.array(counts)], ["term", "tf"])
        return pa.ListArray.from_arrays(offsets, terms)

    def counts(lists: pa.Array) -> pa.Array:
        out = [part(lists.slice(start, _ROWS_COUNTED)) for start in range(0, len(lists), _ROWS_COUNTED)]
        return pa.concat_arrays(out or [part(lists)])

    return F.arrow_udf(counts, "array<struct<term:string,tf:int>>")(toks)


# Rows whose words are numbered together.
_ROWS_COUNTED = 2_000
# Words whose places a task remembers, and numbers of vectors that it works on at a time.
_KNOWN_WORDS = 200_000
_CELLS_HELD = 500_000


def _place(term: str, dims: int) -> int:
    """Bucket and sign of a word in one number; odd ones count down."""
    digest = hashlib.md5(term.encode()).hexdigest()
    return int(digest[:8], 16) % dims * 2 + (digest[8] >= "8")


def hashing_vector(toks: Column, dims: int) -> Column:
    """Signed feature hashing to a unit vector (array<float>); all zero when words cancel out or there are none, null counted as none.

    md5 keeps the vector reproducible in any engine. Counts are whole numbers,
    so the sums do not depend on their order. A word is hashed once per task,
    not once per occurrence; only the words leave the row for the Arrow worker.
    """
    known: dict[str, int] = {}

    def units(lists: pa.Array) -> np.ndarray:
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(known) + len(words) > _KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = _place(w, dims)
        cells = np.array([known[w] for w in words], np.int64)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        at = np.repeat(np.arange(len(lists)) * (2 * dims), lengths) + cells[coded.indices.to_numpy()]
        counts = np.bincount(at, minlength=len(lists) * 2 * dims).reshape(len(lists), dims, 2)
        sums = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
        norm = np.sqrt((sums * sums).sum(1))
        return (sums / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)

    def vectors(lists: pa.Array) -> pa.Array:
        out, step = [], max(1, _CELLS_HELD // dims)
        for start in range(0, len(lists), step):
            part = lists.slice(start, step)
            offsets = np.arange(len(part) + 1, dtype=np.int32) * dims
            out.append(pa.ListArray.from_arrays(offsets, pa.array(units(part).ravel())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float32()))

    return F.arrow_udf(vectors, "array<float>")(toks)
