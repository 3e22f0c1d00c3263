"""Repeated passages: every run of several consecutive sentences is hashed, and all but the first of equal runs are cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import col, fresh, same, slices, text_key

#: Consecutive sentences in a run.
RUN = 3
#: A run of fewer words is no passage: chance and stock phrases repeat it. It grows by further sentences until it holds so many.
LEAST_WORDS = 12
#: The fewest words in a sentence (of a text that has so many), so that any RUN of them hold LEAST_WORDS; twice as many less one are the most.
SENTENCE_WORDS = 4
#: A repeated stretch of fewer words stays where it is, unless it is the whole text: stock phrases and lines are no passages.
#: Of repeated passages of 51 words between foreign ones 30 words at least lay in common runs, in 2,400 trials.
LEAST_CUT_WORDS = 25
#: Bytes of texts within which a task settles repeats before it passes runs on.
SLICE_BYTES = 4 << 20

# Scripts without spaces: each character counts as a word.
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_MARKS, _CLOSING = frozenset(".!?;:,…。！？；，、"), "\"'»”’)]」』"
_WORD = re.compile(r"\S+\s*")
_DENSE_WORD = re.compile(rf"(?:[{_DENSE}]|[^\s{_DENSE}]+)[.!?;:,…。！？；，、\"'»”’)\]」』]*\s*")

_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def sentences(text: str) -> tuple[list[int], list[int], list[bytes]]:
    """Ends, words and normalised bytes of each sentence; white space belongs to the sentence before it.

    A sentence here is some of the words of a clause, or some short clauses. It
    ends after each word that goes before the SENTENCE_WORDS - 1 words on either
    side: words with a mark at their end first, then by hash. Where two such
    words are far apart, the first of them in order among those allowed ends the
    next. So borders follow from the words nearby, and a passage shares its own
    with its other copies in any surroundings. White space between words has no
    say, so a copy that is wrapped elsewhere is cut alike.
    """
    dense = not text.isascii() and _HAS_DENSE.search(text)
    found = (_DENSE_WORD if dense else _WORD).findall(text)
    n, m = len(found), SENTENCE_WORDS
    if not n:
        return ([len(text)], [0], [b""]) if text else ([], [], [])
    last = [-1]
    bits = list(map(str.rstrip, found)) if dense else text.split()
    if n >= 2 * m:
        keys = np.fromiter(map(xxhash.xxh32_intdigest, bits), np.int64, n)
        keys[[w[-1] in _MARKS or (w[-1] in _CLOSING and w.rstrip(_CLOSING)[-1:] in _MARKS) for w in bits]] -= 1 << 32
        windows = n - 2 * m + 2
        mid = keys[m - 1 : m - 1 + windows]
        first = np.ones(windows, bool)
        for d in range(1, m):
            first &= (mid <= keys[m - 1 - d :][:windows]) & (mid < keys[m - 1 + d :][:windows])
        anchors = np.flatnonzero(first) + m - 1
        order = keys[::-1].tolist()
        for b in [*anchors[anchors < n - m].tolist(), n - 1]:
            a = last[-1]
            while b - a >= 2 * m:
                stop = min(a + 2 * m - 1, b - m)
                allowed = order[n - 1 - stop : n - a - m]
                a = stop - allowed.index(min(allowed))
                last.append(a)
            last.append(b)
    else:
        last.append(n - 1)
    places = np.cumsum(np.fromiter(map(len, found), np.int64, n))
    places += len(text) - places[-1]
    ends = places[last[1:]].tolist()
    if dense:
        parts = [" ".join(text[a:b].split()).encode() for a, b in zip([0, *ends], ends, strict=False)]
    else:
        parts = [" ".join(bits[a + 1 : b + 1]).encode() for a, b in zip(last, last[1:], strict=False)]
    return ends, np.diff(last).tolist(), parts


def stretches(words: list[int], run: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence of each run and the one after its last: ``run`` sentences, and more until they hold ``least_words``.
    A text of fewer sentences is a run as a whole, if it holds as many words."""
    counts = np.cumsum([0, *words])
    n = len(words)
    if n < run:
        first = np.zeros(int(counts[-1] >= least_words), np.int64)
        return first, first + n
    first = np.arange(n - run + 1)
    stop = np.maximum(first + run, np.searchsorted(counts, counts[first] + least_words))
    return first[stop <= n], stop[stop <= n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def runs(text: str, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, two 64-bit hashes) of every run of sentences."""
    _, words, parts = sentences(text)
    first, stop = stretches(words, run, least_words)
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    single = b"".join(map(xxhash.xxh3_128_digest, parts))
    pair = np.frombuffer(single, np.uint64).reshape(-1, 2)
    out = []
    for c in range(2):
        h = np.zeros(len(first), np.uint64)
        for i in range(int((stop - first).max())):
            go = np.flatnonzero(first + i < stop) if i >= run else slice(min(len(first), len(parts) - i))
            h[go] = _mixed(h[go] * _MULTIPLY[c] + pair[first[go] + i, c])
        out.append(h)
    return first.astype(np.int32), out[0], out[1]


def repeated(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, tk, at): runs that begin at sentence ``at`` and are not the first of their kind by (doc_id, tk, at).

    A run that repeats within a task's slice of rows is known not to be first
    and is sent on under a key of its own; only each slice's first is gathered
    by hash. So the rows that meet for one passage follow the number of slices,
    not of documents that hold it.
    """
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_key(col("text")).alias("tk"), col("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_pylist() for i in (0, 1))
            sizes = [n or 0 for n in pa.compute.binary_length(batch.column(2)).to_pylist()]
            for lo, hi in slices(sizes, SLICE_BYTES):
                order = sorted(range(lo, hi), key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i]))
                found = [runs(t or "", run, least_words) for t in batch.column(2).slice(lo, hi - lo).to_pylist()]
                found = [found[i - lo] for i in order]
                counts = [len(f[0]) for f in found]
                if not sum(counts):
                    continue
                at, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
                row = np.repeat(np.array(order), counts)
                # rows with equal doc_id and text are one document: they hold each other's passages at the same places
                same_doc = np.array([0] + [int((ids[a], keys[a]) != (ids[b], keys[b])) for a, b in zip(order, order[1:], strict=False)]).cumsum()
                place = np.repeat(same_doc, counts)
                by = np.lexsort((at, place, h2, h1))
                a, b = by[1:], by[:-1]
                equal = (h1[a] == h1[b]) & (h2[a] == h2[b])
                tied = equal & (place[a] == place[b]) & (at[a] == at[b])
                later = np.zeros(len(at), bool)
                first = np.maximum.accumulate(np.where(np.concatenate([[True], ~equal]), np.arange(len(by)), 0))
                later[by] = (place[by] != place[by[first]]) | (at[by] != at[by[first]])
                drop = np.zeros(len(at), bool)
                drop[a[tied]] = True
                h1 = np.where(later, _mixed(h1 + np.uint64(1) + place.astype(np.uint64) * _MULTIPLY[0] + at.astype(np.uint64)), h1)
                mine = ~drop
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[mine].view(np.int64)),
                        pa.array(h2[mine].view(np.int64)),
                        batch.column(0).take(pa.array(row[mine])),
                        batch.column(1).take(pa.array(row[mine])),
                        pa.array(at[mine]),
                        pa.array(later[mine]),
                    ],
                    names=["h1", "h2", "doc_id", "tk", "at", "later"],
                )

    found = rows.mapInArrow(work, "h1 long, h2 long, doc_id long, tk long, at int, later boolean")
    rank = F.rank().over(Window.partitionBy("h1", "h2").orderBy(F.col("later"), F.col("doc_id").asc_nulls_first(), "tk", "at"))
    return found.withColumn("place", rank).where(F.col("later") | (F.col("place") > 1)).select("doc_id", "tk", "at")


def long_enough(gone: np.ndarray, words: list[int], least: int) -> np.ndarray:
    """``gone`` without the stretches of fewer than ``least`` words; all of a text is always enough."""
    if gone.all():
        return gone
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    counts = np.cumsum([0, *words])
    out = gone.copy()
    for a, b in edges.reshape(-1, 2).tolist():
        if counts[b] - counts[a] < least:
            out[a:b] = False
    return out


def without_repeats(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, spans: str | None = None, least_cut: int = LEAST_CUT_WORDS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text), each text without the sentences that a repeated run covers.

    Stretches of fewer than ``least_cut`` words are left, unless nothing else is in the text. Very long texts are cut like any other.

    Of equal runs the one with the smallest (doc_id, text hash, place) stays,
    null ids first, also within one document. Rows that repeat both doc_id and
    text are one document and are treated alike. Null and empty texts stay as
    they are; a text that repeats whole becomes empty, its row stays. n_chars,
    where present, follows the text; other columns stay. ``spans`` names an
    added column with the cut character ranges (start, end) of the old text.
    """
    k_id, k_text, k_at = fresh(docs, "_k_id"), fresh(docs, "_k_text"), fresh(docs, "_k_at")
    cuts = repeated(docs, run, least_words).groupBy("doc_id", "tk").agg(F.collect_set("at").alias("ats")).select(F.col("doc_id").alias(f"{k_id}c"), F.col("tk").alias(f"{k_text}c"), F.col("ats").alias(k_at))
    keyed = docs.select("*", col("doc_id").cast("long").alias(k_id), text_key(col("text")).alias(k_text))
    joined = keyed.join(cuts, same(F.col(k_id), F.col(f"{k_id}c")) & same(F.col(k_text), F.col(f"{k_text}c")), "left").drop(f"{k_id}c", f"{k_text}c", k_id, k_text)
    names = joined.columns
    text_at, cut_at = docs.columns.index("text"), names.index(k_at)
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    from pyspark.sql.types import ArrayType, LongType, StructType

    schema = StructType(list(docs.schema.fields))
    if spans:
        schema = schema.add(spans, ArrayType(StructType().add("start", LongType()).add("end", LongType())))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = batch.column(text_at), batch.column(cut_at)
            new, ranges = [], []
            for i in range(len(texts)):
                ats = cut[i].as_py()
                if not ats:
                    new.append(texts[i].as_py())
                    ranges.append([])
                    continue
                text = texts[i].as_py()
                ends, words, _ = sentences(text)
                stops = dict(zip(*(x.tolist() for x in stretches(words, run, least_words)), strict=True))
                gone = np.zeros(len(ends), bool)
                for a in ats:
                    gone[a : stops[a]] = True
                gone = long_enough(gone, words, least_cut)
                starts, kept, out = [0, *ends[:-1]], [], []
                for g, s, e in zip(gone.tolist(), starts, ends, strict=True):
                    if not g:
                        kept.append(text[s:e])
                    elif out and out[-1]["end"] == s:
                        out[-1]["end"] = e
                    else:
                        out.append({"start": s, "end": e})
                new.append("".join(kept))
                ranges.append(out)
            columns = [batch.column(i) for i in range(len(names)) if i != cut_at]
            columns[text_at] = pa.array(new, type=texts.type)
            if chars_at is not None:
                old = columns[chars_at].to_pylist()
                columns[chars_at] = pa.array([len(t) if r else o for t, r, o in zip(new, ranges, old, strict=True)], type=columns[chars_at].type)
            if spans:
                columns.append(pa.array(ranges, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return joined.mapInArrow(trim, schema)
