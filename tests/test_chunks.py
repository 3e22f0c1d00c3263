"""The chunker against a plain recursive reading of its rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.split import SEPARATORS, recursive_chunks, windows
from corpusmill.operators.chunk import chunk_pages


def pack(pieces, size, overlap):
    chunks, cur, total = [], [], 0
    for piece in pieces:
        if cur and total + len(piece) > size:
            chunks.append("".join(cur))
            while cur and (total > overlap or total + len(piece) > size):
                total -= len(cur.pop(0))
        cur.append(piece)
        total += len(piece)
    chunks.append("".join(cur))
    return [c.strip() for c in chunks if c.strip()]


def split_plainly(text, separators, size, overlap):
    level = next((i for i, s in enumerate(separators) if s in text), None)
    if level is None:
        return pack(list(text), size, overlap)
    head, *rest = text.split(separators[level])
    out, run = [], []
    for piece in [p for p in [head, *[separators[level] + r for r in rest]] if p]:
        if len(piece) < size:
            run.append(piece)
            continue
        out += pack(run, size, overlap) if run else []
        run = []
        out += split_plainly(piece, separators[level + 1 :], size, overlap)
    return out + (pack(run, size, overlap) if run else [])


def random_texts(n, seed):
    rng = random.Random(seed)
    units = [" ", "\n", "\n\n", ". ", "; ", ", ", "x", "😀b"]
    for _ in range(n):
        width = rng.choice([1, 3, 8, 60])
        yield "".join(rng.choice([*units, "a" * rng.randint(1, width), "é" * rng.randint(1, width)]) for _ in range(rng.randint(0, 80)))


EDGES = ["", " ", "\n\n", "x" * 40, "x" * 41, "x" * 39, " " + "x" * 39, "\n" * 90, "a. " * 30, "é" * 200, "\x01a b\x01" * 20]


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (25, 20), (10, 0), (100, 30)])
def test_chunks_follow_the_rules(spark, size, overlap):
    texts = [*EDGES, *random_texts(600, size)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in df.select("t", recursive_chunks(F.col("t"), size, overlap).alias("got")).collect():
        want = split_plainly(row.t, SEPARATORS, size, overlap) if row.t.strip() else []
        assert row.got == want
        assert all(0 < len(c) <= size for c in row.got)


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (25, 20), (10, 0)])
def test_windows(spark, size, overlap):
    texts = [t for t in [*EDGES, *random_texts(200, 5)] if t]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in df.select("t", windows(F.col("t"), size, overlap).alias("got")).collect():
        stride = size - overlap
        assert row.got == [row.t[i : i + size] for i in range(0, max(1, len(row.t) - overlap), stride)]
        assert row.got[0] + "".join(w[overlap:] for w in row.got[1:]) == row.t


def test_null_and_blank_text_give_no_rows(spark):
    pages = spark.createDataFrame([("a", None), ("b", " \n "), ("c", "text")], "document_id string, text string")
    rows = chunk_pages(pages).collect()
    assert [(r.document_id, r.chunk_index, r.chunk_text, r.chunk_length) for r in rows] == [("c", 0, "text", 4)]


def test_one_long_text_stays_whole(spark):
    text = "word " * 200_000
    got = spark.createDataFrame([(text,)], "t string").select(recursive_chunks(F.col("t"), 1000, 200).alias("c")).first().c
    assert len(got) > 1200 and max(map(len, got)) <= 1000
