"""Ranked lexical search against plain integer arithmetic."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, Item_ID string, score double"
ITEMS = "item_id long, text string, DOC_ID int"


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counts = [(d[0], Counter(plain_terms(d[1]))) for d in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i[0], i[1]) for i in items}:
        found = []
        for doc, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_words
            score = 0
            for t in plain_terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "Straße", "A1", "a1"]
    text = lambda n: rng.choice([" ", "-", "\x00", "_", "\n"]).join(rng.choices(words, range(len(words), 0, -1), k=n))
    docs = [(i, text(rng.randint(0, 40)), "x", 1.0) for i in range(300)]
    docs += [(400, None, None, None), (401, "", "", 0.0), (402, "-- \x7f _", "", 0.0), (None, text(30), "", 0.0), (None, "w1 w2", "", 0.0)]
    docs += [docs[5], docs[5]] + [(500 + i, "w59 A1 tie", "", 0.0) for i in range(50)]
    docs.append((600, " ".join(words) * 300, "", 0.0))
    items = [(i, text(rng.randint(0, 30)), i) for i in range(30)] + [(90, None, 1), (91, "", 1), (92, "nowhere", 1), (93, "tie w1", 1), (93, "tie w1", 2), (None, "w3 w3 日本", 1)]
    return docs, items


def test_search_equals_plain_arithmetic(spark, tables):
    docs, items = tables
    found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, ITEMS))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(docs, items)


def test_small_tiles_groups_and_windows_give_the_same(spark, tables, monkeypatch):
    docs, items = tables
    for name, value in (("GROUP_PAIRS", 120), ("ITEM_TILE", 4), ("DOC_TILE", 7)):
        monkeypatch.setattr(lexical, name, value)
    found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k=5)
    assert got(found) == brute(docs, items, 5)


def test_empty_tables_give_no_rows(spark, tables):
    docs, items = spark.createDataFrame(tables[0], DOCS), spark.createDataFrame(tables[1], ITEMS)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "TEXT_WINDOW", 11)
    text = "Abc äöü 日本語日本語 x " * 400 + "long" * 5000 + ",END"
    assert [t.decode() for some in lexical.terms(text.encode()) for t in some] == plain_terms(text)
    assert list(lexical.terms(None)) == [] and [t for some in lexical.terms(b"") for t in some] == []


def test_tiles_are_exact_for_large_weights():
    rng = np.random.default_rng(1)
    items = [{int(t): int(rng.integers(1, 1 << 45)) for t in rng.choice(5000, 3000, replace=False)} for _ in range(3)]
    tile = lexical.ItemTile(items, rng.integers(1, 100, 5000))
    row, term = np.repeat(np.arange(4), 2500), np.concatenate([rng.choice(5000, 2500, replace=False) for _ in range(4)])
    impact = rng.integers(900_000, 999_999, len(row))
    wanted = [[sum(item.get(int(t), 0) * int(v) for t, v in zip(term[row == d], impact[row == d])) % (1 << 64) for d in range(4)] for item in items]
    assert (tile.scores(row, term, impact, 4, 5000).astype(np.uint64).tolist()) == wanted
