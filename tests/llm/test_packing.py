"""Packing: ids against the tokenizer library, places against the rules."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from corpusmill.llm import packing
from corpusmill.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", " a", "a ", "\n", "a \n b", "a  b", "a  b", "a  b", "a\x1c b", "<|endoftext|> b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x<|endoftext|>\n", "<|<|endoftext|>|>", "it's 's 'll", "a 'll b", "é　 a", "x" * 500]
    texts += ["".join(rng.choice(" \n\tab1.,'s \x1cé漢😀") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choice("abé1.,'s") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 12))) for _ in range(1000)]
    ids = packing.ByteLevelIds(tokenizer_file())
    for t in texts:
        assert list(np.frombuffer(ids.encode(t), "<u4")) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_strings_of_added_tokens_may_be_text(tokenizer):
    plain = packing.ByteLevelIds(tokenizer_file(), added_as_text=True).encode("a <|endoftext|> b")
    assert 50256 not in np.frombuffer(plain, "<u4") and tokenizer.decode(list(np.frombuffer(plain, "<u4")), skip_special_tokens=False) == "a <|endoftext|> b"


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 1000)
    ids = packing.ByteLevelIds(tokenizer_file())
    for i in range(50):
        ids.encode(f"a b{i} c{i} d{i}")
    assert 0 < len(ids.words) <= 6 and ids.words.bytes <= 1300


def test_a_very_long_text_and_its_pieces(spark, tokenizer):
    text = "word é\n " * 200_000
    docs = spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string")
    got = packing.packed(docs, tokenizer_file()).collect()
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == len(ids) and max(r["length"] for r in got) <= 2048
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == len(tokenizer.encode("x" * 300_000, add_special_tokens=False).ids) + 1


def places(runs):
    bins, seen = {}, {}
    for size, rank, items, first, per, offset in runs:
        assert items % per == 0 and rank == seen.get(size, 0)
        for x in range(items):
            bins.setdefault(first + x // per, []).append((offset + x % per * size, size))
        seen[size] = rank + items
    return bins, seen


@pytest.mark.parametrize("seed", range(40))
def test_plan_fills_bins_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 80))}
    bins, seen = places(packing.plan(counts, capacity))
    assert seen == counts and sorted(bins) == list(range(len(bins)))
    for items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(3 * s > capacity for _, s in items) <= 2
    total = sum(s * n for s, n in counts.items())
    assert len(bins) >= -(-total // capacity)
    # never worse than best fit by decreasing size, one by one
    gaps = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    assert len(bins) <= len(gaps) * 1.05 + 1


def test_sizes_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_pieces_come_back_as_the_documents(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta.", "γάμμα", "12"]) for _ in range(rng.choice([0, 3, 40, 900, 3000])))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "no id"), (5, rows[5][1]), (5, "other text")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, piece int, offset string")
    got = packing.packed(docs, tokenizer_file(), 256).collect()
    assert len(got) == packing.packed(docs, tokenizer_file(), 256).count()
    by_doc = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["tk"]), []).append(r)
    whole = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 256 or 256
        edges = [0, *range(first, len(ids) + 1, 256)]
        whole.setdefault(i, []).append(sorted((p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:]))))
    for i, wanted in whole.items():
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert mine == sorted(x for w in wanted for x in w)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= total / 256 * 1.02 + 1
    filled = packing.sequences(docs, tokenizer_file(), 256).collect()
    assert sum(len(r["ids"]) for r in filled) == total and max(len(r["ids"]) for r in filled) <= 256


def test_an_empty_table_packs_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).count() == 0
