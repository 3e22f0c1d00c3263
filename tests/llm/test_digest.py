"""Digests against plain counting, neighbours against a sorted list."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np

from corpusmill.llm import digest


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_entropies_equal_plain_counting():
    rng = random.Random(1)
    for text in (prose(rng, 60), "a" * 100, "ab" * 40, bytes(range(256)).decode("latin-1"), "x" * 63 + "y"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = digest.entropies(data)
        assert len(got) == len(data) - 63
        for i, g in enumerate(got.tolist()):
            h = -sum(c / 64 * math.log2(c / 64) for c in collections.Counter(data[i : i + 64].tolist()).values())
            assert abs(h / 6 * digest.LEVELS - g) <= 1.01


def test_windows_across_blocks_and_texts(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, n).encode() for n in (3, 500, 40, 0, 200, 1)]
    whole = [digest.entropies(np.frombuffer(t, np.uint8)) if len(t) >= 64 else np.zeros(0, np.int32) for t in texts]
    monkeypatch.setattr(digest, "BLOCK", 100)
    for a, b in zip(whole, digest.window_entropies(texts), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_features_are_the_rarest_of_their_neighbours():
    rng = np.random.default_rng(3)
    for n in (1, 10, 63, 64, 65, 500):
        rank = rng.integers(0, 50, n)
        span = min(64, n)
        points = np.zeros(n, int)
        for i in range(n - span + 1):
            points[i + int(np.argmin(rank[i : i + span]))] += 1
        want = np.flatnonzero((points >= min(16, n - span + 1)) & (rank < 49))
        assert (digest.features(rank, 49) == want).all()


def test_every_row_meets_its_next(spark):
    rng = random.Random(4)
    rows = [(i * 3, prose(rng, rng.randint(0, 120))) for i in range(80)]
    rows += [(9, "a repeated id " + prose(rng, 30)), (12, rows[4][1]), (None, prose(rng, 20)), (500, None), (501, ""), (502, "x"), (503, prose(rng, 60_000))]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, part string, extra int").repartition(5)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    for parts in (1, 7):
        got = digest.fingerprints(docs, parts).collect()
        assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted((str(i), n, h) for i, n, h in want)
        prints = collections.defaultdict(set)
        text_of = {(str(i), len(t)): t for i, t in order}
        for r in got:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            prints[text_of[str(r["doc_id"]), r["n_chars"]]].add(r["fingerprint"])
        assert all(len(p) == 1 for p in prints.values())
        long = [r for r in got if r["n_chars"] > 300]
        assert np.mean([r["near_edited"] for r in long]) > 0.3 > 0.05 > np.mean([r["near_next"] for r in long])


def test_few_rows_and_none(spark):
    assert digest.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = digest.fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in alone] == [(4, hashlib.sha256(b"abab").hexdigest(), 1.0)]


def test_likeness():
    rng = random.Random(5)
    texts = [prose(rng, 800) for _ in range(6)]
    ranks = digest.rarity(sum(np.bincount(e, minlength=digest.LEVELS + 1) for e in digest.window_entropies([t.encode() for t in texts])))
    a, b, c = digest.digests([texts[0], texts[0] + texts[1], texts[2]], ranks)
    assert digest.likeness(a, a) == 1 and digest.likeness(a, "") == 0 == digest.likeness("", a)
    assert digest.likeness(a, b) > 0.8 > 0.1 > digest.likeness(a, c)
    assert digest.likeness(a, b) == digest.likeness(b, a)
