"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np

from corpusmill.llm import multi_index


def brute(rows, asked, k):
    out = {}
    for i, v in asked:
        scores = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in rows if j != i)
        out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def table(rng, n, dims=16):
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[i % 12] + 0.3 * rng.normal(size=dims)).tolist()) for i in range(n)]


def test_recall_scores_and_order(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "TILE_ROWS", 64)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 8)
    rows = table(np.random.default_rng(1), 600)
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a hot vector
    vectors = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, cell int, tile string")
    asked = [r for r in rows if r[0] % 20 == 0]
    got = {}
    for r in multi_index.search(vectors, vectors.where("vec_id % 20 = 0"), 20, centroids=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want, exact = brute(rows, asked, 20), dict(rows)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    hit = 0
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(np.dot(exact[q], exact[j]))) < 1e-12 for j, s in found)
        hit += len({j for j, _ in found} & {j for j, _ in want[q]})
    assert hit >= 0.9 * 20 * len(want)
    whole = multi_index.search(vectors, vectors.where("vec_id % 20 = 0"), 20, share=1.0, centroids=8).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in whole] == [(q, j) for q in sorted(want) for j, _ in want[q]]


def test_cells_are_visited_by_summed_distance():
    rng = np.random.default_rng(2)
    book = multi_index.Codebook(rng.normal(size=(7, 3)), rng.normal(size=(5, 4)))
    counts = rng.integers(0, 4, 35)
    q = rng.normal(size=7)
    cost = -((book.first @ q[:3])[:, None] + (book.second @ q[3:])[None]).reshape(-1)
    order = [c for c in np.argsort(cost) if counts[c]]
    assert book.visit(q, counts, 10**9) == order
    part = book.visit(q, counts, 20)
    assert part == order[: len(part)] and counts[part].sum() >= 20 > counts[part[:-1]].sum()


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [3.0, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multi_index.search(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 6, 5.0), (0, 2, 20, 5.0), (0, 3, 20, 5.0), (20, 1, 0, 5.0), (20, 2, 6, 5.0)]
    assert multi_index.search(vectors.limit(0), vectors.limit(0)).count() == 0
    assert multi_index.search(vectors.where("vec_id = 0"), vectors.where("vec_id = 0")).count() == 0
