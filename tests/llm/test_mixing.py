"""The mix against plain arithmetic."""

from __future__ import annotations

import hashlib
import random

from corpusmill.llm import mixing


def brute_targets(sizes):
    """Shares by weight, excess shared again until none is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    return target


def test_mixed_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        source = rng.choices(["a", "B", "c", None, "zz", "é"], [30, 1, 5, 3, 1, 8])[0]
        rows.append((i, None if i % 50 == 0 else " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), source))
    rows += [(1000, "\x0b one\x0ctwo x ", "only"), (1001, "", "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    size = {i: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, t, _ in rows}
    sums = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    targets = brute_targets(sums)
    by = {}
    for i, _, s in rows:
        by.setdefault(s, []).append(i)
    for s, ids in by.items():
        budget = int(targets[s] + 1e-9)
        whole, rest = (divmod(budget, sums[s]) if sums[s] else (0, 0))
        for i in sorted(ids, key=lambda i: hashlib.md5(f"17:{i}".encode()).hexdigest()):
            part = min(size[i], max(0, rest))
            rest -= size[i]
            assert (got[i]["size"], got[i]["source_size"]) == (size[i], sums[s])
            assert abs(got[i]["target"] - targets[s]) < 1e-6
            assert got[i]["taken"] == whole * size[i] + part
            assert got[i]["taken"] <= 3 * size[i]
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_mix_gives_the_words_that_were_decided(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(10)), "s" if i < 12 else "t", i) for i in range(20)] + [(3, " ".join(f"w3_{k}" for k in range(10)), "s", 3)] * 2 + [(None, "x y", None, 1), (50, None, "s", 2), (51, "", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    plan = mixing.mixed(docs).groupBy("source").agg({"taken": "sum"}).collect()
    want = {r[0]: r[1] for r in plan}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + len((r["text"] or "").split())
        original = [t for i, t, _, _ in rows if i == r["doc_id"]]
        assert r["text"] in original or any((t or "").startswith(r["text"]) for t in original)
    assert got == want
    assert out.where("doc_id IN (50, 51)").count() == 2


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mixed(docs).collect()] == [(0, 0.0, 0)] * 2
