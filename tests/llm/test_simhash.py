"""SimHash classes against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from corpusmill.llm import simhash
from corpusmill.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    ids = list(range(len(prints)))
    top = ids[:]
    for i in ids:
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and top[i] != top[j]:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return top


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "éta", "zeta", "theta", "iota", "kappa", "mu", "nu", "xi"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = words(rng, 300)
    near = [base.replace("gamma", "gamma", 1) + " " + words(rng, i % 3) for i in range(30)]
    return [words(rng, rng.randint(1, 60)) for _ in range(40)] + near + [None, "", "  \n\t", base, base, "one", "ONE", "x" * 200_000, words(rng, 30_000)]


def test_fingerprints_and_classes_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.classes(docs).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[i]["w"][0] & (2**64 - 1) for i in range(len(texts))] == prints
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_classes(prints, 3)


def test_a_long_text_in_pieces_has_the_fingerprint_of_the_whole(monkeypatch):
    rng = random.Random(9)
    text = words(rng, 700)
    whole = simhash.fingerprints([text], 3, 2)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)
    assert (simhash.fingerprints([text], 3, 2) == whole).all()


@pytest.mark.parametrize(("n", "width", "radius"), [(40, 1, 3), (200, 1, 3), (700, 2, 20), (63, 8, 77), (130, 8, 77)])
def test_blocks_join_what_all_pairs_join(n, width, radius):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, (max(2, n // 8), width)).astype(np.uint64)
    prints = centres[rng.integers(0, len(centres), n)]
    for i in range(n):
        for _ in range(int(rng.integers(0, radius + 2))):
            b = int(rng.integers(0, 64 * width))
            prints[i, b // 64] ^= np.uint64(1 << (b % 64))
    order = np.arange(64 * width)
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    for sizes in (np.array([n]), np.array([n // 3, n - n // 3])):
        a, b = simhash.block_links(np.arange(n), prints, sizes, radius, order)
        assert (distance[a, b] <= radius).all()
        block = np.repeat(np.arange(len(sizes)), sizes)
        want, got = list(range(n)), list(range(n))

        def join(top, x, y):
            lo, hi = sorted((top[x], top[y]))
            return [lo if t == hi else t for t in top] if lo != hi else top

        for x, y in zip(*np.nonzero((distance <= radius) & (block[:, None] == block[None])), strict=True):
            want = join(want, x, y)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            got = join(got, x, y)
        assert got == want


def test_small_blocks_are_compared_in_few_steps(monkeypatch):
    """600 blocks of 46 unrelated rows, some of them near: as many numpy calls as shifts and words, not as bits."""
    rng = np.random.default_rng(46)
    prints, sizes = rng.integers(0, 2**63, (600 * 46, 8)).astype(np.uint64), np.full(600, 46)
    near = rng.choice(600, 40, replace=False) * 46
    prints[near + 45] = prints[near + 3] ^ np.uint64(0b1011)
    monkeypatch.setattr(simhash, "planes", lambda _: pytest.fail("bit planes are for large blocks"))
    a, b = simhash.block_links(np.arange(len(prints)), prints, sizes, 84, np.arange(512))
    assert sorted((min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)) == sorted((n + 3, n + 45) for n in near.tolist())


def test_links_of_dense_small_blocks_are_reduced(monkeypatch):
    monkeypatch.setattr(simhash, "LINKS_HELD", 40)
    prints = np.zeros((300, 2), np.uint64)
    prints[100:200] = np.uint64(2**64 - 1)
    a, b = simhash.block_links(np.arange(300), prints, np.array([150, 150]), 20, np.arange(128))
    assert joined(300, zip(a.tolist(), b.tolist(), strict=True)) == [0] * 100 + [100] * 50 + [150] * 50 + [200] * 100


def joined(n, pairs):
    top = list(range(n))
    for x, y in pairs:
        lo, hi = sorted((top[x], top[y]))
        top = [lo if t == hi else t for t in top] if lo != hi else top
    return top


def test_groups_found_by_different_queries_are_joined():
    """Rows 64-163 are near row 0, 164-263 near row 1; only rows 64 and 200 link the two."""
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, (264, 8)).astype(np.uint64)
    prints[1] = prints[0]
    prints[1, :2] ^= np.uint64(2**64 - 1)  # 128 bits away
    prints[64:164], prints[164:] = prints[0], prints[1]
    for r in range(65, 264):  # each away from the others by bits of its own
        w, b = 2 + r % 6, r // 6 % 60
        prints[r, w] ^= np.uint64(3 << b)
    prints[64] = prints[0]
    prints[64, 0] ^= np.uint64(2**45 - 1)
    prints[200] = prints[64]
    prints[200, 0] ^= np.uint64(2**64 - 2**45)
    prints[200, 1] ^= np.uint64(2**19 - 1)
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    want = joined(264, zip(*np.nonzero(distance <= 50), strict=True))
    assert (distance[np.ix_([0, *range(64, 164)], [1, *range(164, 264)])] <= 50).sum() == 1 and distance[64, 200] <= 50
    assert joined(264, simhash.large_block(prints, 50, np.arange(512))) == want


@pytest.mark.parametrize("seed", range(8))
def test_chains_of_dense_groups_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    centre, rows = rng.integers(0, 2**63, 8).astype(np.uint64), []
    for _ in range(12):  # each centre is 45 bits from the one before; its rows up to 16 bits from it
        for _ in range(int(rng.integers(20, 110))):
            row = centre.copy()
            for b in rng.choice(512, int(rng.integers(0, 17)), replace=False).tolist():
                row[b // 64] ^= np.uint64(1 << (b % 64))
            rows.append(row)
        for b in rng.choice(512, 45, replace=False).tolist():
            centre[b // 64] ^= np.uint64(1 << (b % 64))
    ends, far = np.array([rows[0], rows[-1]]), rng.integers(0, 2**63, (62, 8)).astype(np.uint64)
    prints = np.concatenate([far, ends, rng.permutation(np.array(rows[1:-1]))])
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    for radius in (28, 36, 40):
        got = joined(len(prints), simhash.large_block(prints, radius, np.arange(512)))
        assert got == joined(len(prints), zip(*np.nonzero(distance <= radius), strict=True))


def test_tables_of_radius_three_lose_no_pair():
    rng = random.Random(1)
    for _ in range(300):
        flipped = {rng.randrange(64) for _ in range(3)}
        assert any(all(not (s <= b < s + n) for _, s, n in fields for b in flipped) for fields in simhash.exact_tables())


def test_a_hot_key_is_dealt_to_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    rng = random.Random(2)
    prints = sorted({rng.getrandbits(12) for _ in range(150)})
    nodes = spark.createDataFrame([(i, [p]) for i, p in enumerate(prints)], "id long, w array<long>")
    got = {r["id"]: r["root"] for r in simhash.rooted(nodes, simhash.CONTRACT).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == brute_classes(prints, 3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(300, 200), (300, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {101 + i: 100 for i in range(50)} | {300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    rng = random.Random(3)
    a, b = words(rng, 200), words(rng, 200)
    rows = [(5, a, "x", 1), (5, a, "x", 1), (7, a, "y", 2), (None, a, "z", 3), (None, b, "n", 4), (None, b, "n", 4), (8, None, "q", 5), (9, "", "q", 6), (5, "else " + b[:300], "w", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w string, component_id int")
    found = simhash.classes(docs)
    assert found.count() == len(rows)
    assert {r["component_id"] for r in found.where("doc_id = 7").collect()} == {5}
    kept = sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(5, a, "x", 1), (None, b, "n", 4), (8, None, "q", 5), (5, "else " + b[:300], "w", 7)], key=str)
    assert simhash.keep_one(docs).columns == docs.columns


def test_near_copies_of_five_word_shingles_are_found(spark):
    rng = random.Random(11)
    many = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    docs, want = [], 0
    for g in range(25):
        base = many[g * 600 : g * 600 + 400]
        docs.append((g * 10, " ".join(base)))
        for c in range(1, 4):
            copy = base[:]
            for _ in range(4):  # four words of 400: a similarity of 0.9 and more
                copy[rng.randrange(400)] = f"new{rng.randrange(10**6)}"
            docs.append((g * 10 + c, " ".join(copy)))
        want += 1
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [g * 10 for g in range(want)]


def jaccard(a, b):
    sets = [{h for part in simhash.shingle_hashes(t, 5) for h in part} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("rows_of_a_task", [1024, 3])
def test_every_removed_text_is_like_one_that_stays(spark, monkeypatch, rows_of_a_task):
    """A chain in which each text is near the next one, but far from the others."""
    monkeypatch.setattr(simhash, "CLUSTER_ROWS", rows_of_a_task)
    rng = random.Random(44)
    words = [f"c{rng.randrange(10**6)}" for _ in range(400)]
    rows, now = [], list(words)
    for i in range(12):
        rows.append((i, " ".join(now)))
        now = list(now)
        for at in rng.sample(range(400), 6):
            now[at] = f"d{rng.randrange(10**6)}"
    rows += [(50, rows[0][1]), (None, rows[0][1]), (60, ""), (61, None), (62, "a b"), (63, "a b"), (64, "a c")]
    kept = {(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (0, rows[0][1]) in kept and not {50, None} & {d for d, _ in kept} and len(kept & set(rows[:12])) < 12
    texts = [t for _, t in kept]
    for d, t in set(rows) - kept:
        assert max(jaccard(t, k) for k in texts) >= 0.8, d
    for d, t in kept & set(rows[1:12]):
        assert all(jaccard(t, k) < 0.8 for e, k in kept if e is not None and e < d)
    assert {d for d, _ in kept if d and d >= 60} == {60, 62, 64}


def test_clusters_stay_whole_whatever_the_joins_become(spark, tmp_path):
    rows = [(c, 10 * c + i, c, list(range(c, c + 60))) for c in range(3000) for i in range(2)]
    spark.createDataFrame(rows, "cluster long, doc_id long, tk long, sh array<long>").repartition(12).write.parquet(f"{tmp_path}/members")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        stay = simhash.leaders(spark.read.parquet(f"{tmp_path}/members"), 0.8)
        assert sorted(r["doc_id"] for r in stay.collect()) == [10 * c for c in range(3000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_large_cluster_takes_few_turns(spark, tmp_path, monkeypatch):
    """400 members of one cluster, of which 100 stay, and 30 of another: what stays is what going through them one by one gives."""
    rng, rows = random.Random(4), []
    for g in range(100):
        base = rng.sample(range(10**9), 40)
        for c in range(4):
            # From the first of its group each differs in less than a fifth; two that both differ may not be alike.
            rows.append((7, g + 100 * c if rng.random() < 0.95 else None, g * 4 + c, sorted(base[4 * c : 4 * c + 40] + rng.sample(range(10**9), c))))
    rows += [(8, i, 1000 + i, sorted(rng.sample(range(60), 50))) for i in range(29)] + [(8, None, 9999, [])]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "cluster long, doc_id long, tk long, sh array<long>").repartition(5).write.parquet(f"{tmp_path}/members")
    want, held = set(), {7: [], 8: []}
    for cluster, doc, tk, sh in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
        if not any(len({*sh} & o) >= 0.8 * len({*sh} | o) for o in held[cluster]):
            held[cluster].append({*sh})
            want.add((doc, tk))
    turns, write = [], simhash.materialize

    def counted(df, label):
        turns.append(label)
        assert turns.count("simhash-stay") <= 9, "a turn for each that stays"
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(simhash, "CLUSTER_ROWS", 60)
    monkeypatch.setattr(simhash, "SLICE_ROWS", 50, raising=False)
    got = [tuple(r) for r in simhash.leaders(spark.read.parquet(f"{tmp_path}/members"), 0.8).collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


def test_shingles_of_a_cluster_bound_what_a_task_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "CLUSTER_HASHES", 25)
    rows = [(1, i, i, list(range(20 * (i // 2), 20 * (i // 2) + 20))) for i in range(12)]
    spark.createDataFrame(rows, "cluster long, doc_id long, tk long, sh array<long>").write.parquet(f"{tmp_path}/members")
    assert sorted(r["doc_id"] for r in simhash.leaders(spark.read.parquet(f"{tmp_path}/members"), 0.8).collect()) == [0, 2, 4, 6, 8, 10]
