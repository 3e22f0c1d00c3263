"""Retrieval paths against brute force; both ways of every size check give the same hits."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import answers as A
from corpusmill.operators.hybrid import fuse, fusion_depth, search_hybrid
from corpusmill.operators.embed import embed, embed_with
from corpusmill.operators.index import dedupe, facets, index_eligible, order_fields, to_index_rows, upsert_index, where_fields
from corpusmill.operators.keyword import build_postings, keyword_index, search_keyword
from corpusmill.operators.vector import cell_index, recall_at_k, search_vector, search_vector_ann
from corpusmill.session import broadcast_if_bounded, is_bounded
from corpusmill.sources.index_sink import check_published, publish, publish_index

WORDS = ["alpha", "beta", "gamma", "delta", "rare", "the", "the", "the", "of"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    # A third of all chunks are copies of one text, every score of theirs ties.
    texts[:100] = ["the beta of the copy"] * 100
    return [(f"c{i:03d}", t) for i, t in enumerate(texts)] + [("empty", ""), ("blank", "...")]


@pytest.fixture(scope="module")
def questions():
    return [("q1", "What is the rare alpha?"), ("q2", "the the beta copy"), ("q3", "unknown words only"), ("q4", "..."), ("q5", "GAMMA delta")]


def bm25(corpus, question, k):
    docs = {i: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for i, t in corpus}
    avg = sum(map(len, docs.values())) / len(docs)
    words = set("".join(c if c.isalnum() else " " for c in question.lower()).split())
    scores = {}
    for i, toks in docs.items():
        for w in words:
            tf, df = toks.count(w), sum(w in d for d in docs.values())
            if tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avg))
    ranked = sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
    return [(i, s) for s, i in ranked]


@pytest.mark.parametrize("tile, block, postings", [(4096, 1024, 4_000_000), (16, 2, 30)])
@pytest.mark.parametrize("k", [1, 5, 150])
def test_keyword_equals_brute_force(spark, corpus, questions, k, tile, block, postings, monkeypatch):
    for name, value in (("keyword.TILE_CHUNKS", tile), ("keyword.HELD_POSTINGS", postings), ("scan.QUESTION_BLOCK", block)):
        monkeypatch.setattr(f"corpusmill.operators.{name}", value)
    chunks = spark.createDataFrame(corpus, "chunk_id string, chunk_text string").repartition(5)
    asked = spark.createDataFrame(questions, "question_id string, question string")
    rows = search_keyword(asked, keyword_index(build_postings(chunks)), k).orderBy("question_id", "rank").collect()
    for qid, text in questions:
        got = [(r.chunk_id, pytest.approx(r.score, abs=2e-6)) for r in rows if r.question_id == qid]
        assert [(i, s) for i, s in bm25(corpus, text, k)] == got
        assert [r.rank for r in rows if r.question_id == qid] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("block, cells", [(1024, 2_000_000), (3, 100)])
def test_vector_equals_brute_force(spark, metric, block, cells, monkeypatch):
    monkeypatch.setattr("corpusmill.operators.scan.QUESTION_BLOCK", block)
    monkeypatch.setattr("corpusmill.operators.vector.HELD_CELLS", cells)
    monkeypatch.setattr("corpusmill.operators.vector.SCORES_HELD", cells)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 8)).astype(np.float32)
    vectors[:70] = vectors[0]
    vectors[150] = 0
    asked = rng.normal(size=(8, 8)).astype(np.float32)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)], "chunk_id long, embedding array<float>").repartition(4)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(77, None)], "question_id long, embedding array<float>")
    found = search_vector(qs, index, 5, metric)
    # The index is never shuffled, only the hits are.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow") and plan.count("hashpartitioning") == 1
    rows = found.orderBy("question_id", "rank").collect()
    v, q = vectors.astype(float), asked.astype(float)
    for i in range(8):
        with np.errstate(all="ignore"):
            s = {
                "cosine": q[i] @ v.T / np.linalg.norm(q[i]) / np.linalg.norm(v, axis=1), "dot": q[i] @ v.T,
                "euclidean": -np.linalg.norm(v - q[i], axis=1),
            }[metric]
        order = sorted((j for j in range(200) if not np.isnan(s[j])), key=lambda j: (-round(s[j], 6), j))[:5]
        assert [r.chunk_id for r in rows if r.question_id == i] == order


def test_no_questions_give_no_hits(spark, corpus):
    chunks = embed(spark.createDataFrame(corpus, "chunk_id string, chunk_text string"))
    none = spark.createDataFrame([], "question_id string, question string, embedding array<float>")
    index = keyword_index(build_postings(chunks))
    assert search_hybrid(none, index, chunks, 5).count() == 0
    empty = keyword_index(build_postings(chunks.limit(0)))
    some = embed(spark.createDataFrame([("q", "alpha")], "question_id string, question string"), "question")
    assert search_hybrid(some, empty, chunks.limit(0), 5).count() == 0


def test_a_search_opens_only_the_buckets_of_its_terms(spark, corpus):
    from corpusmill.operators import keyword

    index = keyword_index(build_postings(spark.createDataFrame(corpus, "chunk_id string, chunk_text string")))
    asked = keyword.weighted_questions(spark.createDataFrame([(1, "rare delta")], "question_id int, question string"), index.stats)
    scan = keyword._asked(index, asked)
    opened = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in opened
    assert {r.term for r in scan.collect()} == {"", "rare", "delta"}
    every = {r.bucket for r in index.blocks.select("bucket").distinct().collect()}
    assert len({r.bucket for r in index.blocks.where("term IN ('', 'rare', 'delta')").select("bucket").distinct().collect()}) < len(every)


def test_deep_lists_reach_as_far_as_rounding_does():
    assert [fusion_depth(k) for k in (1, 5, 100)] == [1, 5, 100]
    depth = fusion_depth(2000)
    assert depth > 2000 and round(1 / (60 + depth), 6) == round(1 / 2060, 6) > round(1 / (61 + depth), 6)


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        search_keyword(None, None, 0)


@pytest.mark.parametrize("block", [1024, 3])
def test_ann_finds_close_vectors(spark, monkeypatch, block):
    monkeypatch.setattr("corpusmill.operators.scan.QUESTION_BLOCK", block)
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16)) * 3
    vectors = np.concatenate([m + rng.normal(scale=0.4, size=(30, 16)) for m in middles] + [middles[:1].repeat(140, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [0.0] * 16), (901, None)]
    index = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)
    qs = index.where("chunk_id % 17 = 0").withColumnRenamed("chunk_id", "question_id")
    cells = cell_index(index, 12, 5, 0.95)
    assert cells.rows.count() == 500 and cells.probes <= 3
    found = search_vector_ann(qs, cells, 5)
    assert found.groupBy("question_id", "chunk_id").count().filter("count > 1").isEmpty()
    assert recall_at_k(search_vector(qs, index, 5), found).agg(F.avg("recall")).first()[0] >= 0.9
    one = search_vector_ann(qs.limit(1), cells, 5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    # Only the cells of the question are opened, and the index is not shuffled.
    assert "PartitionFilters: [" in plan and "(cell#" in plan[plan.index("PartitionFilters: [") :][:80] and plan.count("hashpartitioning") == 1
    assert cells.rows.where("cell = 0").count() < 300
    empty = cell_index(index.limit(0), 4)
    assert search_vector_ann(qs, empty, 5).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "question_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "question_id string, chunk_id string, rank int")
    got = [(r.chunk_id, r.score, r.rank) for r in fuse([a, b], 5).orderBy("rank").collect()]
    assert got == [("y", round(1 / 61 + 1 / 62, 6), 1), ("x", round(1 / 61, 6), 2), ("z", round(1 / 62, 6), 3)]


def test_pluggable_embedder(spark):
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)

        def model(texts):
            assert 0 < len(texts) <= 3 and all(t.strip() for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    df = spark.createDataFrame([(i, None if i % 4 == 0 else " " if i % 4 == 1 else "x" * i) for i in range(20)], "i int, chunk_text string").coalesce(1)
    rows = embed_with(df, make, sub_batch=3).collect()
    assert [r.embedding for r in rows] == [None if r.i % 4 < 2 else [float(r.i), 1.0] for r in rows]
    assert made.value == 1


def test_only_blank_text_has_no_vector(spark):
    df = spark.createDataFrame([(None,), (" \n",), ("...",), ("word",)], "chunk_text string")
    assert [r.embedding is None for r in embed(df, dims=4).collect()] == [True, True, False, False]


def test_words_are_hashed_once_per_task(spark, monkeypatch):
    import hashlib

    from corpusmill.functions import tokens as words

    monkeypatch.setattr(words, "_CELLS_HELD", 7)
    texts = [None, " ", "...", "one two one", "Two! two, three", *["w%d x%d" % (i % 5, i) for i in range(40)]]
    vectors = embed(spark.createDataFrame(list(enumerate(texts)), "i int, chunk_text string").coalesce(1), dims=3)
    # No hash per occurrence of a word: the plan has none.
    assert "md5" not in vectors._jdf.queryExecution().executedPlan().toString()
    for r in vectors.collect():
        if not (r.chunk_text or "").strip():
            assert r.embedding is None
            continue
        want = [0.0] * 3
        for w in "".join(c if c.isalnum() else " " for c in r.chunk_text.lower()).split():
            digest = hashlib.md5(w.encode()).hexdigest()
            want[int(digest[:8], 16) % 3] += 1 if digest[8] < "8" else -1
        norm = sum(x * x for x in want) ** 0.5 or 1
        assert r.embedding == pytest.approx([x / norm for x in want], abs=1e-6)


def test_index_rows(spark):
    gold = spark.createDataFrame(
        [(1, "t", [1.0], "3"), (2, "  ", [1.0], None), (3, "t", None, None), (None, "t", [1.0], None), (4, "\n", [1.0], None)],
        "chunk_id long, chunk_text string, embedding array<float>, page_number string",
    )
    rows = index_eligible(to_index_rows(gold))
    assert [(r.chunk_id, r.page_number) for r in rows.orderBy("chunk_id").collect()] == [("1", 3), ("4", None)]
    assert where_fields(rows, page_number=3).count() == 1
    assert [r.chunk_id for r in order_fields(rows, "chunk_id", ascending=False).collect()] == ["4", "1"]
    for bad in (lambda: where_fields(rows, chunk_text="t"), lambda: order_fields(rows, "file_name"), lambda: facets(rows, "page_number")):
        with pytest.raises(ValueError):
            bad()


def test_dedupe_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chunk_id string, v int")
    kept = dedupe(rows, "chunk_id", [F.col("v").desc()])
    assert sorted(map(tuple, kept.collect())) == [("a", 2), ("b", 3)]
    updates = spark.createDataFrame([("b", 9), ("c", 8)], "chunk_id string, v int")
    assert sorted(map(tuple, upsert_index(kept, updates).collect())) == [("a", 2), ("b", 9), ("c", 8)]


def test_publish_in_batches(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        def write(rows):
            # One file per batch, named by its first key: a second run replaces it.
            rows.to_json(f"{folder}/{rows['chunk_id'].iloc[0]}.json", orient="records")
            return [v >= 0 for v in rows["v"]]

        return write

    df = spark.range(1000).select(F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("v"))
    report = publish_index(df, make, batch_size=100, shards=3)
    assert check_published(report) == 1000
    first = sorted(p.name for p in tmp_path.iterdir())
    rows = report.collect()
    assert max(r.n_ok for r in rows) == 100 and sum(r.n_ok < 100 for r in rows) <= 3
    assert sorted(p.name for p in tmp_path.iterdir()) == first
    with pytest.raises(RuntimeError):
        check_published(publish_index(df.withColumn("v", F.col("v") - 1), make, shards=3))


def test_publishing_is_committed_or_leaves_nothing(spark, tmp_path):
    def taking(limit):
        def make():
            return lambda rows: [v < limit for v in rows["v"]]

        return make

    df = spark.range(1000).select(F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("v"))
    done = publish(df, taking(1000), f"{tmp_path}/all", shard_rows=300).collect()
    assert {r.shard for r in done} == {0, 1, 2, 3} and sum(r.n_ok for r in done) == 1000 and max(r.n_ok for r in done) <= 100
    assert sorted(int(k) for r in done for k in r.taken) == list(range(1000))
    assert not (tmp_path / "all" / "pending").exists()
    with pytest.raises(Exception, match="3 rows failed to upload"):
        publish(df, taking(997), f"{tmp_path}/none", shard_rows=300)
    assert not (tmp_path / "none" / "batches").exists() and not (tmp_path / "none" / "pending").exists()
    some = publish(df, taking(997), f"{tmp_path}/some", allow_failed=True).collect()
    assert sorted(k for r in some for k in r.refused) == ["997", "998", "999"]

    def breaking():
        def write(rows):
            raise OSError("the service is gone")

        return write

    with pytest.raises(Exception, match="the service is gone"):
        publish(df, breaking, f"{tmp_path}/gone")
    assert not (tmp_path / "gone" / "batches").exists()
    assert publish(df.limit(0), taking(1), f"{tmp_path}/empty").count() == 0


def test_size_check(spark):
    df = spark.range(1000)
    assert is_bounded(df, max_rows=1000) and not is_bounded(df, max_rows=999) and not is_bounded(df, max_bytes=10)
    assert broadcast_if_bounded(df)[1] and not broadcast_if_bounded(df, max_rows=5)[1]


def test_answers(spark):
    asked = spark.createDataFrame([("q1", "one?"), ("q2", "two?")], "question_id string, question string")
    hits = spark.createDataFrame(
        [("q1", "b", 2, 0.5, "t" * 1300, None, "", 7), ("q1", "a", 1, None, "first", "S", "u", None)],
        "question_id string, chunk_id string, rank int, score double, chunk_text string, short_title string, source_url string, page_number int",
    ).withColumns({"regulation_title": F.lit(None).cast("string"), "file_name": F.lit("f")})
    given = spark.createDataFrame([("q1", "said")], "question_id string, answer string")
    rows = {r.question_id: r for r in A.answer_frame(asked, hits, given).collect()}
    assert [s.chunk_id for s in rows["q1"].sources] == ["a", "b"] and len(rows["q1"].sources[1].chunk_preview) == 1200
    assert rows["q1"].answer == "said" and (rows["q2"].answer, rows["q2"].sources) == (A.NOTHING_FOUND, [])
    context = {r.question_id: r.context for r in A.build_context(asked, hits).collect()}
    assert context["q2"] == "" and context["q1"].startswith(
        "[Source 1]\nChunk ID: a\nShort title: S\nRegulation title: N/A\nFile name: f\nPage number: unknown\nSource URL: u\nSearch score: None\nText:\nfirst\n\n[Source 2]\n"
    )
    assert "Short title: N/A" in context["q1"] and "Source URL: N/A\nSearch score: 0.5\nText:\n" + "t" * 1300 in context["q1"]
    requests = A.build_requests(A.build_context(asked, hits)).collect()
    assert [[m.role for m in r.messages] for r in requests] == [["system", "user"]]
    judge = {r.question_id: r.messages[1].content for r in A.build_judge_requests(A.answer_frame(asked, hits, given)).collect()}
    assert "Page number: None\nText preview:\nfirst" in judge["q1"] and A.NOTHING_FOUND in judge["q2"]


def test_question_checks(spark):
    df = spark.createDataFrame([("ab", 5), ("abc", None), ("abcd", 20), ("abcd", 21), ("abcd", 0), (None, 1)], "question string, top_k int")
    valid, rejected = A.validate_questions(df)
    assert sorted((r.question, r.top_k) for r in valid.collect()) == [("abc", 5), ("abcd", 20)]
    assert rejected.count() == 4 and rejected.filter("reason IS NULL").isEmpty()


@pytest.mark.parametrize("k, tile", [(1, 4096), (5, 16), (120, 16)])
def test_hybrid_ranks_equal_the_full_keyword_list(spark, corpus, questions, k, tile, monkeypatch):
    chunks = embed(spark.createDataFrame(corpus, "chunk_id string, chunk_text string"), dims=8).repartition(5)
    asked = embed(spark.createDataFrame(questions, "question_id string, question string"), "question", 8)
    monkeypatch.setattr("corpusmill.operators.keyword.TILE_CHUNKS", tile)
    index = keyword_index(build_postings(chunks))
    want = fuse([search_keyword(asked, index, 10_000), search_vector(asked, chunks, k)], k)
    assert sorted(map(tuple, search_hybrid(asked, index, chunks, k).collect())) == sorted(map(tuple, want.collect()))


def test_only_scores_that_come_near_the_best_are_rounded(monkeypatch):
    from corpusmill.operators import keyword, scan, vector

    rounded, plain = [], scan.settled

    def counting(scores):
        rounded.append(scores.size)
        return plain(scores)

    for module in (keyword, scan, vector):
        monkeypatch.setattr(module, "settled", counting)
    rng = np.random.default_rng(11)
    chunks, words, asked = 600, 40, 300
    tf = rng.integers(0, 4, (chunks, words)) * (rng.random(words) < rng.random((chunks, words)) * 1.5)
    tf[50:90] = tf[50]
    dl, idf, has = tf.sum(1), rng.random(words) + 0.1, rng.random((asked, words)) < 0.3
    places, ids, avgdl = {f"w{t}": np.flatnonzero(tf[:, t]) for t in range(words) if tf[:, t].any()}, [f"c{i:04d}" for i in range(chunks)], float(dl.mean())
    ints = pa.list_(pa.int32())
    rows = [("", [], [], 0, 0, ids, list(dl))] + [(w, at, tf[at, int(w[1:])], tf[at, int(w[1:])].max(), dl[at].min(), None, None) for w, at in places.items()]
    kinds = [pa.string(), ints, ints, pa.int32(), pa.int32(), pa.list_(pa.string()), ints]
    rows = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["term", "at", "tf", "top_tf", "low_dl", "ids", "dl"])
    want = plain((has * idf) @ (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[:, None] / avgdl))).T)
    terms = [[{"term": f"w{t}", "idf": idf[t]} for t in np.flatnonzero(h)] for h in has]
    near = [[{"chunk_id": ids[c], "score": want[q, c]} for c in (55, 400) if want[q, c] > 0] for q in range(asked)]
    kinds = pa.schema([("question_id", pa.int64()), ("avgdl", pa.float64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("idf", pa.float64())]))), ("near", pa.list_(pa.struct([("chunk_id", pa.string()), ("score", pa.float64())])))])
    block = pa.table([list(range(asked)), [avgdl] * asked, terms, near], schema=kinds)
    for cost in (0, 400, 10**9):
        # By postings, mixed, and by a matrix product.
        monkeypatch.setattr(keyword, "ADDED_COST", cost)
        tile = keyword._Tile([rows.slice(0, 9), rows.slice(9)], avgdl)
        questions = keyword._Asked(block, "near")
        run = tile.runs(questions)
        assert (tile.bound(questions, run) + 1e-9 >= want.max(1)).all()
        rounded.clear()
        for some, scores in tile.scores(questions, run, np.arange(asked)):
            q, at = scan.best_cells(scores, 5, np.full(len(some), -np.inf), scan.SLACK, keyword.TINY)
            for i, me in enumerate(some):
                order = sorted((c for c in range(chunks) if want[me, c] > 0), key=lambda c: (-want[me, c], c))
                assert list(at[q == i]) == order[:5]
                first, end = questions.near_of[me]
                places = [order.index(ids.index(x["chunk_id"])) for x in near[me]]
                assert tile.above(scores[i], questions.near.slice(first, end - first), questions.near_scores[first:end]) == places
        assert 0 < sum(rounded) < want.size / 2
    rounded.clear()
    v = rng.normal(size=(chunks, 16))
    floor = np.full(asked, -np.inf)
    q, at, scores = vector._best(v[:asked] + 0.1, v, "cosine", 5, floor)
    exact = plain(vector._scores(v[:asked] + 0.1, v, "cosine"))
    assert [list(at[q == i]) for i in range(asked)] == [sorted(range(chunks), key=lambda c: (-exact[i, c], c))[:5] for i in range(asked)]
    assert np.allclose(scores, exact[q, at], atol=1e-9) and sum(rounded) < asked * chunks / 2
