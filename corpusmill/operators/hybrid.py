"""Hybrid retrieval: reciprocal rank fusion of keyword and vector results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.keyword import KeywordIndex, scan_tiles, weighted_questions
from corpusmill.operators.topk import DEFAULT_TOP_K, SCORE_DIGITS, check_k, top_k
from corpusmill.operators.vector import search_vector
from corpusmill.session import materialize

RRF_CONSTANT = 60


def fuse(result_lists: list[DataFrame], k: int, constant: int = RRF_CONSTANT, rank: str = "rank") -> DataFrame:
    """Sum 1 / (constant + rank) over the lists and keep the k best."""
    parts = [r.select("question_id", "chunk_id", (F.lit(1.0) / (F.col("rank") + constant)).alias("part")) for r in result_lists]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    fused = merged.groupBy("question_id", "chunk_id").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    return top_k(fused, "question_id", F.col("score"), "chunk_id", k, rank)


def fusion_depth(k: int, constant: int = RRF_CONSTANT) -> int:
    """How many of the keyword list can enter the fused k best without being near: the first k, and those whose part rounds to that of the k-th."""
    part = round(1 / (constant + k), SCORE_DIGITS)
    if not part:
        raise ValueError(f"the parts of the first {k} ranks can't be told apart at {SCORE_DIGITS} digits")
    depth = k
    while round(1 / (constant + depth + 1), SCORE_DIGITS) >= part:
        depth += 1
    return depth


def keyword_ranks(questions: DataFrame, index: KeywordIndex, near: DataFrame, depth: int) -> DataFrame:
    """question_id, chunk_id and keyword rank of the ``depth`` best by words and of every pair in ``near``.

    A chunk that is no near neighbour and not among these can't reach the fused
    best: as many others with a better part are ahead of it. So the whole
    keyword list is never built; the rank of a neighbour is counted, tile by
    tile, as the number of chunks above its score.
    """
    asked = materialize(weighted_questions(questions, index.stats), "asked")
    pairs = near.groupBy("question_id").agg(F.collect_list(F.struct("chunk_id")).alias("near"))
    with_pairs = asked.join(pairs, "question_id", "left").withColumn("near", F.coalesce("near", F.array().cast(pairs.schema["near"].dataType)))
    seen = materialize(scan_tiles(index, with_pairs, depth, "near"), "keyword-seen")
    best = top_k(seen.where("above = 0"), "question_id", F.col("score"), "chunk_id", depth).select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"))
    scored = seen.where("above = -1").select("question_id", "chunk_id", "score")
    placed = scored.groupBy("question_id").agg(F.collect_list(F.struct("chunk_id", "score")).alias("near"))
    above = scan_tiles(index, materialize(asked.join(placed, "question_id"), "near-scored"), depth, "near")
    above = above.groupBy("question_id", "chunk_id").agg(F.sum("above").alias("above"))
    ranks = scored.join(above, ["question_id", "chunk_id"], "left").select("question_id", "chunk_id", (F.coalesce("above", F.lit(0)) + 1).alias("rank"))
    # A chunk that is in both has the same rank in both.
    return best.unionByName(ranks).groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))


def search_hybrid(questions: DataFrame, index: KeywordIndex, vectors: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """``questions`` has question_id, question and embedding; the index and ``vectors`` share chunk_id.

    Questions are written first, so that a model that made their vectors is asked once.
    """
    check_k(k)
    depth = fusion_depth(k)
    held = materialize(questions.select("question_id", "question", "embedding"), "hybrid-questions")
    by_vector = materialize(search_vector(held.select("question_id", "embedding"), vectors, k), "hybrid-near")
    by_words = keyword_ranks(held.select("question_id", "question"), index, by_vector.select("question_id", "chunk_id"), depth)
    return fuse([by_words, by_vector], k)
