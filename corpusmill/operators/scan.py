"""Questions in blocks that tasks read one after the other while they hold a stretch of the index.

However many questions there are, the index is read once and stays where it is:
blocks of questions are files in the shared folder, and a task that holds rows
of the index goes through all blocks. It passes on k rows per question and
stretch, fewer once it knows that others can't be among the best.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.topk import SCORE_DIGITS
from corpusmill.session import scratch_path
from corpusmill.sources.files import children

# Questions in a block, about.
QUESTION_BLOCK = 1024
# A question with more than so many times k hits in a stretch has the others sorted out before the hits are sorted.
CROWDED = 8
# Scores that differ by less may be equal when they are rounded.
SLACK = 2 * 10.0**-SCORE_DIGITS


def settled(scores: np.ndarray) -> np.ndarray:
    """The one rounding of scores; -inf where a pair is no hit (NaN)."""
    scores = np.round(scores, SCORE_DIGITS) + 0.0
    scores[np.isnan(scores)] = -np.inf
    return scores


def write_blocks(questions: DataFrame, label: str, size: int | None = None) -> list[list[str]]:
    """The files of each block of ``questions`` (question_id, ...), dealt by hash."""
    spark, path = questions.sparkSession, scratch_path(questions.sparkSession, label)
    questions.write.parquet(f"{path}/all")
    held = spark.read.schema(questions.schema).parquet(f"{path}/all")
    blocks = max(1, math.ceil(held.count() / (size or QUESTION_BLOCK)))
    if blocks == 1:
        folders = [f"{path}/all"]
    else:
        dealt = held.withColumn("_block", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int"))
        dealt.repartition(blocks, "_block").write.partitionBy("_block").parquet(f"{path}/blocks")
        folders = [f"{path}/blocks/{c}" for c in children(spark, f"{path}/blocks") if c.startswith("_block=")]
    return [[f"{f}/{c}" for c in children(spark, f) if c.endswith(".parquet")] for f in folders]


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


class Blocks:
    """What a task reads of blocks; the last one read is kept, so that a single block is read once."""

    def __init__(self, files: list[list[str]]) -> None:
        self.files, self.last, self.held = files, None, None

    def __len__(self) -> int:
        return len(self.files)

    def __getitem__(self, i: int) -> pa.Table:
        if i >= len(self.files):
            raise IndexError(i)
        if self.last != i:
            tables = []
            for path in self.files[i]:
                store, inner = fs.FileSystem.from_uri(_uri(path))
                with store.open_input_file(inner) as source:
                    tables.append(pq.ParquetFile(source).read())
            self.last, self.held = i, pa.concat_tables(tables).combine_chunks()
        return self.held


class Floors:
    """By block the least score that each question's k best of one stretch had. What is lower in another stretch is not among the best."""

    def __init__(self) -> None:
        self.held: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(0))

    def of(self, block: int, questions: int) -> np.ndarray:
        if len(self.held[block]) != questions:
            self.held[block] = np.full(questions, -np.inf)
        return self.held[block]


def best_cells(scores: np.ndarray, k: int, floor: np.ndarray, slack: float = 0.0, lowest: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(question, column) of each question's k best cells, equal scores by column, none below ``floor``, which rises.

    Cells of at most ``-inf`` or below ``lowest`` are no hits. Scores that are not yet rounded
    need a ``slack``; they are rounded where they come near the floor only.
    """
    hit = scores >= np.maximum(floor - slack, lowest)[:, None]
    if lowest == -np.inf:
        hit &= scores > -np.inf
    crowded = np.flatnonzero(np.count_nonzero(hit, axis=1) > CROWDED * k)
    if len(crowded):
        at = scores.shape[1] - k
        least = np.partition(np.where(hit[crowded], scores[crowded], -np.inf), at, axis=1)[:, at]
        hit[crowded] &= scores[crowded] >= (least - slack)[:, None]
    q, at = np.nonzero(hit)
    return first_of(q, at, settled(scores[q, at]) if slack else scores[q, at], k, floor)[:2]


def first_of(q: np.ndarray, at: np.ndarray, scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (question, column, score) each question's k best, equal scores by column; ``floor`` rises to the k-th."""
    by = np.lexsort((at, -scores, q))
    q, at, scores = q[by], at[by], scores[by]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    last = place == k - 1
    floor[q[last]] = np.maximum(floor[q[last]], scores[last])
    keep = (place < k) & (scores >= floor[q]) & (scores > -np.inf)
    return q[keep], at[keep], scores[keep]


def hit_schema(questions: DataFrame, index: DataFrame) -> str:
    kinds = [(c, df.schema[c].dataType.simpleString()) for df, c in ((questions, "question_id"), (index, "chunk_id"))]
    return ", ".join([*(f"{c} {kind}" for c, kind in kinds), "score double"])
