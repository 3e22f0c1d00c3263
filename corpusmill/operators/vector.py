"""Vector retrieval: exact nearest neighbours, and approximate ones by trained cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.scan import CROWDED, SLACK, Blocks, Floors, best_cells, first_of, hit_schema, settled, write_blocks
from corpusmill.operators.topk import DEFAULT_TOP_K, check_k, top_k
from corpusmill.session import materialize, scratch_path

# Vector cells of the index that a task holds at a time, and scores of one slice of it.
HELD_CELLS = 2_000_000
SCORES_HELD = 2_000_000
# Pairs of vectors that are set side by side.
PAIRS_HELD = 50_000
_SALTS = 32
METRICS = ("cosine", "dot", "euclidean")


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _scores(questions: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Higher is better for every metric; NaN where a zero vector has no direction."""
    if metric == "euclidean":
        sq = (questions**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * questions @ rows.T
        return -np.sqrt(np.maximum(sq, 0))
    out = questions @ rows.T
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out / np.linalg.norm(questions, axis=1)[:, None] / np.linalg.norm(rows, axis=1)[None, :]
    return out


def _best(questions: np.ndarray, rows: np.ndarray, metric: str, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, score) of each question's k best rows, none below ``floor``, which rises.

    Cosines are first taken in single precision: only the cells that may come to the
    floor, within the error of such a sum, are scored in double precision and rounded.
    """
    if metric != "cosine":
        scores = settled(_scores(questions, rows, metric))
        q, at = best_cells(scores, k, floor)
        return q, at, scores[q, at]
    slack = np.float32(SLACK + 2e-7 * (questions.shape[1] + 8))
    with np.errstate(divide="ignore", invalid="ignore"):
        q_norm, r_norm = np.linalg.norm(questions, axis=1), np.linalg.norm(rows, axis=1)
        rough = (questions / q_norm[:, None]).astype(np.float32) @ (rows / r_norm[:, None]).astype(np.float32).T
        hit = rough >= floor.astype(np.float32)[:, None] - slack
        crowded = np.flatnonzero(np.count_nonzero(hit, axis=1) > CROWDED * k)
        if len(crowded):
            at = rough.shape[1] - k
            least = np.partition(np.where(hit[crowded], rough[crowded], -np.inf), at, axis=1)[:, at]
            hit[crowded] &= rough[crowded] >= (least - 2 * slack)[:, None]
        q, at = np.nonzero(hit)
        products = [np.einsum("ij,ij->i", questions[q[i : i + PAIRS_HELD]], rows[at[i : i + PAIRS_HELD]]) for i in range(0, len(q), PAIRS_HELD)]
        scores = settled(np.concatenate([np.zeros(0), *products]) / q_norm[q] / r_norm[at])
    return first_of(q, at, scores, k, floor)


def _with_vector(df: DataFrame, id_col: str, out: str) -> DataFrame:
    return df.select(F.col(id_col).alias(out), "embedding").filter(F.col("embedding").isNotNull())


def search_vector(
    questions: DataFrame,
    index: DataFrame,
    k: int = DEFAULT_TOP_K,
    metric: str = "cosine",
    id_col: str = "chunk_id",
    rank: str = "rank",
) -> DataFrame:
    """Exact k nearest rows per question: question_id, chunk_id, score, rank.

    ``questions`` has question_id and embedding; rows without a vector take no
    part. The index stays where it is and is read once: a task holds some
    HELD_CELLS of it and goes through the blocks of questions.
    """
    check_k(k)
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    qs, rows = _with_vector(questions, "question_id", "question_id"), _with_vector(index, id_col, "chunk_id")
    files = write_blocks(qs, "vector-questions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, floors = Blocks(files), Floors()

        def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # In order of the ids, so that of equal scores the first column is the one to keep.
            table = pa.Table.from_batches(held).sort_by("chunk_id").combine_chunks()
            ids, matrix = table.column("chunk_id").combine_chunks(), _matrix(table.column("embedding"))
            for b in range(len(blocks)):
                asked = blocks[b]
                if not asked.num_rows:
                    continue
                names, vectors, floor = asked.column("question_id").combine_chunks(), _matrix(asked.column("embedding")), floors.of(b, asked.num_rows)
                step = max(1, SCORES_HELD // len(vectors))
                for at in range(0, len(matrix), step):
                    q, place, scores = _best(vectors, matrix[at : at + step], metric, k, floor)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(place + at)), pa.array(scores)], names=["question_id", "chunk_id", "score"])

        held, cells = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                cells += len(batch.column(1).flatten())
                if cells >= HELD_CELLS:
                    yield from answer(held)
                    held, cells = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from answer(held)

    found = rows.select("chunk_id", "embedding").mapInArrow(run, hit_schema(qs, rows))
    return top_k(found, "question_id", F.col("score"), "chunk_id", k, rank)


# Rows per cell that centres are trained on, at most, by MD5 of the id; every row is stored in its cell.
TRAINED_PER_CELL = 256
ROUNDS = 6
# Sums of cells and likenesses are rounded, so that the order in which tasks add them up has no say.
_SUM_DIGITS, _LIKENESS_DIGITS = 6, 9
# Rows of the sample whose neighbours tell how many cells a search must open.
CALIBRATION_ROWS = 64


def _units(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1)[:, None]


def _likeness(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.round(_units(vectors) @ centres.T, _LIKENESS_DIGITS)


@dataclass(frozen=True)
class CellIndex:
    """``rows``: (cell, chunk_id, embedding), stored by cell. ``centres``: a unit vector per cell. ``probes``: how many of
    the likest cells hold the wanted share of neighbours, measured on rows of the index."""

    rows: DataFrame
    centres: np.ndarray
    probes: int


def _train(sample: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after so many turns of k-means by cosine; each turn adds up the rows of a cell where they are."""
    centres, shared = first, sample.sparkSession.sparkContext
    for _ in range(rounds):
        held = shared.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("embedding"))
                    cell = _likeness(x, held.value).argmax(1)
                    np.add.at(sums, cell, _units(x))
                    np.add.at(counts, cell, 1)
            some = np.flatnonzero(counts)
            if len(some):
                lists = pa.array([sums[c].tolist() for c in some], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], names=["cell", "sums"])

        parts = sample.select("embedding").mapInArrow(run, "cell int, sums array<double>").select("cell", F.posexplode("sums").alias("at", "x"))
        new = centres.copy()
        for r in parts.groupBy("cell", "at").agg(F.round(F.sum("x"), _SUM_DIGITS).alias("x")).collect():
            new[r["cell"], r["at"]] = r["x"]
        held.unpersist()
        norms = np.linalg.norm(new, axis=1)
        centres = np.where(norms[:, None] > 0, new / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def _probes(sample: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of likest cells that hold a share ``recall`` of the k nearest of CALIBRATION_ROWS rows, themselves left out."""
    asked = sample.orderBy("order", "chunk_id").limit(CALIBRATION_ROWS).select(F.col("chunk_id").alias("question_id"), "embedding")
    near = search_vector(asked, sample, k + 1).where("question_id <> chunk_id")
    near = top_k(near.select("question_id", "chunk_id", "score"), "question_id", F.col("score"), "chunk_id", k)
    both = near.join(sample.select("chunk_id", F.col("embedding").alias("found")), "chunk_id").join(asked, "question_id").select("embedding", "found").toArrow()
    if not both.num_rows:
        return 1
    likest = np.argsort(-_likeness(_matrix(both.column("embedding")), centres), axis=1, kind="stable")
    cell = _likeness(_matrix(both.column("found")), centres).argmax(1)
    place = np.sort((likest == cell[:, None]).argmax(1))
    return int(place[math.ceil(recall * len(place)) - 1]) + 1


def cell_index(index: DataFrame, cells: int, k: int = DEFAULT_TOP_K, recall: float = 0.9, id_col: str = "chunk_id", rounds: int = ROUNDS) -> CellIndex:
    """Trains centres on a bounded sample of the rows and stores every row in the cell of its likest centre (ties: the first).

    ``probes`` is chosen so that ``recall`` of the k nearest are found, as
    measured. Rows without a vector, or with a zero one, take no part.
    """
    spark, path = index.sparkSession, scratch_path(index.sparkSession, "cells")
    norm = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
    rows = _with_vector(index, id_col, "chunk_id").where(norm > 0)
    order = F.md5(F.col("chunk_id").cast("string"))
    sample = materialize(rows.withColumn("order", order).orderBy("order", "chunk_id").limit(TRAINED_PER_CELL * cells), "cell-sample")
    first = sample.orderBy("order", "chunk_id").limit(cells).select("embedding").toArrow()
    if not first.num_rows:
        return CellIndex(rows.select(F.lit(0).alias("cell"), "chunk_id", "embedding"), np.zeros((0, 0)), 0)
    centres = _train(sample, _units(_matrix(first.column("embedding"))), rounds)
    held, kind = spark.sparkContext.broadcast(centres), {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _likeness(_matrix(batch.column("embedding")), held.value).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["chunk_id", "embedding", "cell"])

    placed = rows.select("chunk_id", "embedding").mapInArrow(place, f"chunk_id {kind['chunk_id']}, embedding {kind['embedding']}, cell int")
    # By cell and a salt: a cell that holds much of the index is many files.
    placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(_SALTS))).write.partitionBy("cell").parquet(path)
    return CellIndex(spark.read.schema(placed.schema).parquet(path), centres, _probes(sample, centres, k, recall))


def search_vector_ann(questions: DataFrame, index: CellIndex, k: int = DEFAULT_TOP_K, rank: str = "rank") -> DataFrame:
    """Approximate neighbours by cosine: each question looks into the ``probes`` cells likest to it, exactly scored.

    Cells that no question looks into are not opened. As in the exact search
    tasks go through blocks of questions, and the index is not shuffled.
    """
    check_k(k)
    centres, probes = index.centres, index.probes
    qs, rows = _with_vector(questions, "question_id", "question_id"), index.rows
    if not len(centres):
        return questions.sparkSession.createDataFrame([], f"{hit_schema(qs, rows)}, {rank} int")
    kind = {f.name: f.dataType.simpleString() for f in qs.schema.fields}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                likest = np.argsort(-np.nan_to_num(_likeness(_matrix(batch.column("embedding")), centres), nan=-2), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(likest.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["question_id", "embedding", "cells"])

    chosen = materialize(qs.mapInArrow(choose, f"question_id {kind['question_id']}, embedding {kind['embedding']}, cells array<int>"), "cell-questions")
    wanted = [r["cell"] for r in chosen.select(F.explode("cells").alias("cell")).distinct().collect()]
    files = write_blocks(chosen, "cell-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files)
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for b in range(len(blocks)):
                asked = blocks[b]
                if not asked.num_rows:
                    continue
                names, vectors, opened = asked.column("question_id").combine_chunks(), _matrix(asked.column("embedding")), asked.column("cells").to_pylist()
                for cell in np.unique(cells):
                    who = np.array([q for q, mine in enumerate(opened) if cell in mine], np.int64)
                    if not len(who):
                        continue
                    part = pa.Table.from_batches([batch.filter(pa.array(cells == cell))]).sort_by("chunk_id").combine_chunks()
                    ids, floor = part.column("chunk_id").combine_chunks(), np.full(len(who), -np.inf)
                    scores = settled(_scores(vectors[who], _matrix(part.column("embedding")), "cosine"))
                    q, place = best_cells(scores, k, floor)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(who[q])), ids.take(pa.array(place)), pa.array(scores[q, place])], names=["question_id", "chunk_id", "score"])

    found = rows.where(F.col("cell").isin(wanted)).select("chunk_id", "embedding", "cell").mapInArrow(run, hit_schema(qs, rows))
    return top_k(found, "question_id", F.col("score"), "chunk_id", k, rank)


def recall_at_k(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the other search returned, per question."""
    hit = found.select("question_id", "chunk_id", F.lit(1).alias("hit"))
    return (
        exact.join(hit, ["question_id", "chunk_id"], "left")
        .groupBy("question_id")
        .agg(F.round(F.count("hit") / F.count(F.lit(1)), 3).alias("recall"))
    )
