"""Approximate nearest neighbours by largest inner product with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import col
from corpusmill.session import materialize

#: Centroids of each half; the index has this number squared of cells.
CENTROIDS = 64
#: The centroids are fitted on so many vectors at most, chosen by hash; every vector is indexed.
SAMPLE_ROWS = 20_000
ROUNDS = 12
#: Cells are visited until they hold this share of all vectors. Vectors without any clusters need about 0.4 for a recall of 0.9.
VISITED_SHARE = 0.5
#: Vectors that one task compares with a block of queries, and queries in a block.
TILE_ROWS, BLOCK_QUERIES = 4096, 2048


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, not zero, every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Codebook:
    first: np.ndarray
    second: np.ndarray

    @property
    def split(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: its nearest centroid pair."""
        a, b = x[:, : self.split], x[:, self.split :]
        i = (a @ self.first.T - 0.5 * (self.first**2).sum(1)).argmax(1)
        j = (b @ self.second.T - 0.5 * (self.second**2).sum(1)).argmax(1)
        return i * len(self.second) + j

    def visit(self, q: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
        """Cells in order of summed distance (less is a larger inner product) until they hold ``wanted`` vectors.

        The multi-sequence walk: a heap holds the next pairs of the two sorted
        lists of centroids; a pair enters when both pairs before it have left.
        """
        da, db = -(self.first @ q[: self.split]), -(self.second @ q[self.split :])
        oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        da, db = da[oa].tolist(), db[ob].tolist()
        heap, done, out, held = [(da[0] + db[0], 0, 0)], set(), [], 0
        width = len(ob)
        taken = [0] * len(oa)  # of row i the pairs (i, 0..taken - 1) have left
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            taken[i] = j + 1
            cell = oa[i] * width + ob[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(oa) and b < width and (a, b) not in done and (a == 0 or taken[a - 1] > b) and (b == 0 or taken[a] >= b):
                    done.add((a, b))
                    heapq.heappush(heap, (da[a] + db[b], a, b))
        return out


def fit(vectors: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> Codebook | None:
    """Centroids of both halves from up to ``sample_rows`` vectors (vec_id, v), the ones with the smallest hashes."""
    rows = vectors.select("v", F.xxhash64("vec_id", F.lit(5)).alias("h")).orderBy("h").limit(sample_rows).select("v").toPandas()
    if not len(rows):
        return None
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    half = max(1, x.shape[1] // 2)
    return Codebook(_k_means(x[:, :half], centroids, ROUNDS, 1), _k_means(x[:, half:], centroids, ROUNDS, 2))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, always summed in the same order, so that equal vectors score equally."""
    return (a * b).sum(axis=1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = VISITED_SHARE, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of ``vectors`` for each of ``queries`` (both vec_id, embedding).

    A row with the query's own vec_id is no candidate. score is the inner
    product of the original vectors in double precision; ties go to the smaller
    vec_id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do null vec_ids or vectors of another length
    than the most frequent one. Repeated rows are candidates of their own; a
    repeated query id asks once, with its least vector.
    A cell of more than TILE_ROWS vectors is dealt to several tiles; a tile
    meets the queries that visit it in blocks, so what a task holds is bounded.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(col("embedding"), lambda x: x.cast("double"))
        return df.select(col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())

    rows, asked = clean(vectors), clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return empty
    rows, asked = rows.where(F.size("v") == size[0]["n"]), asked.where(F.size("v") == size[0]["n"])
    book = fit(rows, centroids, sample_rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = book.cells(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32))], names=["vec_id", "v", "cell"])

    indexed = materialize(rows.mapInArrow(index, "vec_id long, v array<double>, cell int"), "ann-index")
    cells = len(book.first) * len(book.second)
    counts = np.zeros(cells, np.int64)
    for r in indexed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    # cells side by side share a tile up to TILE_ROWS vectors; a larger cell has tiles of its own
    tile, parts, now, held = np.zeros(cells, np.int64), np.ones(cells, np.int64), 0, 0
    for c in range(cells):
        if counts[c] > TILE_ROWS:
            now += 1
            tile[c], parts[c] = now, -(-counts[c] // TILE_ROWS)
            now, held = now + int(parts[c]), 0
        else:
            if held + counts[c] > TILE_ROWS:
                now, held = now + 1, 0
            tile[c] = now
            held += counts[c]
    wanted = max(2 * k, int(np.ceil(share * total)))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    tile_of, parts_of = F.array(*map(F.lit, tile.tolist())), F.array(*map(F.lit, parts.tolist()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_pylist(), _matrix(batch.column(1))
            for lo in range(0, len(ids), 64):
                rows_out = []
                for i in range(lo, min(lo + 64, len(ids))):
                    by: dict[int, list[int]] = {}
                    for c in book.visit(q[i], counts, wanted):
                        for p in range(parts[c]):
                            by.setdefault(int(tile[c]) + p, []).append(c)
                    rows_out += [(ids[i], i, t, cs) for t, cs in by.items()]
                take = pa.array([r[1] for r in rows_out], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows_out], pa.int64()), batch.column(1).take(take), pa.array([r[2] for r in rows_out], pa.int64()), pa.array([r[3] for r in rows_out], pa.list_(pa.int32()))],
                    names=["query_id", "q", "tile", "cells"],
                )

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    visits = asked.mapInArrow(walk, "query_id long, q array<double>, tile long, cells array<int>").select("*", block)
    dealt = indexed.select(
        "vec_id", "v", "cell", (F.get(tile_of, F.col("cell")) + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.get(parts_of, F.col("cell")))).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )

    def compare(visit: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(visit) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, x, cell = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()), rows["cell"].to_numpy()
            slot = np.zeros(cells, bool)
            for lo in range(0, len(visit), 256):
                part = visit.iloc[lo : lo + 256]
                q, own = np.stack(part["q"].to_numpy()), part["query_id"].to_numpy()
                scores = q @ x.T
                for i, cs in enumerate(part["cells"]):
                    slot[:] = False
                    slot[cs] = True
                    at = np.flatnonzero(slot[cell] & (ids != own[i]))
                    if len(at) > k:
                        s = scores[i, at]
                        at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * (1 + np.abs(s).max())]
                    exact = _dot(np.broadcast_to(q[i], (len(at), q.shape[1])), x[at])
                    best = np.lexsort((ids[at], -exact))[:k]
                    out.append((np.full(len(best), own[i]), ids[at][best], exact[best]))
        if not out:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    found = visits.groupBy("tile", "block").cogroup(dealt.groupBy("tile", "block")).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
