"""Ranked lexical search: item weights times document impacts, multiplied in dense float64 tiles whose sums are exact."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import col, map_texts, running_totals
from corpusmill.session import materialize

K = 20
#: (item, term) pairs that are searched in one pass over the documents: a bound for what the driver and each task hold of the items.
GROUP_PAIRS = 1 << 20
ITEM_TILE, TERM_TILE, DOC_TILE = 256, 1 << 11, 1024
#: Weights are multiplied in planes of this many bits. An impact is below 1,000,000 < 2^20, so TERM_TILE products of a plane sum to less than 2^53.
PLANE_BITS = 22
#: Bytes of a long text whose words are held at a time.
TEXT_WINDOW = 1 << 20
#: Lists of the tasks are merged in so many parts before the last merge.
MERGE_PARTS = 32

_LETTERS = bytes(range(ord("A"), ord("Z") + 1))
_OTHER = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_NORMAL = bytes.maketrans(_LETTERS + _OTHER, _LETTERS.lower() + b" " * len(_OTHER))


def terms(data: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, some at a time: maximal runs of ASCII letters, digits and all that is not ASCII; A-Z lower-cased."""
    data = data or b""
    start = 0
    while start < len(data):
        stop = start + TEXT_WINDOW
        part = data[start:stop].translate(_NORMAL)
        while stop < len(data) and part[-1:] != b" ":
            # The window ends inside a term: take the rest of the term as well.
            more = data[stop : stop + 4096].translate(_NORMAL)
            cut = more.find(b" ") + 1 or len(more)
            part += more[:cut]
            stop += cut
        yield part.split()
        start = stop


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms, counts, pairs) of every different (item_id, text) that has a term."""

    def work(columns: list[list]) -> dict[str, object]:
        ids, texts = columns
        found = [Counter() for _ in texts]
        for count, text in zip(found, texts, strict=True):
            for some in terms(text):
                count.update(some)
        return {"item_id": ids, "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found], "pairs": [len(c) for c in found]}

    rows = items.select(col("item_id").cast("long").alias("item_id"), col("text").alias("text")).distinct()
    rows = rows.select("item_id", F.col("text").cast("binary").alias("text"))
    return map_texts(rows, "item_id long, terms array<binary>, counts array<long>, pairs long", work).where("pairs > 0")


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf) of every document with a term: number of its terms, and number in ``vocabulary`` and count of those it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(columns: list[list]) -> dict[str, object]:
        ids, texts = columns
        out: dict[str, list] = {"doc_id": ids, "n": [], "at": [], "tf": []}
        known = shared.value.get
        for text in texts:
            n, held = 0, Counter()
            for some in terms(text):
                n += len(some)
                held.update(map(known, some))
            held.pop(None, None)
            out["n"].append(n)
            out["at"].append(np.fromiter(held.keys(), np.int32, len(held)))
            out["tf"].append(np.fromiter(held.values(), np.int64, len(held)))
        return out

    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("binary").alias("text"))
    return map_texts(rows, "doc_id long, n long, at array<int>, tf array<long>", work).where("n > 0")


class ItemTile:
    """Up to ITEM_TILE items over the compact vocabulary of just these items, commonest terms first."""

    def __init__(self, items: list[dict[int, int]], frequency: np.ndarray) -> None:
        used = np.array(sorted({t for item in items for t in item}), np.int64)
        self.terms = used[np.argsort(-frequency[used], kind="stable")]
        self.n = len(items)
        place = {int(t): i for i, t in enumerate(self.terms)}
        entries = [(i, place[t], w) for i, item in enumerate(items) for t, w in item.items()]
        self.item = np.array([e[0] for e in entries], np.int32)
        self.at = np.array([e[1] for e in entries], np.int32)
        self.weight = np.array([e[2] for e in entries], np.int64)

    def matrix(self, tile: int, plane: int) -> np.ndarray | None:
        """One plane of the weights (items, terms) of one tile of the vocabulary."""
        mine = self.at // TERM_TILE == tile
        bits = self.weight[mine] >> (PLANE_BITS * plane) & ((1 << PLANE_BITS) - 1)
        if not bits.any():
            return None
        dense = np.zeros((self.n, min(TERM_TILE, len(self.terms) - tile * TERM_TILE)))
        dense[self.item[mine], self.at[mine] - tile * TERM_TILE] = bits
        return dense

    def planes(self) -> range:
        return range(-(-int(self.weight.max()).bit_length() // PLANE_BITS))

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, size: int) -> np.ndarray:
        """(items, docs) in 64-bit integers; the entries are (row, term, impact) of a tile of documents."""
        place = np.full(size, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        at = place[term]
        out = np.zeros((self.n, docs), np.int64)
        for tile in range(-(-len(self.terms) // TERM_TILE)):
            mine = (at >= 0) & (at // TERM_TILE == tile)
            if not mine.any():
                continue
            rows, local = np.unique(row[mine], return_inverse=True)
            held = np.zeros((min(TERM_TILE, len(self.terms) - tile * TERM_TILE), len(rows)))
            held[at[mine] - tile * TERM_TILE, local] = impact[mine]
            for plane in self.planes():
                weights = self.matrix(tile, plane)
                if weights is not None:
                    out[:, rows] += (weights @ held).astype(np.int64) << (PLANE_BITS * plane)
        return out


class Best:
    """The k best documents of each item; equal scores by id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * items

    def add(self, first: int, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        # What equals the last place may have a smaller id, so it stays in the running.
        open_ = scores >= self.floor[first : first + len(scores), None]
        for i in np.flatnonzero(open_.any(axis=1)):
            mine = open_[i]
            s, o, d = self.rows[first + i]
            s, o, d = np.concatenate([s, scores[i, mine]]), np.concatenate([o, null[mine]]), np.concatenate([d, ids[mine]])
            order = np.lexsort((d, o, -s))[: self.k]
            self.rows[first + i] = s[order], o[order], d[order]
            if len(order) == self.k:
                self.floor[first + i] = s[order[-1]]


def _group(docs: DataFrame, items: list[Row], k: int) -> DataFrame:
    """(q, doc_id, score) of the best documents of each task; ``q`` counts the items."""
    vocabulary: dict[bytes, int] = {}
    for item in items:
        for term in item["terms"]:
            vocabulary.setdefault(bytes(term), len(vocabulary))
    held = materialize(counted(docs, vocabulary), "lexical-counts")
    total = held.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n_docs, n_words = total["docs"], total["words"]
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in held.select(F.explode("at").alias("at")).groupBy("at").count().toLocalIterator():
        frequency[r["at"]] = r["count"]
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency]
    weighted = [{t: c * weight[t] for t, c in zip((vocabulary[bytes(x)] for x in item["terms"]), item["counts"], strict=True) if frequency[t] and weight[t]} for item in items]
    tiles = [(first, weighted[first : first + ITEM_TILE]) for first in range(0, len(items), ITEM_TILE)]
    shared = docs.sparkSession.sparkContext.broadcast(([(first, ItemTile(t, frequency)) for first, t in tiles if any(t)], len(items), len(vocabulary)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_tiles, n_items, size = shared.value
        best = Best(n_items, k)
        for batch in batches:
            for start in range(0, batch.num_rows, DOC_TILE):
                doc, n, at, tf = batch.slice(start, DOC_TILE).columns
                lengths = np.array([75 + 25 * x * n_docs // n_words for x in n.to_pylist()], np.int64)
                row = np.repeat(np.arange(len(lengths)), pc.list_value_length(at).to_numpy(zero_copy_only=False))
                term, count = at.flatten().to_numpy(), tf.flatten().to_numpy()
                impact = (1_000_000_000 * count) // (1000 * count + 12 * lengths[row])
                null, ids = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
                for first, tile in item_tiles:
                    best.add(first, tile.scores(row, term, impact, len(lengths), size), null, ids)
        for q, (s, o, d) in enumerate(best.rows):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q, np.int32)), pa.array(d, mask=o), pa.array(s)], names=["q", "doc_id", "score"])

    return held.mapInArrow(rank, "q int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of every item (item_id, text): item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores are ordered by doc_id, a null
    doc_id last. Each row of ``docs`` is a document, so repeated rows take
    places of their own. Rows of ``items`` that share id and text are one item;
    different texts of one id are ranked each. Null and empty texts have no
    terms: they are found by nothing and find nothing. Long texts are read in
    windows. An empty table on either side gives no rows.

    Items are searched in groups of GROUP_PAIRS pairs of item and term (and the
    longest item), each in one pass over all documents; a task holds one tile of
    documents, of terms and of items at a time and passes on k rows per item.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items), "lexical-items")
    asked = running_totals(asked, [], [F.col("item_id"), F.xxhash64("terms", "counts")], {"pairs": "before"}, "lexical-groups")
    asked = materialize(asked.withColumn("block", F.floor(F.col("before") / GROUP_PAIRS)), "lexical-blocks")
    blocks = [r["block"] for r in asked.select("block").distinct().orderBy("block").toLocalIterator()]
    found = []
    for block in blocks:
        group = asked.where(F.col("block") == block).select("item_id", "terms", "counts").collect()
        names = spark.createDataFrame([(q, item["item_id"]) for q, item in enumerate(group)], "q int, item_id long")
        part = _group(docs, group, k).withColumn("part", F.spark_partition_id() % MERGE_PARTS)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("rank") <= k)
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
        found.append(part.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)
