"""Keyword retrieval: BM25 over an index of words."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.tokens import term_counts, tokens
from corpusmill.operators.once import with_once
from corpusmill.operators.scan import SLACK, Blocks, Floors, best_cells, settled, write_blocks
from corpusmill.operators.topk import DEFAULT_TOP_K, check_k, top_k
from corpusmill.session import broadcast_if_bounded, materialize, scratch_path

K1 = 1.2
B = 0.75
# Tokens are never empty, so the empty term can carry the chunks of a tile and the totals of the corpus.
_TOTALS = ""
# Chunks that are inverted together; a (term, tile) row is a block of the index.
TILE_CHUNKS = 4096
# Folders of the index by hash of the term: a search opens those of its terms.
BUCKETS = 64
# Blocks of so many neighbouring tiles lie in one file of a bucket, so that a frequent term has many files.
TILE_GROUP = 1024
# Asked postings that a task holds before it goes through the questions.
HELD_POSTINGS = 4_000_000
# Questions that are scored together against a tile.
SCORED_TOGETHER = 256
# What adding one posting costs, in cells of a matrix product.
ADDED_COST = 400
# A chunk that shares a word with a question scores at least this.
TINY = 5e-324


def build_postings(chunks: DataFrame, id_col: str = "chunk_id", text_cols: tuple[str, ...] = ("chunk_text",), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: id, length ``dl``, ``terms`` array<struct<term, tf>> and the columns ``keep``. Row-local, nothing is shuffled."""
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    words = with_once(chunks.select(F.col(id_col).alias("chunk_id"), *keep, text.alias("text")), "toks", tokens(F.col("text")), drop=["text"])
    return words.select("chunk_id", F.size("toks").alias("dl"), term_counts(F.col("toks")).alias("terms"), *keep)


@dataclass(frozen=True)
class KeywordIndex:
    """``blocks``: (bucket, term, tile, at, tf, top_tf, low_dl, ids, dl), sorted by term: the chunks of a tile that hold a term,
    by place in the tile, with the two numbers that bound what a chunk of the block can score. The empty term has the
    tile's chunk ids and lengths. ``stats``: (term, df, total_dl), the empty term with count and length of all chunks."""

    blocks: DataFrame
    stats: DataFrame


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _tile(rows: list[pa.RecordBatch], tile: int) -> pa.RecordBatch:
    """The blocks of a tile's chunks, sorted by term."""
    table = pa.Table.from_batches(rows).sort_by("chunk_id").combine_chunks()
    ids, dl, lists = (table.column(c).combine_chunks() for c in ("chunk_id", "dl", "terms"))
    lengths = dl.to_numpy().astype(np.int32)
    entries = lists.flatten()
    row = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    tf = entries.field("tf").to_numpy()
    coded = pc.dictionary_encode(entries.field("term"))
    words = coded.dictionary
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    code = place[coded.indices.to_numpy()]
    by = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[by], np.arange(len(words) + 1)) if len(words) else np.zeros(1, np.int64)
    row, tf = row[by], tf[by]
    # The empty term first: all chunks of the tile.
    offsets = np.concatenate([[0], starts + len(ids)]).astype(np.int32)
    at = np.concatenate([np.arange(len(ids), dtype=np.int32), row])
    counts = np.concatenate([np.zeros(len(ids), np.int32), tf.astype(np.int32)])
    n = len(words)
    top = np.concatenate([[0], np.maximum.reduceat(tf, starts[:-1])]) if n else np.zeros(1)
    low = np.concatenate([[0], np.minimum.reduceat(lengths[row], starts[:-1])]) if n else np.zeros(1)
    whole = pa.array([0, len(ids)] + [len(ids)] * n, pa.int32())
    rest = pa.array([False] + [True] * n + [False])
    empty = pa.concat_arrays([pa.array([""]), words.take(pa.array(order))])
    return pa.RecordBatch.from_arrays(
        [
            empty, pa.array(np.full(n + 1, tile, np.int64)), pa.ListArray.from_arrays(offsets, pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(counts)),
            pa.array(top.astype(np.int32)), pa.array(low.astype(np.int32)),
            pa.ListArray.from_arrays(whole, ids, mask=rest.slice(0, n + 1)), pa.ListArray.from_arrays(whole, pa.array(lengths), mask=rest.slice(0, n + 1)),
        ],
        names=["term", "tile", "at", "tf", "top_tf", "low_dl", "ids", "dl"],
    )


def inverted(postings: DataFrame) -> DataFrame:
    """The blocks of an index from ``build_postings``: chunks are inverted in the task that holds them, up to TILE_CHUNKS at a time."""
    kind = postings.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, tile = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TILE_CHUNKS - count)
                at += part.num_rows
                held.append(part)
                count += part.num_rows
                if count == TILE_CHUNKS:
                    yield _tile(held, tile)
                    held, count, tile = [], 0, tile + 1
                    # Arrow keeps what it frees; a task must not grow with the number of its tiles.
                    pa.default_memory_pool().release_unused()
        if count:
            yield _tile(held, tile)

    schema = f"term string, tile long, at array<int>, tf array<int>, top_tf int, low_dl int, ids array<{kind}>, dl array<int>"
    rows = postings.select("chunk_id", "dl", "terms").mapInArrow(run, schema)
    # By term, but a frequent term of very many tiles is dealt to several tasks.
    dealt = rows.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.floor(F.col("tile") / TILE_GROUP))
    return dealt.sortWithinPartitions("bucket", "term", "tile")


def term_statistics(blocks: DataFrame) -> DataFrame:
    """Document frequency of each term; the empty term carries chunk count and total length."""
    total = F.coalesce(F.aggregate("dl", F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long"))
    return blocks.select("term", F.size("at").alias("n"), total.alias("d")).groupBy("term").agg(F.sum("n").alias("df"), F.sum("d").alias("total_dl"))


def keyword_index(postings: DataFrame, label: str = "index") -> KeywordIndex:
    """Writes the index of ``postings`` and its statistics to the shared folder."""
    spark, path = postings.sparkSession, scratch_path(postings.sparkSession, label)
    rows = inverted(postings)
    rows.write.partitionBy("bucket").parquet(path)
    blocks = spark.read.schema(rows.schema).parquet(path)
    return KeywordIndex(blocks, materialize(term_statistics(blocks), f"{label}-stats"))


def question_terms(questions: DataFrame) -> DataFrame:
    """Distinct words of each question."""
    return questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))


def weighted_questions(questions: DataFrame, stats: DataFrame) -> DataFrame:
    """(question_id, avgdl, terms array<struct<term, idf>>) of the questions with a word that occurs in the corpus."""
    totals = stats.filter(F.col("term") == _TOTALS)
    n, avgdl = totals.select("df").scalar(), totals.select(F.col("total_dl") / F.col("df")).scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = question_terms(questions).join(stats, "term").select("question_id", F.struct("term", idf.alias("idf")).alias("t"))
    return known.groupBy("question_id").agg(F.array_sort(F.collect_list("t")).alias("terms")).select("question_id", avgdl.alias("avgdl"), "terms")


class _Asked:
    """A block of questions as (question, word, idf) triples, words by number."""

    def __init__(self, rows: pa.Table, near: str | None) -> None:
        lists = rows.column("terms").combine_chunks()
        flat = lists.flatten()
        coded = flat.field("term").dictionary_encode()
        self.ids, self.count = rows.column("question_id").combine_chunks(), len(lists)
        self.q = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()
        self.idf, self.avgdl = flat.field("idf").to_numpy(), rows.column("avgdl")[0].as_py()
        if near:
            # Neighbours of the questions: whose, their ids and, if known, their scores.
            lists = rows.column(near).combine_chunks()
            sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
            self.near_q, self.near = np.repeat(np.arange(len(lists)), sizes), flat.field("chunk_id")
            if flat.type.get_field_index("score") >= 0:
                self.near_scores, ends = flat.field("score").to_numpy(), np.cumsum(sizes)
                self.near_of = list(zip(ends - sizes, ends, strict=True))
                self.lowest = np.full(self.count, np.inf)
                np.minimum.at(self.lowest, self.near_q, self.near_scores)


class _Tile:
    """The asked postings of some chunks, which are sorted by id: word after word, with the bounds of each word."""

    def __init__(self, rows: list[pa.RecordBatch], avgdl: float) -> None:
        # The empty word comes first.
        self.ids, dl = rows[0].column("ids")[0].values, rows[0].column("dl")[0].values.to_numpy()
        rows = [rows[0].slice(1), *rows[1:]]
        norm = K1 * (1 - B + B * dl.astype(np.float64) / avgdl)
        self.words = pa.concat_arrays([r.column("term") for r in rows])
        self.sizes, self.at, tf, tops, lows = (
            np.concatenate([f(r).to_numpy() for r in rows])
            for f in (lambda r: pc.list_value_length(r.column("at")), lambda r: r.column("at").flatten(), lambda r: r.column("tf").flatten(), lambda r: r.column("top_tf"), lambda r: r.column("low_dl"))
        )
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.part = tf * (K1 + 1) / (tf + norm[self.at])
        self.top = tops * (K1 + 1) / (tops + K1 * (1 - B + B * lows / avgdl))

    def runs(self, asked: _Asked) -> np.ndarray:
        """For each triple where its word is in this tile, -1 where it is not."""
        return pc.fill_null(pc.index_in(asked.words, self.words), -1).to_numpy(zero_copy_only=False)[asked.code]

    def bound(self, asked: _Asked, run: np.ndarray) -> np.ndarray:
        """What a chunk of the tile can score at most, by question."""
        there = run >= 0
        return np.bincount(asked.q[there], asked.idf[there] * self.top[run[there]], minlength=asked.count)

    def scores(self, asked: _Asked, run: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(questions, scores by question and chunk) of the ``chosen`` questions, 0 where no word is shared.

        Words that many questions share and many chunks hold are one matrix
        product, the postings of all others are added where they belong.
        """
        n, there = len(self.ids), run >= 0
        often = np.bincount(run[there], minlength=len(self.sizes)) * self.sizes * ADDED_COST > asked.count * n
        row = np.cumsum(often) - 1
        held = np.repeat(often, self.sizes)
        dense = np.zeros((int(often.sum()), n))
        dense[np.repeat(row, self.sizes)[held], self.at[held]] = self.part[held]
        for first in range(0, len(chosen), SCORED_TOGETHER):
            some = chosen[first : first + SCORED_TOGETHER]
            local = np.full(asked.count, -1)
            local[some] = np.arange(len(some))
            mine = np.flatnonzero(there & (local[asked.q] >= 0))
            q, word, idf = local[asked.q[mine]], run[mine], asked.idf[mine]
            wide = often[word]
            weights = np.zeros((len(some), len(dense)))
            np.add.at(weights, (q[wide], row[word[wide]]), idf[wide])
            out = weights @ dense
            q, word, idf = q[~wide], word[~wide], idf[~wide]
            sizes = self.sizes[word]
            at = np.repeat(self.starts[word] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            np.add.at(out.reshape(-1), np.repeat(q * n, sizes) + self.at[at], np.repeat(idf, sizes) * self.part[at])
            yield some, out

    def places(self, wanted: pa.Array) -> np.ndarray:
        """Where chunks lie in the tile, -1 for those that don't."""
        found = pc.index_in(wanted, self.ids.take(pa.array(np.arange(len(self.ids))[::-1])))
        return pc.fill_null(pc.subtract(len(self.ids) - 1, found), -1).to_numpy(zero_copy_only=False)

    def above(self, scores: np.ndarray, wanted: pa.Array, least: np.ndarray) -> list[int]:
        """How many chunks rank above each of ``wanted``, which have the scores ``least``."""
        out = []
        for i, score in enumerate(least):
            n, close = np.count_nonzero(scores > score + SLACK), np.count_nonzero(scores >= max(score - SLACK, TINY))
            if close > n:
                at = np.flatnonzero((scores >= max(score - SLACK, TINY)) & (scores <= score + SLACK))
                near, me = settled(scores[at]), wanted[i].as_py()
                place = bisect_left(range(len(self.ids)), me, key=lambda p: self.ids[p].as_py())
                n += np.count_nonzero(near > score) + np.count_nonzero((near == score) & (at < place))
            out.append(n)
        return out


def _asked(index: KeywordIndex, questions: DataFrame) -> DataFrame:
    """The blocks of the asked terms, tile by tile: other buckets are not opened, other terms are dropped at the scan."""
    terms = questions.select(F.explode("terms.term").alias("term")).distinct().unionAll(questions.sparkSession.range(1).select(F.lit(_TOTALS).alias("term")))
    buckets = [r["b"] for r in terms.select(_bucket(F.col("term")).alias("b")).distinct().collect()]
    blocks = index.blocks.where(F.col("bucket").isin(buckets)).join(broadcast_if_bounded(terms)[0], "term", "left_semi")
    return blocks.select("tile", "term", "at", "tf", "top_tf", "low_dl", "ids", "dl").repartition("tile").sortWithinPartitions("tile", "term")


def scan_tiles(index: KeywordIndex, questions: DataFrame, k: int, near: str | None = None) -> DataFrame:
    """(question_id, chunk_id, score, above) from one pass over the blocks of the asked terms.

    ``questions`` come from ``weighted_questions`` and are written, as each
    task reads them. Without ``near`` each tile gives its k best chunks per
    question; a tile whose bound is below what another tile gave is not scored.
    ``near`` names a column array<struct<chunk_id[, score]>> of ``questions``:
    without scores the tiles also give the scores of these chunks, marked by an
    ``above`` of -1; with scores they give only how many chunks rank above each.
    """
    kinds = (questions.schema["question_id"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString())
    files = write_blocks(questions, "questions")
    counting = near is not None and "score" in questions.schema[near].dataType.elementType.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, floors = Blocks(files), Floors()
        names = ["question_id", "chunk_id", "score", "above"]

        def batch_of(asked: _Asked, q: np.ndarray, ids: pa.Array, scores: np.ndarray, above: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q, pa.int64())), ids, pa.array(scores, pa.float64()), pa.array(above, pa.int64())], names=names)

        def counted(asked: _Asked, tile: _Tile, run: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
            entries, above = [], []
            for some, scores in tile.scores(asked, run, np.flatnonzero((bound > 0) & (bound + 1e-5 >= asked.lowest))):
                for i, q in enumerate(some):
                    first, end = asked.near_of[q]
                    entries += range(first, end)
                    above += tile.above(scores[i], asked.near.slice(first, end - first), asked.near_scores[first:end])
            entries, above = np.array(entries, np.int64), np.array(above, np.int64)
            entries, above = entries[above > 0], above[above > 0]
            if len(entries):
                yield batch_of(asked, asked.near_q[entries], asked.near.take(pa.array(entries)), np.zeros(len(entries)), above)

        def best(asked: _Asked, tile: _Tile, run: np.ndarray, bound: np.ndarray, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
            needed = bound + 1e-5 >= floor
            if near:
                places = tile.places(asked.near)
                needed[asked.near_q[places >= 0]] = True
            for some, scores in tile.scores(asked, run, np.flatnonzero((bound > 0) & needed)):
                least = floor[some]
                q, at = best_cells(scores, k, least, SLACK, TINY)
                floor[some] = least
                if len(q):
                    yield batch_of(asked, some[q], tile.ids.take(pa.array(at)), settled(scores[q, at]), np.zeros(len(q), np.int64))
                if near:
                    local = np.full(asked.count, -1)
                    local[some] = np.arange(len(some))
                    here = np.flatnonzero((places >= 0) & (local[asked.near_q] >= 0))
                    found = scores[local[asked.near_q[here]], places[here]]
                    here, found = here[found > 0], found[found > 0]
                    if len(here):
                        yield batch_of(asked, asked.near_q[here], asked.near.take(pa.array(here)), settled(found), np.full(len(here), -1))

        def answer(held: list[list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
            tiles: list[_Tile] = []
            for b in range(len(blocks)):
                if not blocks[b].num_rows:
                    continue
                asked = _Asked(blocks[b], near)
                floor = floors.of(b, asked.count)
                tiles = tiles or [_Tile(rows, asked.avgdl) for rows in held]
                for tile in tiles:
                    run = tile.runs(asked)
                    bound = tile.bound(asked, run)
                    yield from counted(asked, tile, run, bound) if counting else best(asked, tile, run, bound, floor)

        # Tile by tile: the rows of a tile follow each other, but may come in several batches.
        held, size, now = [], 0, None
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            edges = np.flatnonzero(np.diff(tiles)) + 1
            for first, end in zip([0, *edges], [*edges, len(tiles)], strict=True):
                if first == end:
                    continue
                if tiles[first] != now and size > HELD_POSTINGS:
                    yield from answer(held)
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
                part = batch.slice(first, end - first)
                if tiles[first] != now:
                    now = tiles[first]
                    held.append([])
                held[-1].append(part)
                size += len(part.column("at").flatten())
        if held:
            yield from answer(held)

    return _asked(index, questions).mapInArrow(run, f"question_id {kinds[0]}, chunk_id {kinds[1]}, score double, above long")


def search_keyword(questions: DataFrame, index: KeywordIndex, k: int = DEFAULT_TOP_K, rank: str = "rank") -> DataFrame:
    """The k best chunks per question: question_id, chunk_id, score, rank.

    One way for few and many questions: the blocks of the asked terms meet by
    tile, each task goes through the questions and passes on k rows each.
    """
    check_k(k)
    asked = materialize(weighted_questions(questions, index.stats), "asked")
    found = scan_tiles(index, asked, k).select("question_id", "chunk_id", "score")
    return top_k(found, "question_id", F.col("score"), "chunk_id", k, rank)
