"""Best-fit packing of tokenized documents into sequences of fixed capacity."""

from __future__ import annotations

import bisect
import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import col, map_texts, running_totals, text_key
from corpusmill.session import materialize

CAPACITY = 2048
#: Bytes that the remembered ids of words may take in a worker process; then it starts afresh.
REMEMBERED_BYTES = 16 << 20
#: What a remembered word takes besides its characters and ids, about.
WORD_BYTES = 200
END_ID = 0


# The pattern by which this family of byte-level vocabularies splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space but for the blank, by either of two definitions.
_OTHER_SPACE = re.compile("[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20) + "]")


def byte_ranks(stored: dict) -> dict[bytes, int]:
    """The ranks of a byte-level BPE file whose ids follow the order of its merges; added tokens have none."""
    # The bytes that such files show as themselves; the others are shown as the characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
    back = {c: b for b, c in shown.items()}
    special = {t["content"] for t in stored.get("added_tokens", [])}
    return {bytes(back[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special}


class _Words(dict):
    """Ids of a blank and the string that follows it, and about how many bytes they take."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode, self.bytes = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(" " + word)).tobytes()
        if len(word) <= 64:
            if self.bytes > REMEMBERED_BYTES:
                self.clear()
                self.bytes = 0
            self[word] = ids
            self.bytes += WORD_BYTES + 4 * len(word) + len(ids)
        return ids


class ByteLevelIds:
    """Ids of texts under a byte-level BPE file.

    The file's added tokens cut a text, and each is its own id; with
    ``added_as_text`` their strings are ordinary text. Between a character that is no white space and a single blank before
    another such character there is always a border of the first split, so a
    text is cut there and each different piece is encoded once. Texts with
    other white space next to a blank are encoded whole.
    """

    def __init__(self, path: str, added_as_text: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        added = [] if added_as_text else stored.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        # the longest of those that begin at the same place
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.whole = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=byte_ranks(stored), special_tokens={}).encode_ordinary
        self.words = _Words(self.whole)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not any(token in text for token in self.added):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.cut.split(text) if part)

    def _plain(self, text: str) -> bytes:
        parts = text.split(" ")
        if "" in parts or " \n" in text or "\n " in text or (_OTHER_SPACE.search(text.replace("\n", "x")) if "\n" in text else _OTHER_SPACE.search(text)):
            return array("I", self.whole(text)).tobytes()
        first = array("I", self.whole(parts[0])).tobytes()
        return first + b"".join(map(self.words.__getitem__, parts[1:]))


def _ids(path: str, added_as_text: bool) -> ByteLevelIds:
    """One per worker process, so that what it remembers serves all its tasks."""
    held = sys.__dict__.setdefault("_byte_level_ids", {})
    if (path, added_as_text) not in held:
        held[path, added_as_text] = ByteLevelIds(path, added_as_text)
    return held[path, added_as_text]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, added_as_text: bool = False) -> DataFrame:
    """(doc_id, tk, piece, start, length, ids_crc32[, ids]) of every row: its ids and a closing id 0, cut only where longer than ``capacity``.

    The first piece takes what is left over by whole pieces. Null text counts as
    empty and is the closing id alone. A very long text is one row of ids
    while it is cut, and as many pieces as it needs.
    """

    def work(columns: list[list]) -> dict[str, object]:
        encode = _ids(tokenizer_path, added_as_text).encode
        ids, keys, texts = columns
        end = np.array([END_ID], "<u4").tobytes()
        out: dict[str, list] = {n: [] for n in ("doc_id", "tk", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, key, text in zip(ids, keys, texts, strict=True):
            data = encode(text or "") + end
            n = len(data) // 4
            first = n % capacity or capacity
            edges = [0, *range(first, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                part = data[4 * a : 4 * b]
                for name, value in zip(out, (doc, key, piece, a, b - a, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None), strict=True):
                    out[name].append(value)
        if not with_ids:
            out.pop("ids")
        return out

    schema = "doc_id long, tk long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_key(col("text")).alias("tk"), col("text").alias("text"))
    return map_texts(rows, schema, work)


class _Gaps:
    """Open bins by gap: equal bins are one run (first bin, number of bins)."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in self.runs:
                bisect.insort(self.sizes, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, count))

    def best(self, size: int) -> tuple[int, int, int] | None:
        """The run with the smallest gap of at least ``size``, taken out."""
        i = bisect.bisect_left(self.sizes, size)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, count = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[i]
        return gap, first, count


#: (size, rank of the first item, number of items, first bin, items per bin, offset in the bin)
Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the items of each size go, by rank within the size; ``counts``: size to number of items.

    Sizes, not items, are planned: there are at most ``capacity`` of them at
    any scale. Items above a third of the capacity go at most two to a bin:
    each takes the largest partner that fits, in order of size, items of over
    half first. Smaller items, largest first, go where the least gap is left.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("item sizes must be from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps, bins = _Gaps(), 0

    def lay(size: int, items: int, first: int, per_bin: int, offset: int) -> None:
        runs.append((size, used[size], items, first, per_bin, offset))
        used[size] += items
        left[size] -= items

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    rising = large[::-1]
    for s in large:
        while left[s]:
            i = bisect.bisect_right(rising, min(capacity - s, s)) - 1
            while i >= 0 and (not left[rising[i]] or rising[i] == s and left[s] < 2):
                i -= 1
            if i < 0:
                n = left[s]
                lay(s, n, bins, 1, 0)
                gaps.put(capacity - s, bins, n)
            elif rising[i] == s:
                n = left[s] // 2
                lay(s, 2 * n, bins, 2, 0)
                gaps.put(capacity - 2 * s, bins, n)
            else:
                mate = rising[i]
                n = min(left[s], left[mate])
                lay(s, n, bins, 1, 0)
                lay(mate, n, bins, 1, s)
                gaps.put(capacity - s - mate, bins, n)
            bins += n
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        while left[s]:
            found = gaps.best(s)
            if found is None:
                per = capacity // s
                n = max(1, left[s] // per)
                per = min(per, left[s])
                lay(s, n * per, bins, per, 0)
                gaps.put(capacity - per * s, bins, n)
                bins += n
                continue
            gap, first, count = found
            per = gap // s
            n = min(count, max(1, left[s] // per))
            per = min(per, left[s])
            lay(s, n * per, first, per, capacity - gap)
            gaps.put(gap - per * s, first, n)
            gaps.put(gap, first + n, count - n)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "tk", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    Lengths are counted, the plan is made on the at most ``capacity`` counts,
    and each row finds its place by its rank among the rows of its length. Ranks
    come from range-sorted runs, so a length shared by a third of all rows is
    spread. Rows that ``order`` can't tell apart are interchangeable.
    """
    ranked = running_totals(pieces.withColumn("_one", F.lit(1).cast("long")), ["length"], [F.col(c).asc_nulls_first() for c in order], {"_one": "_rank"}, "pack-ranges").drop("_one")
    ranked = materialize(ranked, "pack-ranked")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(counts, capacity)
    by_size: dict[int, np.ndarray] = {}
    for size in counts:
        by_size[size] = np.array([r[1:] for r in runs if r[0] == size], np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast(by_size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for size in np.unique(lengths):
                mine = lengths == size
                table, r = shared.value[int(size)], ranks[mine]
                at = np.searchsorted(table[:, 0], r, side="right") - 1
                inner = r - table[at, 0]
                sequence[mine] = table[at, 2] + inner // table[at, 3]
                offset[mine] = table[at, 4] + inner % table[at, 3] * size
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(sequence), pa.array(offset)], names=[n for n, _ in kept] + ["sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([f for f in ranked.schema.fields if f.name != "_rank"]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document (doc_id, text) with its place in a sequence.

    Null and empty texts are one piece of length 1. Repeated rows are packed
    each. Null doc_ids are packed too. An empty table gives no rows.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity), "pack-pieces"), capacity)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the token ids of each packed sequence, at most ``capacity`` of them."""
    placed = pack(materialize(token_pieces(docs, tokenizer_path, capacity, with_ids=True), "pack-pieces"), capacity)
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))
