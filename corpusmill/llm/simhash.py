"""Near duplicates by SimHash, compared in blocks.

Fingerprints of the same table key meet in one block. Small blocks are set
against themselves, shifted by 1, 2, ... rows, all at once and word by word;
pairs beyond the radius are left out of the further words. A large block is
stored vertically: plane ``b`` holds bit ``b`` of 64 fingerprints in one
machine word, so one XOR compares a bit of 64 pairs and a carry-save counter
adds it to 64 distances. Words in which all 64 distances exceed the radius are
left out of the further planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import col, components, fresh, map_texts, same, text_key
from corpusmill.session import materialize

SEED = 42
#: A long text is read in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
#: Fingerprints of one key beyond this are dealt to tiles, each pair of tiles to one task.
TILE_ROWS = 8192
#: Tables that are gone through before the others.
FIRST_TABLES = 4
#: Rows that a task compares at a time.
HELD_ROWS = 1 << 15
#: Blocks of fewer rows are compared by shifts, larger ones by query.
SMALL_BLOCK = 256
#: Links of small blocks that are held before those that join nothing new are left out.
LINKS_HELD = 1 << 19
#: Planes between two looks for words to abandon.
STEP = 16

#: (word, first bit, number of bits)
Field = tuple[int, int, int]


@dataclass(frozen=True)
class SimHash:
    """How fingerprints are made and linked.

    ``tables``: each is a list of bit fields; two fingerprints are compared
    when all fields of one table agree, and linked at ``radius`` differing bits
    or fewer.
    """

    shingle_words: int
    words: int
    radius: int
    tables: tuple[tuple[Field, ...], ...]


def exact_tables() -> tuple[tuple[Field, ...], ...]:
    """For 64 bits and radius 3: of five fields three at most can differ, so two agree. No pair is lost."""
    fields = [(0, 0, 13), (0, 13, 13), (0, 26, 13), (0, 39, 13), (0, 52, 12)]
    return tuple((fields[i], fields[j]) for i in range(5) for j in range(i + 1, 5))


def band_tables(words: int, bits: int = 16) -> tuple[tuple[Field, ...], ...]:
    return tuple(((w, s, bits),) for w in range(words) for s in range(0, 64, bits))


#: 64 bits over three-word shingles, radius 3.
CONTRACT = SimHash(3, 1, 3, exact_tables())
#: 512 bits over five-word shingles. Sets with Jaccard similarity 0.8 have an expected share of arccos(0.889) / pi = 0.151
#: differing bits, 77 of 512 with a deviation of 8; the radius is one deviation above. Unrelated texts differ in 256, deviation 11.
#: One of the 32 bands agrees with probability 0.91 at similarity 0.8, 0.97 at 0.85, 0.998 at 0.9.
FIVE_WORDS = SimHash(5, 8, 84, band_tables(8))

#: Texts that share so many of their different shingles are near duplicates.
SIMILARITY = 0.8
#: Members and shingles of a cluster that one task goes through.
CLUSTER_ROWS, CLUSTER_HASHES = 1024, 4_000_000
#: Other members of the cluster that a task compares with those that stay of the first.
SLICE_ROWS = 4096
#: Sets that are indexed together.
INDEXED_SETS = 16

_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def _mix(x: np.ndarray, word: int) -> np.ndarray:
    """An independent 64-bit hash of a hash for each further word; word 0 is the hash itself."""
    if word == 0:
        return x
    x = x + np.uint64((0x9E3779B97F4A7C15 * word) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces that end between words."""
    if len(data) <= PIECE_BYTES:
        yield data.lower().split()
        return
    space, at = b" \t\n\r\x0b\x0c", 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data) and data[end] not in space:
            end += 1
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(text: str | None, k: int) -> Iterator[list[int]]:
    """XXH64 of every run of ``k`` words (all words where there are fewer), piece by piece."""
    digest, tail, any_yet = xxhash.xxh64_intdigest, [], False
    for words in _pieces((text or "").encode("utf-8", "surrogatepass")):
        words = tail + words
        if len(words) >= k:
            joined, ends, at = b" ".join(words), [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            starts = [0] + [e + 1 for e in ends[:-1]]
            yield [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)]
            any_yet, tail = True, words[len(words) - k + 1 :] if k > 1 else []
        else:
            tail = words
    if tail and not any_yet:
        yield [digest(b" ".join(tail), SEED)]


def fingerprints(texts: list[str | None], shingle_words: int, words: int) -> np.ndarray:
    """(texts, words) fingerprints: a bit is set where over half of the hashes have it."""
    n = len(texts)
    counts, totals = np.zeros((n, words, 64)), np.zeros(n)
    held: list[list[int]] = []
    owner: list[int] = []

    def settle() -> None:
        if not held:
            return
        sizes = np.array([len(h) for h in held])
        hashes = np.fromiter((x for h in held for x in h), np.uint64, int(sizes.sum()))
        local = np.repeat(np.arange(len(held), dtype=np.int64) * 256, sizes)
        own = np.array(owner)
        for w in range(words):
            octets = _mix(hashes, w).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                seen = np.bincount(local + octets[:, b], minlength=256 * len(held)).reshape(-1, 256)
                np.add.at(counts[:, w, 8 * b : 8 * b + 8], own, seen @ _BIT)
        np.add.at(totals, own, sizes)
        held.clear()
        owner.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in shingle_hashes(text, shingle_words):
            held.append(part)
            owner.append(i)
            size += len(part)
            if size > 1 << 17:
                settle()
                size = 0
    settle()
    bits = (2 * counts > totals[:, None, None]).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64).reshape(n, words)


def with_fingerprints(docs: DataFrame, how: SimHash) -> DataFrame:
    """(doc_id, text key ``tk``, fingerprint ``w`` as an array of longs) of every row. Null text counts as empty."""

    def work(columns: list[list]) -> dict[str, object]:
        ids, keys, texts = columns
        prints = fingerprints(texts, how.shingle_words, how.words).view(np.int64)
        flat = pa.array(prints.reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, prints.size + 1, how.words, dtype=np.int32)), flat)
        return {"doc_id": ids, "tk": keys, "w": lists}

    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_key(col("text")).alias("tk"), col("text").alias("text"))
    return map_texts(rows, "doc_id long, tk long, w array<long>", work)


# ---- comparison of blocks -------------------------------------------------------------------------------------------


def planes(prints: np.ndarray) -> np.ndarray:
    """(bits, words of 64 lanes): row ``b`` holds bit ``b`` of all fingerprints; one spare word at the end."""
    n, width = prints.shape
    lanes = (n // 64 + 2) * 64
    bits = np.zeros((64 * width, lanes), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius."""
    more, equal = over.copy(), ~over
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            more |= equal & counters[level]
            equal &= ~counters[level]
    return more


def near(diff: Callable[[int, np.ndarray], np.ndarray], order: np.ndarray, radius: int, words: int) -> np.ndarray:
    """A bit for each lane of ``words`` words: is its distance within the radius?

    ``diff(b, slots)`` gives the lanes that differ in bit ``b``, for the words still compared.
    """
    depth = max(1, radius.bit_length())
    found, slots = np.zeros(words, np.uint64), np.arange(words)
    counters, over = [np.zeros(words, np.uint64) for _ in range(depth)], np.zeros(words, np.uint64)
    full = np.uint64(2**64 - 1)
    for at in range(0, len(order), STEP):
        now = order[at : at + STEP]
        for i in range(0, len(now), 2):
            x = diff(now[i], slots)
            ones = counters[0] ^ x
            carry = counters[0] & x
            if i + 1 < len(now):
                y = diff(now[i + 1], slots)
                carry |= ones & y
                ones = ones ^ y
            counters[0] = ones
            for level in range(1, depth):
                c = counters[level]
                counters[level] = c ^ carry
                carry = c & carry
            over |= carry
        far = _exceeds(counters, over, radius)
        live = far != full
        if not live.any():
            return found
        if live.mean() < 0.8:
            slots, over, counters = slots[live], over[live], [c[live] for c in counters]
            far = far[live]
    found[slots] = ~far
    return found


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def small_blocks(prints: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows connected within the radius in blocks of consecutive rows; the rows are shifted by 1, 2, ... against themselves.

    In as many words as unrelated fingerprints need to differ in more bits than the radius, all pairs
    are counted; in the others only those that are still within it.
    """
    rank = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    sizes = sizes[rank]
    rows = np.repeat(starts[rank] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(rows)) - 1  # rows of the same block that follow
    stored = np.ascontiguousarray(prints[rows].T)
    whole = min(len(stored), radius // 32 + 2)
    kind = np.uint8 if whole < 4 else np.uint16
    a, b = [], []
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        # Blocks are sorted by size, so those that have rows so far apart come first.
        reach = int(sizes[: np.searchsorted(-sizes, -d)].sum()) - d
        apart = np.zeros(reach, kind)
        for word in stored[:whole]:
            apart += np.bitwise_count(word[:reach] ^ word[d : reach + d])
        hits = np.flatnonzero((apart <= radius) & (left[:reach] >= d))
        apart = apart[hits].astype(np.int64)
        for word in stored[whole:]:
            apart += np.bitwise_count(word[hits] ^ word[hits + d])
            hits, apart = hits[apart <= radius], apart[apart <= radius]
        a.append(rows[hits])
        b.append(rows[hits + d])
        if sum(map(len, a)) > LINKS_HELD:
            a, b = ([x] for x in _spanning(np.concatenate(a), np.concatenate(b)))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def large_block(prints: np.ndarray, radius: int, order: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all rows of a block that are connected within the radius, but not every pair.

    Rows are taken as queries, found ones first, and a row leaves the planes
    when it is found: in a dense group almost all leave at the first query.
    Queries are also compared with the rows that were found and wait for their
    turn, as far as those are not yet joined with them.
    """
    out: list[tuple[int, int]] = []
    group = np.arange(len(prints))  # a number for each set of rows joined so far

    def join(a: int, b: int) -> None:
        if group[a] != group[b]:
            group[group == group[b]] = group[a]
            out.append((a, b))

    unseen, found = np.arange(len(prints)), []
    stored, alive = planes(prints), np.ones(len(prints), bool)
    full = np.uint64(2**64 - 1)
    while alive.any() or found:
        take, found = found[:64], found[64:]
        if len(take) < 64:
            seeds = np.flatnonzero(alive)[: 64 - len(take)]
            alive[seeds] = False
            take = take + unseen[seeds].tolist()
        block = prints[take]
        apart = np.bitwise_count(block[:, None, :] ^ block[None, :, :]).sum(2, dtype=np.int64)
        i, j = np.nonzero(np.triu(apart <= radius, 1))
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            join(take[x], take[y])
        waiting = np.array(found, np.int64)
        waiting = waiting[(group[waiting] != group[take][:, None]).any(0)]
        apart = np.bitwise_count(block[:, None, :] ^ prints[waiting][None, :, :]).sum(2, dtype=np.uint16)
        i, j = np.nonzero((apart <= radius) & (group[take][:, None] != group[waiting]))
        for x, y in zip(i.tolist(), waiting[j].tolist(), strict=True):
            join(take[x], y)
        if not alive.any():
            continue
        if alive.sum() * 2 < len(alive):
            unseen = unseen[alive]
            stored, alive = planes(prints[unseen]), np.ones(len(unseen), bool)
        words = (len(unseen) + 63) // 64
        mask = np.where(np.unpackbits(np.ascontiguousarray(block).view(np.uint8).reshape(len(take), -1), axis=1, bitorder="little").T, full, np.uint64(0))

        def diff(bit: int, slots: np.ndarray, stored=stored, mask=mask, words=words) -> np.ndarray:
            return stored[bit][slots % words] ^ mask[bit][slots // words]

        hits = near(diff, order, radius, words * len(take)).reshape(len(take), words)
        finder = np.full(len(unseen), -1)  # the query that found a row of this turn first
        for q in range(len(take)):
            lanes = _lanes(hits[q])
            lanes = lanes[lanes < len(unseen)]
            lanes = lanes[alive[lanes]]
            fresh_rows = lanes[finder[lanes] < 0]
            shared = lanes[finder[lanes] >= 0]
            # queries that find the same row are joined by it: one row for each pair of queries is enough
            shared = shared[np.unique(finder[shared], return_index=True)[1]]
            finder[fresh_rows] = q
            group[unseen[fresh_rows]] = group[take[q]]
            out += [(take[q], r) for r in unseen[fresh_rows].tolist()]
            for r in unseen[shared].tolist():
                join(take[q], r)
        new = np.flatnonzero(finder >= 0)
        alive[new] = False
        found += unseen[new].tolist()
    return out


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers the least one that the links (a, b) reach."""
    least = np.arange(n)
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        now = now[now]
        if (now == least).all():
            return now
        least = now


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join something not yet joined: turn by turn each set of rows takes its first link to another one."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, of = at[: len(a)], at[len(a) :], np.arange(len(rows))
    open_, taken = np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        open_ = open_[of[x[open_]] != of[y[open_]]]
        if not len(open_):
            taken = np.concatenate(taken)
            return a[taken], b[taken]
        first = np.full(len(rows), len(a))
        np.minimum.at(first, of[x[open_]], open_)
        np.minimum.at(first, of[y[open_]], open_)
        taken.append(np.unique(first[first < len(a)]))
        of = _least(len(rows), of[x[taken[-1]]], of[y[taken[-1]]])[of]


def block_links(ids: np.ndarray, prints: np.ndarray, sizes: np.ndarray, radius: int, order: np.ndarray | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between the ids of consecutive blocks. ``order``: planes to compare in large blocks, of all or of each."""
    small = (sizes > 1) & (sizes < SMALL_BLOCK)
    starts, a, b = np.cumsum(sizes) - sizes, [], []
    if small.any():
        rows = np.flatnonzero(np.repeat(small, sizes))
        x, y = _spanning(*small_blocks(prints[rows], sizes[small], radius))
        a.append(rows[x])
        b.append(rows[y])
    for g in np.flatnonzero(sizes >= SMALL_BLOCK):
        s = starts[g]
        pairs = np.array(large_block(prints[s : s + sizes[g]], radius, order[g] if isinstance(order, list) else order), np.int64).reshape(-1, 2)
        a.append(s + pairs[:, 0])
        b.append(s + pairs[:, 1])
    at = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b)]
    return _spanning(ids[at[0]], ids[at[1]])


def _orders(how: SimHash) -> list[np.ndarray]:
    """For each table the planes to compare: not those on which its blocks agree; far-apart bits first."""
    out = []
    for fields in how.tables:
        same_bits = {64 * w + s + i for w, s, n in fields for i in range(n)}
        bits = np.array([b for b in range(64 * how.words) if b not in same_bits])
        out.append(bits[np.argsort((bits * 37) % 509, kind="stable")])
    return out


def links(nodes: DataFrame, how: SimHash, tables: range) -> DataFrame:
    """(a, b) links between the roots of ``nodes`` (id, w, root): with what the roots join already, they join exactly what
    pairs within the radius that share a key of one of ``tables`` join.

    A key of more than TILE_ROWS fingerprints is dealt to tiles by hash and
    every pair of tiles meets in a task of its own, so no task holds a key whole.
    """
    w = F.col("w")

    def key(fields: tuple[Field, ...]):
        out = F.lit(0).cast("long")
        for word, start, bits in fields:
            out = F.shiftleft(out, bits).bitwiseOR(F.shiftrightunsigned(w[word], start).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        return out

    keys = F.array(*[F.struct(F.lit(t).alias("t"), key(how.tables[t]).alias("k")) for t in tables])
    keyed = nodes.select("id", "w", "root", F.explode(keys).alias("x")).select("id", "w", "root", "x.t", "x.k")
    hot = materialize(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE_ROWS), "simhash-hot").select(F.col("t").alias("ht"), F.col("k").alias("hk"), "n")
    tiles = F.coalesce(F.ceil(F.col("n") / F.lit(TILE_ROWS)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = (
        keyed.join(hot, (F.col("t") == F.col("ht")) & (F.col("k") == F.col("hk")), "left")
        .select("id", "w", "root", "t", "k", tiles.alias("tiles"))
        .select("root", "w", "t", "k", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))).alias("x"))
        .select("root", "w", "t", "k", "x.i", "x.j")
    )
    orders, radius, width = _orders(how), how.radius, how.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def compare(ids: np.ndarray, prints: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            starts = np.concatenate([[0], edge])
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            a, b = block_links(ids, prints, sizes, radius, [orders[t] for t in keys[starts, 0]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        count = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3, 4, 5)], axis=1)
            held.append((ids, prints, keys))
            count += len(ids)
            if count >= HELD_ROWS:
                ids, prints, keys = (np.concatenate(x) for x in zip(*held, strict=True))
                last = np.flatnonzero((keys != keys[-1]).any(1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from compare(ids[:cut], prints[:cut], keys[:cut])
                held, count = [(ids[cut:], prints[cut:], keys[cut:])], len(ids) - cut
        if count:
            yield from compare(*(np.concatenate(x) for x in zip(*held, strict=True)))

    placed = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return placed.mapInArrow(run, "a long, b long").distinct()


def rooted(nodes: DataFrame, how: SimHash) -> DataFrame:
    """``nodes`` (id, w, ...) with root, the smallest id that links reach.

    The first tables join most of a large group; in the others only links between different roots are passed on, so the
    links of a group follow its size and not its size times the tables.
    """
    now = nodes.withColumn("root", F.col("id"))
    n = len(how.tables)
    for tables in (range(0, min(FIRST_TABLES, n)), range(min(FIRST_TABLES, n), n)):
        if len(tables):
            found = components(links(now, how, tables)).withColumnRenamed("root", "top")
            now = now.join(found, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("top", "root")).drop("node", "top")
            now = materialize(now, "simhash-rooted")
    return now


def classes(docs: DataFrame, how: SimHash = CONTRACT) -> DataFrame:
    """(doc_id, tk, w, component_id, cluster) of every row of ``docs`` (doc_id, text).

    cluster numbers the component, also where doc_ids are null or repeated. component_id is the smallest doc_id reachable over links, itself included;
    equal fingerprints are linked. Texts without a word have fingerprint zero
    and are linked like any other; null text counts as empty. A null doc_id is
    never smallest; a component of null ids has a null component_id. Repeated
    rows each get a row. An empty table gives no rows.
    """
    prints = materialize(with_fingerprints(docs, how), "simhash-prints")
    distinct = materialize(prints.groupBy("w").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = materialize(distinct.select(F.monotonically_increasing_id().alias("id"), "w", "least"), "simhash-nodes")
    joined = rooted(nodes, how)
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = joined.join(lowest.where("n > 1").select(F.col("root").alias("r"), "component_id"), F.col("root") == F.col("r"), "left")
    by_print = linked.select(F.col("w").alias("pw"), F.coalesce("component_id", "least").alias("component_id"), F.col("root").alias("cluster"))
    return prints.join(by_print, F.col("w") == F.col("pw")).select("doc_id", "tk", "w", "component_id", "cluster")


def shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, tk, sh) with the different shingles of every text as sorted hashes."""

    def work(columns: list[list]) -> dict[str, object]:
        ids, keys, texts = columns
        sets = [np.unique(np.fromiter((h for part in shingle_hashes(t, shingle_words) for h in part), np.uint64)).view(np.int64) for t in texts]
        return {"doc_id": ids, "tk": keys, "sh": sets}

    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_key(col("text")).alias("tk"), col("text").alias("text"))
    return map_texts(rows, "doc_id long, tk long, sh array<long>", work)


class _Index:
    """Which of some sets hold a hash."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.sizes = sets, np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.hashes, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)

    def common(self, mine: np.ndarray) -> np.ndarray:
        """How many hashes ``mine``, which are sorted and different, has in common with each set."""
        if not len(self.hashes):
            return np.zeros(len(self.sets), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, mine), len(self.hashes) - 1)
        at = at[self.hashes[at] == mine]
        sizes = self.count[at]
        places = np.repeat(self.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.owner[places], minlength=len(self.sets))


class _Staying:
    """The sets that stay of a cluster, in indexes of INDEXED_SETS and of twice, four times, ... as many."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.parts, self.waiting = similarity, [], []

    def add(self, mine: np.ndarray) -> None:
        self.waiting.append(mine)
        if len(self.waiting) == INDEXED_SETS:
            self.parts.append(_Index(self.waiting))
            self.waiting = []
            while len(self.parts) > 1 and len(self.parts[-1].sets) == len(self.parts[-2].sets):
                self.parts[-2:] = [_Index(self.parts[-2].sets + self.parts[-1].sets)]

    def alike(self, mine: np.ndarray) -> bool:
        """Does ``mine`` share enough with one of the sets?"""
        for part in self.parts:
            common = part.common(mine)
            if (common >= self.similarity * (len(mine) + part.sizes - common)).any():
                return True
        for other in self.waiting:
            if min(len(mine), len(other)) < self.similarity * max(len(mine), len(other)):
                continue
            common = len(np.intersect1d(mine, other, assume_unique=True))
            if common >= self.similarity * (len(mine) + len(other) - common):
                return True
        return False


_MEMBER = "cluster long, doc_id long, tk long, sh array<long>"


def _first_of_each(members: DataFrame, similarity: float) -> DataFrame:
    """The members that stay; a task goes through a cluster in order and holds the sets that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, _Staying(similarity)
        for batch in batches:
            clusters, sets = batch.column(0).to_pylist(), batch.column(3)
            stay = []
            for i, cluster in enumerate(clusters):
                if cluster != now:
                    now, held = cluster, _Staying(similarity)
                mine = sets[i].values.to_numpy()
                if not held.alike(mine):
                    held.add(mine)
                    stay.append(i)
            yield batch.take(pa.array(stay, pa.int64()))

    order = ["cluster", F.col("doc_id").asc_nulls_last(), "tk"]
    return members.select("cluster", "doc_id", "tk", "sh").repartition("cluster").sortWithinPartitions(*order).mapInArrow(run, _MEMBER)


def _still_open(rest: DataFrame, stay: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``rest`` that are like none of the rows of ``stay`` of their cluster.

    The rows of a cluster are dealt to slices of about SLICE_ROWS, and each slice meets all that stay in one task.
    """
    slices = rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).cast("int").alias("slices"))
    slices = materialize(slices, "simhash-slices")
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    first = stay.join(slices, "cluster").select("cluster", each, F.lit(0).alias("open"), "doc_id", "tk", "sh")
    others = rest.join(slices, "cluster").select("cluster", F.pmod(F.xxhash64("doc_id", "tk"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("open"), "doc_id", "tk", "sh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            groups = list(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True))
            sets, keep = batch.column(5), []
            for i, (cluster, part, is_open) in enumerate(groups):
                if (cluster, part) != now:
                    now, held, index = (cluster, part), [], None
                mine = sets[i].values.to_numpy()
                if not is_open:
                    held.append(mine)
                    continue
                index = index or _Index(held)
                common = index.common(mine)
                if not (common >= similarity * (len(mine) + index.sizes - common)).any():
                    keep.append(i)
            yield batch.select(["cluster", "doc_id", "tk", "sh"]).take(pa.array(keep, pa.int64()))

    placed = materialize(first.unionAll(others), "simhash-slices").repartition("cluster", "slice").sortWithinPartitions("cluster", "slice", "open")
    return placed.mapInArrow(run, _MEMBER)


def leaders(members: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, tk) of the members (cluster, doc_id, tk, sh) that stay: each other one is as similar as that to one of these, by exact Jaccard.

    The first open member of a cluster stays and those similar to it go, and so
    on; ids in order, null last. One task goes through the first CLUSTER_ROWS
    open members with CLUSTER_HASHES shingles at most. Where a cluster has more,
    the others are then compared, wherever they are, with all of the first that
    stay, and what is still open takes its turn.
    """
    now, kept = members, None
    by = Window.partitionBy("cluster").orderBy(F.col("doc_id").asc_nulls_last(), "tk")
    while True:
        # Numbers alone are sorted; of a cluster each task passes on so many at most.
        first = now.select("cluster", "doc_id", "tk", F.size("sh").alias("hashes")).withColumn("place", F.row_number().over(by)).where(F.col("place") <= CLUSTER_ROWS)
        first = first.withColumn("held", F.sum("hashes").over(by.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("place") == 1) | (F.col("held") <= CLUSTER_HASHES))
        first = materialize(first.select(F.col("cluster").alias("c"), F.col("doc_id").alias("d"), F.col("tk").alias("t")), "simhash-first")
        on = (F.col("cluster") == F.col("c")) & same(F.col("doc_id"), F.col("d")) & (F.col("tk") == F.col("t"))
        # Written: a repartitioning right above a join by the same key may be left out, and the join may then become one that deals rows otherwise.
        sized = materialize(now.join(first, on, "left").select("cluster", "doc_id", "tk", "sh", F.col("c").isNotNull().alias("first")), "simhash-sized")
        stay = materialize(_first_of_each(sized.where("first"), similarity), "simhash-stay")
        kept = stay.select("doc_id", "tk") if kept is None else kept.unionAll(stay.select("doc_id", "tk"))
        rest = sized.where(~F.col("first")).select("cluster", "doc_id", "tk", "sh")
        if rest.isEmpty():
            return kept
        now = materialize(_still_open(rest, stay, similarity), "simhash-open")


def keep_one(docs: DataFrame, how: SimHash = FIVE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those that nearly repeat another one that stays.

    Fingerprints group the rows. In a group the row with the smallest doc_id
    stays (null ids last, ties by text hash) and all that share at least
    ``similarity`` of their different shingles with it, exactly counted, go;
    what is left of the group is treated in the same way. So each removed row
    has one that stays and is as similar. Equal texts go without counting; of
    wholly repeated rows one stays. All columns are returned as they were.
    """
    wide = fresh(docs, "_k_id"), fresh(docs, "_k_text"), fresh(docs, "_k_no")
    found = materialize(classes(docs, how).groupBy("cluster", "tk").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("f")), "simhash-texts")
    found = found.select("cluster", "tk", F.col("f.doc_id").alias("doc_id"))
    several = found.groupBy(F.col("cluster").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sized = found.join(several, F.col("cluster") == F.col("c"))
    alone = sized.where("n = 1").select("doc_id", "tk")
    open_ = sized.where("n > 1").select("cluster", F.col("doc_id").alias("mid"), F.col("tk").alias("mtk"))
    texts = docs.withColumns({wide[0]: col("doc_id").cast("long"), wide[1]: text_key(col("text"))}).join(
        open_, same(col(wide[0]), F.col("mid")) & (col(wide[1]) == F.col("mtk")), "left_semi"
    )
    sets = shingle_sets(texts, how.shingle_words).dropDuplicates(["doc_id", "tk"])
    members = open_.join(sets, same(F.col("mid"), F.col("doc_id")) & (F.col("mtk") == F.col("tk"))).select("cluster", "doc_id", "tk", "sh")
    keep = alone.unionAll(leaders(materialize(members, "simhash-members"), similarity)).select(F.col("doc_id").alias("kept_id_"), F.col("tk").alias("kept_tk_"))
    keyed = docs.select("*", col("doc_id").cast("long").alias(wide[0]), text_key(col("text")).alias(wide[1]))
    kept = keyed.join(keep, same(F.col(wide[0]), F.col("kept_id_")) & same(F.col(wide[1]), F.col("kept_tk_")), "left_semi")
    number = F.row_number().over(Window.partitionBy(wide[0], wide[1]).orderBy(wide[0]))
    return kept.withColumn(wide[2], number).where(F.col(wide[2]) == 1).select(*[col(c) for c in docs.columns])
