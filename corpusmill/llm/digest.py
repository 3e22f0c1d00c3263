"""Improbable-feature digests: rare byte windows of a text, kept in a chain of Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import col, map_texts, same, slices
from corpusmill.session import materialize

#: Bytes of a feature.
WINDOW = 64
#: Consecutive windows of which the rarest gains a point, and points that make it a feature.
RIVALS, LEAST_POINTS = 64, 16
#: Steps of entropy between 0 and 6 bits that are told apart.
LEVELS = 1000
#: Bits of a filter, bits set by a feature, features in a filter.
FILTER_BITS, HASHES, FULL = 2048, 5, 160
#: Bytes looked at together, with what windows and rivals overlap.
BLOCK = 1 << 16

_LOG = np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1))
# c log2 c in whole 2^-20ths, so that running sums are exact
_GAIN = np.round(np.diff(_LOG) * (1 << 20)).astype(np.int32)
_TOP = int(_GAIN.astype(np.int64).sum())


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of each window, from 0 to LEVELS, of at least WINDOW bytes.

    The sum of c log c over a window's byte counts changes by the counts of the
    byte that leaves and the one that enters; both are counted for all places
    at once by comparing the bytes with themselves at each lag.
    """
    n = len(data)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        equal = (data[lag:] == data[:-lag]).view(np.uint8)
        back[lag:] += equal
        ahead[: n - lag] += equal
    # the first window byte by byte, then one in and one out
    enter = _GAIN[back].astype(np.int64)
    head = 0
    seen = np.zeros(256, np.int64)
    for b in data[:WINDOW].tolist():
        head += int(_GAIN[seen[b]])
        seen[b] += 1
    # for a window that slides by one, 'back' and 'ahead' count within the bytes that both windows share
    change = enter[WINDOW:] - _GAIN[ahead[: n - WINDOW]]
    total = np.concatenate([[head], head + np.cumsum(change)])
    return ((_TOP - total) * LEVELS // _TOP).astype(np.int32)


def _blocks(data: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while True:
        yield at, data[at : at + BLOCK + overlap]
        at += BLOCK
        if at + overlap >= len(data):
            return


def window_entropies(texts: list[bytes]) -> list[np.ndarray]:
    """The entropies of each text's windows; the texts are looked at as one run of bytes, windows across their borders are dropped."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if len(joined) < WINDOW:
        return [np.zeros(0, np.int32) for _ in texts]
    every = np.concatenate([entropies(part) for _, part in _blocks(joined, WINDOW - 1)])
    out, at = [], 0
    for t in texts:
        out.append(every[at : at + max(0, len(t) - WINDOW + 1)])
        at += len(t)
    return out


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each entropy: LEVELS + 1 numbers, at any scale."""

    def work(columns: list[list]) -> dict[str, object]:
        counts = np.zeros(LEVELS + 1, np.int64)
        for found in window_entropies([(text or "").encode() for text in columns[0]]):
            counts += np.bincount(found, minlength=LEVELS + 1)
        at = np.flatnonzero(counts)
        return {"level": at, "n": counts[at]}

    found = map_texts(docs.select(col("text").alias("text")), "level int, n long", work).groupBy("level").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LEVELS + 1, np.int64)
    for row in found:
        out[row["level"]] = row["n"]
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, the rarest lowest; ties by entropy. Windows of entropy 0 are never features."""
    ranks = np.empty(len(counts), np.int64)
    ranks[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    ranks[0] = len(counts)
    return ranks


def features(rank: np.ndarray, never: int) -> np.ndarray:
    """Places of the windows that are rarest among RIVALS neighbours LEAST_POINTS times or more; not those of rank ``never``."""
    n = len(rank)
    if not n:
        return np.zeros(0, np.int64)
    # the leftmost minimum of every stretch, by doubling
    key = (rank << 40) | np.arange(n)
    width, span = 1, min(RIVALS, n)
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    points = np.bincount(key & ((1 << 40) - 1), minlength=n)
    return np.flatnonzero((points >= min(LEAST_POINTS, len(key))) & (rank < never))


def _chain(hashes: list[bytes]) -> str:
    if not hashes:
        return ""
    bits = np.frombuffer(b"".join(hashes), ">u4").reshape(-1, 5)[:, :HASHES] % FILTER_BITS
    out = []
    for at in range(0, len(bits), FULL):
        part = bits[at : at + FULL]
        filled = np.zeros(FILTER_BITS, np.uint8)
        filled[part.reshape(-1)] = 1
        out.append(f"{len(part)}:{base64.b64encode(np.packbits(filled).tobytes()).decode()}")
    return " ".join(out)


def digests(texts: list[str], ranks: np.ndarray) -> list[str]:
    """The chain of filters of each text: for each filter its number of features and its bits, as text.

    A text without a feature is one feature as a whole, an empty one has none.
    """
    raw = [t.encode() for t in texts]
    out = []
    for data, found in zip(raw, window_entropies(raw), strict=True):
        places = features(ranks[found], len(ranks)).tolist()
        hashes = [hashlib.sha1(data[p : p + WINDOW]).digest() for p in places]
        out.append(_chain(hashes or ([hashlib.sha1(data).digest()] if data else [])))
    return out


def _filters(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [p.split(":") for p in text.split(" ")]
    bits = np.frombuffer(b"".join(base64.b64decode(b) for _, b in parts), np.uint64).reshape(len(parts), -1)
    return np.array([int(n) for n, _ in parts]), bits


#: Filters compared at a time, so that long chains take bounded memory.
_TILE = 256


def likeness(a: str, b: str) -> float:
    """0 to 1: for each filter of the shorter chain the best match in the other, by bits in common beyond chance; the mean by features.

    Chance is what filters of so many bits share when filled at random, with
    two standard deviations on top. Two empty digests are equal.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (na, fa), (nb, fb) = _filters(a), _filters(b)
    if len(fa) > len(fb) or len(fa) == len(fb) and na.sum() > nb.sum():
        na, fa, nb, fb = nb, fb, na, fa
    ones_a, ones_b = np.bitwise_count(fa).sum(1).astype(float), np.bitwise_count(fb).sum(1).astype(float)
    best = np.zeros(len(fa))
    for i in range(len(fa)):
        for lo in range(0, len(fb), _TILE):
            common = np.bitwise_count(fa[i] & fb[lo : lo + _TILE]).sum(1)
            ob = ones_b[lo : lo + _TILE]
            chance = ones_a[i] * ob / FILTER_BITS
            chance = chance + 2 * np.sqrt(np.maximum(chance * (1 - ones_a[i] / FILTER_BITS), 0))
            room = np.minimum(ones_a[i], ob) - chance
            best[i] = max(best[i], float(np.max(np.where(room > 0, (common - chance) / np.maximum(room, 1e-9), 0.0))))
    return float(np.clip((best * na).sum() / na.sum(), 0.0, 1.0))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Rows are in order of doc_id, then text; null ids come first and a null text
    is empty. A document's next one lies in its own range of ids, or is the
    first of the following range, of which a copy is sent along; after the last
    document comes the first. So each text is shuffled once, and windows of any
    range stay in their task. Repeated rows follow each other. One document
    alone is its own next. An empty table gives no rows.
    """
    ranks = rarity(entropy_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    ids = materialize(rows.select("doc_id", F.octet_length("text").alias("size")), "digest-ids")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    part = _range_of(F.col("doc_id"), cuts)
    firsts = ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f")).select("part", "f.doc_id").orderBy("part").collect()
    parts = [r["part"] for r in firsts]
    before = {parts[i]: parts[i - 1] for i in range(len(parts))}  # of the first it is the last
    heads = {r["part"]: r["doc_id"] for r in firsts}
    if not parts:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    # rows that share the first id of a range all go along: the receiver takes the first of them by text
    head_of = F.array(*[F.lit(heads.get(p)).cast("long") for p in range(len(cuts) + 1)])
    to = F.array(*[F.lit(before.get(p)).cast("int") for p in range(len(cuts) + 1)])
    halo = F.when(same(F.col("doc_id"), head_of[F.col("part")]), to[F.col("part")])
    sent = rows.withColumn("part", part).withColumn(
        "x", F.explode(F.filter(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("extra")), F.struct(halo.alias("p"), F.lit(1).alias("extra"))), lambda s: s["p"].isNotNull()))
    ).select("doc_id", "text", "x.p", "x.extra")
    dealt = sent.repartitionById(n, "p").sortWithinPartitions("p", "extra", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        # the row whose next is still to come: (doc_id, text, fingerprint)
        waiting, at_part, closed = None, None, False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for lo, hi in slices([len(t) for t in columns[1]], 1 << 20):
                doc_ids, texts, ps, extras = (c[lo:hi] for c in columns)
                pairs = []  # (doc_id, text, fingerprint, next text, its fingerprint)
                for doc_id, text, p, extra, own in zip(doc_ids, texts, ps, extras, digests(texts, ranks), strict=True):
                    if p != at_part:
                        waiting, at_part, closed = None, p, False
                    if extra and closed:
                        continue  # only the first of the next range is wanted
                    if waiting is not None:
                        pairs.append((*waiting, text, own))
                    closed = bool(extra)
                    waiting = None if extra else (doc_id, text, own)
                if not pairs:
                    continue
                changed = [edited_text(x[1], x[3]) for x in pairs]
                prints = digests(changed, ranks)
                rows = [
                    (x[0], len(x[1]), hashlib.sha256(new.encode()).hexdigest(), x[2], other, likeness(x[2], other), likeness(x[2], x[4]))
                    for x, new, other in zip(pairs, changed, prints, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_NAMES)

    return dealt.mapInArrow(run, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _range_of(value, cuts: list[int]):
    """How many of ``cuts`` (sorted) are at most ``value``, by halving."""
    if not cuts:
        return F.lit(0)

    def between(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return F.when(value.isNull(), F.lit(0)).otherwise(between(0, len(cuts)))
