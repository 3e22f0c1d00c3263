"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from corpusmill.llm.common import col, fresh, map_texts, slices

#: Characters of the longest n-gram.
ORDER = 4
#: The model is fitted on a bounded sample: about so many labelled texts and characters of each language, chosen by hash, read whole.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 4_000_000
#: Longer texts are not learned from, so that one of them can't exceed the sample; they are judged like any other.
LONGEST_LEARNED = 200_000
#: Absolute discount of every order.
DISCOUNT = 0.75
#: Characters a model assumes besides those it has seen.
UNSEEN = 5000
#: Share of labelled texts that the rejection limit may refuse, and share that it may accept when their own model is left out.
FALSE_REJECTIONS, FALSE_ACCEPTANCES = 0.03, 0.25
#: Where between these the limit lies. An unknown language may be nearer to the learned ones than they are to each other.
LIMIT_PLACE = 0.3
#: Calibration texts of like length that a limit is set by, at least, where there are so many.
GROUP_TEXTS = 150
UNDETERMINED = "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def points(text: str) -> np.ndarray:
    """The code points of a text as models see them: lower case, one blank for any run of other characters, blanks around."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    return np.frombuffer((" " + " ".join(letters.split()) + " ").encode("utf-32-le", "replace"), np.uint32)


def _take(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The 64-bit key of an n-gram from that of its first characters and its last."""
    key = (key + more.astype(np.uint64) + np.uint64(1)) * _BASE
    return key ^ (key >> np.uint64(29))


def gram_keys(chars: np.ndarray, n: int) -> np.ndarray:
    """A key of the n-gram that ends at each place from n - 1 on."""
    key = np.zeros(len(chars) - n + 1, np.uint64)
    for i in range(n):
        key = _take(key, chars[i : len(chars) - n + 1 + i])
    return key


def _row_keys(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        key = _take(key, rows[:, c])
    return key


#: Sorted keys; from which to which entry each has; the entries' languages and values. It grows with the n-grams of each language.
Store = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Model:
    """For each order from 1 to ORDER sorted keys of n-grams with the log probabilities of the languages that hold them, and of contexts with back-off weights."""

    langs: list[str]
    grams: list[Store]
    contexts: list[Store]
    floor: np.ndarray
    #: cross-entropy of the language's own calibration texts in the middle
    middle: np.ndarray
    #: from so many characters on, a text may be so far above the middle
    lengths: np.ndarray
    slack: np.ndarray
    #: deviation from the middle that a text of one character has
    noise: float = 0.0


def gram_counts(texts: list[tuple[int, str]], langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language, characters packed into 84 bits as two numbers, count) of the longest n-grams of labelled texts."""
    every: list[np.ndarray] = []
    for lang, text in texts:
        chars = points(text)
        if len(chars) < 2:
            continue
        chars = np.concatenate([np.full(ORDER - 1, 0x20, np.uint32), chars])
        high = chars[: len(chars) - 3].astype(np.uint64) << np.uint64(21) | chars[1 : len(chars) - 2].astype(np.uint64)
        low = chars[2 : len(chars) - 1].astype(np.uint64) << np.uint64(21) | chars[3:].astype(np.uint64)
        every.append(np.stack([np.full(len(high), lang, np.uint64), high, low], 1))
    if not every:
        z = np.zeros(0, np.uint64)
        return z, z, z, z.astype(np.int64)
    rows = np.concatenate(every)
    _, first, counts = np.unique(_row_keys(rows), return_index=True, return_counts=True)
    rows = rows[first]
    return rows[:, 0], rows[:, 1], rows[:, 2], counts


def sample(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(lang index, doc_id, text) of the texts that are learned from: labelled, not held out, up to LONGEST_LEARNED characters
    each, by hash about SAMPLE_DOCS texts and SAMPLE_CHARS characters of each language."""
    length = F.length(col("text"))
    rows = docs.where(col("lang").isNotNull() & col("text").isNotNull() & ~held_out(col("doc_id")) & (length <= LONGEST_LEARNED))
    index = F.array_position(F.array(*[F.lit(x) for x in langs]), col("lang").cast("string")).cast("int") - 1
    counts = {r["lang"]: r for r in rows.groupBy(col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("chars")).collect()}
    # a share of each language, by hash; the hash does not look at the text
    share = F.array(*[F.lit(min(1.0, SAMPLE_DOCS / max(1, counts[x]["n"]), SAMPLE_CHARS / max(1, counts[x]["chars"])) if x in counts else 1.0) for x in langs])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return rows.select(index.alias("lang"), col("doc_id").alias("doc_id"), col("text").alias("text"), draw.alias("draw")).where(F.col("draw") < share[F.col("lang")]).select("lang", "doc_id", "text")


def _gram_table(rows: DataFrame, langs: int) -> DataFrame:
    def work(columns: list[list]) -> dict[str, object]:
        lang, high, low, n = gram_counts(list(zip(columns[0], columns[1], strict=True)), langs)
        return {"lang": lang.astype(np.int32), "high": high.astype(np.int64), "low": low.astype(np.int64), "n": n}

    return map_texts(rows.select("lang", "text"), "lang int, high long, low long, n long", work).groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model | None:
    """Models of all languages in ``docs`` (doc_id, text, lang) but the held-out rows; None where there is no labelled text.

    n-grams are counted in tasks; what is gathered is bounded by the sample.
    Kneser-Ney: shorter n-grams count the different characters before them.
    """
    labelled = docs.where(col("lang").isNotNull() & col("text").isNotNull() & ~held_out(col("doc_id")))
    langs = sorted(r["lang"] for r in labelled.select(col("lang").cast("string").alias("lang")).distinct().collect())
    if not langs:
        return None
    chosen = sample(docs, langs)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1  # kept back for calibration
    table = _gram_table(chosen.where(~fold), len(langs)).toPandas()
    model = _estimate(langs, table["lang"].to_numpy(np.int64), table["high"].to_numpy(np.uint64), table["low"].to_numpy(np.uint64), table["n"].to_numpy(np.int64))

    def score(columns: list[list]) -> dict[str, object]:
        cross, sizes = cross_entropies(columns[1], model)
        keep = np.flatnonzero(sizes)
        return {"lang": np.array(columns[0], np.int32)[keep], "cross": cross[keep].tolist(), "n": sizes[keep]}

    seen = map_texts(chosen.where(fold).select("lang", "text"), "lang int, cross array<double>, n long", score).toPandas()
    cross, own, n = np.array(seen["cross"].tolist()).reshape(-1, len(langs)), seen["lang"].to_numpy(), seen["n"].to_numpy()
    calibrate(model, cross, own, n)
    return model


def calibrate(model: Model, cross: np.ndarray, own: np.ndarray, n: np.ndarray) -> None:
    """Sets the rejection limit from the cross-entropies that labelled texts have under all models.

    A text's excess is its cross-entropy above the middle of its language. What
    a text of no learned language gets is seen when a text's own model is left
    out. In each group of texts of like length the limit lies half way between
    the excess that all but a share of FALSE_REJECTIONS of the texts stay below
    with their own model and the one that all but FALSE_ACCEPTANCES are above
    without it; where these overlap it is the former.
    """
    k = len(model.langs)
    for i in range(k):
        if (own == i).any():
            model.middle[i] = np.median(cross[own == i, i])
    excess = cross - model.middle
    at = np.arange(len(own))
    mine, others = excess[at, own], excess.copy()
    others[at, own] = np.inf
    # no language to compare with: twice as many bits a character as its own texts
    foreign = others.min(1) if k > 1 else model.middle[own]
    order = np.argsort(n, kind="stable")
    groups = np.array_split(order, max(1, len(order) // GROUP_TEXTS)) if len(order) else []
    model.lengths = np.array([0, *(n[g[0]] for g in groups[1:])], np.int64)
    low = np.array([np.quantile(mine[g], 1 - FALSE_REJECTIONS) for g in groups] or [np.inf])
    high = np.array([np.quantile(foreign[g], FALSE_ACCEPTANCES) for g in groups] or [np.inf])
    model.slack = np.maximum(low, low + (high - low) * LIMIT_PLACE)
    model.noise = float(np.median(np.abs(mine) * np.sqrt(n))) if len(mine) else 0.0


def limits(model: Model, best: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The cross-entropy above which a text of ``n`` characters is none of language ``best``."""
    return model.middle[best] + model.slack[np.searchsorted(model.lengths, n, side="right") - 1] + 2 * model.noise / np.sqrt(np.maximum(n, 1))


def _estimate(langs: list[str], lang: np.ndarray, high: np.ndarray, low: np.ndarray, count: np.ndarray) -> Model:
    mask = np.uint64((1 << 21) - 1)
    chars = np.stack([high >> np.uint64(21), high & mask, low >> np.uint64(21), low & mask], 1).astype(np.uint32)
    k = len(langs)
    # by language and order: n-grams (rows of characters) with their counts
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[None] * k for _ in range(ORDER)]
    for i in range(k):
        rows, n = chars[lang == i], count[lang == i]
        for order in range(ORDER, 0, -1):
            levels[order - 1][i] = (rows, n)
            if order > 1:  # shorter n-grams count the characters that come before them
                _, first, n = np.unique(_row_keys(rows[:, 1:]), return_index=True, return_counts=True)
                rows = rows[first, 1:]

    keys = _row_keys
    floor = np.zeros(k)
    grams, contexts = [], []
    lower: list[tuple[np.ndarray, np.ndarray] | None] = [None] * k
    for order in range(1, ORDER + 1):
        found, backs = [], []
        for i in range(k):
            rows, n = levels[order - 1][i]
            n = n.astype(float)
            if order == 1:
                total = n.sum() or 1.0
                spread = DISCOUNT * len(n) / total if len(n) else 1.0
                floor[i] = max(spread, 1e-6) / (UNSEEN + len(n))
                p, key = np.maximum(n - DISCOUNT, 0) / total + floor[i], keys(rows)
                by = np.argsort(key)
                lower[i] = (key[by], p[by])
                found.append(lower[i])
                continue
            context = keys(rows[:, :-1])
            heads, at = np.unique(context, return_inverse=True)
            sums, kinds = np.bincount(at, n), np.bincount(at)
            back = DISCOUNT * kinds / np.maximum(sums, 1)
            suffix = keys(rows[:, 1:])
            place = np.minimum(np.searchsorted(lower[i][0], suffix), max(0, len(lower[i][0]) - 1))
            below = np.where(lower[i][0][place] == suffix, lower[i][1][place], floor[i]) if len(suffix) else np.zeros(0)
            p = np.maximum(n - DISCOUNT, 0) / np.maximum(sums[at], 1) + back[at] * below if len(n) else np.zeros(0)
            key = keys(rows)
            by = np.argsort(key)
            lower[i] = (key[by], p[by])
            found.append(lower[i])
            backs.append((heads, back))
        grams.append(_merge(found, k))
        contexts.append(_merge(backs, k) if order > 1 else _merge([], k))
    return Model(langs, grams, contexts, np.log(floor), np.full(k, 20.0), np.zeros(1, np.int64), np.full(1, np.inf))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> Store:
    """One sorted array of keys for all languages, each with the languages that have it."""
    if not sum(len(p[0]) for p in parts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    keys = np.concatenate([p[0] for p in parts])
    by = np.argsort(keys, kind="stable")
    every, first = np.unique(keys[by], return_index=True)
    langs = np.concatenate([np.full(len(p[0]), i, np.int32) for i, p in enumerate(parts)])
    return every, np.append(first, len(keys)), langs[by], np.log(np.concatenate([p[1] for p in parts]))[by].astype(np.float32)


def _rows(store: Store, keys: np.ndarray, k: int) -> np.ndarray:
    """(keys, k) the values of ``keys``, NaN where a language lacks one."""
    known, first, langs, values = store
    out = np.full((len(keys), k), np.nan, np.float32)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = np.flatnonzero(known[at] == keys)
        sizes = first[at[hit] + 1] - first[at[hit]]
        entry = np.repeat(first[at[hit]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out[np.repeat(hit, sizes), langs[entry]] = values[entry]
    return out


def cross_entropies(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) bits per character, and the number of characters scored (0 for texts without a letter)."""
    k = len(model.langs)
    chars, owner_sizes = [], []
    for t in texts:
        p = points(t or "")
        p = p if len(p) > 2 else p[:0]
        owner_sizes.append(len(p))
        if len(p):
            chars.append(np.full(ORDER - 1, 0x20, np.uint32))
            chars.append(p)
    sizes = np.array(owner_sizes, np.int64)
    cross = np.full((len(texts), k), np.inf)
    if not chars:
        return cross, sizes
    joined = np.concatenate(chars)
    # each different n-gram is looked up once, in order of its key
    longest = gram_keys(joined, ORDER)
    keys, first, back = np.unique(longest, return_index=True, return_inverse=True)
    value = np.full((len(keys), k), np.nan, np.float32)
    weight = np.zeros((len(keys), k), np.float32)
    for order in range(ORDER, 0, -1):
        ends = first + ORDER - 1
        windows = joined[ends[:, None] - np.arange(order - 1, -1, -1)]
        gram = np.zeros(len(keys), np.uint64)
        for c in range(order):
            if c == order - 1:
                context = gram
            gram = _take(gram, windows[:, c])
        open_ = np.isnan(value)
        found = _rows(model.grams[order - 1], gram, k)
        value = np.where(open_ & ~np.isnan(found), found + weight, value)
        if order > 1:
            cost = _rows(model.contexts[order - 1], context, k)
            weight = np.where(np.isnan(value) & ~np.isnan(cost), weight + cost, weight)
    value = np.where(np.isnan(value), model.floor.astype(np.float32) + weight, value)
    rows = np.flatnonzero(sizes)
    starts = np.cumsum(sizes[rows] + ORDER - 1) - (sizes[rows] + ORDER - 1)
    for i in range(k):
        per_char = value[:, i].astype(np.float64)[back]
        sums = np.concatenate([[0.0], np.cumsum(per_char)])
        # the n-gram at place p ends at p + ORDER - 1: a text's own characters, without the blanks set before it
        cross[rows, i] = -(sums[starts + sizes[rows]] - sums[starts]) / sizes[rows] / np.log(2)
    return cross, sizes


def _judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text."""
    cross, n = cross_entropies(texts, model)
    some = n > 0
    safe = np.where(some[:, None], cross, 0.0)
    best = safe.argmin(1)
    lowest = safe[np.arange(len(best)), best]
    score = np.where(some, 1 / np.exp2(-(safe - lowest[:, None]) * 20).sum(1), 0.0)
    rejected = ~some | (lowest > limits(model, best, n))
    return [model.langs[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)], score, rejected


def _slice_bytes(model: Model) -> int:
    """Bytes of text that are scored at a time; a table of their n-grams has a column per language."""
    return max(1 << 16, (4 << 20) // max(4, len(model.langs)))


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` with lang_pred, score and rejected.

    lang_pred is the language of the lowest cross-entropy, ties to the first by
    name; UNDETERMINED where the text is null or has no letter, or where nothing
    was learned. score is 0 to 1: the posterior of the winner over 20
    characters of average evidence, 0 where undetermined. rejected tells that
    the best model does worse on it than the limit that ``calibrate`` sets for
    texts of its length, or that the text has no letter. Only the text is read. Empty, repeated and very long texts
    are scored whole like any other.
    """
    if model is None:
        out = docs.withColumns({fresh(docs, "lang_pred"): F.lit(UNDETERMINED), fresh(docs, "score"): F.lit(0.0), fresh(docs, "rejected"): F.lit(True)})
        return out
    # plain data: workers need not be able to import this package
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))
    text_at = docs.columns.index("text")
    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
            for lo, hi in slices(sizes, _slice_bytes(m)):
                part = batch.slice(lo, hi - lo)
                pred, score, rejected = _judge(m, part.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred), pa.array(score), pa.array(rejected)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) whose language can be told; all columns stay as they were.

    Rows of null or letterless texts go, and those that ``predictions`` rejects.
    Repeated rows are judged alike; an empty table, or one without a label,
    keeps nothing. Each text passes through the task once, and rejected rows
    are left out there.
    """
    model = fit(docs)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
            for lo, hi in slices(sizes, _slice_bytes(m)):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(~_judge(m, part.column(text_at).to_pylist())[2]))
            del batch
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
