"""Language models: probabilities against the definition, accuracy on held-out texts."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import langid


def plain_model(texts):
    """Interpolated Kneser-Ney by its definition, with dictionaries."""
    grams = collections.Counter()
    for t in texts:
        chars = "   " + "".join(map(chr, langid.points(t)))
        grams.update(chars[i : i + 4] for i in range(len(chars) - 3))
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    floor = langid.DISCOUNT * len(levels[1]) / sum(levels[1].values()) / (langid.UNSEEN + len(levels[1]))

    def p(gram):
        n = len(gram)
        if n == 1:
            return max(levels[1][gram] - langid.DISCOUNT, 0) / sum(levels[1].values()) + floor if gram in levels[1] else floor
        follow = {g: c for g, c in levels[n].items() if g[:-1] == gram[:-1]}
        if not follow:
            return p(gram[1:])
        total = sum(follow.values())
        return max(follow.get(gram, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(follow) / total * p(gram[1:])

    return p


def test_cross_entropies_equal_the_definition():
    texts = [["abra cadabra", "abba baab caab"], ["xyz zyx xxyy", "yzzy éé"]]
    counts = [langid.gram_counts([(i, t) for t in ts], 2) for i, ts in enumerate(texts)]
    lang, high, low, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    model = langid._estimate(["a", "b"], lang.astype(np.int64), high, low, n)
    asked = ["abracadabra", "XYZ!", "q", "aab zzé qq 12 b", None, "123 --", ""]
    got, sizes = langid.cross_entropies(asked, model)
    for i, t in enumerate(asked):
        chars = "".join(map(chr, langid.points(t or "")))
        if len(chars) <= 2:
            assert sizes[i] == 0 and np.isinf(got[i]).all()
            continue
        padded = "   " + chars
        for k in range(2):
            p = plain_model(texts[k])
            want = -sum(math.log2(p(padded[j : j + 4])) for j in range(len(chars))) / len(chars)
            assert abs(got[i, k] - want) < 1e-4


def corpus():
    rng = random.Random(7)
    parts = {"xx": ["the", "ing", "er", "on", "an", "th"], "yy": ["ción", "ez", "ar", "os", "ue", "ll"], "zz": ["sch", "ung", "ä", "ch", "ei", "tz"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang))
    return rows


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus()
    noise = random.Random(8)
    extra = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 ... !!", None), (1003, "".join(noise.choice("qwxkvjpzfbgmdlyhrucn0123") for _ in range(3000)), None), (1004, rows[0][1] * 300, None), (None, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame([(*r, "s", True) for r in rows + extra], "doc_id long, text string, lang string, score string, rejected boolean")
    model = langid.fit(docs)
    assert model.langs == ["xx", "yy", "zz"]
    asked = docs.select("doc_id", "text")
    got = {r["doc_id"]: r for r in langid.predictions(asked, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["rejected"] and not got[1004]["rejected"] and got[1004]["lang_pred"] == rows[0][2]
    assert not any(got[i]["rejected"] for i, _, _ in rows)
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.schema["lang"].dataType == docs.schema["lang"].dataType
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in rows} | {1004, None}


def test_held_out_rows_teach_nothing(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    blind = docs.where(~langid.held_out(docs["doc_id"]))
    a, b = langid.fit(docs), langid.fit(blind)
    assert all((x[0] == y[0]).all() for x, y in zip(a.grams, b.grams, strict=True)) and (a.slack == b.slack).all() and (a.middle == b.middle).all()


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(empty) is None
    assert langid.accepted(empty).count() == 0
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.predictions(docs, langid.fit(docs)).collect()] == [("und", 0.0)]


def test_left_out_languages_are_rejected_and_own_texts_stay(spark):
    """On the documents of the tables, with each language left out of learning in turn."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    for left_out in ("de", "fr"):
        found = langid.predictions(docs, langid.fit(docs.where(docs["lang"] != left_out))).where(langid.held_out(F.col("doc_id"))).collect()
        foreign = [r["rejected"] for r in found if r["lang"] == left_out]
        own = [r["rejected"] for r in found if r["lang"] != left_out]
        assert np.mean(foreign) >= 0.9 and np.mean(own) <= 0.01


def test_long_texts_teach_nothing_and_the_sample_is_bounded(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([*rows, (5000, "zebra " * 50_000, "xx")], "doc_id long, text string, lang string")
    assert langid.sample(docs, ["xx", "yy", "zz"]).where("doc_id = 5000").count() == 0
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 3000)
    chosen = langid.sample(docs, ["xx", "yy", "zz"]).selectExpr("lang", "length(text) AS n").groupBy("lang").sum("n").collect()
    assert len(chosen) == 3 and all(r["sum(n)"] < 6000 for r in chosen)


def test_repeated_rows_and_ties_are_judged_alike(spark):
    rows = [(i, "same words here " * 9, lang) for i, lang in enumerate(["b", "a"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predictions(docs, langid.fit(docs)).collect()} <= {"a", "b"}
    assert len({(r["lang_pred"], r["score"], r["rejected"]) for r in langid.predictions(docs, langid.fit(docs)).collect()}) == 1
