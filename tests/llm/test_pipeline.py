"""The pipeline on planted cases, and its packed rows against the documents that reached the last stage."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from corpusmill.llm.queries import QUERIES, tokenizer_file

SYLLABLES = {"xx": ["the", "ing", "er", "on", "an", "th"], "yy": ["ción", "ez", "ar", "os", "ue", "ll"]}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.12 else "") for w in words) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(i, prose(rng, lang := rng.choice(["xx", "yy"]), rng.randint(150, 300)), lang, f"s{i % 4}") for i in range(160)]
    copies, near, hosts = [3, 40, 77], [5, 90], [10, 20, 30]
    for c in copies:
        rows += [(1000 + 10 * c + k, rows[c][1], rows[c][2], "s1") for k in range(5)]
    for c in near:
        words = rows[c][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((2000 + c, " ".join(words), rows[c][2], "s2"))
    passage = " " + prose(rng, "xx", 70) + " "
    for c in hosts:
        i, t, lang, s = rows[c]
        cut = len(t) // 2
        rows[c] = (i, t[:cut] + passage + t[cut:], lang, s)
    rows += [(3000, None, "xx", "s0"), (3001, "", None, None), (3002, "12 34 !!", None, "s0"), (3003, "".join(rng.choice("qwxkvjpzfbgmd0123") for _ in range(4000)), None, "s0")]
    folder = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    stages, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(folder)).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        stages[name] = now
    return str(folder), rows, passage, stages


def test_stages_keep_columns_and_order(planted):
    _, _, _, stages = planted
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "mix", "pack"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_planted_cases_are_caught_and_clean_documents_stay(planted):
    _, rows, passage, stages = planted
    kept = {n: {r["doc_id"]: r["text"] for r in df.collect()} for n, df in stages.items() if n != "pack"}
    text = {i: t for i, t, _, _ in rows}
    assert set(text) - set(kept["language"]) == {3000, 3001, 3002, 3003}
    assert set(kept["near_duplicates"]) == set(range(160))
    core = passage[len(passage) // 4 : len(passage) * 3 // 4]
    assert [i for i, t in sorted(kept["passages"].items()) if core in t] == [10]
    changed = {i for i, t in kept["passages"].items() if t != text[i]}
    assert changed == {20, 30}
    assert set(kept["mix"]) <= set(range(160))


def test_packed_rows_are_the_mixed_documents(planted):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    _, _, _, stages = planted
    want = []
    for r in stages["mix"].collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r["doc_id"], p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    got = stages["pack"].collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= sum(ends.values()) / 2048 * 1.05 + 1


def test_run_applies_all_stages(spark, planted):
    folder, _, _, stages = planted
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == stages["pack"].columns
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, stages["pack"].select(*names).collect()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
