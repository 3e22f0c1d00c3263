"""Repeated passages against brute force over all runs of sentences."""

from __future__ import annotations

import random

from corpusmill.llm import spans


def brute(rows, run=spans.RUN, least=spans.LEAST_WORDS):
    """Cut texts by (doc_id, text): every run but the first of its kind covers its sentences."""
    from corpusmill.llm.common import text_key  # noqa: F401  the order of equal ids is not tested here

    split, first = {}, {}
    for doc, text in sorted({(d, t) for d, t in rows if t}, key=lambda x: (x[0] is not None, x[0] or 0)):
        ends = spans.sentences(text)[0]
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        split[doc, text] = parts
        for i in range(len(parts) - run + 1):
            words = [p.split() for p in parts[i : i + run]]
            if sum(map(len, words)) >= least:
                first.setdefault(tuple(tuple(w) for w in words), (doc, text, i))
    out = {}
    for (doc, text), parts in split.items():
        gone = set()
        for i in range(len(parts) - run + 1):
            words = [p.split() for p in parts[i : i + run]]
            if sum(map(len, words)) >= least and first[tuple(tuple(w) for w in words)] != (doc, text, i):
                gone |= set(range(i, i + run))
        if len(gone) < len(parts):
            # stretches of fewer words than a passage has are left
            for i in sorted(gone):
                if i in gone and i - 1 not in gone:
                    stretch = [i]
                    while stretch[-1] + 1 in gone:
                        stretch.append(stretch[-1] + 1)
                    if sum(len(parts[j].split()) for j in stretch) < spans.LEAST_CUT_WORDS:
                        gone -= set(stretch)
        out[doc, text] = "".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) + rng.choice([". ", "! ", ", ", ".\n"])


def corpus():
    rng = random.Random(6)
    passage = "".join(sentence(rng, 8) for _ in range(8))
    flat = " ".join(f"q{rng.randrange(9999)}" for _ in range(80)) + " "  # no mark at all
    rows = []
    for i in range(60):
        own = [sentence(rng, rng.randint(1, 15)) for _ in range(rng.randint(3, 20))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own)), "lead in " + passage + "tail ")
        if i % 7 == 0:
            own.insert(rng.randrange(len(own)), flat)
        rows.append((i, "".join(own)))
    twice = "".join(sentence(rng, 9) for _ in range(5))
    return rows + [(60, twice + "between. " + twice), (61, None), (62, ""), (63, " \n "), (64, "one."), (None, passage), (2, rows[2][1])], passage, flat


def test_cut_texts_equal_brute_force(spark):
    rows, passage, flat = corpus()
    want = brute(rows)
    docs = spark.createDataFrame([(d, t, len(t or ""), "x", 1) for d, t in rows], "doc_id long, text string, n_chars long, at string, tk int").repartition(7)
    out = spans.without_repeats(docs, spans="cut")
    assert out.columns == [*docs.columns, "cut"]
    got = out.collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((d, want.get((d, t), t))) for d, t in rows)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)
    core = passage[len(passage) // 4 : len(passage) * 3 // 4]
    assert sum(core in (r["text"] or "") for r in got) == 1
    assert sum(flat[150:350] in (r["text"] or "") for r in got) == 1
    old = {(d, want.get((d, t), t)): t for d, t in rows}
    for r in got:
        text = old[r["doc_id"], r["text"]] or ""
        kept, at = "", 0
        for c in r["cut"]:
            kept += text[at : c["start"]]
            at = c["end"]
        assert kept + text[at:] == (r["text"] or "")


def test_small_slices_change_nothing(spark, monkeypatch):
    rows, _, _ = corpus()
    want = brute(rows)
    monkeypatch.setattr("corpusmill.llm.common.SLICE_BYTES", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = spans.without_repeats(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((d, want.get((d, t), t))) for d, t in rows)


def test_sentences_cover_a_text():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice("ab .,!?\n\t\"'é") for _ in range(rng.randint(1, 200)))
        ends, words, parts = spans.sentences(text)
        assert ends[-1] == len(text) and ends == sorted(set(ends)) and len(ends) == len(words) == len(parts)
        assert sum(words) == len(text.split())


def test_stock_phrases_stay_and_passages_of_51_words_go(spark):
    rng = random.Random(31)

    def plain(n):
        return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))

    phrase, passage = plain(18), plain(51)
    rows = [(i, f"{plain(40)}. {phrase if i % 2 else passage}. {plain(40)}") for i in range(20)] + [(90, phrase), (91, phrase)]
    got = {r["doc_id"]: r for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), spans="cut").collect()}
    assert all(got[i]["text"] == t for i, t in rows if i % 2 and i < 20)
    assert [i for i in range(0, 20, 2) if not got[i]["cut"]] == [0]
    # a text that is nothing but a phrase said before is a repeat as a whole
    assert got[91]["text"] == ""


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(200_000))
    got = spans.without_repeats(spark.createDataFrame([(1, text), (2, "other " + text)], "doc_id long, text string"), spans="cut").collect()
    assert max(len(r["text"]) for r in got) < len(text) / 2.5


def test_an_empty_table(spark):
    assert spans.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_clauses_lie_in_runs():
    rng = random.Random(21)
    shouted = " ".join(f"W{rng.randrange(10**6)}!!" for _ in range(150))
    verse = "\n".join(f"a{rng.randrange(999)} b{rng.randrange(999)}," for _ in range(60))
    chinese = "，".join("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(rng.randint(2, 9))) for _ in range(40)) + "。"
    for text in (shouted, verse, chinese):
        ends, words, _ = spans.sentences(text)
        covered = {j for i in spans.runs(text)[0].tolist() for j in range(i, i + spans.RUN)}
        assert covered == set(range(len(ends))) and min(words) >= spans.SENTENCE_WORDS


def test_copies_of_short_clauses_are_cut(spark):
    rng = random.Random(22)
    shouted = " ".join(f"W{rng.randrange(10**6)}!!" for _ in range(150))
    chinese = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(300))
    got = spans.without_repeats(spark.createDataFrame([(1, shouted), (2, shouted), (3, chinese), (4, chinese)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: shouted, 2: "", 3: chinese, 4: ""}


def test_a_passage_shares_runs_in_any_surroundings():
    rng = random.Random(23)

    def plain(n):
        return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))

    for kind in range(3):
        for _ in range(200):
            passage = [plain(30) + ". " + plain(30) + ".", plain(51), "".join(sentence(rng, rng.randint(2, 20)) for _ in range(12))][kind]
            hosts = [f"{plain(rng.randint(0, 40))} {passage} {plain(rng.randint(0, 40))}" for _ in range(2)]
            a, b = ({*zip(*(x.tolist() for x in spans.runs(h)[1:]), strict=True)} for h in hosts)
            assert a & b


def test_a_copy_of_a_text_of_two_sentences_is_cut(spark):
    text = "One sentence with a few words, and then. Another one of as many words."
    got = spans.without_repeats(spark.createDataFrame([(1, text), (2, text), (3, "too few words"), (4, "too few words")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: text, 2: "", 3: "too few words", 4: "too few words"}
