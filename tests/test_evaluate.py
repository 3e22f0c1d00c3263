"""Checks, judge replies and summaries on edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluate as E


BAD = [E.BAD_JSON_CLAIM]
# reply: (score, verdict, claims, explanation)
REPLIES = {
    '{"faithfulness_score": 5, "groundedness_pass": true, "unsupported_claims": [], "explanation": "ok"}': (5, True, [], "ok"),
    '{"faithfulness_score": "5", "groundedness_pass": false}': (5, False, [], ""),
    '{"faithfulness_score": " 4 ", "groundedness_pass": "no"}': (4, True, [], ""),
    '{"faithfulness_score": "4.0", "groundedness_pass": "yes"}': (0, False, [], ""),
    '{"faithfulness_score": 4.0, "groundedness_pass": null}': (4, True, [], ""),
    '{"faithfulness_score": 4.9, "groundedness_pass": 1, "unsupported_claims": "one"}': (4, True, ["one"], ""),
    '{"faithfulness_score": null, "unsupported_claims": null}': (0, False, ["None"], ""),
    '{"faithfulness_score": true, "unsupported_claims": 3}': (1, False, ["3"], ""),
    '{"faithfulness_score": -1.5}': (-1, False, [], ""),
    '{"faithfulness_score": [5]}': (0, False, [], ""),
    '{"faithfulness_score": {"a": 5}}': (0, False, [], ""),
    '{"unsupported_claims": ["a", "b"]}': (0, False, ["a", "b"], ""),
    "{}": (0, False, [], ""),
    '{"explanation": "' + "x" * 900 + '"}': (0, False, [], "x" * 900),
    '{"faithfulness_score": "abc"}': (0, False, [], ""),
    '{"faithfulness_score": "+3"}': (3, False, [], ""),
    "nope": (0, False, BAD, "nope"),
    "": (0, False, BAD, ""),
    "[1, 2]": (0, False, BAD, "[1, 2]"),
    "3": (0, False, BAD, "3"),
    '"text"': (0, False, BAD, '"text"'),
    "n" * 700: (0, False, BAD, "n" * 500),
    '{"faithfulness_score": 5': (0, False, BAD, '{"faithfulness_score": 5'),
}


def test_judge_replies(spark):
    rows = spark.createDataFrame([(r,) for r in REPLIES], "r string").select("r", E.parse_judgement(F.col("r")).alias("v")).collect()
    for row in rows:
        assert (row.v.faithfulness_score, row.v.groundedness_pass, list(row.v.unsupported_claims), row.v.explanation) == REPLIES[row.r], row.r


@pytest.mark.parametrize(
    ("titles", "expected", "found", "top"),
    [
        (["AI_Act"], "ai-act", True, True), (["x", "The AI Act text"], "AI Act", True, False), ([None], "GDPR", True, False), ([""], "GDPR", True, False),
        ([], "GDPR", False, False), (["PSD"], "PSD2", True, True), (["x"], "", True, True), (["x"], "y", False, False),
    ],
)
def test_expected_title(spark, titles, expected, found, top):
    df = spark.createDataFrame([([(t,) for t in titles], expected)], "s array<struct<short_title:string>>, e string")
    c = df.select(E.check_expected(F.col("s"), F.col("e")).alias("c")).first().c
    assert (c.expected_regulation_found, c.top_source_matches_expected) == (found, top)
    assert c.retrieved_source_titles == titles and c.top_source_title == (titles[0] if titles else None)


@pytest.mark.parametrize(
    ("answer", "keywords", "found", "share"),
    [("Risk-based ICT", ["risk based", "ICT", "loss"], ["risk based", "ICT"], 0.667), (None, ["a"], [], 0.0), ("a", [], [], 0.0), ("x", [""], [""], 1.0)],
)
def test_keyword_share(spark, answer, keywords, found, share):
    df = spark.createDataFrame([(answer, keywords)], "a string, k array<string>")
    c = df.select(E.check_keywords(F.col("a"), F.col("k")).alias("c")).first().c
    assert (c.found_keywords, c.keyword_coverage) == (found, share)
    assert sorted(c.found_keywords + c.missing_keywords) == sorted(keywords)


def test_average_score(spark):
    df = spark.createDataFrame([(1, [(0.5,), (None,), (0.25,)]), (2, [(None,)]), (3, [])], "i int, s array<struct<score:double>>")
    assert [r[0] for r in df.orderBy("i").select(E.average_score(F.col("s"))).collect()] == [0.375, None, None]


SOURCE = "array<struct<source_number:int,short_title:string,score:double>>"


def test_evaluation_and_summary(spark):
    answers = spark.createDataFrame(
        [("q1", "?", "risk and loss", [(1, "DORA", 0.02)], "dora", ["risk", "loss"]), ("q2", "?", "nothing", [], "GDPR", ["a", "b"]), ("q3", "?", "x", [(1, None, None)], "GDPR", ["x"])],
        f"question_id string, question string, answer string, sources {SOURCE}, expected_regulation string, expected_keywords array<string>",
    )
    judged = spark.createDataFrame([("q1", '{"faithfulness_score": 5, "groundedness_pass": true}'), ("q2", "bad")], "question_id string, response string")
    results = E.evaluate(answers, judged)
    rows = {r.id: r for r in results.collect()}
    assert rows["q1"].passed and not rows["q2"].passed and not rows["q3"].passed
    assert rows["q3"].regulation_check.expected_regulation_found and not rows["q3"].regulation_check.top_source_matches_expected
    s = E.summarize(results).first().asDict()
    assert s == {
        "total_questions": 3, "passed_questions": 1, "pass_rate": 0.333, "questions_with_sources": 2, "expected_regulation_found_count": 2,
        "top_source_matches_expected_count": 1, "average_keyword_coverage": 0.667, "average_faithfulness_score": 1.667, "groundedness_pass_count": 1,
    }
    empty = E.summarize(results.filter("false")).first().asDict()
    assert set(empty.values()) == {0}
    diff = {r.metric: r.difference for r in E.compare_runs(E.summarize(results.filter("false")), E.summarize(results)).collect()}
    assert diff["pass_rate"] == 0.333 and diff["total_questions"] == 3
