"""Quality checks of answers and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.base import blank_to_null, let
from corpusmill.functions.text import norm_key, preview
from corpusmill.operators.answers import ANSWER_PREVIEW

# Thresholds of the pass rule, and what stands for a reply that is no JSON.
MIN_COVERAGE = 0.4
GROUNDED_SCORE = 4
BAD_JSON_CLAIM = "Evaluator did not return valid JSON."
BAD_JSON_PREVIEW = 500


def check_expected(sources: Column, expected: Column) -> Column:
    """Does the expected title occur among the source titles, and is it the top one?

    Containment counts either way. A blank title is contained in everything, so
    it counts as found, but never as the top match.
    """

    def either(title: Column, want: Column) -> Column:
        return let(norm_key(title), lambda t: t.contains(want) | want.contains(t))

    def build(want: Column) -> Column:
        titles = F.transform(sources, lambda s: s["short_title"])
        top = F.get(titles, F.lit(0))
        return F.struct(
            expected.alias("expected_regulation"),
            titles.alias("retrieved_source_titles"),
            F.coalesce(F.exists(titles, lambda t: either(t, want)), F.lit(False)).alias("expected_regulation_found"),
            top.alias("top_source_title"),
            F.coalesce(blank_to_null(top).isNotNull() & either(top, want), F.lit(False)).alias("top_source_matches_expected"),
        )

    return let(norm_key(expected), build)


def check_keywords(answer: Column, keywords: Column) -> Column:
    """Keywords found in and missing from the answer, and the share found (0 for an empty list)."""

    def build(text: Column) -> Column:
        found = F.filter(keywords, lambda w: text.contains(norm_key(w)))
        missing = F.filter(keywords, lambda w: ~text.contains(norm_key(w)))
        share = F.when(F.size(keywords) > 0, F.round(F.size(found) / F.size(keywords), 3)).otherwise(F.lit(0.0))
        return F.struct(
            keywords.alias("expected_keywords"), found.alias("found_keywords"), missing.alias("missing_keywords"),
            share.alias("keyword_coverage"),
        )

    return let(norm_key(answer), build)


def average_score(sources: Column) -> Column:
    """Mean of the scores that are present, rounded to 6; null when there is none."""
    scores = F.filter(F.transform(sources, lambda s: s["score"]), lambda x: x.isNotNull())
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(scores) > 0, F.round(total / F.size(scores), 6))


def average_scores(hits: DataFrame) -> DataFrame:
    return hits.groupBy("question_id").agg(F.round(F.avg("score"), 6).alias("average_retrieval_score"))


def parse_judgement(response: Column) -> Column:
    """Read the judge's JSON reply; anything that is not a JSON object becomes a failed verdict.

    The kind of each field decides how it is read: the score becomes an int or
    0, a verdict that is no boolean follows the score, claims that are no list
    become a list of one text.
    """

    def kind(v: Column, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def text_of(v: Column, path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit("None"))

    def score_of(v: Column) -> Column:
        k = kind(v, "$.faithfulness_score")
        raw = F.try_variant_get(v, "$.faithfulness_score", "string")
        # A whole-number text counts, "4.0" as text does not; a JSON number is cut towards zero.
        as_text = F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("int"))
        as_flag = F.try_variant_get(v, "$.faithfulness_score", "boolean").try_cast("int")
        as_number = F.try_variant_get(v, "$.faithfulness_score", "double").try_cast("int")
        return F.coalesce(F.when(k == "STRING", as_text).when(k == "BOOLEAN", as_flag).otherwise(as_number), F.lit(0))

    def build(v: Column) -> Column:
        return let(score_of(v), lambda score: verdict(v, score))

    def verdict(v: Column, score: Column) -> Column:
        has_verdict = F.try_variant_get(v, "$.groundedness_pass", "variant").isNotNull()
        is_bool = kind(v, "$.groundedness_pass") == "BOOLEAN"
        claims_kind = kind(v, "$.unsupported_claims")
        claims = F.try_variant_get(v, "$.unsupported_claims", "array<string>")
        explanation = F.try_variant_get(v, "$.explanation", "variant")
        return F.struct(
            score.alias("faithfulness_score"),
            F.when(~has_verdict, F.lit(False))
            .when(is_bool, F.try_variant_get(v, "$.groundedness_pass", "boolean"))
            .otherwise(score >= GROUNDED_SCORE)
            .alias("groundedness_pass"),
            F.when(claims_kind.isNull(), F.array().cast("array<string>"))
            .when(claims_kind.startswith("ARRAY"), claims)
            .otherwise(F.array(text_of(v, "$.unsupported_claims")))
            .alias("unsupported_claims"),
            F.when(explanation.isNull(), F.lit("")).otherwise(F.try_variant_get(v, "$.explanation", "string")).alias("explanation"),
        )

    failed = F.struct(
        F.lit(0).alias("faithfulness_score"),
        F.lit(False).alias("groundedness_pass"),
        F.array(F.lit(BAD_JSON_CLAIM)).alias("unsupported_claims"),
        preview(response, BAD_JSON_PREVIEW).alias("explanation"),
    )
    parsed = F.try_parse_json(response)
    return let(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), build(v)).otherwise(failed))


def evaluate(answers: DataFrame, judgements: DataFrame) -> DataFrame:
    """One result per question.

    ``answers`` has question_id, question, answer, sources, expected_regulation
    and expected_keywords; ``judgements`` has question_id and response.
    """
    fallback = F.struct(
        F.lit(0).alias("faithfulness_score"), F.lit(False).alias("groundedness_pass"),
        F.array().cast("array<string>").alias("unsupported_claims"), F.lit("").alias("explanation"),
    )
    verdicts = judgements.select("question_id", parse_judgement(F.col("response")).alias("faithfulness_check"))
    checked = answers.join(verdicts, "question_id", "left").select(
        F.col("question_id").alias("id"),
        "question",
        (F.size("sources") > 0).alias("has_sources"),
        F.size("sources").alias("num_sources"),
        average_score(F.col("sources")).alias("average_retrieval_score"),
        check_expected(F.col("sources"), F.col("expected_regulation")).alias("regulation_check"),
        check_keywords(F.col("answer"), F.col("expected_keywords")).alias("keyword_check"),
        F.coalesce("faithfulness_check", fallback).alias("faithfulness_check"),
        preview(F.coalesce("answer", F.lit("")), ANSWER_PREVIEW).alias("answer_preview"),
    )
    passed = (
        F.col("has_sources")
        & F.col("regulation_check.expected_regulation_found")
        & (F.col("keyword_check.keyword_coverage") >= MIN_COVERAGE)
        & F.col("faithfulness_check.groundedness_pass")
    )
    return checked.withColumn("passed", passed)


def summarize(results: DataFrame) -> DataFrame:
    """Nine metrics in one row; all zero without results."""

    def rate(col: Column) -> Column:
        return F.coalesce(F.round(F.avg(col), 3), F.lit(0.0))

    return results.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if("passed").alias("passed_questions"),
        rate(F.col("passed").cast("int")).alias("pass_rate"),
        F.count_if("has_sources").alias("questions_with_sources"),
        F.count_if("regulation_check.expected_regulation_found").alias("expected_regulation_found_count"),
        F.count_if("regulation_check.top_source_matches_expected").alias("top_source_matches_expected_count"),
        rate(F.col("keyword_check.keyword_coverage")).alias("average_keyword_coverage"),
        rate(F.col("faithfulness_check.faithfulness_score")).alias("average_faithfulness_score"),
        F.count_if("faithfulness_check.groundedness_pass").alias("groundedness_pass_count"),
    )


def compare_runs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """metric, previous, current and their difference for two summaries of one row each."""

    def long(df: DataFrame, name: str) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
        return wide.unpivot([], wide.columns, "metric", name)

    return (
        long(previous, "previous")
        .join(long(current, "current"), "metric", "full")
        .withColumn("difference", F.round(F.col("current") - F.col("previous"), 6))
    )
