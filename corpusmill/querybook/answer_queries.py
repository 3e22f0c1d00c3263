"""Answers, contexts, model requests and quality checks over the whole question tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.pii import PII_ORDERS, PII_REPLACEMENTS, redact_pii
from corpusmill.functions.tokens import tokens
from corpusmill.operators.answers import (
    ANSWER_INSTRUCTIONS, JUDGE_INSTRUCTIONS, NOTHING_FOUND, answer_frame, attach_index_fields, build_context, build_judge_requests,
    build_requests, validate_questions,
)
from corpusmill.operators.embed import embed
from corpusmill.operators.evaluate import (
    BAD_JSON_CLAIM, average_scores, check_expected, check_keywords, compare_runs, evaluate, parse_judgement, summarize,
)
from corpusmill.operators.hybrid import search_hybrid
from corpusmill.operators.keyword import search_keyword
from corpusmill.querybook import sql
from corpusmill.querybook.frames import asked, stored_chunks, stored_postings
from corpusmill.querybook.registry import query, table
from corpusmill.querybook.search_queries import HYBRID, hybrid_hits
from corpusmill.querybook.text_queries import _PII_SQL

DIMS = 64
# A question without any word finds nothing.
_SILENT = "???"
_ASKED_AND_SILENT = f"asked AS (SELECT item_id AS question_id, text AS question FROM benchmark UNION ALL SELECT -1, '{_SILENT}')"


def _asked_and_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(_SILENT)))


def _flat(answers: DataFrame) -> DataFrame:
    """One row per source; a question without sources keeps one row."""
    return answers.select("question_id", "question", "answer", F.explode_outer("sources").alias("s")).select("question_id", "question", "answer", "s.*")


def _flat_sql(hits: str, questions: str = "asked", index: str = "chunked") -> str:
    return f"""SELECT q.question_id, q.question, CASE WHEN h.question_id IS NULL THEN '{NOTHING_FOUND}' END AS answer, h.rank AS source_number,
  h.chunk_id, c.short_title, c.regulation_title, c.source_url, c.page_number, c.file_name, h.score, left(c.chunk_text, 1200) AS chunk_preview
FROM {questions} q LEFT JOIN {hits} h USING (question_id) LEFT JOIN {index} c USING (chunk_id)"""


@query("answers_with_sources", f"WITH {sql.CHUNKED},\n{_ASKED_AND_SILENT},\n{sql.keyword(5)} {_flat_sql('kw_hits')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks = _asked_and_silent(spark, sf_dir), stored_chunks(spark, sf_dir)
    hits = search_keyword(questions, stored_postings(chunks), 5)
    return _flat(answer_frame(questions, attach_index_fields(hits, chunks, questions, 5)))


def _hybrid_with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = stored_chunks(spark, sf_dir)
    return attach_index_fields(hybrid_hits(spark, sf_dir, chunks), chunks, asked(spark, sf_dir), 5)


@query("hybrid_answers", f"WITH {HYBRID} {_flat_sql('fused_hits')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(answer_frame(asked(spark, sf_dir), _hybrid_with_fields(spark, sf_dir)))


def _redact_sql(expr: str) -> str:
    for kind in PII_ORDERS["compat"]:
        expr = f"regexp_replace({expr}, '{_PII_SQL[kind]}', '{PII_REPLACEMENTS[kind]}', 'g')"
    return expr


@query(
    "ask_redacted_turns",
    f"""WITH {sql.CHUNKED},
asked AS (SELECT conv_id || ':' || turn AS question_id, {_redact_sql('text')} AS question FROM conversations WHERE role = 'user' AND length(text) >= 3),
{sql.vectors('chunked', 'chunk_id', 'chunk_text', DIMS, 'cv')},
{sql.vectors('asked', 'question_id', 'question', DIMS, 'qv')},
{sql.keyword(None)},\n{sql.nearest(5, 'qv', 'cv')},\n{sql.fused(5, ('kw_hits', 'vec_hits'))} {_flat_sql('fused_hits')}""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The whole way of a question: check, redact, vectorise, retrieve, list sources.
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question")
    )
    valid, _rejected = validate_questions(turns)
    questions = redact_pii(valid, "question").select("question_id", F.col("redacted_text").alias("question"))
    chunks = stored_chunks(spark, sf_dir)
    hits = search_hybrid(embed(questions, "question", DIMS), stored_postings(chunks), embed(chunks, dims=DIMS), 5)
    return _flat(answer_frame(questions, attach_index_fields(hits, chunks, questions, 5)))


@query(
    "validate_questions",
    """SELECT conv_id, turn, length(text)::INT AS n, top_k, CASE WHEN length(text) < 3 THEN 'question is shorter than 3 characters'
  WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k is outside 1..20' END AS reason
FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN left(text, turn::INT) ELSE text END AS text,
  CASE WHEN role = 'assistant' THEN 5 ELSE (length(text) // 40)::INT END AS top_k FROM conversations)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr("CASE WHEN role = 'system' THEN left(text, cast(turn AS int)) ELSE text END").alias("question"),
        F.when(F.col("role") != "assistant", F.floor(F.length("text") / 40).cast("int")).alias("top_k"),
    )
    valid, rejected = validate_questions(turns)
    both = valid.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
    return both.select("conv_id", "turn", F.length("question").alias("n"), "top_k", "reason")


_SCORE_SQL = r"regexp_replace(regexp_replace(h.score::DECIMAL(18, 6)::VARCHAR, '0+$', ''), '\.$', '.0')"
_CONTEXT_SQL = f"""blocks AS (SELECT h.question_id, string_agg('[Source ' || h.rank || ']' || chr(10) || 'Chunk ID: ' || h.chunk_id || chr(10)
  || 'Short title: ' || c.short_title || chr(10) || 'Regulation title: N/A' || chr(10) || 'File name: ' || c.file_name || chr(10)
  || 'Page number: ' || c.page_number || chr(10) || 'Source URL: ' || c.source_url || chr(10) || 'Search score: ' || {_SCORE_SQL} || chr(10)
  || 'Text:' || chr(10) || c.chunk_text, chr(10) || chr(10) ORDER BY h.rank) AS context
  FROM fused_hits h JOIN chunked c USING (chunk_id) GROUP BY 1),
contexts AS (SELECT question_id, question, coalesce(context, '') AS context FROM asked LEFT JOIN blocks USING (question_id))"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("build_context", f"WITH {HYBRID},\n{_CONTEXT_SQL} SELECT * FROM contexts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_context(asked(spark, sf_dir), _hybrid_with_fields(spark, sf_dir))


@query(
    "build_requests",
    f"""WITH {HYBRID},\n{_CONTEXT_SQL}
SELECT question_id, 'system' AS role, {_text(ANSWER_INSTRUCTIONS)} AS content FROM contexts WHERE context <> ''
UNION ALL SELECT question_id, 'user', 'User question:' || chr(10) || question || chr(10) || chr(10) || 'Retrieved context:' || chr(10) || context
  || chr(10) || chr(10) || 'Answer the question from this context only.' FROM contexts WHERE context <> ''""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_requests(build_context(asked(spark, sf_dir), _hybrid_with_fields(spark, sf_dir))).select("question_id", F.inline("messages"))


@query(
    "average_scores",
    f"WITH {HYBRID} SELECT question_id, round(avg(score), 6) AS average_retrieval_score FROM fused_hits GROUP BY 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_scores(hybrid_hits(spark, sf_dir, stored_chunks(spark, sf_dir)))


# Judge replies of every kind the parser must read, chosen by a digit of a hash.
_SHAPES = (
    ("2", "nope, {n}"),
    ("4", '{{"faithfulness_score": "5", "groundedness_pass": true, "unsupported_claims": [], "explanation": "fine {n}"}}'),
    ("6", '{{"faithfulness_score": "4.0", "groundedness_pass": "yes", "unsupported_claims": "claim {n}", "explanation": ""}}'),
    ("8", '{{"faithfulness_score": 4.0, "groundedness_pass": null, "unsupported_claims": ["a", "{n}"], "explanation": "x"}}'),
    ("a", "[1, {n}]"),
    ("c", '{{"explanation": "only {n}"}}'),
    ("e", '{{"faithfulness_score": 3.9, "groundedness_pass": "true", "unsupported_claims": 7, "explanation": "n {n}"}}'),
    ("g", '{{"faithfulness_score": 5, "groundedness_pass": false, "unsupported_claims": null, "explanation": "z"}}'),
)
# Per shape: score, verdict, claims (joined with |) and explanation.
_EXPECTED = (
    ("0", "false", f"'{BAD_JSON_CLAIM}'", "'nope, ' || n"),
    ("5", "true", "''", "'fine ' || n"),
    ("0", "false", "'claim ' || n", "''"),
    ("4", "true", "'a|' || n", "'x'"),
    ("0", "false", f"'{BAD_JSON_CLAIM}'", "'[1, ' || n || ']'"),
    ("0", "false", "''", "'only ' || n"),
    ("3", "false", "'7'", "'n ' || n"),
    ("5", "false", "'None'", "'z'"),
)


def _response(key: str) -> Column:
    n = F.col(key).cast("string")
    digit = F.substring(F.md5(n), 1, 1)
    out = F.when(F.lit(False), "")
    for limit, shape in _SHAPES:
        out = out.when(digit < limit, F.concat(*[x for part in shape.format(n="\0").split("\0") for x in (F.lit(part), n)][:-1]))
    return out


def _judged_sql(source: str, key: str) -> str:
    def case(i: int) -> str:
        return "CASE " + " ".join(f"WHEN d < '{_SHAPES[j][0]}' THEN {_EXPECTED[j][i]}" for j in range(len(_SHAPES))) + " END"

    return (
        f"SELECT {key}, {case(0)}::INT AS faithfulness_score, {case(1)} AS groundedness_pass, {case(2)} AS claims, {case(3)} AS explanation "
        f"FROM (SELECT {key}, {key}::VARCHAR AS n, substr(md5({key}::VARCHAR), 1, 1) AS d FROM {source})"
    )


@query("parse_judgement", _judged_sql("labels", "doc_id"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", parse_judgement(_response("doc_id")).alias("v")).select(
        "doc_id", "v.faithfulness_score", "v.groundedness_pass", F.array_join("v.unsupported_claims", "|").alias("claims"), "v.explanation"
    )


_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS asked_text, a.text AS answer FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


def _keywords(col: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens(col), lambda w: F.length(w) >= 3)))


def _keywords_sql(expr: str) -> str:
    return f"list_sort(list_distinct(list_filter({sql.tokens(expr)}, lambda w: length(w) >= 3)))"


@query(
    "keyword_coverage",
    f"""WITH {_PAIRS}, k AS (SELECT conv_id, turn, {_keywords_sql('asked_text')} AS kw, {sql.norm('answer')} AS t FROM pairs)
SELECT conv_id, turn, array_to_string(list_filter(kw, lambda w: contains(t, w)), ',') AS found, array_to_string(list_filter(kw, lambda w: NOT contains(t, w)), ',') AS missing,
  CASE WHEN len(kw) > 0 THEN round(len(list_filter(kw, lambda w: contains(t, w))) / len(kw)::DOUBLE, 3) ELSE 0.0::DOUBLE END AS keyword_coverage FROM k""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked_text"))
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = users.join(replies, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", check_keywords(F.col("answer"), _keywords(F.col("asked_text"))).alias("c")).select(
        "conv_id", "turn", F.array_join("c.found_keywords", ",").alias("found"), F.array_join("c.missing_keywords", ",").alias("missing"), "c.keyword_coverage"
    )


_WANTED = "'SRC' || (item_id % 20)"
_EXPECTED_SQL = f"""wanted AS (SELECT item_id AS question_id, {_WANTED} AS expected, lower({_WANTED}) AS e FROM benchmark),
titles AS (SELECT question_id, list(short_title ORDER BY rank) AS t FROM fused_hits JOIN chunked USING (chunk_id) GROUP BY 1),
regulation AS (SELECT question_id, expected, coalesce(array_to_string(t, ','), '') AS titles, t[1] AS top_title,
  coalesce(len(list_filter(t, lambda x: contains(x, e) OR contains(e, x))) > 0, false) AS found,
  coalesce(contains(t[1], e) OR contains(e, t[1]), false) AS top_matches FROM wanted LEFT JOIN titles USING (question_id))"""


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string")).alias("expected_regulation"),
        _keywords(F.col("text")).alias("expected_keywords"),
    )


@query("expected_source", f"WITH {HYBRID},\n{_EXPECTED_SQL} SELECT * FROM regulation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = answer_frame(asked(spark, sf_dir), _hybrid_with_fields(spark, sf_dir)).join(_wanted(spark, sf_dir), "question_id")
    return answers.select("question_id", check_expected(F.col("sources"), F.col("expected_regulation")).alias("c")).select(
        "question_id",
        F.col("c.expected_regulation").alias("expected"),
        F.array_join("c.retrieved_source_titles", ",").alias("titles"),
        F.col("c.top_source_title").alias("top_title"),
        F.col("c.expected_regulation_found").alias("found"),
        F.col("c.top_source_matches_expected").alias("top_matches"),
    )


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered with the text of their first source, joined with what is expected."""
    hits = _hybrid_with_fields(spark, sf_dir)
    extracts = hits.filter("rank = 1").select("question_id", F.col("chunk_text").alias("answer"))
    return answer_frame(asked(spark, sf_dir), hits, extracts).join(_wanted(spark, sf_dir), "question_id")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = asked(spark, sf_dir).select("question_id", _response("question_id").alias("response"))
    return evaluate(_answered(spark, sf_dir), judged)


_RESULTS_SQL = f"""{HYBRID},\n{_EXPECTED_SQL},
verdicts AS ({_judged_sql('asked', 'question_id')}),
first_text AS (SELECT question_id, chunk_text FROM fused_hits JOIN chunked USING (chunk_id) WHERE rank = 1),
sources AS (SELECT question_id, count(*)::INT AS num_sources, round(avg(score), 6) AS average_retrieval_score FROM fused_hits GROUP BY 1),
covered AS (SELECT question_id, {_keywords_sql('question')} AS kw, {sql.norm('chunk_text')} AS t, chunk_text FROM asked LEFT JOIN first_text USING (question_id)),
results AS (SELECT q.question_id AS id, coalesce(num_sources, 0) > 0 AS has_sources, coalesce(num_sources, 0)::INT AS num_sources, average_retrieval_score,
  r.found AS expected_found, r.top_matches, round(len(list_filter(kw, lambda w: contains(t, w))) / len(kw)::DOUBLE, 3) AS coverage,
  v.faithfulness_score, v.groundedness_pass, left(coalesce(c.chunk_text, ''), 700) AS answer_preview
  FROM asked q LEFT JOIN sources USING (question_id) JOIN regulation r USING (question_id) JOIN verdicts v USING (question_id) JOIN covered c USING (question_id)),
graded AS (SELECT *, has_sources AND expected_found AND coverage >= 0.4 AND groundedness_pass AS passed FROM results)"""


@query("evaluate_answers", f"WITH {_RESULTS_SQL} SELECT * FROM graded")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select(
        "id", "has_sources", "num_sources", "average_retrieval_score",
        F.col("regulation_check.expected_regulation_found").alias("expected_found"),
        F.col("regulation_check.top_source_matches_expected").alias("top_matches"),
        F.col("keyword_check.keyword_coverage").alias("coverage"),
        "faithfulness_check.faithfulness_score", "faithfulness_check.groundedness_pass", "answer_preview", "passed",
    )


_SUMMARY = """SELECT count(*) AS total_questions, count(*) FILTER (passed) AS passed_questions, coalesce(round(avg(passed::INT), 3), 0) AS pass_rate,
  count(*) FILTER (has_sources) AS questions_with_sources, count(*) FILTER (expected_found) AS expected_regulation_found_count,
  count(*) FILTER (top_matches) AS top_source_matches_expected_count, coalesce(round(avg(coverage), 3), 0) AS average_keyword_coverage,
  coalesce(round(avg(faithfulness_score), 3), 0) AS average_faithfulness_score, count(*) FILTER (groundedness_pass) AS groundedness_pass_count FROM {}"""


@query("evaluation_summary", f"WITH {_RESULTS_SQL} {_SUMMARY.format('graded')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(_results(spark, sf_dir))


def _label_results(labels: DataFrame) -> DataFrame:
    """Labels as evaluation results: quality is coverage and score, toxicity spoils the grounding."""
    good = F.col("toxic") == 0
    return labels.select(
        (good & (F.col("quality") == 1)).alias("passed"),
        F.lit(True).alias("has_sources"),
        F.struct(good.alias("expected_regulation_found"), (F.col("quality") == 1).alias("top_source_matches_expected")).alias("regulation_check"),
        F.struct((F.col("quality") * 0.75).cast("double").alias("keyword_coverage")).alias("keyword_check"),
        F.struct((F.col("quality") * 4 + 1).alias("faithfulness_score"), good.alias("groundedness_pass")).alias("faithfulness_check"),
    )


_LABEL_RESULTS = """SELECT toxic = 0 AND quality = 1 AS passed, true AS has_sources, toxic = 0 AS expected_found, quality = 1 AS top_matches,
  quality * 0.75::DOUBLE AS coverage, quality * 4 + 1 AS faithfulness_score, toxic = 0 AS groundedness_pass FROM labels JOIN documents USING (doc_id) WHERE {}"""


@query("summary_of_labels", f"{_SUMMARY.format('(' + _LABEL_RESULTS.format('true') + ')')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return summarize(_label_results(table(spark, sf_dir, "labels").join(docs, "doc_id")))


def _long_sql(name: str) -> str:
    metrics = (
        "total_questions passed_questions pass_rate questions_with_sources expected_regulation_found_count top_source_matches_expected_count "
        "average_keyword_coverage average_faithfulness_score groundedness_pass_count"
    ).split()
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v FROM {name}" for m in metrics)


@query(
    "compare_runs",
    f"""WITH p AS ({_SUMMARY.format('(' + _LABEL_RESULTS.format("lang = 'en'") + ')')}), c AS ({_SUMMARY.format('(' + _LABEL_RESULTS.format("lang <> 'en'") + ')')})
SELECT metric, a.v AS previous, b.v AS current, round(b.v - a.v, 6) AS difference FROM ({_long_sql('p')}) a JOIN ({_long_sql('c')}) b USING (metric)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    english, other = labelled.filter("lang = 'en'"), labelled.filter("lang <> 'en'")
    return compare_runs(summarize(_label_results(english)), summarize(_label_results(other)))


@query(
    "judge_requests",
    f"""WITH {HYBRID},
blocks AS (SELECT h.question_id, string_agg('[Source ' || h.rank || ']' || chr(10) || 'Short title: ' || c.short_title || chr(10) || 'Regulation title: None' || chr(10)
  || 'File name: ' || c.file_name || chr(10) || 'Page number: ' || c.page_number || chr(10) || 'Text preview:' || chr(10) || left(c.chunk_text, 1200), chr(10) || chr(10) ORDER BY h.rank) AS b,
  max(CASE WHEN rank = 1 THEN c.chunk_text END) AS answer FROM fused_hits h JOIN chunked c USING (chunk_id) GROUP BY 1)
SELECT question_id, 'system' AS role, {_text(JUDGE_INSTRUCTIONS)} AS content FROM asked
UNION ALL SELECT question_id, 'user', 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer:' || chr(10) || coalesce(answer, '{NOTHING_FOUND}') || chr(10) || chr(10)
  || 'Sources:' || chr(10) || coalesce(b, '') || chr(10) || chr(10) || 'Check the answer now.' FROM asked LEFT JOIN blocks USING (question_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_judge_requests(_answered(spark, sf_dir)).select("question_id", F.inline("messages"))
