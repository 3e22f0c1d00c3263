"""Answers with ordered sources, context blocks and request tables for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.base import blank_to_null
from corpusmill.functions.text import preview
from corpusmill.session import BROADCAST_MAX_ROWS

SOURCE_PREVIEW = 1200
ANSWER_PREVIEW = 700
MIN_QUESTION_CHARS = 3
MAX_TOP_K = 20
DEFAULT_TOP_K = 5
NOTHING_FOUND = "I could not find relevant information in the search index."

# Element type of the sources array.
SOURCE_TYPE = (
    "array<struct<source_number:int,chunk_id:string,short_title:string,regulation_title:string,"
    "source_url:string,page_number:int,file_name:string,score:double,chunk_preview:string>>"
)

ANSWER_INSTRUCTIONS = (
    "You help compliance staff read regulations. Answer from the numbered sources below and from nothing else. "
    "Name the source of every statement as [Source n] and give page numbers where they help. "
    "Do not invent articles, dates, amounts or duties. If the sources do not cover the question, say so and answer "
    "only the part they cover. Begin with a short answer, then list duties, practical meaning and sources used. "
    "This is information, not legal advice."
)
JUDGE_INSTRUCTIONS = (
    "You check whether an answer is supported by its sources. Use no other knowledge and do not grade completeness. "
    "Reply with one JSON object holding faithfulness_score (1 unsupported to 5 fully supported), groundedness_pass "
    "(true for a score of 4 or 5), unsupported_claims (list of texts) and explanation (text)."
)


def validate_questions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): at least three characters, top_k in 1..20, absent top_k read as 5."""
    top = F.coalesce(F.col("top_k"), F.lit(DEFAULT_TOP_K)) if "top_k" in df.columns else F.lit(DEFAULT_TOP_K)
    reason = (
        F.when(F.col("question").isNull(), "question is missing")
        .when(F.length("question") < MIN_QUESTION_CHARS, f"question is shorter than {MIN_QUESTION_CHARS} characters")
        .when(~top.between(1, MAX_TOP_K), f"top_k is outside 1..{MAX_TOP_K}")
    )
    checked = df.withColumn("top_k", top.cast("int")).withColumn("reason", reason)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def attach_index_fields(hits: DataFrame, index: DataFrame, questions: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Add the index fields to the hits.

    There are at most k hits per question. When the questions are few enough
    for that to be a proven bound, the hits are broadcast and the chunk texts
    are not shuffled.
    """
    cap = BROADCAST_MAX_ROWS // k
    few = questions.limit(cap + 1).count() <= cap
    return (F.broadcast(hits) if few else hits).join(index.drop("embedding"), "chunk_id")


def answer_frame(questions: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """question_id, question, answer and the ordered sources array; a fallback answer where nothing was found.

    A group holds at most k hits, because ``hits`` went through a top-k.
    """
    source = F.struct(
        F.col("rank").cast("int").alias("source_number"),
        *[F.col(c) for c in ("chunk_id", "short_title", "regulation_title", "source_url", "page_number", "file_name", "score")],
        preview(F.col("chunk_text"), SOURCE_PREVIEW).alias("chunk_preview"),
    )
    grouped = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(source)).cast(SOURCE_TYPE).alias("sources"))
    out = questions.select("question_id", "question").join(grouped, "question_id", "left")
    text = F.lit(None).cast("string")
    if answers is not None:
        out, text = out.join(answers.select("question_id", "answer"), "question_id", "left"), F.coalesce("answer", F.lit(""))
    return out.select(
        "question_id",
        "question",
        F.when(F.col("sources").isNull(), F.lit(NOTHING_FOUND)).otherwise(text).alias("answer"),
        F.coalesce("sources", F.array().cast(SOURCE_TYPE)).alias("sources"),
    )


def _field(label: str, value: Column, missing: str) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(blank_to_null(value.cast("string")), F.lit(missing)), F.lit("\n"))


def _score_text(score: Column) -> Column:
    """Plain decimal text without trailing zeros; "None" for null."""
    text = F.regexp_replace(score.cast("decimal(18,6)").cast("string"), "0+$", F.lit(""))
    return F.coalesce(F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text), F.lit("None"))


# The labels of both kinds of blocks, and what stands for a missing value.
def context_block(sources: Column, text: str = "chunk_preview") -> Column:
    """Numbered blocks with labelled fields, joined by a blank line."""

    def one(s: Column) -> Column:
        return F.concat(
            F.lit("[Source "), s["source_number"].cast("string"), F.lit("]\n"),
            _field("Chunk ID", s["chunk_id"], "N/A"),
            _field("Short title", s["short_title"], "N/A"),
            _field("Regulation title", s["regulation_title"], "N/A"),
            _field("File name", s["file_name"], "N/A"),
            _field("Page number", s["page_number"], "unknown"),
            _field("Source URL", s["source_url"], "N/A"),
            F.lit("Search score: "), _score_text(s["score"]), F.lit("\n"),
            F.lit("Text:\n"), F.coalesce(s[text], F.lit("")),
        )

    return F.array_join(F.transform(sources, one), "\n\n")


def judge_context(sources: Column) -> Column:
    """Shorter blocks for the judge; a missing value reads "None"."""

    def one(s: Column) -> Column:
        def line(label: str, value: Column) -> Column:
            return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("None")), F.lit("\n"))

        return F.concat(
            F.lit("[Source "), s["source_number"].cast("string"), F.lit("]\n"),
            line("Short title", s["short_title"]),
            line("Regulation title", s["regulation_title"]),
            line("File name", s["file_name"]),
            line("Page number", s["page_number"]),
            F.lit("Text preview:\n"), F.coalesce(s["chunk_preview"], F.lit("")),
        )

    return F.array_join(F.transform(sources, one), "\n\n")


def build_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id and context over the full chunk texts of the hits, in rank order."""
    source = F.struct(
        F.col("rank").cast("int").alias("source_number"),
        *[F.col(c) for c in ("chunk_id", "short_title", "regulation_title", "file_name", "page_number", "source_url", "score", "chunk_text")],
    )
    blocks = hits.groupBy("question_id").agg(context_block(F.sort_array(F.collect_list(source)), "chunk_text").alias("context"))
    return questions.select("question_id", "question").join(blocks, "question_id", "left").select(
        "question_id", "question", F.coalesce("context", F.lit("")).alias("context")
    )


def _messages(system: str, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def build_requests(contexts: DataFrame) -> DataFrame:
    """One model request per question with a context: question_id and messages."""
    user = F.concat(
        F.lit("User question:\n"), F.col("question"), F.lit("\n\nRetrieved context:\n"), F.col("context"),
        F.lit("\n\nAnswer the question from this context only."),
    )
    return contexts.filter(F.col("context") != "").select("question_id", _messages(ANSWER_INSTRUCTIONS, user).alias("messages"))


def build_judge_requests(answers: DataFrame) -> DataFrame:
    user = F.concat(
        F.lit("Question:\n"), F.col("question"), F.lit("\n\nAnswer:\n"), F.coalesce("answer", F.lit("")),
        F.lit("\n\nSources:\n"), judge_context(F.col("sources")), F.lit("\n\nCheck the answer now."),
    )
    return answers.select("question_id", _messages(JUDGE_INSTRUCTIONS, user).alias("messages"))
