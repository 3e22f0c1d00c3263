"""Evaluation items and saved evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.schemas import QUESTIONS
from corpusmill.sources.files import read_json


def read_questions(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    return read_json(spark, path, QUESTIONS, multi_line)


def write_evaluation(results: DataFrame, summary: DataFrame, path: str, top_k: int) -> None:
    """``results`` and ``summary`` as JSON folders; the summary carries time and top_k."""
    results.write.mode("overwrite").json(f"{path}/results")
    (
        summary.withColumn("evaluation_timestamp", F.current_timestamp())
        .withColumn("top_k", F.lit(top_k))
        .write.mode("overwrite")
        .json(f"{path}/summary")
    )
