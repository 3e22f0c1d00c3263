"""Registry of runnable queries, each with its SQL twin where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_cells(vector: Column) -> Column:
    """A number over all cells of a vector, each rounded to 5 places and weighed by its place."""
    weighed = F.transform(vector, lambda x, i: (i + 1) * F.round(x.cast("double") * 100000).cast("long"))
    return F.coalesce(F.aggregate(weighed, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input that is a single small file; a large input already has enough tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
