"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from corpusmill.session import materialize

#: Texts are worked on in slices of about this many bytes, so that a task's memory does not follow its batch of rows.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_key(text: Column) -> Column:
    """64 bits that tell apart rows that share a doc_id."""
    return F.xxhash64(text)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def slices(sizes: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` in sum, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(df: DataFrame, schema: StructType | str, work: Callable[[list[list]], dict[str, object]], text_at: int = -1) -> DataFrame:
    """Runs ``work`` over slices of rows: the columns as lists in, the columns as arrays out."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = schema.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            sizes = [0 if n is None else n for n in pa.compute.binary_length(columns[text_at]).to_pylist()]
            for lo, hi in slices(sizes):
                out = work([c.slice(lo, hi - lo).to_pylist() for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)
            del batch, columns
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column], values: dict[str, str], label: str) -> DataFrame:
    """Adds, for each (value column, name) of ``values``, the sum over the rows before this one in its group.

    The rows are sorted by range, so a group of any size lies in as many
    partitions as it needs. Only one sum per partition and group is gathered;
    rows are numbered within their range. Rows that ``order`` can't tell apart
    come in any order. Nulls sort as ``order`` says; group nulls last.
    """
    part = fresh(df, "_range")
    ranges = [col(g).asc_nulls_last() for g in group] + list(order)
    placed = materialize(df.repartitionByRange(*ranges).withColumn(part, F.spark_partition_id()), label)
    within = Window.partitionBy(part, *[col(g) for g in group]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*[col(g) for g in group]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = placed.groupBy(part, *[col(g) for g in group]).agg(*[F.sum(col(v)).alias(name) for v, name in values.items()])
    offsets = sums.select(
        F.col(part).alias("_p"),
        *[col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        *[F.coalesce(F.sum(name).over(before), zero).alias(f"_o{i}") for i, name in enumerate(values.values())],
    )
    on = F.col(part) == F.col("_p")
    for i, g in enumerate(group):
        on = on & same(col(g), F.col(f"_g{i}"))
    inner = placed.select("*", *[F.coalesce(F.sum(col(v)).over(within), zero).alias(name) for v, name in values.items()])
    return inner.join(offsets, on).select(
        *[col(c) for c in df.columns],
        *[(F.col(name) + F.col(f"_o{i}")).alias(name) for i, name in enumerate(values.values())],
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge; the root is the component's smallest node.

    Large-star and small-star turns (Kiveris et al., 2014) over (a, b), each
    written to the shared folder. Only minima are gathered by node, so a node
    with very many neighbours stays a join that the engine can split.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)).alias("s")).first()
        if (seen["n"], seen["x"], seen["s"]) == mark or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (seen["n"], seen["x"], seen["s"])
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(lowest.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(turned.where(F.col("a") != F.col("b")).unionAll(lowest.select("a", F.col("m").alias("b"))).distinct(), label)
