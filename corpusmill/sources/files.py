"""Raw files as bytes, and the all-or-nothing fallback between two sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from corpusmill.session import broadcast_if_bounded, materialize


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The path's own file system and the path for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the path's own file system; globs are allowed."""
    files, hadoop = _hadoop(spark, path)
    found = files.globStatus(hadoop)
    return found is not None and len(found) > 0


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    files, hadoop = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(hadoop)) if files.exists(hadoop) else []


def delete_path(spark: SparkSession, path: str) -> None:
    files, hadoop = _hadoop(spark, path)
    files.delete(hadoop, True)


def _json_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(file, whole) of every file with a line that is not blank, by its first such line.

    A file is JSON lines unless that line begins an array or an object that
    does not end in it. Only lines of the first block of a file are looked at,
    whatever white space or byte order mark stands before them.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where("block = 0").withColumn("at", F.monotonically_increasing_id()).withColumn("head", F.regexp_replace("value", r"^[\s\x{FEFF}]+", ""))
    heads = lines.where("head <> ''").groupBy("file").agg(F.min_by("head", "at").alias("head"))
    return heads.select("file", (F.col("head").startswith("[") | F.col("head").startswith("{") & F.try_parse_json("head").isNull()).alias("whole"))


def read_json(spark: SparkSession, path: str, schema: StructType, multi_line: bool | None = None) -> DataFrame:
    """JSON records under a schema, whether a file holds an array, an object, on one line or spread, or JSON lines.

    Files that are no JSON lines are read whole, one task each; lines are
    splittable. Which file is which stays in a frame, only two counts are
    looked at. ``multi_line`` says it for all files, without the look.
    """
    reader = spark.read.schema(schema)
    if multi_line is not None:
        return reader.option("multiLine", multi_line).json(path)
    kinds = materialize(_json_kinds(spark, path), "json-kinds")
    seen = kinds.agg(F.count_if("whole").alias("whole"), F.count_if(~F.col("whole")).alias("lines")).first()
    if not seen["whole"] or not seen["lines"]:
        return reader.option("multiLine", bool(seen["whole"])).json(path)

    def of_kind(texts: DataFrame, whole: bool) -> DataFrame:
        files = broadcast_if_bounded(kinds.where(F.col("whole") == whole).select(F.col("file").alias("_file")))[0]
        return texts.select("value", F.col("_metadata.file_path").alias("_path")).join(files, F.col("_path") == F.col("_file"), "left_semi").where(r"value RLIKE '\\S'")

    text = F.regexp_replace("value", r"^\x{FEFF}", "")
    lines = of_kind(spark.read.text(path), False).select(F.from_json(text, schema).alias("r"))
    whole = of_kind(spark.read.text(path, wholetext=True), True).select(F.explode_outer(F.from_json(text, ArrayType(schema))).alias("r"))
    return lines.unionAll(whole).select("r.*")


def read_raw_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, length and content of every file below ``root``, in one distributed scan. Content that is not used is not read."""
    if not path_exists(spark, root):
        raise FileNotFoundError(root)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(root)
        .select("path", "length", "content")
    )


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary set when it has any row, else the secondary set."""
    any_primary = primary.select(F.lit(1).alias("_one")).limit(1)
    spare = secondary.withColumn("_one", F.lit(1)).join(any_primary, "_one", "left_anti").drop("_one")
    return primary.unionByName(spare)
