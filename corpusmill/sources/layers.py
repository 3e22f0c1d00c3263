"""Layer tables: staged replacement with a load time, upserts that rewrite only what they touch, and reads.

A layer is a view over the files of its generations. A write puts a new
generation beside the old one, counts its rows on the way and then replaces the
view: one catalog step, which also takes a new schema. Until then, and when
anything fails before, the layer is what it was, and a reader that has begun
keeps the files it has seen. So a frame may replace the layer it reads.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.sources.files import children, delete_path

DEFAULT_FORMAT = "parquet"
DEFAULT_BUCKETS = 64
_PROPERTY = "corpusmill.layer"
_BUCKET, _KEY, _CHANGE = "_bucket", "_layer_key", "_layer_change"
# So many changes wait beside a layer, at least, before they are written into its buckets.
WAITING_CHANGES = 128


@dataclass(frozen=True)
class Layer:
    """What the view of a layer says of its files.

    ``parts``: folders below ``root``. A layer with a ``key`` has one for each
    bucket that holds rows, in the generation that wrote it last.
    """

    root: str
    fmt: str
    schema: str
    generation: str
    parts: tuple[str, ...]
    before: tuple[str, ...] = ()
    key: str | None = None
    buckets: int = 0
    #: the last micro-batch of a stream that was written to the layer
    batch: int = -1
    #: folders of changes that are merged when the layer is read, their rows, the number of the last one, and the rows of ``parts``
    waiting: tuple[str, ...] = ()
    waiting_rows: int = 0
    changes: int = 0
    rows: int = 0
    #: folders that hold the rows of the last write and no others; none where these lie among older ones
    latest: tuple[str, ...] = ()

    def paths(self, parts: Iterable[str] | None = None) -> list[str]:
        return [f"{self.root}/{p}" for p in (self.parts if parts is None else parts)]


def with_audit(df: DataFrame, layer: str) -> DataFrame:
    """Add ``<layer>_loaded_at``."""
    return df.withColumn(f"{layer}_loaded_at", F.current_timestamp())


def utc_text() -> object:
    """Current time as ISO text in UTC, for records that keep times as text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def with_metrics(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """Count the rows of a stage while they are written; no second pass."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _rows(seen: Observation) -> int:
    """Rows counted; a plan that was found to be empty before it ran has counted nothing."""
    try:
        return seen.get.get("rows", 0)
    except Py4JJavaError as error:
        if "assertion failed" not in str(error.java_exception):
            raise
        return 0


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.replace("`", "").split("."))


def _root(spark: SparkSession, name: str) -> str:
    database, _, table = name.rpartition(".")
    folder = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return f"{folder.rstrip('/')}/{table}.layer"


def layer_of(spark: SparkSession, name: str) -> Layer | None:
    """What is known of a layer; None where there is no such name. Other tables and views are not replaced."""
    if not spark.catalog.tableExists(name):
        return None
    told = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()}
    if _PROPERTY not in told:
        raise ValueError(f"{name} is no layer; drop or rename it first")
    held = json.loads(zlib.decompress(bytes.fromhex(told[_PROPERTY])))
    return Layer(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})


def _nullable(told: object) -> object:
    """The JSON of a schema with every field and element nullable, as files hold them."""
    if isinstance(told, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else _nullable(v) for k, v in told.items()}
    return [_nullable(x) for x in told] if isinstance(told, list) else told


def _schema(layer: Layer) -> StructType:
    return StructType.fromJson(json.loads(layer.schema))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def _publish(spark: SparkSession, name: str, layer: Layer) -> None:
    """The one step in the catalog that makes a generation the layer."""
    where = layer.paths()[0] if len(layer.parts) == 1 else f"{layer.root}/{{{','.join(layer.parts)}}}"
    columns = ", ".join(f"`{f.name}`" for f in _schema(layer).fields)
    # In hex digits: the catalog hides values in which words like "url" occur.
    told = zlib.compress(json.dumps(vars(layer)).encode()).hex()
    rows = f"SELECT {columns} FROM {layer.fmt}.`{where}`"
    if layer.waiting:
        # A row counts unless a later change has its key.
        changes = f"{layer.root}/{{{','.join(layer.waiting)}}}"
        every = f"SELECT {columns}, 0L AS {_CHANGE} FROM {layer.fmt}.`{where}` UNION ALL SELECT {columns}, {_CHANGE} FROM {layer.fmt}.`{changes}/rows`"
        last = f"SELECT {_KEY}, max({_CHANGE}) AS _layer_last FROM parquet.`{changes}/keys` GROUP BY {_KEY}"
        rows = f"SELECT {columns} FROM ({every}) LEFT JOIN ({last}) ON `{layer.key}` <=> {_KEY} WHERE _layer_last IS NULL OR {_CHANGE} >= _layer_last"
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} TBLPROPERTIES ('{_PROPERTY}' = '{told}') AS {rows}")


def _expire(spark: SparkSession, layer: Layer) -> None:
    """Delete what neither this state of the layer nor the one before refers to."""
    kept = {*layer.parts, *layer.waiting, *layer.before}
    for generation in children(spark, layer.root):
        if generation not in kept:
            used = [p for p in kept if p.startswith(f"{generation}/")]
            if not used:
                delete_path(spark, f"{layer.root}/{generation}")
            else:
                for part in children(spark, f"{layer.root}/{generation}"):
                    if part.startswith(_BUCKET) and f"{generation}/{part}" not in kept:
                        delete_path(spark, f"{layer.root}/{generation}/{part}")


def _writer(df: DataFrame, fmt: str) -> DataFrameWriter:
    """Layers and the one before them lie on disk for long: where the format lets choose, they are packed closer than by default."""
    writer = df.write.format(fmt)
    return writer.option("compression", "zstd") if fmt == "parquet" else writer


def _write(df: DataFrame, name: str, layer: Layer, allow_empty: bool) -> tuple[int, tuple[str, ...]]:
    """Write the generation of ``layer`` and return its rows and parts; whatever fails leaves no trace of it."""
    spark, folder = df.sparkSession, f"{layer.root}/{layer.generation}"
    out, seen = with_metrics(df, name)
    try:
        if layer.key:
            # By bucket, in tasks of the advised size: small buckets share a task, one that is larger is several files.
            placed = out.withColumn(_BUCKET, _bucket(layer.key, layer.buckets)).hint("rebalance", F.col(_BUCKET)).sortWithinPartitions(_BUCKET, layer.key)
            _writer(placed, layer.fmt).partitionBy(_BUCKET).save(folder)
        else:
            _writer(out, layer.fmt).save(folder)
        rows = _rows(seen)
        if not rows and not allow_empty:
            raise ValueError(f"{name}: no rows")
        parts = tuple(f"{layer.generation}/{c}" for c in children(spark, folder) if c.startswith(f"{_BUCKET}=")) if layer.key else (layer.generation,)
        if layer.key and not parts:
            # A file without rows, so that the layer keeps its schema.
            df.sparkSession.createDataFrame([], df.schema).write.format(layer.fmt).save(f"{folder}/{_BUCKET}=none")
            parts = (f"{layer.generation}/{_BUCKET}=none",)
        return rows, parts
    except BaseException:
        delete_path(spark, folder)
        raise


def write_layer(
    df: DataFrame,
    name: str,
    layer: str | None = None,
    fmt: str = DEFAULT_FORMAT,
    key: str | None = None,
    buckets: int = DEFAULT_BUCKETS,
    path: str | None = None,
    allow_empty: bool = False,
) -> int:
    """Replace the layer, schema included, and return the number of rows written; zero rows are an error.

    Rows are counted while they are written, so nothing is computed twice. On
    any failure, too few rows among them, the old layer stays. ``key`` lays the
    rows out in ``buckets`` by the hash of that column, for ``upsert_layer``; a
    bucket may be of any size, as several tasks write a large one. ``layer`` adds a load
    time. There may be one writer of a layer at a time. The generation before is
    kept for readers that are still at it; older ones are deleted.
    """
    spark, old = df.sparkSession, layer_of(df.sparkSession, name)
    out = with_audit(df, layer) if layer else df
    root = path or (old.root if old else _root(spark, name))
    new = Layer(root.rstrip("/"), fmt, json.dumps(_nullable(out.schema.jsonValue())), f"g{uuid.uuid4().hex}", (), key=key, buckets=buckets if key else 0)
    rows, parts = _write(out, name, new, allow_empty)
    new = replace(new, parts=parts, latest=parts, rows=rows, before=(*old.parts, *old.waiting) if old and old.root == new.root else ())
    _publish(spark, name, new)
    _expire(spark, new)
    return rows


def upsert_layer(updates: DataFrame, name: str, removed: DataFrame | None = None, layer: str | None = None, batch: int | None = None) -> dict[str, int]:
    """Rows of ``updates`` replace all rows with their keys; keys of ``removed`` lose theirs. Returns the number of updates, of rows written and of buckets rewritten.

    Only the buckets in which a key of either lies are read and written again;
    all others stay the files they are. ``updates`` is written first, as it is
    used twice. Columns are taken by name; a layer keeps its schema. ``batch``
    numbers the micro-batches of a stream: one that was written before, or
    earlier ones, change nothing.
    """
    spark, now = updates.sparkSession, layer_of(updates.sparkSession, name)
    if now is None or not now.key:
        raise ValueError(f"{name} is no layer with a key")
    if batch is not None and batch <= now.batch:
        return {"updates": 0, "rows": 0, "buckets": 0}
    before = now.parts
    if now.waiting:
        now = _settle(spark, name, now)
        before = (*now.parts, *now.before)
    key, schema = now.key, _schema(now)
    stage = f"{now.root}/stage-{uuid.uuid4().hex}"
    try:
        fresh = (with_audit(updates, layer) if layer else updates).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        fresh, seen = with_metrics(fresh, f"{name} updates")
        _writer(fresh, "parquet").save(f"{stage}/rows")
        count = _rows(seen)
        fresh = spark.read.schema(schema).parquet(f"{stage}/rows")
        keys = fresh.select(F.col(f"`{key}`").alias(_KEY))
        if removed is not None:
            keys = keys.unionAll(removed.select(F.col(f"`{key}`").cast(schema[key].dataType).alias(_KEY)))
        keys.distinct().write.parquet(f"{stage}/keys")
        keys = spark.read.parquet(f"{stage}/keys")
        touched = {r["b"] for r in keys.select(_bucket(_KEY, now.buckets).alias("b")).distinct().collect()}
        if not touched:
            return {"updates": 0, "rows": 0, "buckets": 0}
        old = [p for p in now.parts if _number(p) in touched]
        kept = spark.read.schema(schema).format(now.fmt).load(now.paths(old)) if old else spark.createDataFrame([], schema)
        kept = kept.join(keys, F.col(f"`{key}`").eqNullSafe(F.col(_KEY)), "left_anti")
        new = replace(now, generation=f"g{uuid.uuid4().hex}", before=before, batch=now.batch if batch is None else batch, rows=now.rows + count, latest=())
        rows, parts = _write(kept.unionByName(fresh), name, new, allow_empty=True)
        untouched = tuple(p for p in now.parts if _number(p) not in touched and _number(p) is not None)
        if untouched:
            parts = tuple(p for p in parts if _number(p) is not None)
        new = replace(new, parts=untouched + parts)
        if layer_of(spark, name).generation != now.generation:
            delete_path(spark, f"{now.root}/{new.generation}")
            raise RuntimeError(f"{name} was replaced meanwhile")
        _publish(spark, name, new)
    finally:
        delete_path(spark, stage)
    _expire(spark, new)
    return {"updates": count, "rows": rows, "buckets": len(touched)}


def _replaced_meanwhile(spark: SparkSession, name: str, now: Layer) -> None:
    if layer_of(spark, name).generation != now.generation:
        raise RuntimeError(f"{name} was replaced meanwhile")


def merge_layer(updates: DataFrame, name: str, removed: DataFrame | None = None, layer: str | None = None, batch: int | None = None) -> dict[str, int]:
    """As ``upsert_layer``, but nothing that lies in the layer is read or written again. Returns the number of updates and of keys changed.

    The rows and the keys they replace are put beside the buckets, and a read
    leaves out the rows that a later change replaced. Changes are written into
    the buckets once there are WAITING_CHANGES of them with as many rows as the
    buckets hold: so however many changes come, what is written for them grows
    with their rows.
    """
    spark, now = updates.sparkSession, layer_of(updates.sparkSession, name)
    if now is None or not now.key:
        raise ValueError(f"{name} is no layer with a key")
    if batch is not None and batch <= now.batch:
        return {"updates": 0, "keys": 0}
    key, schema, number = now.key, _schema(now), now.changes + 1
    folder = f"c{number}-{uuid.uuid4().hex}"
    path = f"{now.root}/{folder}"
    try:
        fresh = (with_audit(updates, layer) if layer else updates).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        fresh, seen = with_metrics(fresh.withColumn(_CHANGE, F.lit(number).cast("long")), f"{name} updates")
        _writer(fresh, now.fmt).save(f"{path}/rows")
        count = _rows(seen)
        keys = spark.read.schema(schema).format(now.fmt).load(f"{path}/rows").select(F.col(f"`{key}`").alias(_KEY))
        if removed is not None:
            keys = keys.unionAll(removed.select(F.col(f"`{key}`").cast(schema[key].dataType).alias(_KEY)))
        keys, seen = with_metrics(keys.distinct().withColumn(_CHANGE, F.lit(number).cast("long")), f"{name} keys")
        keys.write.parquet(f"{path}/keys")
        changed = _rows(seen)
        if not changed:
            delete_path(spark, path)
            return {"updates": 0, "keys": 0}
        new = replace(
            now, generation=f"g{uuid.uuid4().hex}", before=(*now.parts, *now.waiting), batch=now.batch if batch is None else batch,
            waiting=(*now.waiting, folder), waiting_rows=now.waiting_rows + count, changes=number, latest=(f"{folder}/rows",),
        )
        _replaced_meanwhile(spark, name, now)
        _publish(spark, name, new)
    except BaseException:
        held = layer_of(spark, name)
        if held is None or folder not in held.waiting:
            delete_path(spark, path)
        raise
    _expire(spark, new)
    if len(new.waiting) >= WAITING_CHANGES and new.waiting_rows >= new.rows:
        _settle(spark, name, new)
    return {"updates": count, "keys": changed}


def _settle(spark: SparkSession, name: str, now: Layer) -> Layer:
    """Write the changes that wait into the buckets; the rows of the layer stay the same."""
    new = replace(now, generation=f"g{uuid.uuid4().hex}", before=(*now.parts, *now.waiting), waiting=(), waiting_rows=0, latest=())
    rows, parts = _write(read_layer(spark, name), name, new, allow_empty=True)
    new = replace(new, parts=parts, rows=rows)
    try:
        _replaced_meanwhile(spark, name, now)
    except RuntimeError:
        delete_path(spark, f"{now.root}/{new.generation}")
        raise
    _publish(spark, name, new)
    _expire(spark, new)
    return new


def _number(part: str) -> int | None:
    """The bucket of a part; None for the part of a layer without rows."""
    told = part.rpartition("=")[2]
    return int(told) if told.isdigit() else None


def read_layer(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def read_latest(spark: SparkSession, name: str, generation: str) -> DataFrame | None:
    """The rows of the write that made ``generation``, without a join; None where the layer has another generation or they lie among older ones."""
    now = layer_of(spark, name)
    if now is None or now.generation != generation or not now.latest:
        return None
    return spark.read.schema(_schema(now)).format(now.fmt).load(now.paths(now.latest))


def drop_layer(spark: SparkSession, name: str) -> None:
    """The layer and all its files."""
    now = layer_of(spark, name)
    if now:
        spark.sql(f"DROP VIEW {_quoted(name)}")
        delete_path(spark, now.root)


def require_rows(df: DataFrame, stage: str) -> DataFrame:
    """Fail when the frame is empty; looks for one row only."""
    if df.isEmpty():
        raise ValueError(f"{stage}: no rows")
    return df
