"""Publishing index rows in small batches from the tasks."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusmill.session import scratch_path

BATCH_SIZE = 100

# Takes a batch of rows, returns one success flag per row.
BatchWriter = Callable[[pd.DataFrame], Sequence[bool]]


def batched(df: DataFrame, batch_size: int = BATCH_SIZE, shards: int = 64, key: str = "chunk_id") -> DataFrame:
    """Add shard and batch number. Both follow from the keys alone, so a retried task sends the same batches."""
    shard = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % shards
    w = Window.partitionBy("shard").orderBy(key)
    return df.withColumn("shard", shard.cast("int")).withColumn(
        "batch", (F.floor((F.row_number().over(w) - 1) / F.lit(batch_size)) + 1).cast("int")
    )


def publish_index(
    df: DataFrame, make_writer: Callable[[], BatchWriter], batch_size: int = BATCH_SIZE, shards: int = 64, key: str = "chunk_id"
) -> DataFrame:
    """Send the rows batch by batch and report (shard, batch, n_ok, n_failed).

    The writer is made once per task and must be idempotent by key: Spark may
    run a task again. Rows stream through the task; none pass the driver.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = make_writer()

        def send(shard: int, batch: int, rows: pd.DataFrame) -> dict:
            ok = [bool(x) for x in write(rows.drop(columns=["shard", "batch"]).reset_index(drop=True))]
            return {"shard": shard, "batch": batch, "n_ok": sum(ok), "n_failed": len(rows) - sum(ok)}

        open_rows = None
        for frame in frames:
            frame = frame if open_rows is None else pd.concat([open_rows, frame])
            groups = [(k, g) for k, g in frame.groupby(["shard", "batch"], sort=True)]
            # The last batch may go on in the next Arrow frame.
            open_rows = groups[-1][1] if groups else None
            if len(groups) > 1:
                yield pd.DataFrame([send(*k, g) for k, g in groups[:-1]])
        if open_rows is not None and len(open_rows):
            shard, batch = open_rows[["shard", "batch"]].iloc[0]
            yield pd.DataFrame([send(int(shard), int(batch), open_rows)])

    # The window left the rows hashed by shard and sorted by (shard, key).
    return batched(df, batch_size, shards, key).mapInPandas(run, "shard int, batch int, n_ok long, n_failed long")


def check_published(report: DataFrame) -> int:
    """Total of published rows; any failed row fails the job."""
    row = report.agg(F.coalesce(F.sum("n_ok"), F.lit(0)).alias("ok"), F.coalesce(F.sum("n_failed"), F.lit(0)).alias("bad")).first()
    if row["bad"]:
        raise RuntimeError(f"{row['bad']} rows failed to upload")
    return row["ok"]


# ---- publishing with a commit -----------------------------------------------------------------------------------------

# Rows of a shard, about: what one task sends.
SHARD_ROWS = 100_000


@dataclass
class Sent(WriterCommitMessage):
    """What the attempt of a task that counts has done: its file of batches, rows taken and rows refused."""

    file: str | None
    n_ok: int
    n_failed: int


class BatchWriterOfTask(DataSourceWriter):
    """Sends a task's rows in batches and records them in a file of its own; only the attempts that Spark commits count."""

    def __init__(self, make_writer: Callable[[], BatchWriter], folder: str, columns: list[str], allow_failed: bool) -> None:
        self.make_writer, self.folder, self.columns, self.allow_failed = make_writer, folder, columns, allow_failed

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri("file://" + self.folder.removeprefix("file:") if self.folder.startswith("file:/") and not self.folder.startswith("file://") else self.folder)

    def write(self, rows: Iterator[Row]) -> Sent:
        send, out, held, counts, file = self.make_writer(), None, [], [0, 0], f"pending/{uuid.uuid4().hex}.json"
        store, base = self._store()

        def close() -> None:
            nonlocal out
            frame = pd.DataFrame([[r[c] for c in self.columns] for r in held], columns=self.columns)
            ok = [bool(x) for x in send(frame)]
            if out is None:
                store.create_dir(f"{base}/pending", recursive=True)
                out = store.open_output_stream(f"{base}/{file}", compression=None)
            record = {"shard": held[0]["shard"], "batch": held[0]["batch"], "n_ok": sum(ok), "n_failed": len(ok) - sum(ok)}
            keys = [r[self.columns[0]] for r in held]
            record |= {"taken": [str(k) for k, good in zip(keys, ok, strict=True) if good], "refused": [str(k) for k, good in zip(keys, ok, strict=True) if not good]}
            out.write((json.dumps(record) + "\n").encode())
            counts[0] += record["n_ok"]
            counts[1] += record["n_failed"]
            held.clear()

        for row in rows:
            if held and (row["shard"], row["batch"]) != (held[0]["shard"], held[0]["batch"]):
                close()
            held.append(row)
        if held:
            close()
        if out:
            out.close()
        return Sent(file if out else None, *counts)

    def commit(self, messages: list[Sent | None]) -> None:
        done = [m for m in messages if m]
        failed = sum(m.n_failed for m in done)
        if failed and not self.allow_failed:
            raise RuntimeError(f"{failed} rows failed to upload")
        store, base = self._store()
        store.create_dir(f"{base}/batches", recursive=True)
        for m in done:
            if m.file:
                store.move(f"{base}/{m.file}", f"{base}/batches/{m.file.rpartition('/')[2]}")
        self._drop_pending()
        with store.open_output_stream(f"{base}/published.json", compression=None) as out:
            out.write(json.dumps({"n_ok": sum(m.n_ok for m in done), "n_failed": failed}).encode())

    def abort(self, messages: list[Sent | None]) -> None:
        self._drop_pending()

    def _drop_pending(self) -> None:
        store, base = self._store()
        if store.get_file_info(f"{base}/pending").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/pending")


def publish(df: DataFrame, make_writer: Callable[[], BatchWriter], folder: str | None = None, batch_size: int = BATCH_SIZE, key: str = "chunk_id", allow_failed: bool = False, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Send all rows and return the batches (shard, batch, n_ok, n_failed, taken, refused), read back from ``folder``.

    The writer is made once per task and must be idempotent by key, as Spark may
    run a task again; what it takes and refuses is recorded per attempt. Once
    all tasks are done the committed attempts become the record, in one step on
    the driver, which only sees counts and file names. A refused row fails the
    whole and leaves no record, unless ``allow_failed``. The number of shards
    follows from the rows; shard and batch follow from the keys.
    """
    spark, folder = df.sparkSession, folder or scratch_path(df.sparkSession, "published")
    columns = [key, *[c for c in df.columns if c != key]]
    rows = df.select(*columns)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    sent = batched(rows, batch_size, shards, key)

    class IndexBatches(DataSource):
        @classmethod
        def name(cls) -> str:
            return "index_batches"

        def writer(self, schema, overwrite):
            return BatchWriterOfTask(make_writer, folder, columns, allow_failed)

    spark.dataSource.register(IndexBatches)
    # The window left each shard whole in a partition, sorted by key.
    sent.write.format("index_batches").mode("append").save()
    schema = "shard int, batch int, n_ok long, n_failed long, taken array<string>, refused array<string>"
    return spark.read.schema(schema).json(f"{folder}/batches")
