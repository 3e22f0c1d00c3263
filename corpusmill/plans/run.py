"""The gated run over all layers, with a ledger from which a stopped run goes on."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.chunk import chunk_pages
from corpusmill.operators.embed import DEFAULT_DIMS, embed
from corpusmill.operators.extract import extract_landed
from corpusmill.operators.index import INDEX_FIELDS, SEARCHABLE, dedupe, index_eligible, to_index_rows
from corpusmill.operators.keyword import build_postings, inverted, term_statistics
from corpusmill.operators.manifest import changes_detected, normalize_manifest, successful
from corpusmill.session import release_shuffles
from corpusmill.sources.files import read_raw_files
from corpusmill.sources.index_sink import BatchWriter, publish
from corpusmill.sources.layers import DEFAULT_BUCKETS, layer_of, merge_layer, read_latest, read_layer, upsert_layer, write_layer

KEY = "document_id"
LEDGER = "run_ledger"


@dataclass(frozen=True)
class RunConfig:
    """Where runs read and write.

    ``buckets`` of every layer, by document: a later run puts its rows beside
    them, see ``merge_layer``. ``publish_to`` is the folder for the records of what was
    sent to an index service.
    """

    raw_root: str
    database: str = "default"
    dims: int = DEFAULT_DIMS
    buckets: int = DEFAULT_BUCKETS
    fmt: str = "parquet"
    publish_to: str | None = None

    def table(self, name: str) -> str:
        return f"{self.database}.{name}"


class _Run:
    """One run: what its stages read and how they write."""

    def __init__(self, spark: SparkSession, cfg: RunConfig, run_id: str, manifest: DataFrame, files: DataFrame | None) -> None:
        self.spark, self.cfg, self.run_id, self.files = spark, cfg, run_id, files
        self.documents = normalize_manifest(manifest.where("changed"))
        self.ids = manifest.where("changed").select(KEY).distinct()
        #: the generation that this run has written of each layer
        self.wrote = _generations(spark, cfg, run_id)

    def read(self, name: str) -> DataFrame:
        return read_layer(self.spark, self.cfg.table(name))

    def changed(self, name: str) -> DataFrame:
        """The rows of a layer that belong to changed documents: what this run has written of it, where that lies in files of its own."""
        own = read_latest(self.spark, self.cfg.table(name), self.wrote[name]) if self.wrote.get(name) else None
        return self.read(name).join(self.ids, KEY, "left_semi") if own is None else own.where(F.col(KEY).isNotNull())

    def put(self, rows: DataFrame, name: str, layer: str | None = None, may_be_empty: bool = False) -> int:
        """Replaces the changed documents' rows; the first run makes the layer, which then must have rows."""
        table = self.cfg.table(name)
        if layer_of(self.spark, table) is None:
            count = write_layer(rows, table, layer, self.cfg.fmt, KEY, self.cfg.buckets, allow_empty=may_be_empty)
        else:
            count = merge_layer(rows, table, removed=self.ids, layer=layer)["updates"]
        self.wrote[name] = layer_of(self.spark, table).generation
        return count

    def landed(self) -> tuple[DataFrame, DataFrame]:
        """Pages and quarantine."""
        files = self.files if self.files is not None else read_raw_files(self.spark, self.cfg.raw_root)
        return extract_landed(successful(self.documents), files, self.cfg.raw_root)

    def index_rows(self) -> DataFrame:
        """Index rows of the changed documents, with the document they come from."""
        gold = self.changed("gold_embeddings")
        rows = dedupe(index_eligible(to_index_rows(gold)), "chunk_id", [F.col("file_name"), F.col("chunk_text")])
        return rows.join(gold.select("chunk_id", KEY).distinct(), "chunk_id")

    def postings(self) -> DataFrame:
        return build_postings(self.changed("index_chunks"), text_cols=SEARCHABLE, keep=(KEY,))

    def whole(self, rows: DataFrame, name: str) -> int:
        return write_layer(rows, self.cfg.table(name), fmt=self.cfg.fmt, allow_empty=True)

    def sent(self, make_writer: Callable[[], BatchWriter]) -> int:
        folder = f"{self.cfg.publish_to}/{self.run_id}-{uuid.uuid4().hex}" if self.cfg.publish_to else None
        record = publish(self.changed("index_chunks").select(*INDEX_FIELDS), make_writer, folder)
        return record.agg(F.coalesce(F.sum("n_ok"), F.lit(0)).alias("n")).first()["n"]

    def stages(self, make_writer: Callable[[], BatchWriter] | None) -> list[tuple[str, Callable[[], int]]]:
        out = [
            ("bronze_documents", lambda: self.put(self.documents, "bronze_documents", "bronze")),
            ("bronze_quarantine", lambda: self.put(self.landed()[1], "bronze_quarantine", "bronze", may_be_empty=True)),
            ("bronze_pages", lambda: self.put(self.landed()[0], "bronze_pages", "bronze")),
            ("silver_chunks", lambda: self.put(chunk_pages(self.changed("bronze_pages")), "silver_chunks", "silver")),
            ("gold_embeddings", lambda: self.put(embed(self.changed("silver_chunks"), dims=self.cfg.dims), "gold_embeddings")),
            ("index_chunks", lambda: self.put(self.index_rows(), "index_chunks")),
            ("index_terms", lambda: self.put(self.postings(), "index_terms")),
            # Word blocks hold chunks of many documents, so they are made anew from the terms of all chunks.
            ("index_postings", lambda: self.whole(inverted(self.read("index_terms")), "index_postings")),
            ("index_stats", lambda: self.whole(term_statistics(self.read("index_postings")), "index_stats")),
        ]
        return [*out, ("published", lambda: self.sent(make_writer))] if make_writer else out


def run_state(spark: SparkSession, cfg: RunConfig, run_id: str) -> dict[str, int]:
    """The stages of a run that are done, in order, with their rows."""
    if layer_of(spark, cfg.table(LEDGER)) is None:
        return {}
    rows = read_layer(spark, cfg.table(LEDGER)).where(F.col("run_id") == run_id).orderBy("place").collect()
    return {r["stage"]: r["rows"] for r in rows}


def _generations(spark: SparkSession, cfg: RunConfig, run_id: str) -> dict[str, str | None]:
    """The generation that each done stage of a run has written."""
    if layer_of(spark, cfg.table(LEDGER)) is None:
        return {}
    return {r["stage"]: r["generation"] for r in read_layer(spark, cfg.table(LEDGER)).where(F.col("run_id") == run_id).collect()}


def _record(spark: SparkSession, cfg: RunConfig, run_id: str, stage: str, place: int, rows: int) -> None:
    layer = layer_of(spark, cfg.table(stage))
    entry = [(f"{run_id}:{stage}", run_id, stage, place, rows, layer.generation if layer else None)]
    row = spark.createDataFrame(entry, "entry string, run_id string, stage string, place int, rows long, generation string")
    if layer_of(spark, cfg.table(LEDGER)) is None:
        write_layer(row, cfg.table(LEDGER), "run", key="entry", buckets=4)
    else:
        upsert_layer(row, cfg.table(LEDGER), layer="run")


def run_corpus(
    spark: SparkSession,
    manifest: DataFrame,
    cfg: RunConfig,
    run_id: str | None = None,
    files: DataFrame | None = None,
    make_writer: Callable[[], BatchWriter] | None = None,
) -> dict[str, int]:
    """All layers brought up to date with a manifest that has ``changed``; nothing is done when nothing changed.

    Only changed documents are extracted, cut and embedded again; what lies in
    the layers of the others is neither read nor written for it. The ledger keeps for each run and
    stage the rows and the generation written: a run that was stopped goes on,
    with its ``run_id``, at the first stage that isn't in it. Every stage may
    run twice. Documents without usable content go to ``bronze_quarantine``
    with the reason. With ``make_writer`` the run ends in publishing the index
    rows of the changed documents. ``files`` (path, content) stand in for those below ``raw_root``.
    """
    if not changes_detected(manifest).first()["changes_detected"]:
        return {}
    run_id = run_id or uuid.uuid4().hex
    done = run_state(spark, cfg, run_id)
    for place, (stage, work) in enumerate(_Run(spark, cfg, run_id, manifest, files).stages(make_writer)):
        if stage not in done:
            done[stage] = work()
            _record(spark, cfg, run_id, stage, place, done[stage])
            release_shuffles(spark)
    return done
