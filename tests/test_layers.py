"""Manifest rules, layer tables, refresh, the gated run and the file stream."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmill.operators.extract import attach_content, extract_landed, split_quarantine
from corpusmill.operators.manifest import changes_detected, concat_records, detect_changes, infer_compliance_domain, normalize_manifest
from corpusmill.operators.keyword import KeywordIndex, search_keyword
from corpusmill.plans.run import RunConfig, _Run, run_corpus, run_state
from corpusmill.sources.evaluation import read_questions, write_evaluation
from corpusmill.sources.files import read_raw_files, with_fallback
from corpusmill.sources.layers import drop_layer, layer_of, merge_layer, read_latest, read_layer, require_rows, upsert_layer, with_metrics, write_layer
from corpusmill.sources.manifest import corpus_registry, read_manifest, write_manifest
from corpusmill.streaming.ingest import document_stream, stream_ingest, stream_replace


def test_manifest_array_and_missing_file(spark, tmp_path):
    path = tmp_path / "manifest.json"
    records = [
        {"document_id": "a", "title": "T", "file_size_bytes": 12, "ingestion_status": "downloaded", "surprise": 1},
        {"document_id": "b", "ingestion_status": "failed", "error": "gone"},
    ]
    path.write_text(json.dumps(records, indent=4))
    got = {r.document_id: r for r in read_manifest(spark, str(path)).collect()}
    assert (got["a"].title, got["a"].file_size_bytes, got["b"].error, got["b"].file_name) == ("T", 12, "gone", None)
    assert read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    write_manifest(read_manifest(spark, str(path)), str(tmp_path / "out"))
    assert read_manifest(spark, str(tmp_path / "out")).count() == 2


def test_records_of_any_form_are_all_read(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(id as string) document_id", "'downloaded' ingestion_status").repartition(4)
    write_manifest(rows, str(tmp_path / "lines"))
    assert read_manifest(spark, str(tmp_path / "lines")).count() == 1000
    (tmp_path / "lines" / "an array.json").write_text(json.dumps([{"document_id": f"x{i}"} for i in range(7)], indent=2))
    (tmp_path / "lines" / "one object.json").write_text(json.dumps({"document_id": "y"}, indent=2))
    (tmp_path / "lines" / "flat.json").write_text(json.dumps([{"document_id": "z1"}, {"document_id": "z2"}]))
    assert read_manifest(spark, str(tmp_path / "lines")).select("document_id").distinct().count() == 1010


def test_a_refused_write_leaves_the_old_rows(spark):
    assert write_layer(spark.range(10), "default.kept", "bronze") == 10
    with pytest.raises(ValueError):
        write_layer(spark.range(0), "default.kept", "bronze")
    kept = read_layer(spark, "default.kept")
    assert kept.count() == 10 and kept.where("bronze_loaded_at IS NULL").count() == 0


SHAPES = {
    "spread.json": '{"document_id": "s",\n "title": "T"}',
    "tabbed array.json": '\t\n\t[{"document_id": "a1"},\n{"document_id": "a2"}]',
    "one line array.json": '[{"document_id": "b1"}, {"document_id": "b2"}]',
    "lines.json": '{"document_id": "l1"}\n\n  {"document_id": "l2"}\n',
    "mark.json": '\ufeff  {"document_id": "m1"}\n{"document_id": "m2"}',
    "late.json": '{"document_id": "k1", "title": "["}\n{"document_id": "k2"}',
}
WANTED = {"spread.json": ["s"], "tabbed array.json": ["a1", "a2"], "one line array.json": ["b1", "b2"], "lines.json": ["l1", "l2"], "mark.json": ["m1", "m2"], "late.json": ["k1", "k2"]}


@pytest.mark.parametrize("names", [[n] for n in SHAPES] + [list(SHAPES)])
def test_json_of_every_shape_gives_equal_records(spark, tmp_path, names):
    for name in names:
        (tmp_path / name).write_text(SHAPES[name], encoding="utf-8")
    got = [r.document_id for r in read_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(i for n in names for i in WANTED[n])


def failing(name):
    return F.when(F.col(name) == 7, F.raise_error(F.lit("a task fails")).cast("long")).otherwise(F.col(name))


def files_below(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    name = "default.survives"
    assert write_layer(spark.range(10), name, path=str(tmp_path / "l")) == 10
    with pytest.raises(Exception, match="a task fails"):
        write_layer(spark.range(20).select(failing("id").alias("id")), name, path=str(tmp_path / "l"))
    assert sorted(r.id for r in read_layer(spark, name).collect()) == list(range(10))
    with pytest.raises(Exception, match="a task fails"):
        write_layer(spark.range(20).select(failing("id").alias("id")), "default.never_was")
    assert layer_of(spark, "default.never_was") is None


def test_a_frame_may_replace_the_layer_it_reads(spark):
    name = "default.self"
    write_layer(spark.range(10).withColumn("x", F.lit("old")), name)
    for n in (20, 40, 80):
        now = read_layer(spark, name)
        write_layer(now.unionByName(now.withColumn("id", F.col("id") + 1000)).withColumn("y", F.lit(n)).select("id", "x"), name)
        assert read_layer(spark, name).count() == n


def test_readers_keep_the_files_they_have_seen_and_older_ones_go(spark, tmp_path):
    name, root = "default.generations", tmp_path / "l"
    write_layer(spark.range(5), name, path=str(root))
    reader = read_layer(spark, name)
    write_layer(spark.range(7).withColumn("more", F.lit(1.5)), name, path=str(root))
    assert reader.count() == 5 and read_layer(spark, name).columns == ["id", "more"]
    write_layer(spark.range(9), name, path=str(root))
    assert len({f.split("/")[0] for f in files_below(root)}) == 2
    drop_layer(spark, name)
    assert not root.exists() and not spark.catalog.tableExists(name)


def test_other_tables_are_not_replaced(spark):
    spark.range(3).write.saveAsTable("default.foreign_table")
    with pytest.raises(ValueError, match="no layer"):
        write_layer(spark.range(1), "default.foreign_table")
    assert spark.table("default.foreign_table").count() == 3


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    name, root = "default.keyed", tmp_path / "l"
    rows = spark.range(1000).selectExpr("cast(id as string) k", "id v", "named_struct('a', array(id)) s")
    write_layer(rows, name, "gold", key="k", buckets=16, path=str(root))
    before = files_below(root)
    done = upsert_layer(rows.where("v IN (3, 500)").selectExpr("s", "k", "-1 v").unionByName(spark.sql("SELECT 'new' k, 7L v, named_struct('a', array(7L)) s")), name, spark.createDataFrame([("9",), ("absent",)], "k string"), "gold")
    assert done["buckets"] <= 5
    got = {r.k: r.v for r in read_layer(spark, name).collect()}
    assert got == {str(i): i for i in range(1000) if i != 9} | {"3": -1, "500": -1, "new": 7}
    kept = files_below(root) & before
    assert len({f for f in before if any(p in f for p in layer_of(spark, name).parts)}) >= 11 and len(files_below(root)) <= len(kept) + 5
    assert read_layer(spark, name).where("gold_loaded_at IS NULL").count() == 0
    assert upsert_layer(rows.limit(0).select("k", "v", "s"), name, layer="gold") == {"updates": 0, "rows": 0, "buckets": 0}
    upsert_layer(read_layer(spark, name).select("k", (F.col("v") + 1).alias("v"), "s"), name, layer="gold")
    assert {r.k: r.v for r in read_layer(spark, name).collect()} == {k: v + 1 for k, v in got.items()}


def test_a_failed_upsert_changes_nothing(spark):
    name = "default.keyed_too"
    write_layer(spark.range(50), name, key="id", buckets=4)
    with pytest.raises(Exception, match="a task fails"):
        upsert_layer(spark.range(5, 9).select(failing("id").alias("id")), name)
    assert read_layer(spark, name).count() == 50
    with pytest.raises(ValueError, match="no layer with a key"):
        write_layer(spark.range(5), "default.without_key")
        upsert_layer(spark.range(1), "default.without_key")


def test_a_keyed_layer_may_become_empty_and_hold_null_keys(spark):
    name = "default.keyed_empty"
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, v string")
    write_layer(rows, name, key="k", buckets=4)
    upsert_layer(spark.createDataFrame([(None, "d")], "k int, v string"), name)
    assert sorted((r.k or 0, r.v) for r in read_layer(spark, name).collect()) == [(0, "d"), (1, "a")]
    upsert_layer(rows.limit(0), name, rows.select("k"))
    assert read_layer(spark, name).count() == 0 and read_layer(spark, name).columns == ["k", "v"]
    upsert_layer(rows, name)
    assert read_layer(spark, name).count() == 3


def test_records_of_the_same_time_are_told_apart(spark):
    current = spark.createDataFrame([("a", "m", None)], "document_id string, cellar_last_modified string, error string")
    rows = [("a", "m", "downloaded", "1"), ("a", None, "failed", "1")]
    for order in (rows, rows[::-1]):
        previous = spark.createDataFrame(order, "document_id string, cellar_last_modified string, ingestion_status string, downloaded_at_utc string")
        assert detect_changes(current, previous).first().changed


def test_registry(spark):
    official = spark.createDataFrame([("32016R0679", "GDPR", "Data Protection")], "celex string, short_title string, category string")
    web = spark.createDataFrame([("w", "W", "html")], "document_id string, short_title string, file_format string")
    rows = {r.document_id: r for r in corpus_registry(official, web).collect()}
    assert rows["32016R0679"].file_name == "32016R0679_EN_GDPR.pdf" and rows["32016R0679"].source_url.endswith("CELEX:32016R0679")
    assert rows["w"].celex is None and rows["w"].file_format == "html"


def test_empty_string_counts_as_missing(spark):
    df = spark.createDataFrame(
        [("a", "", "T", "", "Payments", "", "S", "pdf", ""), ("b", "R", "T", "Own", None, "Auth", "", "odt", "fr")],
        "document_id string, regulation_title string, title string, regulation_category string, category string, issuing_authority string, source_system string, file_format string, language string",
    )
    a, b = normalize_manifest(df).orderBy("document_id").collect()
    assert (a.regulation_title, a.regulation_category, a.issuing_authority, a.compliance_domain, a.document_type, a.language) == ("T", "Payments", "S", "Payment services", "regulatory_document", "EN")
    assert (b.regulation_title, b.regulation_category, b.issuing_authority, b.compliance_domain, b.document_type, b.language) == ("R", "Own", "Auth", "Own", None, "fr")
    assert [r[0] for r in spark.createDataFrame([("",), (None,)], "c string").select(infer_compliance_domain(F.col("c"))).collect()] == [None, None]


def test_change_rules(spark):
    current = spark.createDataFrame(
        [("same", "m", None), ("new", "m", None), ("moved", "m2", None), ("nomark", None, None), ("wasfailed", "m", None), ("fails", "m", "HTTP 500")],
        "document_id string, cellar_last_modified string, error string",
    )
    previous = spark.createDataFrame(
        [("same", "m", "downloaded", "2"), ("same", "old", "downloaded", "1"), ("moved", "m", "downloaded", "1"), ("nomark", None, "downloaded", "1"), ("wasfailed", "m", "failed", "1"), ("fails", "m", "downloaded", "1")],
        "document_id string, cellar_last_modified string, ingestion_status string, downloaded_at_utc string",
    )
    rows = {r.document_id: r for r in detect_changes(current, previous).collect()}
    assert [d for d, r in rows.items() if not r.changed] == ["same"]
    assert rows["fails"].ingestion_status == "failed" and rows["fails"].cellar_last_modified is None and rows["same"].downloaded_at_utc > "2"
    assert changes_detected(detect_changes(current, previous)).first()[0]
    same = current.filter("document_id = 'same'")
    assert not changes_detected(detect_changes(same, previous)).first()[0]
    assert not changes_detected(detect_changes(current.filter("false"), previous)).first()[0]


def test_fallback_and_union(spark):
    a, b, none = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int"), spark.createDataFrame([], "x int")
    assert [sorted(r.x for r in with_fallback(p, s).collect()) for p, s in ((a, b), (none, b), (none, none))] == [[1], [2, 3], []]
    assert concat_records(a, spark.createDataFrame([("q",)], "y string")).columns == ["x", "y"]


def landing(tmp_path):
    for folder, name, content in (
        ("pdf", "d1.pdf", "page one\f\fpage three é".encode()), ("html", "d2.html", b"<html><body><article>web\xff text</article></body></html>"),
        ("xml", "d3.xml", b"<a><Cube time='2026-01-02'><Cube currency='USD' rate='1.5'/></Cube></a>"), ("xml", "d4.xml", b"<a><b></a>"), ("html", "d5.html", b"<nav>x</nav>"),
    ):
        (tmp_path / folder).mkdir(exist_ok=True, parents=True)
        (tmp_path / folder / name).write_bytes(content)
    return str(tmp_path)


def manifest_rows(spark, status="downloaded"):
    names = [("d1", "pdf", "d1.pdf"), ("d2", "html", "d2.html"), ("d3", "xml", "d3.xml"), ("d4", "xml", "d4.xml"), ("d5", "html", "d5.html"), ("d6", "pdf", "lost.pdf"), ("d7", "doc", "d7.doc"), ("d8", "pdf", None)]
    return spark.createDataFrame([(*n, status, "T " + n[0], True) for n in names], "document_id string, file_format string, file_name string, ingestion_status string, short_title string, changed boolean")


@pytest.mark.parametrize("small", [True, False])
def test_attach_content_isolates_failures(spark, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr("corpusmill.operators.extract.broadcast_if_bounded", lambda df: (df, False))
    root = landing(tmp_path)
    good, bad = split_quarantine(attach_content(manifest_rows(spark), read_raw_files(spark, root), root))
    assert sorted(r.document_id for r in good.collect()) == ["d1", "d2", "d3", "d4", "d5"]
    errors = {r.document_id: r.error for r in bad.collect()}
    assert errors == {"d6": f"File not found: {root}/pdf/lost.pdf", "d7": "Unsupported file format: doc", "d8": "Missing file_name"}


@pytest.mark.parametrize("small", [True, False])
def test_contents_are_extracted_where_they_are_read(spark, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr("corpusmill.operators.extract.broadcast_if_bounded", lambda df: (df, False))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        root = landing(tmp_path)
        pages, bad = extract_landed(manifest_rows(spark), read_raw_files(spark, root), root)
        got = {(r.document_id, r.page_number, r.section_number, r.short_title, r.file_format): r.text for r in pages.collect()}
        plan = pages._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert got == {
        ("d1", 1, None, "T d1", "pdf"): "page one", ("d1", 3, None, "T d1", "pdf"): "page three é", ("d2", None, 1, "T d2", "html"): "web text",
        ("d3", None, 1, "T d3", "xml"): "Date: 2026-01-02\nEuro foreign exchange reference rates:\nUSD: 1.5",
    }
    assert {r.document_id for r in bad.collect()} == {"d6", "d7", "d8"}
    if not small:
        # The join stands above the extraction: content never reaches a shuffle.
        assert "content" not in plan[: plan.index("Generate")]


@pytest.mark.parametrize("spelled, root", [("hdfs://nn:8020/raw", "hdfs://nn:8020/raw"), ("s3a://bucket/raw", "s3a://bucket/raw"), ("file:/raw", "/raw"), ("file:///raw", "/raw")])
def test_paths_of_any_store_meet_the_manifest(spark, spelled, root):
    files = spark.createDataFrame([(f"{spelled}/pdf/d1.pdf", b"text")], "path string, content binary")
    good, bad = split_quarantine(attach_content(manifest_rows(spark).where("document_id = 'd1'"), files, root))
    assert good.first().source_file == f"{root}/pdf/d1.pdf" and bad.count() == 0


def test_downloaded_records_say_where_their_file_lies(spark):
    current = spark.createDataFrame([("a", "pdf", "a.pdf", None), ("b", "pdf", "b.pdf", "gone")], "document_id string, file_format string, file_name string, error string")
    previous = spark.createDataFrame([], "document_id string, cellar_last_modified string, ingestion_status string, downloaded_at_utc string")
    got = {r.document_id: r.volume_path for r in detect_changes(current, previous, raw_root="/raw").collect()}
    assert got == {"a": "/raw/pdf/a.pdf", "b": None}


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_raw_files(spark, str(tmp_path / "none"))


def test_a_document_that_arrives_again_replaces_its_chunks(spark, tmp_path):
    name, src, schema = "default.streamed", str(tmp_path / "in"), "document_id string, text string, version int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run(progress="a"):
        arriving = document_stream(spark, src, spark.createDataFrame([], schema).schema, glob="*.parquet", files_per_trigger=1)
        stream_replace(arriving, name, str(tmp_path / progress), order="version", buckets=4).awaitTermination()
        return sorted((r.document_id, r.chunk_text) for r in read_layer(spark, name).collect())

    arrive([("a", "one " * 600, 1), ("b", "two", 1), ("c", " ", 1)])
    assert [d for d, _ in run()] == ["a"] * 3 + ["b"]
    arrive([("a", "short now", 2), ("d", "new", 1), ("d", "newer", 2)])
    assert run() == [("a", "short now"), ("b", "two"), ("d", "newer")]
    state = layer_of(spark, name)
    assert state.batch == 1 and run() == run() and layer_of(spark, name) == state
    # Without its progress the stream sends the first batches again; the layer has them already.
    assert run("b") == [("a", "short now"), ("b", "two"), ("d", "newer")] and layer_of(spark, name) == state
    arrive([("b", None, 2)])
    assert run() == [("a", "short now"), ("d", "newer")]


def test_batches_of_a_stream_leave_what_was_written_before(spark, tmp_path):
    name, src, root, schema = "default.beside", str(tmp_path / "in"), tmp_path / "l", "document_id string, text string, version int"
    for n in range(4):
        rows = [(f"d{n}-{i}", f"text {i}", 1) for i in range(20)] + [("again", f"round {n}", n)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        before = {f for f in files_below(root) if f.endswith(".parquet")} if n else set()
        arriving = document_stream(spark, src, spark.createDataFrame([], schema).schema, glob="*.parquet", files_per_trigger=1)
        stream_replace(arriving, name, str(tmp_path / "progress"), order="version", buckets=2, path=str(root)).awaitTermination()
        assert before <= set(files_below(root))
        got = {r.document_id: r.chunk_text for r in read_layer(spark, name).collect()}
        assert len(got) == 20 * (n + 1) + 1 == read_layer(spark, name).count() and got["again"] == f"round {n}"


@pytest.mark.parametrize("waiting", [2, 128])
def test_changes_merged_at_the_read_equal_rewritten_buckets(spark, tmp_path, monkeypatch, waiting):
    monkeypatch.setattr("corpusmill.sources.layers.WAITING_CHANGES", waiting)
    name, schema = f"default.merged_{waiting}", "id string, v int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    held = lambda: sorted((str(r.id), r.v) for r in read_layer(spark, name).collect())
    write_layer(frame([("a", 1), ("b", 2), ("b", 3), (None, 4)]), name, key="id", buckets=3, path=str(tmp_path / "m"))
    assert merge_layer(frame([("b", 5), ("c", 6), ("c", 7)]), name, batch=0) == {"updates": 3, "keys": 2}
    assert held() == [("None", 4), ("a", 1), ("b", 5), ("c", 6), ("c", 7)]
    assert merge_layer(frame([("x", 0)]), name, batch=0) == {"updates": 0, "keys": 0}
    assert merge_layer(frame([(None, 8)]), name, removed=frame([("c", 0), ("none", 0)])) == {"updates": 1, "keys": 3}
    assert held() == [("None", 8), ("a", 1), ("b", 5)]
    merge_layer(frame([("c", 9), ("d", 1), ("e", 1)]), name)
    assert len(layer_of(spark, name).waiting) == {2: 1, 128: 3}[waiting]
    reader = read_layer(spark, name)
    upsert_layer(frame([("a", 10)]), name, removed=frame([("b", 0)]))
    assert held() == [("None", 8), ("a", 10), ("c", 9), ("d", 1), ("e", 1)] and not layer_of(spark, name).waiting and layer_of(spark, name).batch == 0
    assert reader.count() == 6
    merge_layer(frame([]), name, removed=frame([("a", 0)]))
    assert held() == [("None", 8), ("c", 9), ("d", 1), ("e", 1)]
    write_layer(frame([("z", 1)]), name, key="id")
    assert held() == [("z", 1)]
    drop_layer(spark, name)


class Down(RuntimeError):
    pass


def test_a_stopped_run_goes_on_at_its_stage(spark, tmp_path, monkeypatch):
    spark.sql("CREATE DATABASE IF NOT EXISTS resumed")
    cfg = RunConfig(raw_root=landing(tmp_path / "raw"), database="resumed", dims=16, buckets=4, publish_to=str(tmp_path / "sent"))
    manifest, taking = manifest_rows(spark), lambda: lambda rows: [True] * len(rows)

    def broken(*args, **named):
        raise Down("no vectors today")

    with monkeypatch.context() as patch:
        patch.setattr("corpusmill.plans.run.embed", broken)
        with pytest.raises(Down):
            run_corpus(spark, manifest, cfg, "r1", make_writer=taking)
    assert run_state(spark, cfg, "r1") == {"bronze_documents": 8, "bronze_quarantine": 3, "bronze_pages": 4, "silver_chunks": 4}
    before = {n: layer_of(spark, cfg.table(n)) for n in ("bronze_documents", "bronze_pages", "silver_chunks")}
    done = run_corpus(spark, manifest, cfg, "r1", make_writer=taking)
    assert {n: layer_of(spark, cfg.table(n)) for n in before} == before
    assert list(done) == list(run_state(spark, cfg, "r1")) and done["published"] == 4 and done["gold_embeddings"] == 4
    assert run_corpus(spark, manifest, cfg, "r1", make_writer=taking) == done
    # A second run changes one document and does no other again.
    (tmp_path / "raw" / "pdf" / "d1.pdf").write_bytes(b"page one, second version")
    changed = manifest.withColumn("changed", F.col("document_id") == "d1")
    again = run_corpus(spark, changed, cfg, "r2", make_writer=taking)
    assert again["bronze_pages"] == 1 == again["gold_embeddings"] == again["published"]
    texts = {r.document_id: r.chunk_text for r in read_layer(spark, cfg.table("index_chunks")).collect()}
    assert texts["d1"] == "page one, second version" and set(texts) == {"d1", "d2", "d3"}
    index = KeywordIndex(read_layer(spark, cfg.table("index_postings")), read_layer(spark, cfg.table("index_stats")))
    asked = spark.createDataFrame([(1, "second three")], "question_id int, question string")
    assert search_keyword(asked, index, 5).count() == 1


def test_gated_run(spark, tmp_path):
    cfg = RunConfig(raw_root=landing(tmp_path), database="default", dims=16, buckets=4)
    assert run_corpus(spark, manifest_rows(spark).withColumn("changed", F.lit(False)), cfg) == {}
    done = run_corpus(spark, manifest_rows(spark), cfg)
    assert done["bronze_quarantine"] == 3 and {r.document_id for r in read_layer(spark, "default.bronze_quarantine").collect()} == {"d6", "d7", "d8"}
    assert done["bronze_documents"] == 8 and done["bronze_pages"] == 4 == done["index_chunks"] and done["index_postings"] >= done["index_stats"] > 10
    pages = {(r.document_id, r.page_number, r.section_number): r.text for r in read_layer(spark, "default.bronze_pages").collect()}
    assert pages == {
        ("d1", 1, None): "page one", ("d1", 3, None): "page three é", ("d2", None, 1): "web text",
        ("d3", None, 1): "Date: 2026-01-02\nEuro foreign exchange reference rates:\nUSD: 1.5",
    }
    gold = read_layer(spark, "default.gold_embeddings")
    assert {"bronze_loaded_at", "silver_loaded_at", "embedding", "chunk_id"} <= set(gold.columns) and "text" not in gold.columns
    again = run_corpus(spark, manifest_rows(spark), cfg)
    assert again == done


def test_empty_stage_is_an_error(spark):
    with pytest.raises(ValueError):
        write_layer(spark.range(0), "default.never")
    with pytest.raises(ValueError):
        require_rows(spark.range(0), "stage")
    df, seen = with_metrics(spark.range(7), "seven")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 7


def test_stream_takes_every_file_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    docs = spark.createDataFrame([("a", "one  two"), ("b", " ")], "document_id string, text string")
    docs.write.parquet(src)

    def run():
        stream_ingest(document_stream(spark, src, docs.schema, glob="*.parquet", files_per_trigger=1), out, ckpt).awaitTermination()
        return sorted((r.document_id, r.chunk_text) for r in spark.read.parquet(out).collect())

    assert run() == [("a", "one two")]
    assert run() == [("a", "one two")]
    spark.createDataFrame([("c", "three")], "document_id string, text string").write.mode("append").parquet(src)
    assert run() == [("a", "one two"), ("c", "three")]


def test_questions_and_saved_runs(spark, tmp_path):
    path = tmp_path / "questions.json"
    path.write_text(json.dumps([{"id": "q1", "question": "?", "expected_regulation": "GDPR", "expected_keywords": ["a", "b"]}]))
    assert read_questions(spark, str(path)).first().expected_keywords == ["a", "b"]
    write_evaluation(spark.range(3), spark.range(1).withColumnRenamed("id", "total"), str(tmp_path / "run"), 5)
    assert spark.read.json(str(tmp_path / "run" / "results")).count() == 3
    assert spark.read.json(str(tmp_path / "run" / "summary")).first().top_k == 5


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    # One task per bucket, before, held as much as the bucket had, however large.
    name, path = "wide_bucket", tmp_path / "wide"
    rows = spark.range(0, 40_000, numPartitions=8).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    size, least = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    try:
        spark.conf.set(size, "256k")
        spark.conf.set(least, "64k")
        assert write_layer(rows, name, key="k", buckets=1, path=str(path)) == 40_000
        assert len(files_below(path)) > 4
        upsert_layer(rows.where("k = '7'").withColumn("v", F.lit("new")), name, removed=rows.where("k = '8'"))
    finally:
        spark.conf.unset(size)
        spark.conf.unset(least)
    kept = read_layer(spark, name)
    assert (kept.count(), kept.select("k").distinct().count()) == (39_999, 39_999)
    assert [r.v for r in kept.where("k = '7'").collect()] == ["new"] and kept.where("k = '8'").isEmpty()


def test_a_later_run_leaves_what_was_written_before(spark, tmp_path):
    """What lies in the layers is neither written again nor joined to find the rows of the changed documents, and files are packed closely."""
    spark.sql(f"CREATE DATABASE lean LOCATION '{tmp_path}/lean'")
    cfg = RunConfig(raw_root=landing(tmp_path / "raw"), database="lean", dims=16, buckets=2)
    run_corpus(spark, manifest_rows(spark), cfg, "r1")
    layers = ("bronze_pages", "silver_chunks", "gold_embeddings", "index_chunks", "index_terms")
    first = {n: layer_of(spark, cfg.table(n)) for n in layers}
    (tmp_path / "raw" / "pdf" / "d1.pdf").write_bytes(b"page one, second version")
    run = _Run(spark, cfg, "r2", manifest_rows(spark).withColumn("changed", F.col("document_id") == "d1"), None)
    for stage, work in run.stages(None):
        work()
        if stage in layers:
            now = layer_of(spark, cfg.table(stage))
            assert now.parts == first[stage].parts and len(now.waiting) == 1
            changed = run.changed(stage)
            assert "Join" not in changed._jdf.queryExecution().optimizedPlan().toString()
            assert sorted(changed.drop("embedding").toPandas().astype(str).values.tolist()) == sorted(
                read_layer(spark, cfg.table(stage)).where("document_id = 'd1'").drop("embedding").toPandas().astype(str).values.tolist()
            )
    assert {r.chunk_text for r in read_layer(spark, "lean.index_chunks").where("document_id = 'd1'").collect()} == {"page one, second version"}
    held = [f for f in Path(f"{tmp_path}/lean").rglob("*.parquet") if "run_ledger" not in str(f) and "/keys/" not in str(f)]
    assert held and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in held if pq.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}


def test_rows_of_another_write_are_not_taken_for_those_of_a_run(spark, tmp_path):
    name, frame = "default.latest", lambda rows: spark.createDataFrame(rows, "id string, v int")
    write_layer(frame([("a", 1), ("b", 2)]), name, key="id", buckets=2, path=str(tmp_path / "m"))
    first = layer_of(spark, name).generation
    assert read_latest(spark, name, first).count() == 2
    merge_layer(frame([("b", 3)]), name)
    assert read_latest(spark, name, first) is None
    assert [tuple(r) for r in read_latest(spark, name, layer_of(spark, name).generation).collect()] == [("b", 3)]
    upsert_layer(frame([("c", 4)]), name)
    assert read_latest(spark, name, layer_of(spark, name).generation) is None and read_latest(spark, "default.no_layer", first) is None
    drop_layer(spark, name)
