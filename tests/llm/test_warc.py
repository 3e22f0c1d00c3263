"""Archives: exact round trip, whatever the ranges."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import random

import pytest

from corpusmill.llm import warc


def pages():
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}.example/p {i}\r\nX: y" if i % 9 == 0 else f"http://h{i % 3}.example/é/{i}", "".join(rng.choice("ab<>é\r\n") for _ in range(rng.choice([0, 50, 500, 5000])))) for i in range(120)]
    same = "<p>" + "same " * 40
    rows += [(200 + i, None, same) for i in range(30)] + [(5, "u", same), (300, "u", None), (301, "u", ""), (302, "u", "s" * 99), (303, "u", "s" * 99), (304, "u", "é" * 50), (305, "u", "é" * 50), (5, "u", same), (None, "n", same)]
    # a payload that holds what looks like archives, stored and compressed
    fake = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n").decode("latin-1")
    rows += [(500, "http://long.example/" + "".join(rng.choice("abcdefghij") for _ in range(70_000)), "<p>"), (501, "data:" + "x" * 5_000_000, None)]
    return rows + [(400, "u", fake * 50), (401, "u", "WARC/1.0\r\n" * 500), (402, "u", os.urandom(60_000).hex())]


@pytest.mark.parametrize("split", [4 << 20, 1000, 37])
def test_round_trip(spark, tmp_path, split):
    rows = pages()
    frame = spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in rows], "page_id long, url string, html string, refers_to int, digest string").repartition(3)
    files = warc.write_archives(frame, f"file://{tmp_path}/archives")
    got = warc.read_archives(spark, files, split, with_payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        later = i is not None and len(data) >= 100 and first[h] != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", first[h] if later else None, None if later else data))
    mine = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(map(repr, mine)) == sorted(map(repr, want))


def test_a_foreign_reader_reads_the_members(spark, tmp_path):
    frame = spark.createDataFrame([(1, "http://a.example/", "<p>x" * 50), (2, "http://b.example/", "<p>x" * 50)], "page_id long, url string, html string")
    for row in warc.write_archives(frame, f"file://{tmp_path}/a").collect():
        with open(row["path"].removeprefix("file://"), "rb") as f:
            data = f.read()
        assert len(data) == row["bytes"]
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == row["records"]


def test_damaged_bytes_between_records_are_passed_over():
    good = [warc.encode_record(i, "u", b"x" * 300, None, "d") for i in range(4)]
    data = b"junk\x1f\x8b\x08junk" + good[0] + good[1] + b"\x1f\x8b\x08" + good[2][:40] + good[3]
    for cut in range(0, len(data), 61):
        found = [f for lo, hi in ((0, cut), (cut, len(data))) for f in warc.scan_range(io.BytesIO(data), len(data), lo, hi)]
        assert [f[1]["warc-record-id"] for f in found] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>"]


def test_an_empty_table_and_the_shared_folder(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.round_trip(spark.createDataFrame([(7, "u", None)], "page_id long, url string, html string")).first()["page_id"] == 7


def test_ranges_are_dealt_to_as_many_tasks_as_the_bytes_give(spark, tmp_path):
    rng = random.Random(4)
    frame = spark.createDataFrame([(i, "u", "".join(rng.choice("abcdefgh") for _ in range(4000))) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(frame, f"file://{tmp_path}/big")
    size = files.agg({"bytes": "sum"}).first()[0]
    tasks = {split: warc.read_archives(spark, files, split).rdd.getNumPartitions() for split in (20_000, 80_000, 1 << 30)}
    assert tasks == {split: -(-size // split) for split in tasks}
    places = warc.read_archives(spark, files, 20_000).selectExpr("spark_partition_id() AS t").distinct().count()
    assert places > 10


def test_a_lost_record_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", "<p>") for i in range(9)], "page_id long, url string, html string")
    files = warc.write_archives(frame, f"file://{tmp_path}/lost")
    with pytest.raises(RuntimeError, match="9 records were written, 8 were read"):
        warc.checked(warc.read_archives(spark, files).where("page_id <> 4"), files)
