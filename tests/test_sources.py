"""Manifest and report readers, streams of events, stream filters."""

import base64
import json
import zlib

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.operators import reading
from pagemill.sources import manifests
from pagemill.streaming import progress

from .conftest import SF


def test_manifests(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("path\tpage\n# note\n\na\\b.pdf\t2\na/b.pdf\t2\nc.pdf\t1\n")
    assert sorted((r.path, r.page_no) for r in manifests.read_pages(spark, str(tmp_path / "p.tsv")).collect()) == [("a/b.pdf", 2), ("c.pdf", 1)]
    (tmp_path / "w.tsv").write_text("a.pdf\tone\na.pdf\ttwo\n")
    assert manifests.read_passwords(spark, str(tmp_path / "w.tsv")).first().password == "two"
    (tmp_path / "e.tsv").write_text("a.pdf\t1\tPASS\na.pdf\t1\tDIFF\tboom\n")
    row = manifests.read_expectations(spark, str(tmp_path / "e.tsv")).first()
    assert (row.status, row.error_contains, row.note) == ("DIFF", "boom", "")


def test_contracts(spark, tmp_path):
    page = {"ExpectedRawStatus": "PASS"}
    (tmp_path / "a.json").write_text(json.dumps({"Path": "a.pdf", "Pages": {"1-2": page, "3": page, "x": page}}))
    (tmp_path / "b.json").write_text(json.dumps({"Path": "a.pdf", "Pages": {"3": page}}))
    (tmp_path / "_c.json").write_text(json.dumps({"Path": "c.pdf", "Pages": {"1": page}}))
    found = manifests.read_contracts(spark, str(tmp_path))
    assert sorted((r.path, r.page_no or 0) for r in found.collect()) == [("a.pdf", 0), ("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("a.pdf", 3)]
    assert [r.page_no for r in manifests.duplicate_contracts(found).collect()] == [3]


def test_scan_report_and_ocr(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"path": "a", "n": 1}, {"path": "b"}]}))
    found = manifests.read_scan_report(spark, str(tmp_path / "r.json"), StructType().add("path", "string").add("n", "integer"))
    assert sorted((r.path, r.n or 0) for r in found.collect()) == [("a", 1), ("b", 0)]
    word = "\t".join(["5", "1", "1", "1", "1", "1", "300", "600", "150", "30", "90", "Hi"])
    (tmp_path / "o.tsv").write_text("level\n4\t1\n" + word + "\n" + word.replace("Hi", " ") + "\n")
    row = manifests.read_ocr_words(spark, str(tmp_path / "o.tsv")).collect()
    assert len(row) == 1 and tuple(row[0].box) == (72.0, 792.0 - 144.0 - 7.2, 108.0, 648.0)


def test_event_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = progress.windowed_counts(progress.read_events(spark, f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, progress.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))


def test_stream_filters(spark):
    rows = [("FlateDecode", zlib.compress(b"abc")), ("ASCIIHexDecode", b"61 62 6>"), ("ASCII85Decode", base64.a85encode(b"abc") + b"~>"), ("RunLengthDecode", bytes([1, 97, 98, 254, 99, 128])), ("FlateDecode", b"bad"), ("JPXDecode", b"x"), (None, None)]
    found = reading.decoded_streams(spark.createDataFrame(rows, "filter string, data binary").coalesce(1)).collect()
    assert [bytes(r.decoded) if r.decoded is not None else None for r in found] == [b"abc", b"ab`", b"abc", b"abccc", None, None, None]


def test_rtl_run_turns_round(spark):
    letters = [(1, 1, 0, c, v, (6.0 * c, 0.0, 6.0 * c + 5, 10.0)) for c, v in enumerate("aאב גb")]
    found = reading.rtl_runs_reversed(spark.createDataFrame(letters, "doc_id int, page_no int, line_no int, col int, value string, box struct<l:double,b:double,r:double,t:double>"))
    assert [r.value for r in found.orderBy("logical_col").collect()] == ["a", "ג", " ", "ב", "א", "b"]
    assert found.agg(F.count("*")).first()[0] == 6
