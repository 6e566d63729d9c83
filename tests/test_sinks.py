"""Report sinks over streams that are stopped and started again, and the forms of the finished reports."""

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.plans import sink_queries
from pagemill.streaming import sinks

ENTRY = "path string, page int, status string, ms double"


def _write(spark, folder, rows):
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(folder)


def _lines(folder):
    parts = sorted(x for x in os.listdir(folder) if x.startswith("part-"))
    return [line for x in parts for line in open(f"{folder}/{x}", encoding="utf-8").read().split("\n")[:-1]]


@pytest.fixture
def sink(spark, tmp_path):
    return sinks.ReportSink(spark, f"file://{tmp_path}/report", ENTRY, order=["path", "page"])


def _progress(sink):
    return json.load(open(f"{sink.path.removeprefix('file://')}/progress.json"))


def test_a_stopped_stream_goes_on_without_a_row_twice(spark, tmp_path, sink, monkeypatch):
    source = f"file://{tmp_path}/in"
    _write(spark, source, [("a", 1, "PASS", 1.0), ("b", 1, "FAIL", None)])
    _write(spark, source, [("c", 1, "PASS", 2.0)])
    real, calls = sinks.ReportSink.snapshot, []

    def dies(self, completed=False):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed after the entries were written")
        real(self, completed)

    monkeypatch.setattr(sinks.ReportSink, "snapshot", dies)
    with pytest.raises(Exception, match="killed"):
        sinks.collected(_stream(spark, source), sink)
    assert sink.entries().count() == 3 and _progress(sink)["processed"] in (1, 2) and _progress(sink)["partial"]
    monkeypatch.setattr(sinks.ReportSink, "snapshot", real)
    _write(spark, source, [("a", 2, "PASS", 3.0)])
    sinks.collected(_stream(spark, source), sink)
    assert sorted((r.path, r.page) for r in sink.entries().collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    assert _progress(sink) == {"partial": True, "completed": False, "processed": 4, "statusCounts": {"FAIL": 1, "PASS": 3}}
    sinks.collected(_stream(spark, source), sink)
    assert sink.entries().count() == 4


def test_finished_reports(spark, tmp_path, sink):
    source = f"file://{tmp_path}/in"
    _write(spark, source, [('q"x, y', 2, "PASS", 0.1234567), ("a", 10, "a|b", 100.0), ("a", 9, None, None)])
    sinks.collected(_stream(spark, source), sink)
    for _ in range(2):
        sink.finish("Run")
    folder = sink.path.removeprefix("file://")
    assert _lines(f"{folder}/pages.csv") == ["path,page,status,ms", '"a",9,,', '"a",10,"a|b",100', '"q""x, y",2,"PASS",0.123457']
    assert [json.loads(x) for x in _lines(f"{folder}/report.json")] == [{"path": "a", "page": 9}, {"path": "a", "page": 10, "status": "a|b", "ms": 100.0}, {"path": 'q"x, y', "page": 2, "status": "PASS", "ms": 0.1234567}]
    assert _lines(f"{folder}/report.md") == ["# Run", "- Entries: 3", "| status | n |", "| --- | --- |", "|  | 1 |", "| PASS | 1 |", "| a\\|b | 1 |"]
    assert _progress(sink)["completed"] and not os.listdir(f"{folder}/.writing")


def test_an_empty_report(spark, sink):
    sink.finish("Nothing")
    folder = sink.path.removeprefix("file://")
    assert _lines(f"{folder}/pages.csv") == ["path,page,status,ms"] and _lines(f"{folder}/report.json") == [] and _progress(sink)["processed"] == 0


def test_csv_of_several_parts_is_read_whole(spark, tmp_path, sink, monkeypatch):
    rows = [(f"p{i:03}", i, None if i % 7 == 0 else 'say "a", b\nc' if i % 5 == 0 else "", i / 4) for i in range(200)]
    sink.add(spark.createDataFrame(rows, ENTRY), 0)
    monkeypatch.setattr(sinks, "_in_order", lambda rows, order: rows.repartitionByRange(5, *order).sortWithinPartitions(*order))
    sink.finish("Parts")
    assert sum(x.startswith("part-") for x in os.listdir(f"{sink.path.removeprefix('file://')}/pages.csv")) > 1
    assert sorted(map(tuple, sink.csv_entries().collect())) == rows


def test_report_files_give_every_event(spark, tmp_path):
    events = [(None, 1, "view", 1.5), (None, 2, "view", None), (7, 1, "view", 2.0), (7, 1, "view", 1.0), (7, 1, "view", 1.0), (8, None, None, 3.25)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = sink_queries.report_files(spark, f"file://{tmp_path}").collect()
    assert sorted(map(str, found)) == sorted(str(Row(event_id=a, user_id=b, event_type=c, value=d, json_value=d)) for a, b, c, d in events)


def test_a_taken_name_is_not_written_again(spark, sink):
    folder = sinks.Folder(spark, sink.path)
    for n, expected in ((1, True), (2, False)):
        written = folder.temporary()
        spark.range(n).write.parquet(written)
        assert folder.publish(written, "x/batch=0") is expected
    assert spark.read.parquet(f"{sink.path}/x/batch=0").count() == 1


def test_numbers(spark):
    given = [0.0, 1.5, -2.0, 0.0000005, 0.00000049, 1e10, 100.0, None]
    found = spark.createDataFrame([(x,) for x in given], "x double").select(T.csv_number(F.col("x")).alias("s")).collect()
    assert [r.s for r in found][:3] + [r.s for r in found][5:7] == ["0", "1.5", "-2", "10000000000", "100"] and found[3].s == "0.000001" and found[4].s == "0"


def test_step_events(spark):
    steps = spark.createDataFrame([("r", 1, 2, "open", "PASS", None), ("r", 2, 2, "save", "FAIL", "OPERATION_FAILED")], "run string, k int, n int, command string, status string, error string")
    rows = sinks.step_events(steps, "run", "k", "n", {"command": "command", "status": "status", "errorCode": "error"}).orderBy("k", "second").collect()
    assert [json.loads(r.value)["type"] for r in rows] == ["step-start", "step-complete"] * 2
    assert json.loads(rows[1].value) == {"type": "step-complete", "ordinal": 1, "total": 2, "id": "step-1", "command": "open", "status": "PASS"} and json.loads(rows[3].value)["errorCode"] == "OPERATION_FAILED"
