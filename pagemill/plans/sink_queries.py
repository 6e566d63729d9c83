"""Queries that run tables through report sinks and read what these have written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.operators.ranges import running
from pagemill.plans.registry import register
from pagemill.session import table
from pagemill.storage import shared_folder
from pagemill.streaming import sinks

_ENTRY = "event_id long, user_id long, event_type string, value double"


def _finished(spark: SparkSession, sf_dir: str) -> sinks.ReportSink:
    """All events as a stream of files through a sink, with a finished report."""
    sink = sinks.ReportSink(spark, f"{shared_folder(spark)}/report-{uuid.uuid4().hex}", _ENTRY, status="event_type", order=["event_id"])
    # A pattern, as a stream does not take the name of one file; it fits a folder of files as well.
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    sinks.collected(events.select("event_id", "user_id", "event_type", "value"), sink)
    sink.finish("Events")
    return sink


@register("s14_report_files", "SELECT event_id, user_id, event_type, round(value, 6) AS value, round(value, 6) AS json_value FROM events")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the finished CSV and JSON reports hold it."""
    sink = _finished(spark, sf_dir)
    # Events of one id, or of none, are told apart by what else they hold, and equal ones by their place among those.
    same = ["event_id", "user_id", "event_type"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("value")).alias("nth")
    csv = sink.csv_entries().select("*", nth)
    parsed = spark.read.schema(_ENTRY).json(f"{sink.path}/report.json").select(*same, F.round("value", 6).alias("json_value"), nth)
    return csv.join(parsed, [csv[c].eqNullSafe(parsed[c]) for c in (*same, "nth")]).select(*(csv[c] for c in same), "value", "json_value")


@register("s15_progress_snapshot", "SELECT event_type AS status, count(*) AS n, (SELECT count(*) FROM events) AS processed, true AS completed FROM events GROUP BY 1")
def progress_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of a stream's progress."""
    kind = "partial boolean, completed boolean, processed long, statusCounts map<string,long>"
    found = spark.read.schema(kind).json(f"{_finished(spark, sf_dir).path}/progress.json")
    return found.select(F.explode("statusCounts").alias("status", "n"), "processed", "completed")


@register("s14_markdown", """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT '# Events' AS line UNION ALL SELECT '- Entries: ' || (SELECT count(*) FROM events) UNION ALL SELECT '| event_type | n |' UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || event_type || ' | ' || n || ' |' FROM c""")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the finished Markdown report."""
    return spark.read.text(f"{_finished(spark, sf_dir).path}/report.md").select(F.col("value").alias("line"))


@register("s16_progress_events", """WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, count(*) OVER (PARTITION BY conv_id) AS total, role, CASE WHEN length(text) > 900 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN length(text) > 900 THEN 'OPERATION_FAILED' END AS error FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, CAST(ordinal AS BIGINT) AS ordinal, second, CASE second WHEN 0 THEN '{"type":"step-start","ordinal":' || ordinal || ',"total":' || total || ',"id":"step-' || ordinal || '"}'
  ELSE '{"type":"step-complete","ordinal":' || ordinal || ',"total":' || total || ',"id":"step-' || ordinal || '","command":"' || role || '","status":"' || status || '"' || CASE WHEN error IS NULL THEN '' ELSE ',"errorCode":"' || error || '"' END || '}' END AS value FROM s, (VALUES (0), (1)) AS k(second)""")
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and completion of every step as lines of JSON."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    failed = F.length("text") > 900
    steps = running(turns.select("conv_id", "turn", "role", F.when(failed, "FAIL").otherwise("PASS").alias("status"), F.when(failed, "OPERATION_FAILED").alias("error")), ["conv_id"], ["turn"]).withColumnRenamed("nth", "ordinal")
    counted = steps.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")), "conv_id")
    return sinks.step_events(counted, "conv_id", "ordinal", "total", {"command": "role", "status": "status", "errorCode": "error"})
