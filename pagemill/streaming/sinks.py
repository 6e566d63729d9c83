"""Reports that grow with a stream: entries by batch, a progress snapshot after each, and JSON, CSV and Markdown at the end.

Everything is written beside its place and then renamed into it, so that a reader sees whole batches and whole reports only. A batch's folder carries the number that the
stream's checkpoint gives it: after a restart the batch that was under way comes again under the same number, and is passed over if its folder is there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from pagemill.functions import text as T


class Folder:
    """Renames and small files through Spark's file systems, whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{name}"))

    def temporary(self) -> str:
        """A path for what is being written; names with a leading dot are not read by Spark."""
        return f"{self.path}/.writing/{uuid.uuid4().hex}"

    def publish(self, written: str, name: str) -> bool:
        """Renames a written folder to a name that is not taken; False where it is, and then what was written goes."""
        to = self._at(f"{self.path}/{name}")
        self._fs.mkdirs(to.getParent())
        if not self._fs.exists(to) and self._fs.rename(self._at(written), to):
            return True
        self._fs.delete(self._at(written), True)
        return False

    def replace(self, written: str, name: str) -> None:
        """The same for a name that may be taken: the old folder is put aside before and removed after."""
        to, aside = self._at(f"{self.path}/{name}"), self._at(self.temporary())
        old = self._fs.exists(to) and self._fs.rename(to, aside)
        if not self._fs.rename(self._at(written), to):
            raise OSError(f"{self.path}/{name} could not be written")
        if old:
            self._fs.delete(aside, True)

    def replace_file(self, name: str, text: str) -> None:
        """A small file in one step: readers find the old one or the new one."""
        written, to = self._at(self.temporary()), self._at(f"{self.path}/{name}")
        out = self._fs.create(written, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(to.toUri(), self._conf).rename(written, to, options)


def csv_cell(name: str, kind) -> Column:
    """Strings quoted, numbers with at most six digits after the point, nothing for null."""
    if isinstance(kind, StringType):
        return F.coalesce(T.csv_quote(F.col(name)), F.lit(""))
    return F.coalesce(T.csv_number(F.col(name)) if isinstance(kind, NumericType) else F.col(name).cast("string"), F.lit(""))


def csv_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """(value): a header and one line for each row in order; the part files one after another are the CSV file."""
    cells = F.concat_ws(",", *(csv_cell(f.name, f.dataType) for f in rows.schema.fields))
    body = rows.select(F.lit(1).alias("_part"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), cells.alias("value"))
    head = rows.sparkSession.range(1).select(F.lit(0).alias("_part"), *(F.lit(None).cast(rows.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)), F.lit(",".join(rows.columns)).alias("value"))
    return _in_order(head.unionByName(body), ["_part", *(f"_o{i}" for i in range(len(order)))]).select("value")


def json_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """(value): a JSON object for each row in order."""
    return _in_order(rows, order).select(F.to_json(F.struct(*rows.columns)).alias("value"))


def markdown_lines(counts: DataFrame, title: str, status: str) -> DataFrame:
    """(value): title, total and a table of counts by status, largest first. counts (status, n) has one row for each status."""
    lines = counts.select(F.lit(4).alias("k"), (-F.col("n")).alias("m"), F.coalesce(status, F.lit("")).alias("s"), F.concat(F.lit("| "), F.replace(F.coalesce(status, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(" | "), "n", F.lit(" |")).alias("value"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(1).alias("k"), F.lit(0).cast("long").alias("m"), F.lit("").alias("s"), F.concat(F.lit("- Entries: "), "n").alias("value"))
    fixed = counts.sparkSession.createDataFrame([(0, 0, "", f"# {title}"), (2, 0, "", f"| {status} | n |"), (3, 0, "", "| --- | --- |")], "k int, m long, s string, value string")
    return fixed.unionByName(total).unionByName(lines).coalesce(1).sortWithinPartitions("k", "m", "s").select("value")


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


class ReportSink:
    """A report in a folder: entries of a stream as they come, counted by a status column, and finished reports in an order of columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, status: str = "status", order: list[str] | None = None):
        self.spark, self.path, self.schema, self.status, self.order = spark, path, schema, status, order or [status]
        self.folder = Folder(spark, path)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in one batch, for foreachBatch: entries, then their counts, then the snapshot of all batches so far."""
        for kind, rows in (("entries", batch), ("counts", None)):
            if not self.folder.exists(f"{kind}/batch={batch_id}"):
                rows = self._batch("entries", batch_id).groupBy(self.status).agg(F.count(F.lit(1)).alias("n")).coalesce(1) if rows is None else rows
                written = self.folder.temporary()
                rows.write.parquet(written)
                self.folder.publish(written, f"{kind}/batch={batch_id}")
        self.snapshot()

    def _batch(self, kind: str, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}/batch={batch_id}")

    def entries(self) -> DataFrame:
        """All entries so far."""
        if not self.folder.exists("entries"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/entries").select(*self.spark.createDataFrame([], self.schema).columns)

    def counts(self) -> DataFrame:
        """(status, n) over all batches, from their counts."""
        kind = self.spark.createDataFrame([], self.schema).schema[self.status].dataType.simpleString()
        empty = self.spark.createDataFrame([], f"`{self.status}` {kind}, n long")
        if not self.folder.exists("counts"):
            return empty
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/counts").groupBy(self.status).agg(F.sum("n").alias("n"))

    def csv_entries(self) -> DataFrame:
        """The entries as the finished CSV report holds them. Its parts are one file cut in pieces, so that only the first begins with the header; a quoted cell may hold line ends or nothing."""
        first = F.col("_metadata.file_name").startswith("part-00000")
        read = lambda header: self.spark.read.schema(self.schema).csv(f"{self.path}/pages.csv", header=header, escape='"', multiLine=True, nullValue="\0")
        return read(True).where(first).unionByName(read(False).where(~first))

    def snapshot(self, completed: bool = False) -> None:
        """progress.json: how many entries there are, by status, and whether more may come. It has a number for each status and nothing else."""
        found = {r[self.status]: r.n for r in self.counts().collect()}
        self.folder.replace_file("progress.json", json.dumps({"partial": not completed, "completed": completed, "processed": sum(found.values()), "statusCounts": {str(k): found[k] for k in sorted(found, key=str)}}))

    def finish(self, title: str) -> None:
        """report.json, pages.csv and report.md as folders of text in order, and the last snapshot."""
        rows = self.entries()
        for name, lines in (("report.json", json_lines(rows, self.order)), ("pages.csv", csv_lines(rows, self.order)), ("report.md", markdown_lines(self.counts(), title, self.status))):
            written = self.folder.temporary()
            lines.write.text(written)
            self.folder.replace(written, name)
        self.snapshot(completed=True)


def collected(stream: DataFrame, sink: ReportSink) -> None:
    """Runs a stream into a sink until nothing new is left; the checkpoint stands in the sink's folder, so that a later call goes on from there."""
    run = stream.writeStream.foreachBatch(sink.add).option("checkpointLocation", f"{sink.path}/.checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()


def step_events(steps: DataFrame, run: str, place: str, total: str, columns: dict[str, str]) -> DataFrame:
    """(run, place, value): for each step of a run a start and a completion as lines of JSON, in the order of their places.

    columns gives the JSON names of a completion and the columns that they come from; a null value is left out. A failed step's error is one of them.
    """
    at = [F.col(place).alias("ordinal"), F.col(total).alias("total"), F.concat(F.lit("step-"), F.col(place)).alias("id")]
    start = F.to_json(F.struct(F.lit("step-start").alias("type"), *at))
    done = F.to_json(F.struct(F.lit("step-complete").alias("type"), *at, *(F.col(c).alias(name) for name, c in columns.items())))
    return steps.select(run, place, F.posexplode(F.array(start, done)).alias("second", "value"))
