"""A positional word index that lasts: postings in batches and hash buckets, searched without reading texts again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators.search import regex_matches
from pagemill.session import spread
from pagemill.storage import stored

_WORD = re.compile(r"\S+", re.ASCII)
_CHANGES = re.compile(T.MAY_FOLD)
_PLACE = "struct<line_no:int,word_no:int,start:int,before:string,after:string,at:array<int>>"
_POSTING = f"key string, word string, doc_id long, n int, places array<{_PLACE}>, bucket int, batch int"
_KNOWN = "doc_id long, n_lines int, live boolean, batch int"
PAIR = ["doc_id", "line_no"]


def _postings(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(word, doc_id, places) of the words of docs (doc_id, text), a row for each document, in matching form: a document's places of a word are put together where its text is, in pieces of
    about `most` places, so that no row for a place is ever shuffled.

    start is the word's place in the matching form of its line; at, where folding moves letters, holds for each of its characters and the one after it the place in the text as it
    is. before and after are the blanks around the word.
    """
    names = ["line_no", "word_no", "start", "before", "after", "at"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def together(held: dict[tuple[int, str], list[tuple]]) -> pa.RecordBatch:
        ends = np.append(0, np.cumsum([len(found) for found in held.values()]))
        columns = zip(*(place for found in held.values() for place in found), strict=True)
        places = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        words, ids = pa.array([w for _, w in held], pa.string()), pa.array([d for d, _ in held], pa.int64())
        return pa.RecordBatch.from_arrays([words, ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)], names=["word", "doc_id", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for doc, whole in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for line, text in enumerate(whole.as_py().split("\n")):
                    places = None
                    if _CHANGES.search(text):
                        forms = T.fold_letters(list(text))
                        places = [i + 1 for i, form in enumerate(forms) for _ in form] + [len(text) + 1]
                        text = "".join(forms)
                    spans = [m.span() for m in _WORD.finditer(text)]
                    for k, (a, z) in enumerate(spans):
                        left, right = spans[k - 1][1] if k else 0, spans[k + 1][0] if k + 1 < len(spans) else len(text)
                        held.setdefault((doc, text[a:z]), []).append((line, k, a + 1, text[left:a], text[z:right], places[a : z + 1] if places else None))
                    size += len(spans)
                if size >= most:
                    yield together(held)
                    held, size = {}, 0
        if held:
            yield together(held)

    return docs.select("doc_id", "text").mapInArrow(run, f"word string, doc_id long, places array<{_PLACE}>")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class TextIndex:
    """An index in a folder: postings (by batch and bucket of the trimmed, lower-case word), and which batch of each document counts.

    Adding and removing only write new files. The last batch that names a document counts; if that removed it, it has none. A document that is in no batch is
    not indexed, and searches pass over it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def add(self, docs: DataFrame, batch: int) -> None:
        """Indexes docs (doc_id, text) as a batch with a number above those before. Null texts and ids are not indexed; rows of one id are one document,
        whose lines must not have the same number twice, so repeated ids in a batch are refused by their first text in order."""
        given = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # Only texts of repeated ids are shuffled; as a rule there are none.
        several = stored(given.groupBy("doc_id").count().where("count > 1").select("doc_id"))
        repeated = given.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        given = given.join(several, "doc_id", "left_anti").unionByName(repeated)
        key = F.lower(T.trim_edges(F.col("word")))
        postings = _postings(spread(given)).withColumn("key", key)
        postings = postings.select("key", "word", "doc_id", F.size("places").alias("n"), "places", _bucket(F.col("key"), self.buckets).alias("bucket"))
        # Each task writes a file for each bucket, so postings go from their texts to the index without a shuffle.
        postings.sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        given.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.lit(True).alias("live")).write.parquet(f"{self.path}/known/batch={batch}")

    def remove(self, ids: DataFrame, batch: int) -> None:
        """Takes the documents (doc_id) out, as a batch of its own."""
        ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("n_lines"), F.lit(False).alias("live")).distinct().write.parquet(f"{self.path}/known/batch={batch}")

    def documents(self) -> DataFrame:
        """(doc_id, batch, n_lines) of the documents that are indexed now."""
        last = self.spark.read.schema(_KNOWN).parquet(f"{self.path}/known").groupBy("doc_id").agg(F.max(F.struct("batch", "live", "n_lines")).alias("x"))
        return last.where("x.live").select("doc_id", "x.batch", "x.n_lines")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_POSTING).option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")

    def postings(self, rows: DataFrame | None = None) -> DataFrame:
        """Postings of the documents that are indexed now, of all postings or of some."""
        rows = self._rows() if rows is None else rows
        return rows.join(self.documents().select("doc_id", "batch"), ["doc_id", "batch"])

    def frequencies(self, words: list[str]) -> DataFrame:
        """(word, docs, occurrences) of whole words; only their buckets are read."""
        keys = [T.fold_text(w).lower() for w in words]
        asked = self._keys(keys).groupBy(F.col("key").alias("word")).agg(F.count_distinct("doc_id").alias("docs"), F.sum("n").alias("occurrences"))
        return asked

    def _keys(self, keys: list[str]) -> DataFrame:
        buckets = [r.b for r in self.spark.createDataFrame([(k,) for k in keys], "key string").select(_bucket(F.col("key"), self.buckets).alias("b")).collect()]
        return self.postings().where(F.col("bucket").isin(buckets) & F.col("key").isin(keys))

    def whole_words(self, term: str) -> DataFrame:
        """(doc_id, line_no, start, length, word) of the words that equal the term without case and edge punctuation."""
        hits = self._keys([T.fold_text(term).lower()])
        return self._placed(hits, F.lit(0), F.length("word")).select(*PAIR, "start", "length", "word")

    def substrings(self, term: str, ignore_case: bool = True) -> DataFrame:
        """(doc_id, line_no, start, length) of a term, left to right without overlaps, as the live search finds it. Places are in the text as it is.

        A term within one word is looked for in words. One with blanks in it is cut at them: its first part must end a word, the last begin one, those between be words, and
        the postings of the parts are joined where they stand next to each other with the same blanks between. A term of blanks alone finds nothing.
        """
        needle = T.fold_text(term)
        needle = needle.lower() if ignore_case else needle
        parts, blanks = needle.split(), re.split(r"\S+", needle, flags=re.ASCII)
        if not parts:
            return self.postings().select(*PAIR[:1], F.lit(0).alias("line_no"), F.lit(0).alias("start"), F.lit(0).alias("length")).where("false")
        word = F.lower("word") if ignore_case else F.col("word")
        lead, trail = blanks[0], blanks[-1]
        if len(parts) == 1 and not lead and not trail:
            hits = self.postings().where(F.contains(word, F.lit(needle))).withColumn("_s", F.explode(T.positions(word, needle)))
            return self._placed(hits, F.col("_s") - 1, F.lit(len(needle))).select(*PAIR, "start", "length")
        found = None
        for i, part in enumerate(parts):
            first, last = i == 0, i == len(parts) - 1
            open_left, open_right = first and not lead, last and not trail
            fits = F.endswith(word, F.lit(part)) if open_left and not open_right else F.startswith(word, F.lit(part)) if open_right and not open_left else F.contains(word, F.lit(part)) if open_left else word == part
            own = self.postings().where(fits).withColumn("p", F.explode("places")).withColumn("line_no", F.col("p.line_no"))
            if not last:
                own = own.where(F.col("p.after") == blanks[i + 1])
            elif trail:
                own = own.where(F.startswith("p.after", F.lit(trail)))
            if first and lead:
                own = own.where(F.endswith("p.before", F.lit(lead)))
            place = lambda at: F.coalesce(F.get(F.col("p.at"), at), F.col("p.start") + at)
            begin = place(F.length("word") - len(part)) if open_left else place(F.lit(0)) - len(lead)
            size = F.lit(len(part)) if open_right else F.length("word")
            stop = F.greatest(place(size), place(size - 1) + 1) + (0 if open_right else len(trail))
            keep = own.select(*PAIR, (F.col("p.word_no") - i).alias("_anchor"), *([begin.alias("start")] if first else []), *([stop.alias("_stop")] if last else []))
            found = keep if found is None else found.join(keep, [*PAIR, "_anchor"])
        # Places that overlap the one taken before fall away, line by line.
        spans = F.array_sort(F.collect_list(F.struct("start", "_stop")))
        taken = F.aggregate(spans, F.array().cast("array<struct<start:int,_stop:int>>"), lambda s, x: F.when((F.size(s) == 0) | (x["start"] >= F.get(s, F.size(s) - 1)["_stop"]), F.concat(s, F.array(x))).otherwise(s))
        lines = found.groupBy(*PAIR).agg(taken.alias("x")).select(*PAIR, F.explode("x").alias("x"))
        return lines.select(*PAIR, "x.start", (F.col("x._stop") - F.col("x.start")).alias("length"))

    def _placed(self, hits: DataFrame, offset: Column, length: Column) -> DataFrame:
        """A row for each occurrence of the hits' words with the place of `length` characters from `offset` on."""
        each = hits.withColumn("_o", offset).withColumn("_n", length).withColumn("p", F.explode("places"))
        start = F.coalesce(F.get(F.col("p.at"), F.col("_o")), F.col("p.start") + F.col("_o"))
        after = F.col("_o") + F.col("_n")
        stop = F.coalesce(F.greatest(F.get(F.col("p.at"), after), F.get(F.col("p.at"), after - 1) + 1), F.col("p.start") + after)
        return each.select("doc_id", "p.line_no", "p.word_no", "word", start.alias("start"), (stop - start).alias("length"))

    def lines(self, containing: str | None = None) -> DataFrame:
        """(doc_id, line_no, text): the indexed lines in matching form, put together from postings; only those with a word that contains a string, if one is given."""
        rows = self._rows()
        if containing is not None:
            # Stored, so that a small table of wanted lines is known to be one and goes to the postings, not these to it.
            wanted = stored(self.postings().where(F.contains("word", F.lit(containing))).select("doc_id", F.explode("places.line_no").alias("line_no")).distinct())
            rows = rows.join(wanted.groupBy("doc_id").agg(F.collect_set("line_no").alias("_lines")), "doc_id")
            rows = rows.withColumn("places", F.filter("places", lambda p: F.array_contains(F.col("_lines"), p["line_no"]))).where(F.size("places") > 0).drop("_lines")
        each = self.postings(rows).select("doc_id", "word", F.explode("places").alias("p"))
        piece = F.struct(F.col("p.word_no").alias("k"), F.concat(F.when(F.col("p.word_no") == 0, F.col("p.before")).otherwise(""), "word", F.col("p.after")).alias("v"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["v"]), "")
        return each.groupBy("doc_id", F.col("p.line_no").alias("line_no")).agg(text.alias("text"))

    def regex(self, pattern: str, literal: str | None = None) -> DataFrame:
        """(doc_id, line_no, match_no, matched) of a regular expression in lines with words. literal: a string without blanks that every match contains in one word; with it only lines
        that have it are put together."""
        return regex_matches(self.lines(literal), pattern).drop("text")
