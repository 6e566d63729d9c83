"""Redaction: spatial filters on boxes, text redaction by letters, keep and remove segments, scrubbing of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.storage import stored


def without_intersecting(items: DataFrame, area: Column) -> DataFrame:
    """Items whose box is null or does not cross the area."""
    return items.where(~G.intersects(area, F.col("box")))


def without_contained(items: DataFrame, area: Column) -> DataFrame:
    return items.where(~G.contains(area, F.col("box")))


def removal_flags(letters: DataFrame, area: Column, strategy: str = "AnyOverlap") -> DataFrame:
    """letters with removed and overlap (None, Partial, Full) against an area."""
    return letters.withColumn("removed", G.removed(F.col("box"), area, strategy)).withColumn("overlap", G.overlap_type(F.col("box"), area))


def segments(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment_no, kept, overlap, start, stop, text): maximal runs of letters with one fate.

    A run ends where kept turns into removed or back, or where a removed run's overlap type changes.
    """
    order = Window.partitionBy(*keys).orderBy("col")
    fate = F.when(F.col("removed"), F.col("overlap")).otherwise("kept")
    flipped = flagged.withColumn("_fate", fate).withColumn("_new", F.coalesce((F.col("_fate") != F.lag("_fate").over(order)).cast("int"), F.lit(1)))
    numbered = flipped.withColumn("segment_no", F.sum("_new").over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), "")
    runs = numbered.groupBy(*keys, "segment_no", "_fate").agg(F.min("col").alias("start"), (F.max("col") + 1).alias("stop"), text.alias("text"))
    return runs.select(*keys, "segment_no", (F.col("_fate") == "kept").alias("kept"), F.when(F.col("_fate") == "kept", "None").otherwise(F.col("_fate")).alias("overlap"), "start", "stop", "text")


def line_segments(lines: DataFrame, keys: list[str], area: Column, strategy: str = "AnyOverlap") -> DataFrame:
    """The segments of removal_flags and segments from lines as rows (keys, letters array<struct<value, box>>), one letter a column: lines stay in their rows."""
    letters = F.col("letters")
    fate = F.transform(letters, lambda x: F.when(G.removed(x["box"], area, strategy), G.overlap_type(x["box"], area)).otherwise("kept"))
    told = lines.where(F.size(letters) > 0).withColumn("_f", fate)
    f, n = F.col("_f"), F.size("_f")
    turns = F.filter(F.transform(f, lambda x, i: F.when((i == 0) | (x != F.get(f, i - 1)), i)), lambda i: i.isNotNull())
    marked = told.withColumn("_a", turns)
    stops = F.concat(F.slice("_a", F.lit(2), n), F.array(n))

    def segment(a: Column, z: Column) -> Column:
        return F.struct(a.alias("start"), z.alias("stop"), F.get(f, a).alias("fate"), F.array_join(F.transform(F.slice(letters, a + 1, z - a), lambda x: x["value"]), "").alias("text"))

    found = marked.select(*keys, F.posexplode(F.zip_with("_a", stops, segment)).alias("segment_no", "s"))
    kept = F.col("s.fate") == "kept"
    return found.select(*keys, (F.col("segment_no") + 1).cast("long").alias("segment_no"), kept.alias("kept"), F.when(kept, "None").otherwise(F.col("s.fate")).alias("overlap"), "s.start", "s.stop", "s.text")


def _rewritten(text: Column, ranges: Column, mark: str) -> Column:
    """The text with each letter in one of the sorted ranges as a mark, or left out if the mark is empty. Ranges that meet are taken as one."""
    init = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = F.greatest(s["at"], x["a"])
        kept = F.substring(text, s["at"], begin - s["at"])
        return F.struct(F.greatest(s["at"], x["z"]).alias("at"), F.concat(s["out"], F.array(kept, F.repeat(F.lit(mark), F.greatest(x["z"] - begin, F.lit(0))))).alias("out"))

    return F.aggregate(ranges, init, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"], F.length(text))))


def redacted_lines(lines: DataFrame, term: str, mark: str = "█", ignore_case: bool = False) -> DataFrame:
    """lines (…, text) with n_matches and redacted: every letter of every match becomes a mark; matches may overlap.

    Text and term are compared in matching form (T.match_ranges). A null text has no match and stays null.
    """
    found = T.with_matching_form(lines).withColumn("_r", T.match_ranges(F.col("text"), F.col("form"), [term], ignore_case))
    masked = F.when(F.size("_r") > 0, _rewritten(F.col("text"), F.col("_r"), mark)).otherwise(F.col("text"))
    return found.select(*lines.columns, F.when(F.col("text").isNull(), 0).otherwise(F.size("_r")).alias("n_matches"), masked.alias("redacted"))


def redact_to_the_end(lines: DataFrame, terms: list[str], ignore_case: bool = True, passes: int = 10) -> DataFrame:
    """lines (…, text) with redacted, n_matches, passes and swept: letters of all matches of all terms go, again and again until no term is left.

    Each pass is a stored table of the lines that still had a match, so later passes touch only those. A line that has matches after the last
    pass, or that a pass did not change, is swept: its operation goes as a whole. So no line holds a term at the end, whatever was nested in it. passes is the number of passes
    that took letters, n_matches counts over all of them and the sweep. Matches do not cross lines; null texts stay null; rows may repeat.
    """
    state = lines.withColumn("_now", F.col("text")).withColumn("n_matches", F.lit(0)).withColumn("passes", F.lit(0)).withColumn("swept", F.lit(False))
    columns = state.columns
    done: list[DataFrame] = []
    for turn in range(passes + 1):
        looked = T.with_matching_form(state, "_now").withColumn("_r", T.match_ranges(F.col("_now"), F.col("form"), terms, ignore_case)).drop("form")
        hit = F.coalesce(F.size("_r") > 0, F.lit(False))
        looked = stored(looked.withColumn("_hit", hit))
        done.append(looked.where("not _hit").select(*columns))
        open_rows = looked.where("_hit")
        if open_rows.isEmpty():
            break
        counted = open_rows.withColumn("n_matches", F.col("n_matches") + F.size("_r"))
        if turn == passes:
            done.append(counted.withColumn("_now", F.lit("")).withColumn("swept", F.lit(True)).select(*columns))
            break
        cut = counted.withColumn("_cut", _rewritten(F.col("_now"), F.col("_r"), "")).withColumn("swept", F.col("_cut") == F.col("_now"))
        state = cut.withColumn("_now", F.when(F.col("swept"), "").otherwise(F.col("_cut"))).withColumn("passes", F.col("passes") + (~F.col("swept")).cast("int")).select(*columns)
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out.select(*lines.columns, F.col("_now").alias("redacted"), "n_matches", "passes", "swept")


def redact_all(docs: DataFrame, terms: list[str], passes: int = 10) -> DataFrame:
    """(doc_id, redacted, n_removed, n_left): terms cut out pass after pass until none is left or `passes` have run.

    Cutting can join letters to a new match, hence the passes; a pass over a clean text changes nothing. n_left is the number of terms that
    are still there after the last pass, more than 0 only for a text that the passes did not finish.
    """
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    cut = lambda s, term: F.struct(F.replace(s["t"], term, F.lit("")).alias("t"), (s["n"] + ((F.length(s["t"]) - F.length(F.replace(s["t"], term, F.lit("")))) / F.length(term)).cast("int")).alias("n"))
    start = F.struct(F.col("text").alias("t"), F.lit(0).alias("n"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(max(passes, 1))), start, lambda s, _: F.aggregate(wanted, s, cut))
    out = docs.select("doc_id", done.alias("_x")).select("doc_id", F.col("_x.t").alias("redacted"), F.col("_x.n").alias("n_removed"))
    return out.withColumn("n_left", F.coalesce(F.size(F.filter(wanted, lambda term: F.contains(F.col("redacted"), term))), F.lit(0)))


def scrubbed(rows: DataFrame, columns: list[str], terms: list[str], emptied: str | None = None) -> DataFrame:
    """rows with the terms removed from the columns; what becomes empty turns into `emptied`."""
    for name in columns:
        clean = T.remove_terms(F.col(name), terms)
        rows = rows.withColumn(name, F.when((clean == "") & (F.col(name) != ""), F.lit(emptied)).otherwise(clean))
    return rows
