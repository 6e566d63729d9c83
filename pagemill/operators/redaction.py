"""A redaction as a list of actions on pages, applied at once: what goes, what is painted over, and what was counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators.content import category, renumbered
from pagemill.sources.layout import LINES_PER_PAGE, page_letter_arrays
from pagemill.storage import stored

KEYS = ["doc_id", "page_no"]
_BOX = "struct<l:double,b:double,r:double,t:double>"


@dataclass(frozen=True)
class Action:
    """kind: area, text, letters, all_text or category; value: a box, a text, a test of a letter (value, l, b, r, t), or a category's name."""

    kind: str
    value: object = None


@dataclass(frozen=True)
class Redaction:
    """Actions in order. Redaction().area(box).text("name").category("XObject").without_markers() and so on; apply() runs them on all pages."""

    actions: tuple[Action, ...] = ()
    marked: bool = True

    def _with(self, kind: str, value: object = None) -> Redaction:
        return replace(self, actions=(*self.actions, Action(kind, value)))

    def area(self, left: float, bottom: float, right: float, top: float) -> Redaction:
        return self._with("area", (left, bottom, right, top))

    def text(self, term: str) -> Redaction:
        """An empty text is no action."""
        return self._with("text", term) if term else self

    def letters(self, test: Callable[[Column], Column]) -> Redaction:
        return self._with("letters", test)

    def all_text(self) -> Redaction:
        return self._with("all_text")

    def category(self, kind: str) -> Redaction:
        return self._with("category", kind)

    def without_markers(self) -> Redaction:
        return replace(self, marked=False)

    def marks(self, pages: DataFrame) -> DataFrame:
        """(doc_id, page_no, action, nth, mark): the boxes that the actions take on each page (doc_id, page_no, letters), in order of actions and letters.

        Texts are found in the letters of the page one after another, in matching form, with overlaps; a match's box surrounds its letters, also over two lines.
        """
        texts = [a.value for a in self.actions if a.kind == "text"]
        if any(a.kind in ("area", "text", "letters") for a in self.actions):
            # All actions in one pass over the letters; only pages with a text to find that folding may change go another way.
            spelled = pages.withColumn("_text", F.array_join(F.transform("letters", lambda x: x["value"]), "")) if texts else pages
            spelled = T.with_matching_form(spelled, "_text") if texts else spelled
            each = F.explode(F.concat(*(self._boxes(n, action) for n, action in enumerate(self.actions)))).alias("m")
            return spelled.select(*KEYS, each).select(*KEYS, "m.action", "m.nth", "m.mark")
        return pages.select(*KEYS, F.lit(0).alias("action"), F.lit(0).alias("nth"), F.lit(None).cast(_BOX).alias("mark")).where("false")

    def marks_on_lines(self, pages: DataFrame) -> DataFrame:
        """The same boxes for pages (doc_id, page_no, lines) as layout.page_lines gives them: the task that holds a page makes its letters. A test of letters gets them as arrays
        under the same names, so it may use operators alone."""
        actions = self.actions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, x in page_letter_arrays(batch):
                    at, rows = [np.zeros(0, np.int64)], [np.zeros((0, 6))]
                    sides = np.stack([x.left, x.bottom, x.right, x.top], axis=1)
                    named = {"value": x.code.view("<U1"), "line_no": x.row + (part.column("page_no").to_numpy()[x.page] - 1) * LINES_PER_PAGE, "col": x.col} | dict(zip("lbrt", sides.T, strict=True))
                    for n, action in enumerate(actions):
                        if action.kind == "area":
                            page = np.arange(part.num_rows)
                            boxes = np.tile(np.array(action.value, float), (len(page), 1))
                        elif action.kind == "letters":
                            hit = np.flatnonzero(action.value(named))
                            page, boxes = x.page[hit], sides[hit]
                        elif action.kind == "text":
                            spans = [(i, x.first[i] + a - 1, x.first[i] + z - 1) for i in range(part.num_rows) for a, z in T.ranges_in(x.text(i), [action.value], ignore_case=False)]
                            page = np.array([i for i, _, _ in spans], np.int64)
                            boxes = np.array([(*sides[a:z, :2].min(axis=0), *sides[a:z, 2:].max(axis=0)) for _, a, z in spans]).reshape(-1, 4)
                        else:
                            continue
                        nth = np.arange(len(page)) - np.searchsorted(page, page, "left")
                        at.append(page)
                        rows.append(np.column_stack([np.full(len(page), n), nth, boxes]))
                    at, found = np.concatenate(at), np.concatenate(rows)
                    own = [part.column(k).take(pa.array(at)) for k in KEYS]
                    numbers = [pa.array(found[:, i].astype(np.int32)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, *numbers, *(pa.array(found[:, i]) for i in range(2, 6))], names=[*KEYS, "action", "nth", *"lbrt"])

        kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in KEYS)
        found = pages.select(*KEYS, "lines").mapInArrow(run, f"{kinds}, action int, nth int, l double, b double, r double, t double")
        return found.select(*KEYS, "action", "nth", F.struct(*"lbrt").alias("mark"))

    def _boxes(self, n: int, action: Action) -> Column:
        """The boxes of one action on a page as structs (action, nth, mark)."""
        letters = F.col("letters")
        if action.kind == "area":
            boxes = F.array(G.rect(*map(F.lit, action.value)))
        elif action.kind == "text":
            boxes = F.transform(T.match_ranges(F.col("_text"), F.col("form"), [action.value], ignore_case=False), lambda r: _surrounding(letters, r))
        elif action.kind == "letters":
            boxes = F.transform(F.filter(letters, action.value), lambda x: G.rect(x["l"], x["b"], x["r"], x["t"]))
        else:
            boxes = F.array()
        return F.transform(boxes.cast(f"array<{_BOX}>"), lambda m, i: F.struct(F.lit(n).alias("action"), i.alias("nth"), m.alias("mark")))

    def taken(self, ops: DataFrame, marks: DataFrame) -> DataFrame:
        """ops with action, the first that takes them: an operator goes with a box that crosses its own, with its category, or with all text; else null."""
        crossed = stored(_first_crossing(ops, marks).groupBy(*KEYS, "op_idx").agg(F.min("action").alias("_crossed")))
        by_kind = F.lit(None).cast("int")
        for n, action in reversed(list(enumerate(self.actions))):
            if action.kind in ("all_text", "category"):
                by_kind = F.when(F.col("category") == (action.value or "TextShowing"), n).otherwise(by_kind)
        return ops.join(crossed, [*KEYS, "op_idx"], "left").withColumn("action", F.least("_crossed", by_kind)).drop("_crossed")

    def apply(self, ops: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(operators after it, counts) of ops (doc_id, page_no, op_idx, name, category, box, text) on pages (doc_id, page_no, letters), or
        (doc_id, page_no, lines) with the layout's letters.

        The operators that are left keep their order; behind them each box is painted over by five operators, unless without_markers. The counts (doc_id, page_no,
        operators_removed, areas_redacted, text_occurrences, letters_redacted, categories_removed, all_text_removed) have a row for each page with operators or letters.
        Letters are those of the page as it was, for every action. Operators without a box cross nothing.
        """
        marks = stored(self.marks(pages) if "letters" in pages.columns else self.marks_on_lines(pages))
        judged = self.taken(ops, marks)
        kept = judged.where("action is null").drop("action")
        if self.marked:
            last = ops.groupBy(*KEYS).agg((F.max("op_idx") + 1).alias("_next"))
            steps = F.posexplode(F.array(*map(F.lit, ("q", "rg", "re", "f", "Q")))).alias("_k", "name")
            painted = marks.join(last, KEYS, "left").select(*KEYS, "action", "nth", "mark", F.coalesce("_next", F.lit(0)).alias("_next"), steps)
            place = F.col("_next") + (F.col("action") * 1_000_000 + F.col("nth")) * 5 + F.col("_k")
            new = painted.select(*KEYS, place.cast("long").alias("op_idx"), "name", category(F.col("name")).alias("category"), F.when(F.col("name") == "re", F.col("mark")).alias("box"), F.lit(None).cast("string").alias("text"))
            kept = renumbered(kept.withColumn("op_idx", F.col("op_idx").cast("long")).select(*new.columns).unionByName(new))
        of = lambda kind: [n for n, a in enumerate(self.actions) if a.kind == kind]
        hits = marks.groupBy(*KEYS).agg(F.count_if(F.col("action").isin(*of("area"))).alias("areas_redacted"), F.count_if(F.col("action").isin(*of("text"))).alias("text_occurrences"), F.count_if(F.col("action").isin(*of("letters"))).alias("letters_redacted"))
        gone = judged.groupBy(*KEYS).agg(F.count("action").alias("operators_removed"))
        counts = gone.join(hits, KEYS, "full").fillna(0, ["operators_removed", "areas_redacted", "text_occurrences", "letters_redacted"])
        return kept, counts.withColumn("categories_removed", F.lit(len(of("category")))).withColumn("all_text_removed", F.lit(bool(of("all_text"))))


def _surrounding(letters: Column, r: Column) -> Column:
    """The box around the letters of a range (a, z)."""
    own = F.slice(letters, r["a"], r["z"] - r["a"])
    return G.rect(F.array_min(F.transform(own, lambda x: x["l"])), F.array_min(F.transform(own, lambda x: x["b"])), F.array_max(F.transform(own, lambda x: x["r"])), F.array_max(F.transform(own, lambda x: x["t"])))


def _first_crossing(ops: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, page_no, op_idx, action) of the operators whose box crosses a mark (strictly, as G.intersects), with the first action of those. Operators and marks of a page meet as
    arrays, as a line's operator may be crossed by a mark for each of its letters and only the first action counts."""
    sides = lambda box: [F.col(f"{box}.{s}").alias(s) for s in "lbrt"]
    by_page = lambda rows, number, box, name: rows.where(F.col(box).isNotNull()).groupBy(*KEYS).agg(F.collect_list(F.struct(F.col(number).alias("n"), *sides(box))).alias(name))
    pages = by_page(ops, "op_idx", "box", "ops").join(by_page(marks, "action", "mark", "marks"), KEYS)

    def numbers(rows: pa.Array) -> list[np.ndarray]:
        return [rows.field(c).to_numpy(zero_copy_only=False) for c in ("n", *"lbrt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hit, action = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (own, taken) in enumerate(zip(batch.column("ops"), batch.column("marks"), strict=True)):
                (n, *box), (kind, *mark) = numbers(own.values), numbers(taken.values)
                first = np.full(len(n), -1)
                for a in np.unique(kind)[::-1]:
                    l, b, r, t = (x[kind == a] for x in mark)  # noqa: E741
                    step = max((1 << 20) // len(l), 1)
                    for s in range(0, len(n), step):
                        x = [c[s : s + step, None] for c in box]
                        first[s : s + step][((x[0] < r) & (x[2] > l) & (x[1] < t) & (x[3] > b)).any(axis=1)] = a
                found = np.flatnonzero(first >= 0)
                at.append(np.full(len(found), i))
                hit.append(n[found])
                action.append(first[found])
            own = [batch.column(k).take(pa.array(np.concatenate(at))) for k in KEYS]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(hit)).cast(number), pa.array(np.concatenate(action).astype(np.int32))], names=[*KEYS, "op_idx", "action"])

    number = pa.int32() if ops.schema["op_idx"].dataType.simpleString() == "int" else pa.int64()
    kinds = ", ".join(f"{k} {ops.schema[k].dataType.simpleString()}" for k in (*KEYS, "op_idx"))
    return pages.mapInArrow(run, f"{kinds}, action int")
