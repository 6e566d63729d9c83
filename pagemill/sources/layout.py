"""Layout adapter: documents as pages of letters with synthetic, deterministic geometry.

A line of text is a line of the page, 60 lines a page; a letter is 5 wide and 10 high, columns are 6 and rows 12 apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.geometry import rect
from pagemill.session import spread

LINES_PER_PAGE = 60


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, row, text): every line of every document; a null text has none."""
    lines = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return lines.select("doc_id", (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("int").alias("page_no"), "line_no", (F.col("line_no") % LINES_PER_PAGE).alias("row"), "text")


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): the lines of each page joined again."""
    lined = docs.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    numbered = lined.select("doc_id", "lines", F.explode(F.sequence(F.lit(1), F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int"))).alias("page_no"))
    return numbered.select("doc_id", "page_no", F.array_join(F.slice("lines", (F.col("page_no") - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n").alias("text"))


def letters(docs: DataFrame, keep_spaces: bool = True) -> DataFrame:
    """(doc_id, page_no, line_no, col, value, box): one row for each code point; without spaces their columns stay empty."""
    found = text_lines(docs).select("doc_id", "page_no", "line_no", "row", F.posexplode(F.split("text", "")).alias("col", "value")).where("value <> ''")
    if not keep_spaces:
        found = found.where("value <> ' '")
    left, bottom = 72 + 6 * F.col("col"), 720 - 12 * F.col("row")
    return found.select("doc_id", "page_no", "line_no", "col", "value", rect(left, bottom, left + 5, bottom + 10).alias("box"))


def page_letters(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, letters): the letters of each page as one array of (line_no, col, value, l, b, r, t) in reading order; a page of empty lines has an empty one."""

    def letter(line_no: Column, row: Column) -> Callable[[Column, Column], Column]:
        left, bottom = lambda c: 72.0 + 6 * c, 720.0 - 12 * row
        sides = lambda c: (left(c).alias("l"), bottom.alias("b"), (left(c) + 5).alias("r"), (bottom + 10).alias("t"))
        return lambda v, c: F.struct(line_no.cast("int").alias("line_no"), c.alias("col"), v.alias("value"), *sides(c))

    def page(lines: Column) -> Callable[[Column], Column]:
        values = lambda line: F.filter(F.split(line, ""), lambda v: v != "")
        return lambda p: F.flatten(F.transform(F.slice(lines, p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), lambda line, r: F.transform(values(line), letter(p * LINES_PER_PAGE + r, r))))

    lined = spread(docs.where("text is not null").select("doc_id", "text")).select("doc_id", F.split("text", "\n", -1).alias("lines"))
    n = F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), page(F.col("lines")))
    return lined.select("doc_id", F.posexplode(made).alias("page_no", "letters")).select("doc_id", (F.col("page_no") + 1).alias("page_no"), "letters")


def page_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, lines array<string>): a row for each page, with its lines; a null text has none."""
    lined = spread(docs.where("text is not null").select("doc_id", "text")).select("doc_id", F.split("text", "\n", -1).alias("lines"))
    numbered = lined.select("doc_id", "lines", F.explode(F.sequence(F.lit(1), F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int"))).alias("page_no"))
    return numbered.select("doc_id", "page_no", F.slice("lines", (F.col("page_no") - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)).alias("lines"))


@dataclass(frozen=True)
class PageLetters:
    """The letters of some pages, one after another: code (code point), page (from 0), row and col of each, left and bottom of its place; of the pages first (letter, and one past the last)."""

    code: np.ndarray
    page: np.ndarray
    row: np.ndarray
    col: np.ndarray
    left: np.ndarray
    bottom: np.ndarray
    first: np.ndarray

    @property
    def right(self) -> np.ndarray:
        return self.left + 5

    @property
    def top(self) -> np.ndarray:
        return self.bottom + 10

    def text(self, page: int) -> str:
        return self.code[self.first[page] : self.first[page + 1]].tobytes().decode("utf-32-le")

    @property
    def blank(self) -> np.ndarray:
        """White space, as \\s has it."""
        return (self.code == 32) | ((self.code >= 9) & (self.code <= 13))

    def texts(self, order: np.ndarray, start: np.ndarray) -> pa.Array:
        """The letters in an order as strings, each from one of the starts to the next."""
        code = self.code[order]
        width = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
        ends = np.append(np.int32(0), np.cumsum(width, dtype=np.int32))
        data = code.tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends[np.append(start, len(code))]), pa.py_buffer(data))


def page_letter_arrays(batch: pa.RecordBatch, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, PageLetters]]:
    """Rows of page_lines in pieces of about `limit` letters, each with its letters where the layout puts them."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("lines")), 0).to_numpy().astype(np.int64)
    lines = batch.column("lines").flatten().cast(pa.large_string()).fill_null("")
    at = np.append(0, np.cumsum(sizes))
    letters = np.append(0, np.cumsum(pc.utf8_length(lines).to_numpy()))
    lo = 0
    while lo < batch.num_rows:
        hi = min(max(int(np.searchsorted(letters[at], letters[at[lo]] + limit, "right")) - 1, lo + 1), batch.num_rows)
        own = lines.slice(at[lo], at[hi] - at[lo])
        n = np.diff(letters[at[lo] : at[hi] + 1])
        code = np.frombuffer("".join(own.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        page = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        row = np.arange(len(n)) - np.repeat(at[lo:hi] - at[lo], sizes[lo:hi])
        line = np.repeat(np.arange(len(n)), n)
        col = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        yield batch.slice(lo, hi - lo), PageLetters(code, page[line], row[line], col, 72.0 + 6 * col, 720.0 - 12 * row[line], letters[at[lo : hi + 1]] - letters[at[lo]])
        lo = hi


def line_letters(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, row, letters): the letters of each line as an array of (value, box), place i in column i."""
    values = F.filter(F.split("text", ""), lambda v: v != "")
    bottom = 720 - 12 * F.col("row")
    boxed = F.transform(values, lambda v, i: F.struct(v.alias("value"), rect(72 + 6 * i, bottom, 77 + 6 * i, bottom + 10).alias("box")))
    return text_lines(docs).select("doc_id", "page_no", "line_no", "row", boxed.alias("letters"))
