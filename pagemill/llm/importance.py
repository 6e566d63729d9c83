"""Importance resampling towards a target: hashed n-gram features, gains from two histograms, and a Gumbel top-k draw.

The words of a text, joined by one space, are scanned once: the CRC-32 of every prefix that ends a word is kept. The CRC of any
run of words then follows from two prefixes. With B the run, A what stands before it and n the bytes of B,
crc(A + B) = x^(8n) * crc(A) + crc(B) over GF(2), so crc(B) is the later prefix's CRC plus the earlier one's, shifted by n bytes.
Shifts by powers of two are tables of 4 x 256 words, and a shift by n applies those of n's binary digits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored, text_chunks

#: Bytes of words: digits, letters (A-Z as a-z) and all beyond ASCII; any other byte separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACED = re.compile(rb" ?[^ ]+")
#: The reversed polynomial of CRC-32 (a fixed value).
_POLYNOMIAL = 0xEDB88320


@cache
def byte_table() -> np.ndarray:
    """The CRC register after one byte, by the low byte of the register and the byte given."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), c >> np.uint32(1))
    return c


@cache
def shift_tables(power: int) -> np.ndarray:
    """(4, 256): what each byte of a CRC becomes when 2**power zero bytes follow; tables of a shift come from applying half of it twice."""
    byte = np.arange(256, dtype=np.uint32)
    if power:
        half = shift_tables(power - 1)
        return np.stack([_apply(half, _apply(half, byte << np.uint32(8 * k))) for k in range(4)])
    return np.stack([byte_table(), *(byte << np.uint32(8 * k) for k in range(3))])


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(0xFF)
    return tables[0][crc & low] ^ tables[1][(crc >> np.uint32(8)) & low] ^ tables[2][(crc >> np.uint32(16)) & low] ^ tables[3][crc >> np.uint32(24)]


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """x^(8 n) times each CRC: the part that a prefix's CRC has in the CRC of the prefix and n more bytes."""
    out = crc.copy()
    for power in range(int(n_bytes.max(initial=0)).bit_length()):
        on = (n_bytes >> power) & 1 == 1
        out[on] = _apply(shift_tables(power), out[on])
    return out


def normalised_words(text: bytes) -> bytes:
    """The words of a text in lower case, joined by one space."""
    return b" ".join(text.translate(_WORD_BYTES).split())


def feature_crcs(data: np.ndarray, offsets: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run up to `longest`: the CRCs of all runs, and the number of the text that each is in."""
    raw = data.tobytes()
    ends: list[int] = []
    sizes: list[int] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        pieces = _SPACED.findall(normalised_words(raw[a:b]))
        counts[i] = len(pieces)
        if pieces:
            ends.extend(accumulate(pieces, lambda crc, piece: zlib.crc32(piece, crc), initial=0))
            sizes.append(0)
            sizes.extend(map(len, pieces))
    # Each text with words has one prefix more than words, the empty one; a prefix that is followed by a word goes on with a space.
    end, stop = np.array(ends, np.uint32), np.cumsum(np.array(sizes, np.int64))
    some = counts > 0
    first = np.concatenate([[0], np.cumsum(counts[some] + 1)])[:-1].astype(np.int64)
    empty = np.zeros(len(end), bool)
    empty[first] = True
    spaced = ~(byte_table()[(~end ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (~end >> np.uint32(8)))
    start = np.where(empty, np.uint32(0), spaced)
    begin = stop + ~empty
    text = np.repeat(np.flatnonzero(some), counts[some] + 1)
    for k in range(1, longest + 1):
        at = np.flatnonzero(text[k:] == text[:-k]) if len(text) > k else np.zeros(0, np.int64)
        yield end[at + k] ^ shifted(start[at], stop[at + k] - begin[at]), text[at]


def bucket_counts(table: DataFrame, text_col: str, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket, for buckets with any; each task sends one histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                for crc, _ in feature_crcs(data, offsets, longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    return table.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """For each bucket floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))); the array has `buckets` numbers, whatever the corpus."""
    spark = docs.sparkSession
    both = bucket_counts(docs, "text", buckets, longest).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, "text", buckets, longest).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = stored(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["s", "t"])
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(total.s + buckets)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(total.t + buckets)))
    rows = every.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()
    gains = np.zeros(buckets, np.int64)
    for r in rows:
        gains[r.bucket] = r.gain
    return gains


def _gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 hexadecimal digits of sha256('seed:doc_id')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def top_ranks(scored: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """scored with rank (1, 2, ... in the given order, null beyond `keep`), by ranges: rows are dealt out by order, each range is sorted
    and counted, and a row's rank is its place in its range after all rows of the ranges before. No task holds more than a range."""
    spark = scored.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = scored.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt = stored(dealt.withColumn("range_no", F.shiftright(place, 33).cast("int")).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r.range_no: r.n for r in dealt.groupBy("range_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = dict(zip(sorted(counts), accumulate((counts[k] for k in sorted(counts)), initial=0)))
    offsets = spark.createDataFrame([(k, v) for k, v in before.items()], "range_no int, rows_before long")
    rank = F.col("rows_before") + F.col("place") + 1
    return dealt.join(F.broadcast(offsets), "range_no").withColumn("rank", F.when(rank <= keep, rank)).drop("range_no", "place", "rows_before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 3, min_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for every row of docs; docs and target need doc_id (docs only) and text.

    rank is null for rows that are not drawn; percent of the rows with at least min_words words are, those of the highest score, ties
    to the smaller id. Null and empty texts have no features and weight 0. A null id draws with the hash of an empty id and comes last among equal
    scores. Rows of the same id are documents of their own: they draw the same number, and equal rows take ranks in any order. Other
    columns are not read. With an empty target every t is 0; with empty docs the result is empty.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = bucket_gains(given, target, buckets, longest)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                n = hi - lo
                words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for k, (crc, text) in enumerate(feature_crcs(data, offsets, longest)):
                    found = np.bincount(text, minlength=n)
                    words = found if k == 0 else words
                    features += found
                    weight += np.bincount(text, gains[crc % np.uint32(buckets)], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = given.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= min_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = top_ranks(able, order, percent * able.count() // 100)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
