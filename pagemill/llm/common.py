"""Helpers shared by the training-data operators: stored intermediate tables and vectorised text hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_103_515_245
_POWERS: dict[str, np.ndarray] = {}
_RUN_DIRS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, as in tests, a new one on this machine;
    on a cluster that folder would not be shared, so there the setting is asked for."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, removed when the driver ends."""
    path = f"{scratch_dir(spark)}/pagemill-{spark.sparkContext.applicationId}"
    if path not in _RUN_DIRS:
        _RUN_DIRS.add(path)
        atexit.register(drop_stored, spark, path)
    return path


def drop_stored(spark: SparkSession, path: str | None = None) -> None:
    """Removes the intermediate tables of this application, for results that have been written; called at the end of the driver."""
    if spark.sparkContext._jsc is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path or _run_dir(spark))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage is cut and any executor may be lost later."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(given: DataFrame, name: str = "doc") -> DataFrame:
    """given (doc_id, text) with doc (or another name), a number that no two different texts share: the id where all its rows have one text, else, and for
    null ids, a negative hash of id and text. Only ids with several texts are looked up; as a rule there are none."""
    hashed = given.withColumn("_h", F.xxhash64("text"))
    several = hashed.where("doc_id is not null").groupBy("doc_id").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo < hi")
    several = stored(several.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_several")))
    own = -(F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))) - 2
    looked = hashed.drop("_h").join(several, F.col("doc_id") == F.col("_id"), "left")
    return looked.select(*given.columns, F.when(F.col("doc_id").isNull() | F.col("_several"), own).otherwise(F.col("doc_id")).alias(name))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that close inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PRIME_CODES = (_BYTE_CODES % np.uint64(_PRIME)).astype(np.int64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse; kept for the life of the worker."""
    name = "inv" if inverse else "pow"
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        step = np.full(size, _BASE_INV if inverse else _BASE, np.uint64)
        step[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(step)
    return have[:n]


def prime_powers(n: int, inverse: bool = False) -> np.ndarray:
    """The same modulo the prime 2**31 - 1."""
    name = "prime inv" if inverse else "prime pow"
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = 1 << max((n - 1).bit_length(), 18)
        base = pow(_PRIME_BASE, -1, _PRIME) if inverse else _PRIME_BASE
        have = np.ones(1, np.int64)
        while len(have) < size:
            have = np.concatenate([have, have * pow(base, len(have), _PRIME) % _PRIME])
        _POWERS[name] = have
    return have[:n]


Prefix = tuple[np.ndarray, np.ndarray]


def prefix_hash(data: np.ndarray) -> Prefix:
    """Prefix sums p with span_hash(p, s, e) a polynomial hash of data[s:e]: modulo 2**64 and modulo a prime. The power of two alone
    would take some strings of 1,024 and more bytes for equal (Thue-Morse); the prime tells them apart."""
    out, prime = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.int64)
    np.cumsum(_BYTE_CODES[data] * powers(len(data)), out=out[1:])
    np.cumsum(_PRIME_CODES[data] * prime_powers(len(data)) % _PRIME, out=prime[1:])
    return out, prime


def span_hash(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end); equal spans have equal hashes wherever they are."""
    inv, prime_inv = powers(len(prefix[0]), inverse=True), prime_powers(len(prefix[0]), inverse=True)
    second = (prefix[1][end] - prefix[1][start]) % _PRIME * prime_inv[start] % _PRIME
    return mix((prefix[0][end] - prefix[0][start]) * inv[start] + (end - start).astype(np.uint64)) ^ mix(second.astype(np.uint64) + np.uint64(1))


def short_span_hash(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The part of span_hash modulo 2**64 alone, for spans of well under 1,024 bytes."""
    inv = powers(len(prefix[0]), inverse=True)
    return mix((prefix[0][end] - prefix[0][start]) * inv[start] + (end - start).astype(np.uint64))


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and one past the last) of the words; words never cross documents."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    begin, stop = ~space, ~space
    edge_before, edge_after = np.ones(len(data), bool), np.ones(len(data), bool)
    edge_before[1:] = space[:-1]
    edge_after[:-1] = space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge_before[inner] = True
    edge_after[inner - 1] = True
    starts = np.flatnonzero(begin & edge_before)
    ends = np.flatnonzero(stop & edge_after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of the words with A-Z lower-cased."""
    starts, ends, bounds = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, bounds
    return span_hash(prefix_hash(_LOWER[data]), starts, ends), starts, ends, bounds


def short_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of well under 1,024 bytes with A-Z lower-cased, by their sums modulo 2**64 alone."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[_LOWER[data]] * powers(len(data)), out=sums[1:])
    return short_span_hash((sums, sums), starts, ends)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document the sorted distinct 64-bit hashes of its k-word shingles; with 1 to k-1 words, of the whole sequence."""
    words, _, _, bounds = word_hashes(data, offsets)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    n = max(len(words) - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled += words[i : i + n] * factors[i]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.uint64((words[a:b] * factors[: b - a]).sum(dtype=np.uint64)) + np.uint64(b - a)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
