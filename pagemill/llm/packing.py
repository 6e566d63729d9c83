"""Packing token pieces into sequences of fixed length by bin completion with branch and bound.

The search runs on the histogram of piece lengths, which has at most `capacity` rows whatever the corpus: the largest remaining
length opens a sequence, all its undominated fillings are enumerated (the least waste first), a filling is used as often as the counts
allow, and branches that cannot beat the best solution by their waste are pruned. The first descent, which always takes the
best-fitting filling, is the first incumbent. least_sequences, a lower bound, comes with the result and shows how good it is. Only the resulting patterns go back to the tasks; pieces find their place by their
rank among the pieces of their length, counted in salted groups, so no length has to fit in one task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import stored

Pattern = tuple[tuple[int, ...], int]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE of a tokenizers file; tiktoken merges the same vocabulary by the same ranks and gives the same ids.

    Added tokens are cut out of a text before it is merged, as tokenizers does, and have the ids of the file.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    vocabulary = parsed["model"]["vocab"]
    added = {t["content"]: t["id"] for t in parsed.get("added_tokens") or []}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and token not in added}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def _reference_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str, end_id: int) -> np.ndarray:
    """Ids of a whole text, then the end id; an added token's string in a text is its one id."""
    try:
        ids = _encoder(path).encode_to_numpy(text or "", allowed_special="all")
    except ValueError:
        # Its pattern runs out of stack on about a million blanks on end; the slower library has no such limit.
        ids = np.array(_reference_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids.astype(np.uint32), np.uint32(end_id))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if they fit, else full pieces after a first one with the rest."""
    first = n if n <= capacity else n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def tokenized_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, when asked for, ids) of every document; a null text counts as empty."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            keys = batch.column("doc_id").to_pylist()
            for key, text in zip(keys, batch.column("text"), strict=True):
                ids = token_ids(text.as_py(), path, end_id)
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n]
                    for column, value in zip(columns, (key, k, s, n, zlib.crc32(part.astype("<u4").tobytes()), part.tolist() if with_ids else None), strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def _sums(pieces: list[int]) -> tuple[int, int]:
    """Bit sets of the sums of all subsets of the pieces, and of the subsets of two or more."""
    every, one, more = 1, 0, 0
    for s in pieces:
        more |= (more | one) << s
        one |= 1 << s
        every |= every << s
    return every, more


def fillings(counts: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of the room, one after another: the least waste first, then the largest pieces first.

    Which sums can be reached is found first, as bit sets over the sizes from the smallest up, so no branch of the enumeration is in vain.
    A filling is dominated when a piece that it leaves could stand for none or more of its pieces with less waste, or for two or more
    of them with the same: what is left is then easier to pack.
    """
    sizes = sorted(s for s, n in counts.items() if n > 0 and s <= room)
    within = (1 << (room + 1)) - 1
    reach = [1]
    for s in sizes:
        now, shifted = reach[-1], reach[-1]
        for _ in range(min(counts[s], room // s)):
            shifted = shifted << s & within
            now |= shifted
        reach.append(now)

    def exact(i: int, target: int) -> Iterator[tuple[int, ...]]:
        """Fillings of exactly the target with the i smallest sizes."""
        while i and not target - sizes[i - 1] >= 0:
            i -= 1
        if not target:
            yield ()
        elif i:
            s = sizes[i - 1]
            for n in range(min(counts[s], target // s), -1, -1):
                if reach[i - 1] >> (target - n * s) & 1:
                    for rest in exact(i - 1, target - n * s):
                        yield (s,) * n + rest

    for target in range(room, -1, -1):
        if reach[-1] >> target & 1:
            waste = room - target
            for filling in exact(len(sizes), target):
                left = sum(1 << s for s in sizes if counts[s] > filling.count(s))
                every, more = _sums(list(filling))
                if not more & left and not any(every << w & left for w in range(1, waste + 1)):
                    yield filling


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: all tokens over the capacity, and pieces of over half of it share no sequence."""
    return max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))


def plan_sequences(counts: dict[int, int], capacity: int, node_limit: int = 2000) -> list[Pattern]:
    """Patterns (lengths, how often) that hold exactly the given pieces in as few sequences as the search finds.

    Depth first: each node has the generator of its fillings, the best-fitting one first, so the first descent is the first incumbent. A
    node is left when its sequences and those that its remaining tokens need at least are as many as the incumbent's. The search
    ends when the incumbent meets least_sequences, when all undominated fillings are tried, or after node_limit nodes; the first descent is
    never cut short.
    """
    bound = least_sequences(counts, capacity)
    best: list[Pattern] | None = None
    best_bins = nodes = 0

    def node(left: dict[int, int], bins: int) -> tuple:
        largest = max(left)
        rest = {s: n - (s == largest) for s, n in left.items() if n - (s == largest)}
        return left, bins, sum(s * n for s, n in left.items()), largest, fillings(rest, capacity - largest)

    start = {s: n for s, n in counts.items() if n > 0}
    if not start:
        return []
    stack, trail = [node(start, 0)], []
    while stack:
        left, bins, tokens, largest, options = stack[-1]
        filling = None
        if best is None or (bins + -(-tokens // capacity) < best_bins and nodes < node_limit and best_bins > bound):
            filling = next(options, None)
        if filling is None:
            stack.pop()
            if trail:
                trail.pop()
            continue
        nodes += 1
        pattern = (largest, *filling)
        uses = {s: pattern.count(s) for s in set(pattern)}
        times = min(left[s] // k for s, k in uses.items())
        rest = {s: n - uses.get(s, 0) * times for s, n in left.items()}
        rest = {s: n for s, n in rest.items() if n}
        trail.append((pattern, times))
        if rest:
            stack.append(node(rest, bins + times))
            continue
        if best is None or bins + times < best_bins:
            best, best_bins = list(trail), bins + times
        trail.pop()
    return best or []


def packed(pieces: DataFrame, capacity: int = 1024, salts: int = 128) -> DataFrame:
    """pieces with sequence_id, offset and least_sequences: every piece once, no sequence over capacity, offsets without gaps.

    least_sequences is the same in all rows: no packing of the pieces has fewer sequences.

    pieces needs doc_id, piece and length (1 to capacity) and should be a stored table, as it is read twice. Rows may repeat.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = stored(salted.groupBy("length", "_salt").count())
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places, taken, base = [], dict.fromkeys(counts, 0), 0
    for lengths, times in plan_sequences(counts, capacity):
        at = 0
        for s in lengths:
            places.append((int(s), taken[s], taken[s] + times, base, at))
            taken[s] += times
            at += s
        base += times
    place = spark.createDataFrame(places, "length long, lo long, hi long, base long, at long")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")
    ranked = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(groups.select("length", "_salt", before.alias("_before")), ["length", "_salt"]).withColumn("_rank", F.col("_n") + F.col("_before"))
    put = ranked.join(place, "length").where("_rank >= lo and _rank < hi")
    return put.select(*pieces.columns, (F.col("base") + F.col("_rank") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset"), F.lit(least_sequences(counts, capacity)).cast("long").alias("least_sequences"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequences: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset, least_sequences.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur; a null id is carried through.
    An empty table gives no rows. Other columns are not read.
    """
    return packed(stored(tokenized_pieces(docs, capacity, end_id, tokenizer_path, with_ids)), capacity)
