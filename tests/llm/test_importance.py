"""Importance resampling against a plain count of every n-gram, and CRCs of runs against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import importance, queries

from ..conftest import SF

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text, longest=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def buckets_of(text, buckets):
    return Counter(zlib.crc32(x.encode()) % buckets for x in runs(text)[1])


def brute(docs, target, buckets=10_000, min_words=20, percent=5):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets_of(x, buckets))
    for x in target:
        t.update(buckets_of(x, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found = buckets_of(x, buckets)
        weight = sum(gain[b] * n for b, n in found.items())
        rows.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), runs(x)[0]])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=str)


def test_crcs_of_runs():
    rng = random.Random(3)
    texts = ["", "A", "Ab-9 c", "é ü" * 5, "x" * 300 + " " + "y" * 70_000 + " z", "?!"] + [" ".join("".join(rng.choice("abcÉ9.-") for _ in range(rng.randint(1, 40))) for _ in range(50)) for _ in range(30)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = [[] for _ in texts]
    for crc, text in importance.feature_crcs(np.frombuffer(b"".join(raw), np.uint8), offsets, 3):
        for c, i in zip(crc.tolist(), text.tolist(), strict=True):
            got[i].append(c)
    assert got == [[zlib.crc32(x.encode()) for x in runs(t)[1]] for t in texts]


def test_op13_on_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert sorted((tuple(r) for r in queries.op13_importance(spark, SF).collect()), key=str) == brute(docs, target)


def test_edges(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["Aa", "b", "c9", "é"]) for _ in range(rng.randint(15, 60)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, " ,.;"), (None, "one two"), (None, " ".join(["b"] * 40)), (3, texts[3][1])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, rank int, score int").repartition(4)
    target = spark.createDataFrame([("b c9 b c9",), (None,)], "text string")
    found = sorted((tuple(r) for r in importance.resample(docs, target, percent=30).collect()), key=str)
    assert [r[:4] for r in found] == [r[:4] for r in brute(texts, ["b c9 b c9", None], percent=30)]
    # The two equal rows of id 3 may take their ranks in either order.
    assert sorted(r[4] or 0 for r in found) == sorted(r[4] or 0 for r in brute(texts, ["b c9 b c9", None], percent=30))


@pytest.mark.parametrize("side", ["docs", "target", "both"])
def test_empty_tables(spark, side):
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    none = some.where(F.lit(False))
    found = importance.resample(none if side != "target" else some, none if side != "docs" else some, percent=100).collect()
    assert len(found) == (1 if side == "target" else 0) and all(r.rank == 1 for r in found)
