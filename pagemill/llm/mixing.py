"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling.

Tokens are counted by cells (source, language, topic). Cell weights are raked to the marginal targets of the three dimensions
in turn until they settle; no cell may get more tokens than it has, so after each cycle weights are trimmed to that and raked
again. A document is kept with the probability weight / tokens of its cell, by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored, text_chunks, word_hashes

DIMENSIONS = ("source", "lang", "topic")
#: Raking ends after so many cycles, or when no weight has moved by more than this share of the budget.
CYCLES, TOLERANCE = 200, 1e-9
Targets = Mapping[str, Mapping[object, float]]


def with_topics(docs: DataFrame, topics: int = 8, least_bytes: int = 6) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens): words of the whole text, and the class most of its longer words fall in.

    Classes are shares of the vocabulary by word hash, ties go to the lower class, texts without longer words to class 0. A
    corpus with topics of its own passes them to `mixed` instead. Null source or language is a category of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                words, starts, ends, bounds = word_hashes(data, offsets)
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                long = ends - starts >= least_bytes
                votes = np.bincount(doc[long] * topics + (words[long] % np.uint64(topics)).astype(np.int64), minlength=(hi - lo) * topics)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("lang"), pa.array(votes.reshape(-1, topics).argmax(axis=1).astype(np.int32)), pa.array(np.diff(bounds))], names=["doc_id", "source", "lang", "topic", "n_tokens"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, source string, lang string, topic int, n_tokens long")


def tempered(shares: Mapping[object, float], power: float) -> dict[object, float]:
    """Shares raised to a power under 1 and made to sum to 1: large categories shrink, small ones grow."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(tokens: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], budget: float, cycles: int = CYCLES, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights of about the budget in sum whose marginals meet the targets (shares) as far as tokens allow."""
    weights = tokens * min(1.0, budget / max(tokens.sum(), 1.0))
    for _ in range(cycles):
        start = weights
        for member, target in zip(members, targets, strict=True):
            sums = np.bincount(member, weights, len(target))
            weights = weights * np.divide(target * budget, sums, out=np.zeros(len(target)), where=sums > 0)[member]
        weights = np.minimum(weights, tokens)
        if np.abs(weights - start).max(initial=0.0) <= tolerance * max(budget, 1.0):
            break
    return weights


def _rake_in_spark(cells: DataFrame, targets: DataFrame, budget: float, total: float, cycles: int = CYCLES, tolerance: float = TOLERANCE) -> DataFrame:
    """The same raking with the same end as joins and aggregates, for more cells than a driver should hold. targets: dimension, value, share."""
    now = cells.withColumn("weight", F.col("tokens") * min(1.0, budget / max(total, 1.0)))
    for _ in range(cycles):
        now = now.withColumn("_start", F.col("weight"))
        for name in DIMENSIONS:
            goal = targets.where(F.col("dimension") == name).select(F.col("value").alias("_v"), "share")
            factor = now.groupBy(F.col(name).cast("string").alias("_k")).agg(F.sum("weight").alias("_s"))
            factor = factor.join(goal, F.col("_k").eqNullSafe(F.col("_v")), "left").select("_k", F.coalesce(F.try_divide(F.col("share") * budget, F.col("_s")), F.lit(0.0)).alias("_f"))
            now = now.join(factor, F.col(name).cast("string").eqNullSafe(F.col("_k"))).withColumn("weight", F.col("weight") * F.col("_f")).drop("_k", "_f")
        now = stored(now.withColumn("weight", F.least("weight", F.col("tokens").cast("double"))))
        if (now.agg(F.max(F.abs(F.col("weight") - F.col("_start")))).first()[0] or 0.0) <= tolerance * max(budget, 1.0):
            break
        now = now.drop("_start")
    return now


def cell_probabilities(cells: DataFrame, targets: Targets | None = None, power: float = 0.7, keep_share: float = 0.75, driver_cells: int = 100_000, cycles: int = CYCLES) -> DataFrame:
    """(source, lang, topic, probability) from (source, lang, topic, tokens).

    A dimension without given targets gets its own shares to the given power. Categories that given targets leave out get
    weight 0. Up to driver_cells cells are raked in memory, more as Spark jobs, by one rule and to the same end.
    """
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    budget = keep_share * total
    if cells.count() > driver_cells:
        parts = []
        for name in DIMENSIONS:
            if targets and name in targets:
                parts.append(spark.createDataFrame([(name, None if k is None else str(k), float(v)) for k, v in targets[name].items()], "dimension string, value string, share double"))
            else:
                raised = cells.groupBy(F.col(name).cast("string").alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("r"))
                norm = raised.agg(F.sum("r")).first()[0] or 1.0
                parts.append(raised.select(F.lit(name).alias("dimension"), "value", (F.col("r") / norm).alias("share")))
        raked = _rake_in_spark(cells, stored(parts[0].unionByName(parts[1]).unionByName(parts[2])), budget, total, cycles)
        return raked.select(*DIMENSIONS, F.coalesce(F.try_divide("weight", "tokens"), F.lit(1.0)).alias("probability"))
    rows = cells.collect()
    tokens = np.array([r.tokens for r in rows], float)
    members, goals = [], []
    for name in DIMENSIONS:
        values = sorted({r[name] for r in rows}, key=lambda v: (v is not None, str(v)))
        number = {v: i for i, v in enumerate(values)}
        members.append(np.array([number[r[name]] for r in rows], int))
        sums = np.bincount(members[-1], tokens, len(values)) / max(total, 1.0)
        goal = targets[name] if targets and name in targets else tempered(dict(zip(values, sums, strict=True)), power)
        goals.append(np.array([goal.get(v, 0.0) for v in values], float))
    weights = rake(tokens, members, goals, budget, cycles)
    p = np.divide(weights, tokens, out=np.ones_like(weights), where=tokens > 0)
    found = [(*(r[name] for name in DIMENSIONS), float(x)) for r, x in zip(rows, p, strict=True)]
    return spark.createDataFrame(found, cells.select(*DIMENSIONS).withColumn("probability", F.lit(0.0)).schema)


def mixed(counted: DataFrame, targets: Targets | None = None, power: float = 0.7, keep_share: float = 0.75, seed: int = 11) -> DataFrame:
    """counted (doc_id, source, lang, topic, n_tokens) with probability and selected, one row for every row.

    Cells without tokens are kept. A null id has a hash like any other; rows that repeat an id share its decision within a cell.
    An empty table gives no rows.
    """
    cells = stored(counted.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    p = cell_probabilities(cells, targets, power, keep_share)
    match = None
    for name in DIMENSIONS:
        p = p.withColumnRenamed(name, f"_{name}")
        one = F.col(name).eqNullSafe(F.col(f"_{name}"))
        match = one if match is None else match & one
    point = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    out = counted.join(p, match).drop(*(f"_{name}" for name in DIMENSIONS))
    return out.withColumn("selected", point < F.col("probability"))


def mix_documents(docs: DataFrame, targets: Targets | None = None, topics: int = 8, power: float = 0.7, keep_share: float = 0.75, seed: int = 11) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, selected) of docs, raked to the targets; see `mixed`."""
    return mixed(stored(with_topics(docs, topics)), targets, power, keep_share, seed)
