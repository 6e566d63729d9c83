"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become counts of hashed byte trigrams and of words that repeat the word before (a block of equal features, so that it
weighs as much as many trigrams), both over the whole text, damped, weighted by inverse document frequency over all
documents, and projected on the leading singular directions of a bounded sample of labelled rows. That sample is also the set of
voters: at most `sample` rows, those with the smallest hash of their id, so the matrix that goes to every task holds
sample x rank numbers whatever the corpus. Each document takes exact cosines with every voter, block by block, and the
`neighbours` nearest vote with a power of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import text_chunks, word_hashes
from pagemill.llm.toxicity import fold_of, training_labels


#: Features that all hold the number of repeated words.
REPEATS = 48


def feature_counts(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Counts of hashed byte trigrams, digits as one byte, and in the last features of repeated words; nothing crosses documents."""
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, dims), np.float32)
    if len(data) < 3:
        return out
    digits = (data >= 48) & (data <= 57)
    b = np.where(digits, np.uint8(48), data).astype(np.uint32)
    codes = ((b[:-2] * np.uint32(66049) + b[1:-1] * np.uint32(257) + b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1)
    for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if hi - lo >= 3:
            out[i] = np.bincount(codes[lo : hi - 2], minlength=dims)
    words, _, _, bounds = word_hashes(data, offsets)
    again = np.zeros(len(words) + 1, np.int64)
    again[2:] = np.cumsum(words[1:] == words[:-1])
    first = np.minimum(bounds[:-1] + 1, bounds[1:])
    out[:, dims - REPEATS :] = (again[bounds[1:]] - again[first])[:, None]
    return out


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            for a in range(lo, hi, 512):
                z = min(a + 512, hi)
                part = offsets[a - lo : z - lo + 1]
                yield batch.slice(a, z - a), feature_counts(data[part[0] : part[-1]], part - part[0], dims)


def document_frequencies(docs: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and how many documents there are; tasks send one array each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for part, counts in _rows(batches, dims):
            total += (counts > 0).sum(axis=0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(dims), -1], pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["feature", "n"])

    found = {r.feature: r.n for r in docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(i, 0) for i in range(dims)], float), found.get(-1, 0)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, idf-weighted rows of unit length; a row without features stays zero."""
    x = np.log1p(counts) * idf
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, held_out_rest: int = 0, threshold: float = 0.3, dims: int = 2048, rank: int = 48, sample: int = 3000, neighbours: int = 25, power: int = 4) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbour_similarity), one row for every row of docs.

    score: the similarity-weighted share of label 1 among the nearest voters. Texts of under three bytes (null, empty) have no
    features and get the voters' share of label 1; so do all texts when no row is labelled (then 0.5). Rows with a null id are
    scored, not held out and never vote; of an id with several texts the least votes. Labels, language, source and id never enter a score; other columns are not read.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df, n = document_frequencies(given, dims)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    rows = training_labels(labels, "quality", fold_of(held_out_mod) != held_out_rest).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in _rows(batches, dims):
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([x.tobytes() for x in weigh(counts, idf)], pa.binary())], names=["label", "x"])

    voters = given.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text").mapInArrow(sampled, "label int, x binary").collect()
    y = np.array([r.label for r in voters], np.float32)
    share = float(y.mean()) if len(y) else 0.5
    x = np.stack([np.frombuffer(r.x, np.float32) for r in voters]) if voters else np.zeros((1, dims), np.float32)
    values, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    basis = vectors[:, ::-1][:, : min(rank, len(values))].astype(np.float32)
    latent = x @ basis
    length = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = np.divide(latent, length, out=np.zeros_like(latent), where=length > 0)
    sent = spark.sparkContext.broadcast((idf, basis, latent, y))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, latent, y = sent.value
        k = min(neighbours, len(y))
        for part, counts in _rows(batches, dims):
            z = weigh(counts, idf) @ basis
            norms = np.linalg.norm(z, axis=1)
            score, best = np.full(len(z), share), np.zeros(len(z))
            some = norms > 0
            if k and some.any():
                cos = (z[some] / norms[some, None]) @ latent.T
                near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                sims = np.take_along_axis(cos, near, axis=1)
                w = np.clip(sims, 1e-3, 1.0).astype(float) ** power
                score[some] = (w * y[near]).sum(axis=1) / w.sum(axis=1)
                best[some] = sims.max(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(score, 0.0, 1.0)), pa.array(best)], names=["doc_id", "score", "neighbour_similarity"])

    out = given.mapInArrow(vote, "doc_id long, score double, neighbour_similarity double")
    return out.select("doc_id", F.coalesce(fold_of(held_out_mod) == held_out_rest, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbour_similarity")
