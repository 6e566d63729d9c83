"""Toxic passages by maximum-scoring segment search over token log-odds, aggregated by extreme-value calibration.

1. Log-odds. Over the labelled training rows, at most about `train_rows` of them so that they can be sent to the texts, the number
   of toxic and of other texts with a token gets an informative Dirichlet prior (the token's share of both, `prior_mass`
   pseudo-tokens); the log-odds ratio and its standard error give a z-score. Beginnings of tokens of three to seven letters
   are counted likewise and stand for tokens that are too rare themselves. The lexicon keeps all with |z| >= min_z that are at least min_ratio
   times as likely in one class as in the other, by plain shares: weaker ones, such as the plain words of a language with somewhat more toxic texts, would
   add up over a long text to a segment of the whole. The bounded training rows bound it. All other tokens share the log-odds of their summed counts.
2. Scan. One linear pass over a whole text finds all disjoint maximal-scoring segments; runs of tokens outside the lexicon are
   one step each.
3. Calibration. A segment of score S in a text of m tokens has the expected count E = K m exp(-lambda S); lambda solves
   sum p exp(lambda s) = 1 over the scores of non-toxic text, K is fitted to the best scores of non-toxic training texts. A text's
   evidence is the sum of -ln E over its segments with E <= 1 (else that of its best segment), and one logistic curve over the
   evidence of all training texts turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

_TOKEN = re.compile(r"\w+")
#: Letters of the beginnings that stand for rare tokens, the longest first.
BEGINNINGS = (7, 6, 5, 4, 3)
SCANNED = "doc_id long, n_tokens long, segments array<struct<start:int,end:int,score:double>>"


def fold(text: str) -> str:
    """Lower case with the length kept, so that offsets in the result are offsets in the text."""
    return text.replace("İ", "i").lower()


def beginnings(token: str) -> list[str]:
    """What stands for a token that is not in the lexicon itself, the longest first."""
    return [f"{token[:n]}*" for n in BEGINNINGS if len(token) > n]


class _Scores(dict):
    """Scores by token, filled as tokens are met: the token's own, else that of its longest beginning in the lexicon, else None."""

    def __init__(self, scores: dict[str, float], most: int = 1_000_000):
        super().__init__()
        self.known, self.most = scores, most

    def __missing__(self, token: str) -> float | None:
        found = self.known.get(token)
        if found is None:
            found = next((self.known[b] for b in beginnings(token) if b in self.known), None)
        if len(self) >= self.most:
            self.clear()
        self[token] = found
        return found


@dataclass(frozen=True)
class Model:
    """Token scores, the score of every other token, and the two constants of the extreme-value law."""

    scores: dict[str, float]
    other: float
    decay: float
    base: float = 0.1
    intercept: float = 0.0
    slope: float = 1.0
    cut: float = 0.5


def maximal_segments(steps: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of (first token, end token, score) steps, in linear time.

    A stack holds candidate segments with the running sums before and after each; a new positive step joins the nearest earlier
    candidate that starts lower, as long as that one ended lower too.
    """
    stack: list[tuple[float, float, int, int]] = []
    total = 0.0
    for first, end, score in steps:
        before, total = total, total + score
        if score <= 0:
            continue
        lo, hi, start = before, total, first
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= lo:
                j -= 1
            if j < 0 or stack[j][1] >= hi:
                stack.append((lo, hi, start, end))
                break
            lo, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(start, end, hi - lo) for lo, hi, start, end in stack]


def scan_text(text: str, scores: _Scores, other: float) -> tuple[int, list[tuple[int, int, float]]]:
    """Token count of the whole text and its maximal segments as character spans with their scores."""
    folded = fold(text)
    tokens = _TOKEN.findall(folded)
    hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s is not None]
    if not any(s > 0 for _, s in hits):
        return len(tokens), []
    steps, at = [], 0
    for i, s in hits:
        if i > at:
            steps.append((at, i, other * (i - at)))
        steps.append((i, i + 1, s))
        at = i + 1
    found = maximal_segments(steps)
    spans = [m.span() for m in _TOKEN.finditer(folded)]
    return len(tokens), [(spans[a][0], spans[b - 1][1], s) for a, b, s in found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["token", "toxic", "clean"])
        counts[0].clear()
        counts[1].clear()
        return batch

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            words = set(_TOKEN.findall(fold(text.as_py() or "")))
            counts[label].update(words | {b for w in words for b in beginnings(w)})
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield out()
    yield out()


def token_counts(train: DataFrame) -> DataFrame:
    """(token, toxic, clean): texts of train (text, label 0 or 1) with the token, so that one text's repetitions count once."""
    return train.select("text", "label").mapInArrow(_count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_scores(counts: DataFrame, prior_mass: float = 10_000.0, min_z: float = 3.0, min_ratio: float = 5.0) -> Model:
    """Log-odds with Dirichlet priors from token counts; with one class missing or no tokens, a model without a lexicon."""
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n_t, n_c = float(sums[0] or 0), float(sums[1] or 0)
    if not n_t or not n_c:
        return Model({}, -0.01, 1.0)
    prior = prior_mass * (F.col("toxic") + F.col("clean")) / (n_t + n_c)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (n_t + prior_mass - t)) - F.log(c / (n_c + prior_mass - c))
    scored = counts.select("token", "toxic", "clean", odds.alias("s"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"))
    ratio = F.log((F.col("toxic") + 0.5) / n_t) - F.log((F.col("clean") + 0.5) / n_c)
    rows = scored.where((F.abs("z") >= min_z) & (F.abs(ratio) >= math.log(min_ratio)) & (F.col("toxic") + F.col("clean") >= 5)).orderBy(F.abs("z").desc(), "token").collect()
    scores = {r.token: r.s for r in rows}
    rest_t, rest_c = n_t - sum(r.toxic for r in rows), n_c - sum(r.clean for r in rows)
    other = min(math.log((rest_t + 1) / (n_t + 2)) - math.log((rest_c + 1) / (n_c + 2)), -1e-4)
    p = np.array([r.clean + 0.5 for r in rows] + [rest_c + 0.5])
    p, s = p / p.sum(), np.array([r.s for r in rows] + [other])
    lo, hi = 1e-3, 8.0
    if (p * s).sum() >= 0 or s.max() <= 0:
        decay = 1.0
    else:
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (p * np.exp(mid * s)).sum() > 1 else (mid, hi)
        decay = (lo + hi) / 2
    return Model(scores, other, decay)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, segments) of whole texts; segments are character spans with scores. Null texts have no tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, other = _Scores(sent.value.scores), sent.value.other
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            found = [scan_text(x.as_py() or "", scores, other) for x in batch.column("text")]
            lists = pa.array([[{"start": a, "end": b, "score": s} for a, b, s in segs] for _, segs in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), lists], names=["doc_id", "n_tokens", "segments"])

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)


def _best() -> Column:
    return F.array_max(F.transform("segments", lambda s: s["score"]))


def evidence(model: Model) -> Column:
    """Sum of -ln E over segments with E <= 1, else -ln E of the best segment, on a logarithmic scale on both sides of 0: it has no
    ends, and still few values when rounded. Texts without a segment are as one with E = 10 a token."""
    log_e = lambda s: F.lit(math.log(model.base)) + F.log(F.greatest("n_tokens", F.lit(1))) - model.decay * s
    total = F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + F.greatest(-log_e(s["score"]), F.lit(0.0)))
    best = -F.coalesce(log_e(_best()), F.log(10.0 * F.greatest("n_tokens", F.lit(1))))
    found = F.when(best > 0, total).otherwise(best)
    return F.signum(found) * F.log1p(F.abs(found))


def calibrate(scanned: DataFrame, labels: DataFrame, model: Model) -> Model:
    """The model with K from non-toxic training texts, and a logistic curve and a balanced cut from a histogram of all training texts.

    The cut is the score from which on the share of toxic texts that it catches, less that of other texts, is largest."""
    joined = stored(scanned.join(labels.select("doc_id", "label"), "doc_id"))
    excess = model.decay * _best() - F.log(F.greatest("n_tokens", F.lit(1)))
    mean = joined.where("label = 0 and size(segments) > 0").agg(F.avg(excess)).first()[0]
    base = math.exp(min(max((mean if mean is not None else -2.3) - 0.5772, -12.0), 3.0))
    model = Model(model.scores, model.other, model.decay, base)
    bins = joined.groupBy(F.round(evidence(model), 2).alias("x"), "label").count().collect()
    if len({r.label for r in bins}) < 2:
        share = 0.99 if any(r.label for r in bins) else 0.01
        return Model(model.scores, model.other, model.decay, base, math.log(share / (1 - share)), 0.0)
    x, y, w = (np.array(v, float) for v in zip(*((r.x, r.label, r["count"]) for r in bins), strict=True))
    a, b = 0.0, 0.1
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum() - 1e-3 * b])
        h = w * p * (1 - p) + 1e-9
        m = np.array([[h.sum(), (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    b = max(b, 1e-6)
    ends = np.unique(x)
    gain = [(w * y)[x >= e].sum() / (w * y).sum() - (w * (1 - y))[x >= e].sum() / (w * (1 - y)).sum() for e in ends]
    best = ends[int(np.argmax(gain))]
    return Model(model.scores, model.other, model.decay, base, a, b, float(1 / (1 + np.exp(-(a + b * (best - 0.005))))))


def training_labels(labels: DataFrame, label_col: str, keep: Column) -> DataFrame:
    """(doc_id, label) of the training rows that have an id and a label; of repeated ids, the largest label counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & keep)
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label")).where("label in (0, 1)")


def fold_of(mod: int) -> Column:
    """crc32 of the id as text modulo `mod`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows of (doc_id, label) by a hash of the id; all of them when there are no more than that."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def toxic_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 4, held_out_rest: int = 2, threshold: float | None = 0.3, train_rows: int = 50_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_tokens, segments), one row for every row of docs.

    predicted: the score is at least the threshold; without one, at least the balanced cut that the training rows give.

    segments: the significant passages (E <= 1) as character spans with scores. Texts without tokens (null, empty) get the score
    of a text without evidence. Rows with a null id are scored, not held out, and never trained on. With an empty label table
    every score is the same. Labels, language, source and id never enter a score; other columns are not read.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = training_labels(labels, "toxic", fold_of(held_out_mod) != held_out_rest)
    train = F.broadcast(bounded_sample(rows, train_rows))
    model = fit_scores(stored(token_counts(given.join(train, "doc_id"))))
    scanned = stored(scan(given, model))
    model = calibrate(scanned, rows, model)
    score = 1 / (1 + F.exp(-(F.lit(model.intercept) + model.slope * evidence(model))))
    log_e = lambda s: F.lit(math.log(model.base)) + F.log(F.greatest("n_tokens", F.lit(1))) - model.decay * s["score"]
    out = scanned.select("doc_id", F.coalesce(fold_of(held_out_mod) == held_out_rest, F.lit(False)).alias("held_out"), score.alias("score"), "n_tokens", F.filter("segments", lambda s: log_e(s) <= 0).alias("segments"))
    return out.withColumn("predicted", (F.col("score") >= (model.cut if threshold is None else threshold)).cast("int"))
