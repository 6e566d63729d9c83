"""Parts of the methods against brute force: fillings, hashes, raking by both ways, repeated ids, very long texts, scores."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import common, knnquality, mixing, packing, suffixdedup, toxicity

from ..conftest import SF


def test_fillings_are_all_the_undominated_ones():
    rng = random.Random(3)
    for _ in range(150):
        counts = dict(Counter(rng.randint(1, 12) for _ in range(rng.randint(1, 9))))
        room, items = rng.randint(1, 20), sorted(Counter(counts).elements())
        every = {tuple(sorted(c, reverse=True)) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room}

        def dominated(f, room=room, counts=counts):
            waste, left = room - sum(f), [s for s in counts if counts[s] > f.count(s)]
            subsets = [c for n in range(len(f) + 1) for c in itertools.combinations(f, n)]
            return any(sum(c) < u <= sum(c) + waste or (u == sum(c) and len(c) > 1) for c in subsets for u in left)

        found = list(packing.fillings(counts, room))
        assert len(found) == len(set(found)) and set(found) == {f for f in every if not dominated(f)}
        assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)


def test_packing_meets_the_bound_on_the_table(spark):
    found = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    n, least = found.sequence_id.nunique(), found.least_sequences.iloc[0]
    assert least <= n <= least + 2 and found.groupby("sequence_id").length.sum().max() <= 1024


def test_hashes_tell_thue_morse_words_apart():
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = (np.array([97 + (b ^ flip) for b in bits], np.uint8) for flip in (0, 1))
    data = np.concatenate([one, two, one])
    prefix = common.prefix_hash(data)
    assert len(set(common.span_hash(prefix, np.array([0, 4096, 8192]), np.array([4096, 8192, 12288])).tolist())) == 2


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.5, "de": 0.5}}])
def test_raking_is_one_rule_in_memory_and_in_spark(spark, targets):
    rng = random.Random(1)
    rows = [(s, g, t, rng.randint(1, 1000)) for s in ("a", "b", None) for g in ("en", "de") for t in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    one, two = ({(r.source, r.lang, r.topic): r.probability for r in mixing.cell_probabilities(cells, targets, driver_cells=n, cycles=4).collect()} for n in (100, 0))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_mixed_marginals(spark):
    """Expected tokens of each category of op5's table against its target share, as far as no cell must give more than it has."""
    found = mixing.mix_documents(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).toPandas()
    kept = found.n_tokens * found.probability
    for name in mixing.DIMENSIONS:
        own = found.groupby(name).n_tokens.sum() / found.n_tokens.sum()
        goal, got = mixing.tempered(own.to_dict(), 0.7), (kept.groupby(found[name]).sum() / kept.sum()).to_dict()
        assert max(abs(goal[k] - got[k]) for k in goal) < 0.035, (name, goal, got)
    assert found[found.probability > 1 - 1e-9].selected.all() and abs(found.selected.mean() - found.probability.mean()) < 0.05


def test_op8_different_texts_of_one_id_and_very_long_texts(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = text(300), text(600)
    long = text(5_000_000)
    rows = [(1, "x" + shared + other), (1, text(900)), (2, shared + "y"), (3, long[4_100_000:4_300_000]), (4, long), (4, long[:100]), (5, None)]
    found = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.n_bytes): r for r in found}
    assert len(found) == len(rows) and by[1, 901].n_removed == 300 and by[1, 900].n_removed == 0 and by[2, 301].n_removed == 300
    assert by[3, 200_000].n_removed == 200_000 and by[4, 100].n_removed == 0
    assert by[4, 5_000_000].n_removed == 200_000 and by[4, 5_000_000].kept_sha256 == hashlib.sha256((long[:4_100_000] + long[4_300_000:]).encode()).hexdigest()


def test_op10_votes_equal_brute_force(spark):
    """Scores remade with all cosines of all voters, sorted."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in knnquality.quality_scores(docs, labels).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    ids = sorted(texts)
    raw = {i: knnquality.feature_counts(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]), 2048)[0] for i in ids}
    df = sum((raw[i] > 0).astype(float) for i in ids)
    idf = (np.log((len(ids) + 1) / (df + 1))).astype(np.float32) + np.float32(0.05)
    label = {r.doc_id: r.quality for r in labels.collect()}
    import zlib

    voters = [i for i in ids if i in label and zlib.crc32(str(i).encode()) % 5]
    x = np.stack([knnquality.weigh(raw[i][None], idf)[0] for i in voters])
    basis = np.linalg.svd(x.astype(float), full_matrices=False)[2][:48].T
    unit = lambda z: z / np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-30)
    latent, y = unit(x @ basis), np.array([label[i] for i in voters])
    close = []
    for i in ids:
        z = knnquality.weigh(raw[i][None], idf)[0]
        if not z.any():
            continue
        cos = latent @ unit(z @ basis)
        near = np.argsort(-cos)[:25]
        w = np.clip(cos[near], 1e-3, 1) ** 4
        close.append(abs((w * y[near]).sum() / w.sum() - found[i].score))
    assert np.quantile(close, 0.98) < 2e-3


def test_op4_scores_follow_the_segments(spark):
    """Scores remade from each text's own scan with the fitted model: brute force over all segments for its best one."""
    docs = spark.createDataFrame([(i, ("idiot trash " * 3 if i % 3 == 0 else "") + " ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS toxic")
    model = toxicity.fit_scores(toxicity.token_counts(docs.join(labels.withColumnRenamed("toxic", "label"), "doc_id")))
    scored = toxicity.scan(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in scored[:60]:
        steps = [model.scores.get(t) or next((model.scores[b] for b in toxicity.beginnings(t) if b in model.scores), model.other) for t in texts[r.doc_id].split()]
        sums = np.concatenate([[0.0], np.cumsum(steps)])
        best = max(sums[j] - sums[i] for i in range(len(sums)) for j in range(i, len(sums)))
        assert abs(max((s.score for s in r.segments), default=0.0) - max(best, 0.0)) < 1e-9
    found = toxicity.toxic_scores(docs, labels, threshold=None)
    assert found.where("(predicted = 1) != (doc_id % 3 = 0)").count() == 0


def test_op4_leaves_clean_texts_of_a_language_with_more_toxic_ones(spark):
    """Plain words of a language with twice the toxic share, some of it in copies, do not add up to a toxic text."""
    draw = random.Random(5)
    rows = []
    for i in range(1200):
        lang = i % 2
        toxic = draw.random() < (0.16 if lang else 0.08)
        words = [f"{'xy'[lang]}{draw.randrange(60)}" for _ in range(draw.randrange(100, 400))]
        rows.append((i, " ".join(["idiot", "trash", *words] if toxic else words), int(toxic)))
    rows += [(1200 + i, next(r[1] for r in rows if r[2] and r[0] % 2), 1) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.toxic_scores(table, table, threshold=None).join(table.select("doc_id", "toxic"), "doc_id")
    assert found.where("toxic = 0 and predicted = 1").count() <= 5
    assert found.where("toxic = 1 and predicted = 0").count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(ValueError):
        common.scratch_dir(Session())
