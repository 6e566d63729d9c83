"""The ten operators and the pipeline against brute force, SQL, round trips and held-out labels on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chaining, packing, queries, toxicity
from pagemill.llm.components import connected_components

from ..conftest import SF

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def labels_of(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_op1(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = labels_of(ids, links)
    for r in queries.op1_minhash(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)


def test_op2(spark, texts):
    ids = sorted(texts)
    found = {r.doc_id: r for r in queries.op2_imatch(spark, SF).collect()}
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[nxt][:half]
        assert found[i].n_chars == len(texts[i]) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = {}
    for i in ids:
        assert prints.setdefault(texts[i], found[i].fingerprint) == found[i].fingerprint
    assert np.mean([found[i].near_edited > found[i].near_next for i in ids]) > 0.8


def test_op3(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    n = {r.vec_id: int(k) for r, k in zip(rows, linked.sum(axis=1), strict=True)}
    assert {r.vec_id: r.n_links for r in queries.op3_cover_tree(spark, SF).collect()} == n


def test_op3_on_clusters(spark):
    from pagemill.llm import covertree

    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(12, 8)), 25, axis=0) + rng.normal(scale=0.25, size=(300, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    label = labels_of(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(links), strict=True)])
    for r in covertree.near_vectors(frame, pivots=40, block_rows=32).collect():
        assert (r.n_links, r.component_id) == (links[r.vec_id].sum(), label[r.vec_id])


@pytest.mark.parametrize("query, label, least", [("op4_toxicity", "toxic", 0.88), ("op10_knn_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    folder = SF.replace("0.001", "0.01")
    found = queries.queries()[query](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert (found.predicted == found[label]).mean() >= least


def test_maximal_segments():
    """Every maximal segment by definition, on short score lists."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = rng.integers(-4, 5, rng.integers(1, 12)).astype(float)
        sums = np.concatenate([[0.0], np.cumsum(scores)])

        def proper(i, j):
            return sums[j] > sums[i] and all(sums[i] < sums[k] for k in range(i + 1, j + 1)) and all(sums[j] > sums[k] for k in range(i, j))

        good = [(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1) if proper(i, j)]
        largest = sorted(g for g in good if not any(h != g and h[0] <= g[0] and g[1] <= h[1] for h in good))
        steps = [(i, i + 1, s) for i, s in enumerate(scores)]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(steps)] == largest


def test_op5(spark):
    found = queries.op5_mixing(spark, SF).toPandas()
    assert ((found.probability >= 0) & (found.probability <= 1 + 1e-9)).all()
    kept = (found.n_tokens * found.probability).sum() / found.n_tokens.sum()
    assert 0.6 < kept <= 0.76


def test_rake_meets_marginals():
    from pagemill.llm.mixing import rake

    tokens = np.full(12, 100.0)
    rows, columns = np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)
    weights = rake(tokens, [rows, columns], [np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.3, 0.2, 0.1])], 300.0)
    assert np.allclose(np.bincount(rows, weights), [150, 90, 60], atol=1e-4) and np.allclose(np.bincount(columns, weights), [120, 90, 60, 30], atol=1e-4)


def test_op6(spark, duck):
    found = queries.op6_line_dedup(spark, SF).toPandas().sort_values("doc_id")
    expected = duck.sql(queries.oracle_sql()["op6_line_dedup"]).df().sort_values("doc_id")
    assert found.values.tolist() == expected[found.columns].values.tolist()


def test_op7_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = queries.op7_packing(spark, SF).toPandas()
    for i in sorted(texts)[:60]:
        ids = np.array([*own.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        pieces = found[found.doc_id == i].sort_values("piece")
        assert pieces.length.sum() == len(ids)
        assert [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces.itertuples()] == list(pieces.ids_crc32)


@pytest.mark.parametrize("items", [[6, 5, 5, 4], [7, 6, 4, 3], [5, 5, 5, 3, 2], [9, 8, 2, 1, 5, 5], [4, 4, 4, 4, 4, 2, 6, 8]])
def test_packing_is_optimal_on_small_cases(items):
    def least(left, bins):
        if not left:
            return len(bins)
        options = {b for b in bins if b >= left[0]}
        return min([least(left[1:], tuple(sorted([*[x for k, x in enumerate(bins) if k != bins.index(b)], b - left[0]]))) for b in options] + [least(left[1:], tuple(sorted([*bins, 10 - left[0]])))])

    plan = packing.plan_sequences(Counter(items), 10)
    assert sum(n for _, n in plan) == least(sorted(items, reverse=True), ())
    assert sum((Counter({s: k * n for s, k in Counter(p).items()}) for p, n in plan), Counter()) == Counter(items)


def test_op8(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    count = Counter(b[p : p + 200] for b in raw.values() for p in range(len(b) - 199))
    for r in queries.op8_suffix_array(spark, SF).collect():
        b, gone = raw[r.doc_id], np.zeros(len(raw[r.doc_id]) + 1, bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), gone.sum(), (np.diff(gone.astype(int), prepend=0) == 1).sum(), hashlib.sha256(kept).hexdigest())


def test_op9_covers_exact_passages(spark, texts):
    own = {i: words(t) for i, t in texts.items()}
    places = {}
    for i, w in own.items():
        for p in range(len(w) - 49):
            places.setdefault(tuple(w[p : p + 50]), set()).add((i, p))
    need = {(i, q) for found in places.values() if len({i for i, _ in found}) > 1 for i, p in found for q in range(p, p + 50)}
    have = set()
    for r in queries.op9_chaining(spark, SF).collect():
        have |= {(r.doc_id, q) for q in range(r.start, r.end)} | {(r.partner_id, q) for q in range(r.partner_start, r.partner_end)}
    assert need <= have


def test_chains_ascend():
    found = [(0, 0, 5), (10, 9, 5), (3, 30, 5), (20, 22, 5)]
    assert chaining.best_chains(found, 0.1, 60)[0] == [(0, 0, 5), (10, 9, 5), (20, 22, 5)]
    assert chaining.matched_words(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (5, None)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def test_pipeline(spark, texts):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF).toPandas()
    assert set(found.doc_id) < set(texts) and found.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_keeps_one_of_each_near_group(spark, texts):
    """The near-duplicate stage against brute force on five words, with a repeated row, an id of two texts and a null id."""
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet")
    first = min(texts)
    own = given.where(F.col("doc_id") == first)
    extra = own.withColumn("text", F.lit("a text of its own that no other document of this table has in it"))
    docs = given.unionByName(own).unionByName(extra).unionByName(own.withColumn("doc_id", F.lit(None).cast("long")))
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in corpus_pipeline.dedup_near(spark, docs, SF).collect())
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = labels_of(ids, links)
    groups = {}
    for i in ids:
        groups.setdefault(label[i], []).append(i)
    assert (-1, texts[first]) in found and (first, extra.first().text) in found
    left = [i for i, t in found if i != -1 and t == texts.get(i)]
    assert sorted(label[i] for i in left) == sorted(groups) and len(found) == len(groups) + 2
