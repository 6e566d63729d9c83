"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import chaining, covertree, imatch, knnquality, linededup, minhash, mixing, packing, suffixdedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, component long, h long, row string, spans string"


def _words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = "\n".join(_words(i, 12) for i in range(400))
    texts = [(1, long), (2, long), (2, long), (3, None), (4, ""), (5, " \n \n"), (6, "one"), (7, "one"), (None, "no id at all"), (None, None), (8, "é" * 5000), (9, _words(9, 80)), (10, _words(9, 80) + " more"), (11, "idiot " * 30)]
    return spark.createDataFrame([(i, t, "en" if i else None, "s" if i != 4 else None, len(t or ""), 1, 2, 3, "x", "y") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 1, 0), (11, 0, 1), (11, None, 1), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "minhash": lambda d, l: minhash.near_duplicates(d),
    "imatch": lambda d, l: imatch.edit_fingerprints(d),
    "toxicity": lambda d, l: toxicity.toxic_scores(d, l),
    "mixing": lambda d, l: mixing.mix_documents(d),
    "linededup": lambda d, l: linededup.remove_repeated_lines(d),
    "suffixdedup": lambda d, l: suffixdedup.remove_repeats(d),
    "knnquality": lambda d, l: knnquality.quality_scores(d, l),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(name, docs, labels):
    found = OPERATORS[name](docs, labels).select("doc_id").toPandas().doc_id
    given = docs.select("doc_id").toPandas().doc_id
    assert sorted(found.fillna(-1)) == sorted(given.fillna(-1))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_empty_tables_of_pair_operators(spark, docs):
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert chaining.shared_passages(docs.limit(0)).count() == 0
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_minhash(docs):
    found = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs).collect()}
    by = {k[0]: r for k, r in found.items() if k[0]}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert by[3].component_id == 3 and by[3].n_shingles == 0 and by[4].kept
    assert by[7].component_id == 6 and by[10].component_id == 9
    assert all(r.kept and r.component_id is None for k, r in found.items() if k[0] is None)


def test_imatch(docs):
    rows = [r for r in imatch.edit_fingerprints(docs).collect()]
    one = {r.doc_id: r for r in rows if r.doc_id}
    assert one[1].fingerprint == one[2].fingerprint and one[6].fingerprint == one[7].fingerprint != one[9].fingerprint
    assert one[3].n_chars == 0 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert one[6].near_next == 1.0
    assert one[6].edited_sha256 == hashlib.sha256(b"ono").hexdigest()


def test_linededup(docs):
    found = linededup.remove_repeated_lines(docs)
    assert found.columns == docs.columns + ["n_lines", "n_removed", "n_runs"]
    one = {r.doc_id: r for r in found.collect() if r.doc_id}
    assert one[1].n_removed == 0 and one[2].text == "" and one[2].n_removed == 400 and one[2].n_runs == 1
    assert one[3].text is None and one[3].n_lines == 0 and one[5].text == " \n \n"


def test_suffixdedup(docs):
    one = {r.doc_id: r for r in suffixdedup.remove_repeats(docs).collect() if r.doc_id}
    assert one[1].n_removed == one[1].n_bytes == one[2].n_removed
    assert one[8].n_removed == one[8].n_bytes == 10000 and one[8].n_spans == 1
    assert one[6].n_removed == 0 and one[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_packing(docs):
    found = packing.pack_documents(docs, capacity=64, with_ids=True).toPandas()
    assert found.groupby("sequence_id").length.sum().max() <= 64
    assert len(found[found.doc_id == 3]) == 1 and list(found[found.doc_id == 3].ids.iloc[0]) == [2]
    for _, group in found.sort_values("offset").groupby("sequence_id"):
        assert list(group.offset) == [0, *group.length.cumsum()[:-1]]


def test_covertree(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0])]
    found = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == len(rows)
    one = {r.vec_id: r for r in found}
    assert one[1].n_links == 3 and one[2].component_id == 1 and one[9].component_id == 1
    assert all(one[i].n_links == 0 and one[i].component_id == i for i in (3, 4, 5, 6, 7, 8)) and one[None].component_id is None


def test_chaining(docs):
    found = chaining.shared_passages(docs).collect()
    assert {(r.doc_id, r.partner_id) for r in found} == {(1, 2), (2, 1), (9, 10), (10, 9)}
    assert all(r.identity >= 0.8 for r in found)


def test_scores_stay_in_range(docs, labels):
    for found in (toxicity.toxic_scores(docs, labels), knnquality.quality_scores(docs, labels)):
        assert found.where("score < 0 or score > 1 or score is null").count() == 0
        assert found.where((F.col("score") >= 0.3) != (F.col("predicted") == 1)).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert docs.count() > 0


def test_minhash_repeated_id_with_two_texts(spark):
    one, two, other = _words(41, 60), _words(42, 60), _words(43, 60)
    docs = spark.createDataFrame([(5, one), (5, two), (7, two + " end"), (8, other), (9, one)], "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert found == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 5, False)]


def test_minhash_blocks_equal_whole_groups(spark):
    """Many alike documents of several sizes: cut into blocks of a few rows, the links span the same components."""
    from pagemill.llm.components import connected_components

    base = _words(77, 200).split()
    texts = []
    for i in range(60):
        rng = random.Random(i)
        words = list(base[: 100 + i])
        for _ in range(i % 12):
            words[rng.randrange(len(words))] = f"w{i}x{rng.randrange(99)}"
        texts.append((i, " ".join(words)))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in texts]
    frame = spark.createDataFrame(texts, "doc long, text string")
    members = spark.createDataFrame([(k, i, len(s), i) for k in (1, 2) for i, s in enumerate(sets)], "key long, rep long, n long, component long")

    def spanned(links):
        return sorted((r.id, r.component) for r in connected_components(links).collect())

    exact = [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = spanned(spark.createDataFrame(exact, "a long, b long"))
    for rows, small in ((512, 64), (7, 64), (7, 4)):
        found = minhash._remaining_links(members, frame, 5, 80, block_rows=rows, small=small)
        assert spanned(found) == expected
        assert {(max(r.a, r.b), min(r.a, r.b)) for r in found.collect()} <= set(exact)
