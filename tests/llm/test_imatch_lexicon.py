"""op2's lexicon and signatures against brute force: every term of the band is kept, and signatures depend on nothing else."""

import re
from collections import Counter

from pagemill.llm import imatch


def _terms(text):
    return {w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w}


def test_each_band_term_has_a_signature(spark):
    docs = spark.createDataFrame([(i, f"term{i % 1000}") for i in range(2000)], "doc_id long, text string")
    found = imatch.edit_fingerprints(docs).collect()
    assert not [r.doc_id for r in found if set(r.fingerprint.split(":")[1]) == {"-"}]


def test_lexicon_holds_every_band_term(spark):
    texts = [" ".join(f"w{i * j % 997}" for j in range(1, 200)) for i in range(1, 400)] + ["", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(w for t in texts for w in _terms(t))
    band = {w for w, n in counts.items() if max(2.0, 0.01 * len(texts)) <= n <= 0.2 * len(texts)}
    hashes = {r.h for r in spark.createDataFrame([(w,) for w in band], "w string").selectExpr("xxhash64(w) AS h").collect()}
    assert len(band) > 500 and {r.h for r in imatch.lexicon(docs, 0.01, 0.2).collect()} == hashes


def test_signatures_equal_brute_force(spark):
    """The subset hashes of text and edited text, remade from the words of each subset, agree; so do both likenesses."""
    texts = [" ".join(f"w{(i // 3) * 7 + j * (1 + i % 2)}" for j in range(60)) for i in range(60)]
    docs = spark.createDataFrame([(i * 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for t in texts for w in _terms(t)}], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    hashed |= {r.w: r.h for r in spark.createDataFrame([(f"w{i}"[:n],) for i in range(1000) for n in range(1, 5)], "w string").distinct().selectExpr("w", "xxhash64(w) AS h").collect()}
    counts = Counter(w for t in texts for w in _terms(t))
    band = {w for w, n in counts.items() if max(2.0, 0.06) <= n <= 12}

    def subsets(text):
        out = [set() for _ in range(128)]
        for w in _terms(text) & band:
            h = hashed[w]
            out[(h >> 24) % 8 * 16 + (h >> 40) % 16].add(w)
        return out

    def alike(x, y):
        if _terms(x) == _terms(y):
            return 1.0
        used = [(a, b) for a, b in zip(subsets(x), subsets(y), strict=True) if a or b]
        return sum(a == b for a, b in used) / len(used) if used else 0.0

    for r in imatch.edit_fingerprints(docs, 0.001, 0.2, 5).collect():
        i = r.doc_id // 5
        own, following = texts[i], texts[(i + 1) % len(texts)]
        edited = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        assert abs(r.near_edited - alike(own, edited)) < 1e-9 and abs(r.near_next - alike(own, following)) < 1e-9
        signs = r.fingerprint.split(":")[1]
        assert [signs[k * 4 : k * 4 + 4] == "----" for k in range(128)] == [not s for s in subsets(own)]
