"""Evidence tokens and coverage statuses on hand-made rows."""

from pagemill.operators import tooling

POLICY = "requirement string, needed array<string>, covers array<string>, min_atomic int, min_corpus int"


def test_tokens_of_a_requirement(spark):
    policy = spark.createDataFrame([("img-1", ["filter:flate", "image-color:rgb.8", "bpc:16", "stream-filter:ab"], ["of", "soft mask", "jpx:tile:2"], None, None), ("r", None, None, None, None)], POLICY)
    found = {(r.requirement, r.token) for r in tooling.evidence_tokens(policy).collect()}
    own = {"img-1", "filter:flate", "flate", "image-color:rgb.8", "rgb", "bpc:16", "stream-filter:ab", "soft mask", "jpx:tile:2", "tile"}
    assert found == {("img-1", t) for t in own} | {("r", "r")}


def test_tokens_are_found_anywhere(spark):
    tokens = spark.createDataFrame([("a", "filter:flate"), ("a", "ask"), ("b", "a.b"), ("c", ""), ("d", "none")], "requirement string, token string")
    files = spark.createDataFrame([(1, "Filter:FlateDecode here"), (2, "a mask"), (3, "axb"), (4, "xa.by"), (5, None), (6, "MASKED"), (7, "basket")], "file long, text string")
    assert {(r.requirement, r.file, r.nth) for r in tooling.token_evidence(tokens, files, 3).collect()} == {("a", 1, 1), ("a", 2, 2), ("a", 6, 3), ("b", 4, 1)}
    assert tooling.token_evidence(tokens.where("false"), files, 3).count() == 0


def test_four_statuses(spark):
    policy = spark.createDataFrame([("both", [], [], 2, 1), ("corpus", [], [], None, 3), ("atomic", [], [], 3, None), ("none", [], [], None, None), ("zero", [], [], 0, 0)], POLICY)
    atomic = spark.createDataFrame([("both", 1), ("both", 2), ("corpus", 1), ("atomic", 1)], "requirement string, file long")
    corpus = spark.createDataFrame([("both", 1), ("corpus", 1), ("corpus", 2), ("atomic", 9)], "requirement string, file long")
    found = {r.requirement: (r.atomic_count, r.corpus_count, r.status) for r in tooling.coverage_status(policy, atomic, corpus).collect()}
    assert found == {"both": (2, 1, "COVERED"), "corpus": (1, 2, "MISSING_CORPUS"), "atomic": (1, 1, "MISSING_ATOMIC"), "none": (0, 0, "MISSING_BOTH"), "zero": (0, 0, "COVERED")}
