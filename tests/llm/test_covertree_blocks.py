"""op3's blocks grow with the table, and large blocks are compared in pieces."""

import numpy as np

from pagemill.llm import covertree


def test_few_blocks_of_many_vectors_give_all_links(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 4)).astype(np.float32)
    x[3000:3100] = x[:100]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    blocks, stored = [], covertree.stored

    def seen(df):
        out = stored(df)
        if "block" in out.columns:
            blocks.append((out.count(), out.schema["rows"].dataType.elementType["x"].dataType.simpleString()))
        return out

    monkeypatch.setattr(covertree, "stored", seen)
    monkeypatch.setattr(covertree, "BLOCKS", 2)
    found = {r.vec_id: r for r in covertree.near_vectors(frame, cosine=0.999, block_rows=64).collect()}
    assert len(blocks) == 1 and blocks[0][0] <= 4 and blocks[0][1] == "array<float>"
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.999
    np.fill_diagonal(links, False)
    assert [found[i].n_links for i in range(6000)] == links.sum(axis=1).tolist()
    ids, least = covertree._spanning(*np.nonzero(links))
    want = dict(zip(ids.tolist(), least.tolist(), strict=True))
    assert all(found[i].component_id == want.get(i, i) for i in range(6000))
