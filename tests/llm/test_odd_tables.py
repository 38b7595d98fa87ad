"""Odd tables that operators must not leave out parts of."""

import numpy as np


def test_toxicity_without_mined_terms(spark):
    """So few toxic texts that no term is mined: lexicon and patterns still tell them apart."""
    import random

    from terraframe.llm import toxicity

    rnd = random.Random(2)
    plain = "the house of green light and river stone walks over a hill with many trees".split()
    words = [w for ws in toxicity.LEXICONS.values() for w in ws if w.isalpha()]
    rows = [(i, " ".join(rnd.choices(plain, k=30) + (rnd.sample(words, 4) if i % 10 == 0 else []))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i, _ in rows if i < 60], "doc_id long, quality int, toxic int")
    sample = [(t, int(i % 10 == 0)) for i, t in rows if i < 40]
    assert toxicity.mine(sample)[0] == []
    model = toxicity.fit(sample, {0: 36, 1: 4})
    assert model["coefficients"] is not None
    scores = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in scores if i % 10 == 0) > max(scores[i] for i in scores if i % 10)
    assert toxicity.classify(docs, labels).select("score").distinct().count() > 1
    assert toxicity.fit([], {})["coefficients"] is None


def test_embeddings_without_id_link_others(spark):
    from terraframe.llm import embedding_dedup as ed

    def at(degrees):
        return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]

    # at a cosine of 0.95 (18.2 degrees): 1 and 2 meet only through the vector without an id; two more without one meet each other
    rows = [(1, at(0)), (None, at(15)), (2, at(30)), (None, at(100)), (None, at(110)), (3, at(200))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df).collect()), key=str)
    want = [(1, 1, 1, True), (None, 2, 1, False), (2, 1, 1, False), (None, 1, None, False), (None, 1, None, False), (3, 0, 3, True)]
    assert got == sorted(want, key=str)


def test_different_vectors_of_one_id(spark):
    from terraframe.llm import embedding_dedup as ed

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_simhash_without_id_links_others(spark, monkeypatch):
    from terraframe.llm import simhash

    far = 0xFFFF << 40
    fps = [(1, 0), (None, 0b11), (2, 0b1111), (None, far), (None, far ^ 1 << 41), (3, -1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: docs)
    df = spark.createDataFrame(fps, "id long, fp long")
    got = sorted(((r.id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, id_col="id").collect()), key=str)
    component = {0: 1, 0b11: 1, 0b1111: 1, far: None, far ^ 1 << 41: None, -1: 3}
    assert got == sorted(((i, f"{f & (1 << 64) - 1:016x}", component[f]) for i, f in fps), key=str)
