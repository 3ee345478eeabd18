"""Word vectors are trained block by block; the vocabulary stays a table."""

import numpy as np

from skillgrid.operators import vectors


def as_arrays(model):
    return {r.word: np.frombuffer(bytes(r.vector), np.float32) for r in model.collect()}


def test_words_of_one_context_are_alike(spark):
    draw = np.random.default_rng(1)
    themes = [[f"{c}{k}" for k in range(12)] for c in "xy"]
    rows = [(k, " ".join(draw.choice(themes[k % 2], 60))) for k in range(800)]
    rows += [(800, None), (801, "..."), (802, "Lonely"), (802, "Lonely"), (None, "again " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = vectors.train_word_vectors(docs, size=16, rounds=5, chars=20_000)
    assert isinstance(model, type(docs))  # a table: nothing of the vocabulary lies in the driver
    got = as_arrays(model)
    assert sorted(got) == sorted([*themes[0], *themes[1], "lonely", "again"])
    unit = {w: v / np.linalg.norm(v) for w, v in got.items()}
    same = np.mean([unit[a] @ unit[b] for t in themes for a in t for b in t if a != b])
    other = np.mean([unit[a] @ unit[b] for a in themes[0] for b in themes[1]])
    assert np.isfinite(list(got.values())).all() and same > other + 0.2
    out = vectors.document_vectors(model, docs, size=16, chars=20_000)
    assert out.columns == ["doc_id", "vector"] and out.count() == len(rows)
    vec = {r.doc_id: np.array(r.vector) for r in out.collect()}
    assert np.allclose(vec[802], got["lonely"]) and not vec[800].any() and not vec[801].any()
    assert np.allclose(vec[None], got["again"], atol=1e-6)
    assert len({r[0] for r in vectors.token_blocks(docs, chars=20_000).select("block").distinct().collect()}) > 3


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = vectors.train_word_vectors(docs, size=4, rounds=2)
    assert model.count() == 0 and vectors.document_vectors(model, docs, size=4).count() == 0
