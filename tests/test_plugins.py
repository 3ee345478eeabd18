"""Own functions for vectors and spans."""

import numpy as np
import pytest

from skillgrid.operators import extract, pairs, plugins

DOC = "doc_id string, text string, vector string"


def letters():
    return lambda texts: np.array([[s.count("a"), s.count("b"), np.nan if "bad" in s else 1.0] for s in texts])


def capitals():
    def find(texts):
        return [[(w, "SKILL", 0.9 if w.islower() else 0.4, s.index(w), s.index(w) + len(w)) for w in s.split() if "sql" in w.lower()] for s in texts]
    return find


def test_vectors_of_chunks_are_pooled(spark):
    long = "aa " * 2000
    docs = spark.createDataFrame([("x", "aab", "clash"), ("l", long, ""), ("n", None, ""), ("e", " \n", ""), ("f", "bad", ""), ("r", "a", ""), ("r", "b", ""), (None, "a", "")], DOC)
    got = {r.doc_id: r for r in plugins.embedded(docs, ["doc_id"], letters, 3, size=100).collect()}
    assert set(got) == {"x", "l", "n", "e", "f", "r"} and {k for k, r in got.items() if r.failed} == {"n", "e", "f"}
    assert np.allclose(got["x"].vector, np.array([2, 1, 1]) / np.sqrt(6)) and got["n"].vector == [0.0] * 3
    assert np.allclose(got["r"].vector, np.array([0.5, 0.5, 1]) / np.sqrt(1.5))
    counts = [s.count("a") for s in [long[i:i + 99] for i in range(0, 5999, 99)]]
    mean = np.array([np.mean(counts), 0, 1])
    assert np.allclose(got["l"].vector, mean / np.linalg.norm(mean), atol=1e-3)
    assert plugins.embedded(docs.limit(0), ["doc_id"], letters, 3).count() == 0
    with pytest.raises(Exception, match="vectors of shape"):
        plugins.embedded(docs, ["doc_id"], letters, 4).collect()


def test_vectors_reach_the_course_scores(spark):
    mods = plugins.embedded(spark.createDataFrame([("c", "m", "aaa"), ("c", "k", "bbb")], "course_id string, module_id string, text string"), ["course_id", "module_id"], letters, 3)
    jobs = plugins.embedded(spark.createDataFrame([(1, "aaa"), (2, None)], "job_id long, text string"), ["job_id"], letters, 3)
    got = {r.job_id: r.semantic_score for r in pairs.semantic_scores(mods, jobs).collect()}
    assert got[2] == 0.0 and abs(got[1] - (1 + 0.1) / 2) < 1e-9


def test_spans_reach_the_entities(spark):
    docs = spark.createDataFrame([("d", "use mysql and SQL daily with kafka", "c"), ("n", None, ""), ("b", "  ", "")], DOC)
    found = plugins.spans(docs, capitals)
    assert {(r.doc_id, r.word, r.score, r.start, r.end) for r in found.collect()} == {("d", "mysql", 0.9, 4, 9), ("d", "SQL", 0.4, 14, 17)}
    lexicon = extract.with_words(spark.createDataFrame([("mysql", "mysql"), ("kafka", "kafka")], "phrase string, skill string"))
    entities = {r.skill: (r.source, r.confidence, r.mention_count) for r in extract.extract_entities(docs.drop("vector"), lexicon, spans=found).collect()}
    assert entities == {"mysql": ("bert-ner", 0.9, 2), "kafka": ("phrase_matcher", 0.92, 1)}
    assert plugins.spans(docs.limit(0), capitals).count() == 0
