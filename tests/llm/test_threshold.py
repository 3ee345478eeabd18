"""Leaks just above the threshold, where the fingerprints of window and item differ most."""

import random

from skillgrid.llm import decontam, toxicity

N = 1500


def near_threshold(seed=11):
    """Documents that hold one item each with one word replaced: similarity (n - 9) / (n + 1) for n words."""
    r = random.Random(seed)
    items, docs, expected = [], [], {}
    for k in range(N):
        n = r.randrange(49, 65)
        words = [f"{r.randrange(10**9):x}" for _ in range(n)]
        items.append((k, " ".join(words)))
        words[r.randrange(5, n - 5)] = "other"
        docs.append((k, " ".join(["before"] * r.randrange(3) + words + ["after"] * r.randrange(3))))
        expected[k] = (n - 9) / (n + 1)
    return items, docs, expected


def test_recall_at_the_threshold(spark):
    items, docs, expected = near_threshold()
    got = {r.doc_id: (r.item_id, round(r.similarity, 9)) for r in decontam.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(expected) and all(got[k][0] == k and 0.8 <= got[k][1] <= expected[k] + 1e-8 for k in got)
    best = sum(got.get(k) == (k, round(expected[k], 9)) for k in expected)
    print("documents found", len(got), "with their best window", best, "of", N)
    assert best >= 0.998 * N


def test_repeated_labels_have_one_meaning(spark):
    docs = spark.createDataFrame([(k, "vile scum" if k % 2 else "kind words") for k in range(120)], "doc_id long, text string")
    once = [(k, 1, k % 2) for k in range(100)]
    want = sorted(toxicity.classify(docs, spark.createDataFrame(once, "doc_id long, quality int, toxic int")).collect())
    more = [(k, 1, 1) for k in range(0, 100, 2)] + once + [(k, 1, 1) for k in range(1, 100, 2)]  # the least label of a document counts
    assert sorted(toxicity.classify(docs, spark.createDataFrame(more, "doc_id long, quality int, toxic int").repartition(7)).collect()) == want
