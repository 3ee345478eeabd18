"""Every gram of a character model has its own value, whatever the model's size."""

import math
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import charlm, quality


def test_no_gram_takes_the_value_of_another(spark):
    draw = np.random.default_rng(5)
    letters = np.array(list(string.ascii_lowercase))
    docs = spark.createDataFrame([("".join(draw.choice(letters, 400)), g) for g in "xy" for _ in range(20)], "t string, g string")
    rows = charlm.kept(charlm.smooth(charlm.count_grams(docs, "t", "g", 3), 3, True), "model")
    model = charlm.collect(rows, 3, 4)  # 16 runs of leading bits for thousands of entries
    assert len(model.keys) == rows.count()
    bound = charlm.collect(rows, 3, 4, most=10)
    assert bound.width == charlm.WIDTH and len(bound.keys) == len(np.unique(model.keys >> np.uint64(40)))
    asked = [a + b + c for a in "abcd" for b in "efgh" for c in "ijé"]
    codes, bounds = charlm.code_points(charlm.pa.array(asked), 0)
    got = model.log_probs(codes, np.arange(2, len(codes), 3), 0)
    stored = {(r.size, r.kind, r.hi, r.lo): r.value for r in rows.where("lang = 'x'").collect()}

    def pack(t):
        return charlm.packed(np.array([[ord(c)] for c in t], np.int64)) if t else (np.zeros(1, int), np.zeros(1, int))

    def value(t):
        hi, lo = (int(x[0]) for x in pack(t))
        if (len(t), 0, hi, lo) in stored:
            return stored[len(t), 0, hi, lo]
        if not t:
            return -30.0
        hi, lo = (int(x[0]) for x in pack(t[:-1]))
        return (stored.get((len(t), 1, hi, lo), 0.0) if len(t) > 1 else 0.0) + value(t[1:])

    assert got.tolist() == pytest.approx([value(t) for t in asked], rel=1e-5)
    wanted = spark.createDataFrame([("x", int(pack(t)[0][0]), int(pack(t)[1][0]), t) for t in asked], "lang string, hi long, lo long, gram string")
    joined = {(r.hi, r.lo): r.value for r in charlm.gram_scores(wanted, rows, 3).collect()}
    assert [joined[r.hi, r.lo] for r in wanted.collect()] == pytest.approx([value(t) for t in asked])
    assert sum(math.exp(v) for v in got) > 0


def test_a_model_of_any_size_gives_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, None, "en", "a"), (-2, "", "en", None), (-3, "alone", "only", "a"), (None, "é漢" * 40, None, "b"), (7, "twice " * 30, "en", "a"), (7, "twice " * 30, "en", "a")], docs.schema)
    docs = docs.unionByName(odd)
    small, large = quality.quality(docs), quality.quality(docs, most=0)

    def shown(df):
        return sorted(map(str, df.select("doc_id", "n_words", "kept", "base_failed", F.round("perplexity", 2)).collect()))

    assert shown(small) == shown(large) and small.count() == docs.count()
