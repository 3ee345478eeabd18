"""Refreshes of stored matches: equal to matching everything again, repeatable, and blind to texts that hold no changed phrase."""

from skillgrid.operators import extract
from skillgrid.streaming import refresh

TEXTS = {"a": "We need machine learning. And deep-learning too", "b": "Deep learning or cooking", "c": "cooking", "d": "", "e": None, "f": "ML, ml; m l", "g": "deep thoughts " * 3000}
BASE = [("cooking", "cooking", 0)]


def setup_store(spark, path):
    docs = spark.createDataFrame([*TEXTS.items(), (None, "ml"), ("a", "A")], "doc_id string, text string")
    base = spark.createDataFrame(BASE, "phrase string, skill string, rank int")
    refresh.add_documents(docs, base, path, buckets=8)
    return base


def decide(spark, rows):
    return spark.createDataFrame(rows, refresh.DECISION)


def hits(spark, path):
    return sorted(map(tuple, refresh.current_hits(spark, path).collect()))


def whole(spark, approved):
    docs = spark.createDataFrame([(k, v or "") for k, v in TEXTS.items()], "doc_id string, text string")
    aliases = spark.createDataFrame([(s, a, "approved") for s, a in approved], "canonical_skill string, alias string, status string")
    base = spark.createDataFrame(BASE, "phrase string, skill string, rank int")
    found = extract.phrase_hits(docs, extract.assemble_lexicon(base, extract.approved_aliases(aliases)))
    return sorted(map(tuple, found.select("doc_id", "skill", "text", "start", "end").collect()))


def test_refreshes_equal_matching_all_texts(spark, tmp_path):
    path = str(tmp_path / "store")
    base = setup_store(spark, path)
    # of repeated ids the greatest text counts
    assert hits(spark, path) == whole(spark, [])
    refresh.refresh(decide(spark, [("machine learning", "ml", "approved", 1), ("deep learning", "dl", "candidate", 1)]), base, path, "s", 0, 8)
    assert hits(spark, path) == whole(spark, [("machine learning", "ml")])
    refresh.refresh(decide(spark, [("deep learning", "dl", "approved", 2), ("machine learning", "ml", "approved", None)]), base, path, "s", 1, 8)
    both = whole(spark, [("machine learning", "ml"), ("deep learning", "dl")])
    assert hits(spark, path) == both
    before = refresh.refreshes(spark, path).collect()
    refresh.refresh(decide(spark, [("deep learning", "dl", "rejected", 9)]), base, path, "s", 1, 8)  # settled already
    assert hits(spark, path) == both and refresh.refreshes(spark, path).collect() == before
    refresh.refresh(decide(spark, [("machine learning", "ml", "rejected", 3), ("cuisine", "cooking", "approved", 3), (None, "x", "approved", 3)]), base, path, "s", 2, 8)
    assert hits(spark, path) == whole(spark, [("deep learning", "dl"), ("cuisine", "cooking")])
    log = sorted((r.batch, r.phrases, r.documents) for r in refresh.refreshes(spark, path).collect())
    # texts with ml or machine; with deep or dl; with ml, machine or cooking
    assert log == [(0, 2, 2), (1, 2, 3), (2, 4, 4)]
    refresh.refresh(decide(spark, []), base, path, "s", 3, 8)
    assert refresh.refreshes(spark, path).where("batch = 3").first()["documents"] == 0


def test_a_stopped_refresh_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "store")
    base = setup_store(spark, path)
    row = decide(spark, [("machine learning", "ml", "approved", 1)])
    refresh.refresh(row, base, path, "s", 0, 8)
    done = hits(spark, path)
    log = spark.createDataFrame([], refresh.REFRESHES)
    log.write.mode("overwrite").parquet(f"{path}/refreshes")  # as if it had been stopped before its last step
    refresh.refresh(row, base, path, "s", 0, 8)
    assert hits(spark, path) == done == whole(spark, [("machine learning", "ml")])


def test_only_touched_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    setup_store(spark, path)
    heads = spark.createDataFrame([("ml",)], "first_word string")
    touched = refresh.touched_documents(spark, path, heads, 8)
    assert [r.doc_id for r in touched.collect()] == ["f"]
    texts = refresh.touched_texts(spark, path, touched)
    assert [r.doc_id for r in texts.collect()] == ["f"]
    bucket = touched.first()["doc_bucket"]
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert any(f"= {bucket})" in part[:200] or f"IN ({bucket})" in part[:200] for part in plan.split("PartitionFilters")[1:]), plan


def test_a_second_load_gets_the_present_aliases(spark, tmp_path):
    path = str(tmp_path / "store")
    base = setup_store(spark, path)
    refresh.refresh(decide(spark, [("machine learning", "ml", "approved", 1)]), base, path, "s", 0, 8)
    more = spark.createDataFrame([("x", "ml")], "doc_id string, text string")
    for _ in range(2):
        refresh.add_documents(more, base, path, load="1", buckets=8)
    assert [h for h in hits(spark, path) if h[0] == "x"] == [("x", "machine learning", "ml", 0, 2)]
    refresh.refresh(decide(spark, [("machine learning", "ml", "rejected", 2)]), base, path, "s", 1, 8)
    assert hits(spark, path) == whole(spark, [])
    refresh.add_documents(more.limit(0), base, str(tmp_path / "empty"), buckets=8)
    assert hits(spark, str(tmp_path / "empty")) == []
