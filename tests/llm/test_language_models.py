"""Language models of any size give every gram its own value."""

import pytest

from skillgrid.llm import language


def test_a_language_model_of_any_size_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "alone", "only"), (None, "é漢ß" * 40, None), (7, "Twice " * 30, "en"), (7, "Twice " * 30, "en"), (-4, "12 34", "de")], docs.schema)
    docs = docs.unionByName(odd)
    monkeypatch.setattr(language, "BLOCK_CHARS", 50_000)
    small, large = language.identify(docs).collect(), language.identify(docs, most=10).collect()

    def shown(rows):
        return sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], r["rejected"], round(r["score"], 4), round(r["cross_entropy"], 3)) for r in rows)

    a, b = shown(small), shown(large)
    assert len(a) == docs.count() and [x[:4] for x in a] == [x[:4] for x in b]
    for x, y in zip(a, b):
        assert x[4:] == pytest.approx(y[4:], abs=2e-3)


def test_an_empty_table_and_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(none, most=-1).count() == 0
    alone = spark.createDataFrame([(1, "abc", None), (2, None, "en")], none.schema)
    assert {(r["doc_id"], r["lang_pred"]) for r in language.identify(alone, most=-1).collect()} == {(1, "und"), (2, "und")}
