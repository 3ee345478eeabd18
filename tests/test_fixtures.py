"""Small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from skillgrid.functions import scores, skills, text
from skillgrid.operators import analytics, cleaning, extract, pairs, review, training, vectors, verify
from skillgrid.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("skill,kind,tier", [
    ("c#", "technical", "tool"), ("leadership", "soft", "transferable"), ("project management", "business", "method")])
def test_classes(spark, skill, kind, tier):
    k = value(spark, skills.classify(F.lit(skill)))
    assert (k.skill_type, k.tier) == (kind, tier)


def test_entity_id(spark):
    assert value(spark, skills.entity_id(F.lit("Project-Management"))) == "skill-project-management"
    assert value(spark, skills.entity_id(F.lit("c#"))).startswith("skill-c-")


def test_final_score(spark):
    def final(s, k, c):
        return value(spark, scores.score_breakdown(F.lit(s), F.lit(k), F.lit(c)))

    low, high = final(0.55, 0.25, 0.35), final(0.78, 0.5, 0.88)
    assert (low.decision_tree_score, round(low.final_score, 3)) == (0.65, 0.47)
    assert (high.decision_tree_score, round(high.final_score, 3)) == (0.95, 0.756)


def test_matched_confidence(spark):
    def table(owner, rows):
        return spark.createDataFrame(rows, f"{owner} string, skill string, confidence double")

    out = pairs.matched_confidence(table("course_id", [("c", "python", 0.8), ("c", "sql", 0.6)]), table("job_id", [("j", "python", 0.9), ("j", "sql", 0.7)]))
    assert out.first()["confidence_score"] == pytest.approx(0.75)


def test_excluded_terms_are_not_extracted(spark):
    docs = spark.createDataFrame([("d", "Experience with c#, c++, Go, Golang, and Go programming language is useful.")], "doc_id string, text string")
    assert extract.extract_entities(docs, extract.assemble_lexicon(extract.base_lexicon(spark))).count() == 0


def test_alias_and_dynamic_terms(spark):
    body = "Build PowerBI dashboards for finance teams using human centred design."
    docs = spark.createDataFrame([("d", body)], "doc_id string, text string")
    alias = spark.createDataFrame([("power bi", "powerbi", "approved"), ("x", "dashboards", "candidate")], "canonical_skill string, alias string, status string")
    dynamic = spark.createDataFrame([("human centred design",)], "skill string")
    lexicon = extract.assemble_lexicon(extract.base_lexicon(spark), extract.approved_aliases(alias), dynamic)
    found = {r.skill: (r.text, r.start) for r in extract.extract_entities(docs, lexicon, dynamic).collect()}
    assert found["power bi"] == ("PowerBI", 6)
    assert found["human centred design"][1] == body.index("human")


def test_phrase_hits_agree_with_brute_force(spark):
    import re
    body = "Data analysis, data-analysis; big data  analysis. Sales data analysis\nanalysis of sales data."
    phrases = ["data analysis", "analysis", "sales data"]
    lex = extract.with_words(spark.createDataFrame([(p, p) for p in phrases], "phrase string, skill string"))
    got = {(r.skill, r.start, r.end) for r in extract.phrase_hits(spark.createDataFrame([("d", body)], "doc_id string, text string"), lex).collect()}
    flat = body.lower().replace("-", " ")
    want = {(p, m.start(), m.end()) for p in phrases for m in re.finditer(rf"(?<![\w]){p}(?![\w])", flat)}
    assert got == want


def test_low_confidence_span_is_dropped(spark):
    spans = spark.createDataFrame([("d", "SKILL", "requires", 0.2, 0, 8), ("d", "B-SKILL", "##sql", 0.9, 9, 12)],
                                  "doc_id string, label string, word string, score double, start int, end int")
    assert [r.skill for r in extract.accepted_spans(spans).collect()] == ["sql"]


def test_chunks_and_pooling(spark):
    chunks = value(spark, vectors.text_chunks(F.lit("strategy " * 900), 1000, 4))
    assert len(chunks) == 4 and all(len(c) <= 1000 for c in chunks)
    whole = value(spark, vectors.text_chunks(F.lit("strategy " * 900), 1000, None))
    assert " ".join(whole) == ("strategy " * 900).strip()
    df = spark.createDataFrame([("d", [3.0, 0.0]), ("d", [0.0, 4.0])], "doc_id string, vector array<double>")
    v = vectors.pooled_vectors(df, ["doc_id"]).first()["vector"]
    assert sum(x * x for x in v) == pytest.approx(1.0)


def test_neutral_vector(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    some = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "doc_id string, vector array<double>")
    rows = {r.doc_id: r for r in vectors.with_neutral(docs, some, "doc_id", 3).collect()}
    assert rows["b"].vector == [0.0, 0.0, 0.0] and rows["b"].failed and not rows["a"].failed


def test_clamp_keeps_the_tail(spark):
    out = value(spark, text.clamp_text(F.lit("A" * 5000 + "TAIL"), 4000))
    assert len(out) <= 4100 and out.endswith("TAIL") and "characters omitted" in out


def test_dates(spark):
    for written in ("Monday, May 20, 2024", "May 20, 2024", "20 May 2024", "2024-05-20", "2024-05-20T10:00:00Z"):
        assert str(value(spark, text.parse_date(F.lit(written)))) == "2024-05-20"
    assert value(spark, text.parse_date(F.lit("soon"))) is None


def test_advert_lines(spark):
    df = spark.createDataFrame([("Head\nSummary: short\nmore\n\nQualifications\nDegree\nRef:\n\nR-7",)], "description string")
    s = cleaning.advert_sections(df).first()
    assert (s.summary, s.position_info) == ("short\nmore", "Degree\nRef:\nR-7")
    assert cleaning.advert_metadata(df).first().meta_job_reference == "R-7"


def test_thin_text_warning(spark):
    w = value(spark, verify.warnings_of(F.lit("x" * 100), F.array(F.lit("sql")), 80))
    assert w == ["Long text has only 1 extracted skill(s); expected more evidence for the skill matrix."]


def test_verifier_answer(spark):
    body = '{"suggested_skills": "Data Analysis, Scenario Planning\\nSAP_Financial_Accounting", "false_positive_stored_skills": ["Tax", "tax"]}'
    r = value(spark, verify.normalised_response(F.lit(body)))
    assert r.suggested_skills == ["data analysis", "scenario planning", "sap financial accounting"]
    assert r.false_positive_stored_skills == ["tax"] and r.status == "needs_review"


def test_correlation_of_three_profiles(spark):
    rows = [(1, "strategy"), (1, "analytics"), (2, "analytics"), (2, "finance"), (3, "strategy"), (3, "leadership")]
    out = {(r.left, r.right): r.value for r in analytics.skill_correlation(spark.createDataFrame(rows, "job_id int, skill string")).collect()}
    assert out["finance", "finance"] == 1.0 and out["analytics", "finance"] == 0.5 == out["finance", "analytics"]


def test_divergence(spark):
    rows = [(1, "A", "strategy"), (1, "A", "analytics"), (2, "Analyst", "analytics"), (2, "Analyst", "finance"), (3, "B", "strategy"), (3, "B", "leadership")]
    out = {(r.role, r.skill): r.value for r in analytics.role_divergence(spark.createDataFrame(rows, "job_id int, role string, skill string")).collect()}
    assert out["Analyst", "finance"] == pytest.approx(0.33)


def test_suggestions(spark):
    df = spark.createDataFrame([("c", 1, 0.32, ["strategy"], ["analytics", "finance"])], "course_id string, job_id int, similarity_score double, matched array<string>, missing array<string>")
    row = {r.skill: r for r in analytics.skill_suggestions(df).collect()}["finance"]
    assert (row.demand_count, row.job_count, row.course_count, row.gap_percent, row.coverage) == (1, 1, 0, 100, 0)


def test_forecast(spark):
    df = spark.createDataFrame([("strategy", 2024), ("strategy", 2025)], "skill string, extracted_year int")
    r = analytics.yearly_forecast(df).first()
    assert (r.years, r.counts, r.forecast) == ([2024, 2025], [1, 1], 1)


def test_sectors(spark):
    assert value(spark, skills.infer_sector(F.lit("Cyber Security Analyst"))) == "Cybersecurity and Risk"
    assert value(spark, skills.infer_sector(F.lit("accounting, tax, budget"))) == "Finance and Accounting"


def test_greedy_spans(spark):
    docs = spark.createDataFrame([("d", "x" * 40)], "doc_id string, text string")
    spans = [("d", 0, 5), ("d", 0, 9), ("d", 4, 8), ("d", 5, 9), ("d", 30, 50)]
    r = training.examples(docs, spark.createDataFrame(spans, "doc_id string, start int, end int")).first()
    assert ([(s.start, s.end) for s in r.spans], r.skipped) == ([(0, 5), (5, 9)], 3)


def test_semantic_blocks_agree(spark):
    import random
    rng = random.Random(1)
    mods = spark.createDataFrame([(f"c{i % 2}", f"m{i}", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(9)], "course_id string, module_id string, vector array<double>")
    jobs = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(20)], "job_id int, vector array<double>")
    def run(**k):
        return {(r.course_id, r.job_id): round(r.semantic_score, 9) for r in pairs.semantic_scores(mods, jobs, **k).collect()}
    assert run(job_blocks=1, module_blocks=1) == run(job_blocks=5, module_blocks=3)


def test_pairs_do_not_depend_on_copies(spark):
    c = spark.createDataFrame([("c1", ["a", "b"]), ("c2", [])], "course_id string, course_skills array<string>")
    j = spark.createDataFrame([(i, ["b", "z"][: i % 3]) for i in range(7)], "job_id int, job_skills array<string>")
    rows = [(r.course_id, r.job_id, tuple(r.matched), tuple(r.missing), tuple(r.extra)) for r in pairs.gap(c, j).collect()]
    assert len(rows) == 14 and ("c1", 2, ("b",), ("z",), ("a",)) in rows
    assert pairs.pair_up(c, j, copies=3).count() == 14


def test_csv_encoding_and_required_columns(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(" Title ,Description\nCaf\xe9 manager,Runs it\n,none\n".encode("latin-1"))
    df = readers.usable(readers.read_adverts_csv(spark, str(p)))
    assert [r.title for r in df.collect()] == ["Café manager"]
    bad = tmp_path / "b.csv"
    bad.write_text("title\nx\n")
    with pytest.raises(ValueError):
        readers.read_adverts_csv(spark, str(bad))


def test_csv_encoding_of_each_file(spark, tmp_path):
    for name, data in [
            ("u", "title,description\nCafé Zürich 東京,\"two\nlines\"\nodd � mark,\n".encode()),
            ("l", "title,description\nCaf\xe9 Z\xfcrich,x\n".encode("latin-1")),
            ("b", "\ufefftitle,description\nnaïve 東京,x\n".encode())]:
        (tmp_path / f"{name}.csv").write_bytes(data)
    got = readers.read_adverts_csv(spark, str(tmp_path))
    assert sorted(r.title for r in got.collect()) == sorted(["Café Zürich 東京", "odd � mark", "Café Zürich", "naïve 東京"])
    assert "two\nlines" in [r.description for r in got.collect()]


def test_candidate_does_not_count_until_approved(spark):
    base = [("m", 0, "e1", "c1", "accounting", "SKILL", "x", "business", "legacy", None, 1, "accounting", "legacy"),
            ("m", 1, "e2", "c2", "sap financial accounting", "SKILL", "candidate", "business", "model", 0.5, 1, "sap", "candidate")]
    rows = spark.createDataFrame(base, "m string, pos long, entity_id string, chunk_id string, skill string, label string, tier string, skill_type string, "
                                       "source string, confidence double, mention_count int, text string, label_status string")
    assert review.active_skills(rows, "m").first().skills == ["accounting"]
    assert review.active_skills(review.approve_candidates(rows), "m").first().skills == ["accounting", "sap financial accounting"]


def test_synthetic_adverts_do_not_depend_on_partitions(spark):
    roles = [{"title": "A", "category": "X", "salary": (100000, 200000), "description": "{company} in {city}"}]
    def rows():
        return sorted(tuple(r) for r in readers.synthetic_adverts(spark, 50, roles, [("P", "Q"), ("R", "S")], ["a", "b"], ["x"]).repartition(3).collect())
    assert rows() == rows() and len(rows()) == 50


def test_dropped_advert_blocks_no_later_one(spark):
    from skillgrid.operators.cleaning import unique_adverts
    rows = [(1, "s", "id1", "X"), (2, "s", "id2", "X"), (3, "s", "id2", "Y"), (4, "s", "", "Y"), (5, "s", None, "Z"), (6, "t", "id1", "W")]
    got = unique_adverts(spark.createDataFrame(rows, "job_id long, source string, external_id string, fingerprint string"))
    assert sorted(r["job_id"] for r in got.collect()) == [1, 3, 5, 6]
