"""Tagged outputs: what is written comes back, and is counted."""

from skillgrid.sources import reports


def test_rows_come_back_with_their_types(spark, tmp_path):
    rows = [("a", 'quo"te, comma', 1, 0.5, True), ("a", "two\nlines", None, None, False), ("b c/d", "", 3, -0.0, None), (None, None, 4, 1e-9, True), ("", "\\N", 5, 2.0, True), ("a", "a\\", 6, 1.0, True),
            ("a", "a\\", 6, 1.0, True)]
    df = spark.createDataFrame(rows, "tag string, body string, n long, x double, ok boolean")
    counts = reports.write_tagged(df, str(tmp_path / "out"), "tag")
    assert {(r.tag, r.rows) for r in counts.collect()} == {("a", 4), ("b c/d", 1), ("", 2)}
    back = reports.read_tagged(spark, str(tmp_path / "out"), df.schema, "tag")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([(t or "", *rest) for t, *rest in rows], key=repr)
    again = reports.write_tagged(df.where("tag = 'a'"), str(tmp_path / "out"), "tag")  # a repeated job replaces all outputs
    assert {(r.tag, r.rows) for r in again.collect()} == {("a", 4)}


def test_long_text_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([("t", "line\n" * 50_000)], "tag string, body string")
    reports.write_tagged(df, str(tmp_path / "long"), "tag")
    assert reports.read_tagged(spark, str(tmp_path / "long"), df.schema, "tag").first().body == "line\n" * 50_000
    assert reports.write_tagged(df.limit(0), str(tmp_path / "none"), "tag").count() == 0


def test_refined_rows_fill_defaults(spark):
    own = "entity_id string, chunk_id string, skill string, label string, skill_type string, tier string, source string, confidence double, mention_count int, text string, start int, end int, label_status string"
    e = ("i", "k", "sql", None, "technical", "tool", "ner", 0.9, 2, "SQL", None, None, "")
    jobs = spark.createDataFrame([(1, "T", "", "C"), (2, "T", "Firm", None)], "job_id long, title string, company string, category string")
    job_e = spark.createDataFrame([(1, *e), (2, *e), (9, *e)], "job_id long, " + own)
    mods = spark.createDataFrame([("m", "c", "M")], "module_id string, course_id string, name string")
    courses = spark.createDataFrame([("c", "", "Course")], "course_id string, code string, name string")
    got = reports.refined_rows(job_e, jobs, spark.createDataFrame([("m", *e)], "module_id string, " + own), mods, courses).collect()
    assert {(r.source_type, r.source_id, r.parent_label, r.source_label, r.label, r.label_status) for r in got} == {
        ("job", "1", "C", "T", "SKILL", "machine"), ("job", "2", None, "T @ Firm", "SKILL", "machine"), ("module", "m", "Course", "M", "SKILL", "machine")}
