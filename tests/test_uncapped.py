"""Tables larger than the sizes at which results used to be cut."""

import json

from pyspark.sql import functions as F

from skillgrid.operators import analytics, evidence, verify


def test_all_evidence_is_counted(spark):
    jobs = spark.range(3500).select(F.col("id").cast("string").alias("i"), F.lit("job").alias("source_type"), F.lit("technical").alias("skill_type"), F.lit("Finance").alias("sector"))
    modules = spark.range(7).select(F.concat(F.lit("z"), F.col("id").cast("string")).alias("i"), F.lit("module").alias("source_type"), F.lit("soft").alias("skill_type"), F.lit("Law").alias("sector"))
    rows = jobs.unionByName(modules)
    for c in [*evidence.EVIDENCE_ORDER, "label_status", "job_title"]:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.col("i"))
    got = {(r.kind, r.value): r.n for r in evidence.bundle_counts(rows).collect() if not r.kind.startswith("facet_label") and r.kind != "facet_job_title"}
    assert got == {("skill_type", "technical"): 3500, ("skill_type", "soft"): 7, ("source_type", "job"): 3500, ("source_type", "module"): 7,
                   ("facet_skill_type", "technical"): 0, ("facet_skill_type", "soft"): 0, ("facet_sector", "Finance"): 0, ("facet_sector", "Law"): 0}
    few = evidence.bundle_counts(rows, sample=10, chart=4)
    assert few.where("kind = 'skill_type'").agg(F.sum("n")).first()[0] == 4


def test_all_cells_and_names(spark):
    names = [f"skill {k:02}" for k in range(12)]
    results = spark.range(700).select(F.lit("c").alias("course_id"), F.col("id").alias("job_id"), (F.col("id") / 700).alias("similarity_score"),
                                      F.lit(names).alias("matched"), F.lit(names[:9]).alias("missing"))
    jobs = spark.range(700).select(F.col("id").alias("job_id"), F.lit("t").alias("title"), F.lit("x").alias("company"))
    courses = spark.createDataFrame([("c", "C1", "Course", "")], "course_id string, code string, name string, university string")
    cells = analytics.result_cells(results, jobs, courses)
    assert cells.count() == 700 and analytics.result_cells(results, jobs, courses, 5).count() == 5
    first = cells.first()
    assert first.job_id == 699 and first.matched == ", ".join(names) and first.missing == ", ".join(names[:9])


def test_all_suspicious_records_and_names(spark):
    docs = spark.range(33).select("id", F.lit("a long text " * 40).alias("text"), F.array(F.lit("x")).alias("skills"))
    assert verify.suspicious(docs, ["id"]).count() == 33 and verify.suspicious(docs, ["id"], 20).count() == 20
    names = [f"skill {k}" for k in range(30)]
    answer = F.lit(json.dumps({"status": "ok", "suggested_skills": json.dumps(names), "false_positive_stored_skills": ", ".join(names)}))
    got = spark.range(1).select(verify.normalised_response(answer).alias("r"), verify.normalised_response(answer, 12).alias("few")).first()
    assert got.r.suggested_skills == names and got.r.false_positive_stored_skills == names and got.few.suggested_skills == names[:12]
