"""Skill suggestions and gaps against plain counting."""

from pyspark.sql import functions as F

from skillgrid.functions import skills
from skillgrid.operators import analytics, pairs


def test_gap_keeps_order_and_nulls(spark):
    rows = spark.createDataFrame([(["a", "c", "e"], ["a", "b", "c"]), ([], ["a"]), (["a"], []), ([None, "a", "b"], [None, "b"]), (None, ["a"]), (["a"], None)],
                                 "course array<string>, job array<string>")
    got = [tuple(r) for r in rows.select(*pairs.gap_columns(F.col("course"), F.col("job"))).collect()]
    assert got == [(["a", "c"], ["b"], ["e"]), ([], ["a"], []), ([], [], ["a"]), ([None, "b"], [], ["a"]), (None, None, None), (None, None, None)]


def test_suggestions_count_jobs_courses_and_pairs(spark):
    results = [("c1", 1, ["sql", "tax"], ["audit"]), ("c2", 1, ["tax"], ["audit", "sql"]), ("c1", 2, [], ["tax"]), ("c1", None, ["tax"], []), (None, 3, ["tax"], ["sql"]), ("c1", 1, ["tax"], ["law"])]
    df = spark.createDataFrame(results, "course_id string, job_id long, matched array<string>, missing array<string>")
    names = {s for r in results for s in r[2] + r[3]}
    label = {r.s: r.l for r in spark.createDataFrame([(s,) for s in names], "s string").select("s", skills.refined_label(F.col("s")).alias("l")).collect()}
    seen = {}
    for course, job, matched, missing in results:
        for hit, side in ((1, matched), (0, missing)):
            for s in {label[x] for x in side} - {None}:
                seen.setdefault(s, []).append((course, job, hit))
    expected = {s: (len(v), len({j for _, j, _ in v}), len({c for c, _, h in v if h}), sum(h for *_, h in v), sum(1 - h for *_, h in v)) for s, v in seen.items()}
    got = {r.skill: (r.demand_count, r.job_count, r.course_count, r.matched_count, r.missing_count) for r in analytics.skill_suggestions(df, None).collect()}
    assert got == expected and len(got) > 1
    assert analytics.skill_suggestions(df.limit(0), None).count() == 0
    # pairs are combined by course before a shuffle, jobs counted from their lists: nothing is summed by skill and job
    assert "keys=[skill#" not in "".join(line for line in df.sparkSession._jvm.PythonSQLUtils.explainString(analytics.skill_suggestions(df)._jdf.queryExecution(), "simple").splitlines() if "job_id" in line and "sum(" in line)
