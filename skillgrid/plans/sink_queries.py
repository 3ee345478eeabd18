"""Sinks with several outputs, written in one pass and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.operators import pairs, verify
from skillgrid.plans import binding as B
from skillgrid.plans.registry import query
from skillgrid.plans.review_queries import WARN_FROM, WARN_SQL, _listed, matrix_health
from skillgrid.session import work_dir
from skillgrid.sources import reports

REFINED_SQL = """
    SELECT 'job' AS source_type, CAST(e.job_id AS VARCHAR) AS source_id, category AS parent_label, CASE WHEN company <> '' THEN title || ' @ ' || company ELSE title END AS source_label,
      entity_id, chunk_id, skill, label, skill_type, tier, e.source, confidence, mention_count, text, CAST(pos * 20 AS INT) AS "start", CAST(pos * 20 + length(skill) AS INT) AS "end", label_status
    FROM m_job_ent e JOIN m_job j ON e.job_id = j.job_id
    UNION ALL SELECT 'module', module_id, course_id, module_name, entity_id, chunk_id, skill, label, skill_type, tier, source, confidence, mention_count, text, CAST(pos AS INT), NULL, label_status FROM m_mod_ent"""


def _refined(t):
    start = (F.col("pos") * 20).cast("int")
    jobs = t.job_entities.withColumn("start", start).withColumn("end", (start + F.length("skill")).cast("int"))
    mods = t.module_entities.withColumn("start", F.col("pos").cast("int")).withColumn("end", F.lit(None).cast("int"))
    return reports.refined_rows(jobs, t.jobs, mods, t.modules, t.courses)


@query("A15_refined_tables", REFINED_SQL, ("m_job_ent", "m_mod_ent", "m_job"))
def refined_tables(t):
    """Both refined-skill tables, read back from their folders."""
    path, rows = work_dir(t.spark, "refined"), _refined(t)
    reports.write_tagged(rows, path, "source_type")
    return reports.read_tagged(t.spark, path, rows.schema, "source_type")


@query("A15_refined_counts", f"SELECT source_type, count(*) AS rows FROM ({REFINED_SQL}) GROUP BY 1", ("m_job_ent", "m_mod_ent", "m_job"))
def refined_counts(t):
    return reports.write_tagged(_refined(t), work_dir(t.spark, "refined"), "source_type")


@query("A14_dashboard_visuals", f"""
    WITH b AS (SELECT least(4, CAST(floor(greatest(0, similarity_score) * 5) AS INT)) AS bucket, count(*) AS n FROM m_result GROUP BY 1),
    mx AS (SELECT 'jobs' AS source, skill, count(*) AS n FROM m_job_skill GROUP BY 2 UNION ALL SELECT 'courses', skill, count(DISTINCT module_id) FROM m_mod_ent GROUP BY 2),
    e AS (SELECT * FROM m_result ORDER BY similarity_score DESC, course_id, job_id LIMIT 100)
    SELECT 'score_bucket_summary' AS visual, 'Latest' AS run, 'analysis' AS source, NULL AS course_id, NULL AS course, NULL AS job_id, NULL AS job, ({B._in(K.SCORE_BANDS)})[i + 1] AS dimension,
      coalesce(n, 0)::DOUBLE AS value, NULL::DOUBLE AS score_percent, NULL AS matched_skills, NULL AS missing_skills, 'Pairs of course and job with a score in the range' AS notes FROM range(5) r(i) LEFT JOIN b ON i = bucket
    UNION ALL SELECT 'skill_demand_vs_curriculum', 'Latest', source, NULL, NULL, NULL, NULL, skill, n, NULL, NULL, NULL, 'Documents of the side with the skill'
      FROM (SELECT * FROM mx QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, skill) <= 50)
    UNION ALL SELECT 'course_to_job_network_edge', 'Latest', 'similarity', e.course_id, name, CAST(e.job_id AS VARCHAR), title, 'cosine_similarity', similarity_score, {B.sql_round('similarity_score * 100.0::DOUBLE', 1)},
      array_to_string(matched, '; '), array_to_string(missing, '; '), 'Edge of the similarity network' FROM e JOIN m_course c ON e.course_id = c.course_id JOIN m_job j ON e.job_id = j.job_id""",
    ("m_result", "m_job_skill", "m_mod_ent", "m_course", "m_job"))
def dashboard_visuals(t):
    """Chart points of the dashboard, written by chart and read back."""
    matrix = pairs.skill_matrix(t.job_skill, t.module_entities.select("module_id", "skill").distinct())
    rows, path = reports.dashboard_visuals("Latest", t.results, matrix, t.jobs, t.courses), work_dir(t.spark, "dashboard")
    reports.write_tagged(rows, path, "visual")
    return reports.read_tagged(t.spark, path, rows.schema, "visual")


JOB_WARN_FROM = """(SELECT j.job_id, j.description AS content, count(e.skill) AS n, count(DISTINCT e.skill) AS d FROM m_job j
    LEFT JOIN (SELECT * FROM m_job_ent WHERE label_status = 'reviewed') e ON e.job_id = j.job_id GROUP BY 1, 2)"""
#: A job text counts as long from here on.
LONG_JOB = 80


def _warned_sql(section, key, source, warn):
    return f"""SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS record, n AS skill_count, length(content) AS text_chars, replace(rtrim({warn}, '|'), '|', ' | ') AS warnings,
        content AS sample, NULL::BIGINT AS value, TRUE AS flagged FROM {source} WHERE {warn} <> '' AND content <> ''"""


@query("A18_verification_records", f"""
    WITH y AS (SELECT max(year(o_orderdate)) AS run_id FROM orders),
    m AS (SELECT 'jobs' AS source, skill, count(*) AS f FROM m_job_skill JOIN orders ON job_id = o_orderkey WHERE year(o_orderdate) = (SELECT run_id FROM y) GROUP BY 2
      UNION ALL SELECT 'courses', skill, count(DISTINCT module_id) FROM m_mod_ent GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f DESC, skill) AS rn FROM m)
    {_warned_sql('modules', 'module_id', WARN_FROM, WARN_SQL)} UNION ALL {_warned_sql('jobs', 'job_id', JOB_WARN_FROM, WARN_SQL.replace('>= 20', f'>= {LONG_JOB}'))}
    UNION ALL SELECT 'skill_matrix', source, count(*), NULL, NULL, NULL, CAST(sum(f) FILTER (rn <= 20) AS BIGINT), count(*) <= 1 FROM r GROUP BY 2""",
    ("m_module", "m_mod_ent", "m_job", "m_job_ent", "m_job_skill"))
def verification_records(t):
    """The report of all checks, written by section and read back."""
    have = t.job_lines.where("label_status = 'reviewed'").groupBy("job_id").agg(F.collect_list("skill").alias("skills"))
    jobs = t.jobs.join(have, "job_id", "left").select(F.col("job_id").alias("record"), F.col("description").alias("text"), F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))
    mods = _listed(t).withColumnRenamed("module_id", "record")
    rows = reports.verification_records(verify.suspicious(mods, ["record"], None, 20), verify.suspicious(jobs, ["record"], None, LONG_JOB), matrix_health(t))
    path = work_dir(t.spark, "verification")
    reports.write_tagged(rows, path, "section")
    return reports.read_tagged(t.spark, path, rows.schema, "section")
