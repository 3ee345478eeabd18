"""Skill-evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.functions import skills
from skillgrid.operators import evidence, extract
from skillgrid.plans import binding as B
from skillgrid.plans.registry import query
from skillgrid.plans.skill_queries import clean_sector_sql, sector_sql

EXCLUDED = f"list_contains({B._in(K.EXCLUDED_TERMS)}, skill)"

# the evidence table as a CTE
EV_SQL = f"""ev AS MATERIALIZED (
    SELECT 'job' AS source_type, CAST(e.job_id AS VARCHAR) AS source_id,
      CASE WHEN company <> '' THEN title || ' @ ' || company ELSE title END AS source_label, '' AS parent_label, entity_id, chunk_id, skill,
      CASE WHEN {EXCLUDED} THEN 'exclude' ELSE label END AS label, tier, CASE WHEN {EXCLUDED} THEN 'exclude' ELSE skill_type END AS skill_type,
      coalesce(nullif(CASE WHEN label = 'sector' THEN skill ELSE '' END, ''), nullif({clean_sector_sql('category')}, ''),
        nullif({sector_sql("lower(title || ' ' || description || ' ' || category || ' ' || company || ' ' || skill || ' ' || text)")}, ''), 'Unclassified') AS sector,
      title AS job_title, coalesce(date_posted, created_on) AS extracted_date, CAST(year(coalesce(date_posted, created_on)) AS INT) AS extracted_year,
      e.source, confidence, mention_count, text, label_status, 'job:' || e.job_id || ':' || entity_id AS unique_key, pos
    FROM m_job_ent e JOIN m_job j ON e.job_id = j.job_id
    UNION ALL
    SELECT 'module', e.module_id, module_name, e.course_id, entity_id, chunk_id, skill,
      CASE WHEN {EXCLUDED} THEN 'exclude' ELSE label END, tier, CASE WHEN {EXCLUDED} THEN 'exclude' ELSE skill_type END,
      coalesce(nullif({sector_sql("lower(m.name || ' ' || e.course_id || ' ' || m.content || ' ' || e.course_id || ' MBA ' || e.course_id || ' ' || skill || ' ' || text)")}, ''), e.course_id),
      '', m.created_on, 1999, e.source, confidence, mention_count, text, label_status, 'module:' || e.module_id || ':' || entity_id, pos
    FROM m_mod_ent e JOIN m_module m ON e.module_id = m.module_id)"""
EV_NEEDS = ("m_job_ent", "m_job", "m_mod_ent", "m_module")
KEPT = "skill_type <> 'exclude' AND label <> 'exclude'"
ORDER = "source_type, source_label, source_id, pos"


def rows(t):
    return evidence.evidence_rows(t.job_entities, t.jobs, t.module_entities, t.modules, t.courses)


@query("G1_evidence_rows", f"WITH {EV_SQL} SELECT * FROM ev", EV_NEEDS)
def evidence_rows(t):
    return rows(t)


@query("G2_filtered_evidence", f"""
    WITH {EV_SQL} SELECT unique_key, pos, skill, sector FROM ev WHERE {KEPT} AND source_type = 'job' AND skill_type IN ('technical', 'business')
      AND label_status IN ('reviewed', 'machine') AND (contains(lower(skill), 'data') OR contains(lower(source_label), 'data')
        OR contains(lower(sector), 'data') OR contains(lower(job_title), 'data') OR contains(lower(chunk_id), 'data') OR contains(lower(entity_id), 'data'))""", EV_NEEDS)
def filtered_evidence(t):
    return evidence.filter_evidence(rows(t), source=["job"], skill_type=["technical", "business"], label_status=["reviewed", "machine"],
                                    q=" Data ").select("unique_key", "pos", "skill", "sector")


@query("G3_bundle_counts", f"""
    WITH {EV_SQL}, s AS (SELECT * FROM ev WHERE {KEPT}), c AS (SELECT * FROM s)
    SELECT 'skill_type' AS kind, skill_type AS value, count(*) AS n FROM c GROUP BY 2
    UNION ALL SELECT 'source_type', source_type, count(*) FROM c GROUP BY 2
    UNION ALL SELECT DISTINCT 'facet_skill_type', skill_type, 0 FROM s UNION ALL SELECT DISTINCT 'facet_label_status', label_status, 0 FROM s
    UNION ALL SELECT DISTINCT 'facet_sector', sector, 0 FROM s UNION ALL SELECT DISTINCT 'facet_job_title', job_title, 0 FROM s WHERE job_title <> ''""", EV_NEEDS)
def bundle_counts(t):
    return evidence.bundle_counts(evidence.filter_evidence(rows(t)))


@query("G4_document_frequency", f"""
    SELECT skill, count(DISTINCT job_id) AS frequency FROM m_job_ent WHERE label <> 'exclude' AND source <> 'regex' AND label_status <> 'candidate' AND NOT {EXCLUDED}
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", ("m_job_ent",))
def document_frequency(t):
    return evidence.top(evidence.document_frequency(t.job_lines, "job_id"), 10)


FIRST_SQL = """SELECT {o} AS owner, skill, row_number() OVER (PARTITION BY {o} ORDER BY min(pos), skill) AS r FROM {e}
      WHERE label_status <> 'candidate' GROUP BY 1, 2"""


@query("G5_display_skills", f"""
    SELECT owner AS job_id, string_agg(skill, '|' ORDER BY r) AS skills FROM ({FIRST_SQL.format(o='job_id', e='m_job_ent')}) WHERE r <= 3 GROUP BY 1""", ("m_job_ent",))
def display_skills(t):
    return evidence.display_skills(t.job_entities, "job_id", 3).select("job_id", F.array_join("skills", "|").alias("skills"))


@query("G6_course_display_skills", f"""
    WITH f AS ({FIRST_SQL.format(o='module_id', e='m_mod_ent')}),
    c AS (SELECT split_part(owner, '/', 1) AS course_id, skill, count(*) AS n FROM f WHERE r <= 24 GROUP BY 1, 2)
    SELECT course_id, skill, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY n DESC, skill) AS rank FROM c) WHERE rank <= 12""", ("m_mod_ent",))
def course_display_skills(t):
    return evidence.course_display_skills(t.module_entities)


@query("G7_unique_entities", """
    SELECT job_id, CAST(rank AS INT) AS rank, entity_id, skill, source, confidence, mention_count FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY job_id, entity_id ORDER BY pos) AS u FROM m_job_ent) WHERE u = 1) WHERE rank <= 10""", ("m_job_ent",))
def unique_entities(t):
    return evidence.unique_entities(t.job_entities, "job_id")


@query("G8_active_skills", """
    SELECT job_id, string_agg(DISTINCT skill, '|' ORDER BY skill) AS skills FROM m_job_ent WHERE label_status <> 'candidate' GROUP BY 1""", ("m_job_ent",))
def active_skills(t):
    from skillgrid.operators import review
    return review.active_skills(t.job_lines, "job_id").select("job_id", F.array_join("skills", "|").alias("skills"))


REPORT_SQL = """rep AS MATERIALIZED (
    SELECT skill, 'job' AS skill_type, 'job' AS source_type, CASE WHEN category = '' THEN 'Unclassified' ELSE category END AS sector,
      CAST(year(coalesce(date_posted, created_on)) AS INT) AS extracted_year, CASE WHEN company <> '' THEN title || ' @ ' || company ELSE title END AS source_label
    FROM m_job_ent e JOIN m_job j ON e.job_id = j.job_id WHERE label_status <> 'candidate'
    UNION ALL SELECT skill, 'course', 'module', CASE WHEN university = '' THEN 'Course module' ELSE university END, 1999, module_name
    FROM m_mod_ent e JOIN m_course c ON e.course_id = c.course_id WHERE label_status <> 'candidate')"""
REPORT_NEEDS = ("m_job_ent", "m_job", "m_mod_ent", "m_course")


def report(t):
    return evidence.report_rows(t.job_lines, t.jobs, t.module_entities, t.courses)


@query("G9_report_rows", f"""
    WITH {REPORT_SQL} SELECT skill, skill_type, source_type, sector, extracted_year, count(*) AS n FROM rep GROUP BY ALL""", REPORT_NEEDS)
def report_rows(t):
    return report(t).groupBy("skill", "skill_type", "source_type", "sector", "extracted_year").agg(F.count("*").alias("n"))


@query("G9_matrix_rows", """
    SELECT skill, 'job' AS skill_type, 'job' AS source_type, 'Analysis aggregate' AS sector, count(*) AS n FROM m_job_skill GROUP BY 1
    UNION ALL SELECT skill, 'course', 'module', 'Analysis aggregate', count(DISTINCT module_id) FROM m_mod_ent GROUP BY 1""", ("m_job_skill", "m_mod_ent"))
def matrix_rows(t):
    from skillgrid.operators import pairs
    matrix = pairs.skill_matrix(t.job_skill, t.module_entities.select("module_id", "skill").distinct())
    return evidence.matrix_rows(matrix).groupBy("skill", "skill_type", "source_type", "sector").agg(F.count("*").alias("n"))


@query("G10_balanced_sample", f"""
    WITH {EV_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY {ORDER}) AS rn FROM ev WHERE {KEPT})
    SELECT source_type, unique_key, pos FROM (SELECT *, CASE WHEN rn > 450 THEN 1 ELSE 0 END AS late FROM k) ORDER BY late, source_type, rn LIMIT 900""", EV_NEEDS)
def balanced_sample(t):
    return evidence.balanced_sample(evidence.filter_evidence(rows(t))).select("source_type", "unique_key", "pos")


@query("G11_status_counts", """
    SELECT count_if(label_status = 'candidate') AS candidate, count_if(label_status = 'reviewed') AS reviewed, count_if(label_status = 'legacy') AS legacy,
      count_if(label_status = 'machine') AS machine, count(*) AS total FROM (SELECT label_status FROM m_job_ent UNION ALL SELECT label_status FROM m_mod_ent)""", ("m_job_ent", "m_mod_ent"))
def status_counts(t):
    return evidence.status_counts(t.job_lines.select("label_status").unionByName(t.module_entities.select("label_status")))


@query("G12_course_skill_audit", """
    SELECT m.course_id, m.module_id, m.name AS module_name, s.skill, entity_id, chunk_id, source, skill_type, tier, label_status, label, confidence, m.content AS context
    FROM m_module m JOIN (SELECT *, row_number() OVER (PARTITION BY module_id, skill ORDER BY pos DESC) AS r FROM m_mod_ent) s ON s.module_id = m.module_id AND r = 1""", ("m_module", "m_mod_ent"))
def course_skill_audit(t):
    none = F.lit(None).cast("int")
    context = extract.paragraph_context(F.col("content"), none, none, F.col("skill"), 2000)
    return evidence.course_audit(t.modules, t.module_entities, context)


@query("G13_candidate_queue", f"""
    WITH {EV_SQL} SELECT * FROM (SELECT 'candidate' AS queue, unique_key, pos FROM ev WHERE label_status = 'candidate' AND {KEPT} ORDER BY {ORDER} LIMIT 60)
    UNION ALL SELECT * FROM (SELECT 'reviewed', unique_key, pos FROM ev WHERE label_status = 'reviewed' AND {KEPT}
      ORDER BY source_type DESC, source_label DESC, source_id DESC, pos DESC LIMIT 24)""", EV_NEEDS)
def candidate_queue(t):
    r = rows(t)
    a = evidence.candidate_queue(r).select(F.lit("candidate").alias("queue"), "unique_key", "pos")
    return a.unionByName(evidence.recently_reviewed(r).select(F.lit("reviewed").alias("queue"), "unique_key", "pos"))


@query("G14_course_list", """
    SELECT 'course' AS kind, code AS value FROM m_course WHERE university = 'University 2' AND country = 'South Africa'
    UNION ALL SELECT DISTINCT 'university', university FROM m_course WHERE university <> '' UNION ALL SELECT DISTINCT 'country', country FROM m_course""", ("m_course",))
def course_list(t):
    listed = evidence.course_list(t.courses, "University 2", "South Africa").select(F.lit("course").alias("kind"), F.col("code").alias("value"))
    return listed.unionByName(evidence.course_facets(t.courses).select(F.col("facet").alias("kind"), "value"))
