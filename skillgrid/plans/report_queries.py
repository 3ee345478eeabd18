"""Queries on gap results and evidence reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.functions import scores
from skillgrid.operators import analytics, pairs, vectors
from skillgrid.plans import binding as B
from skillgrid.plans.evidence_queries import EV_NEEDS, EV_SQL, KEPT, REPORT_NEEDS, REPORT_SQL, report, rows
from skillgrid.plans.registry import query
from skillgrid.plans.score_queries import TOKEN_COSINE_SQL
from skillgrid.plans.skill_queries import refine_sql
from skillgrid.operators.evidence import filter_evidence

PCT = B.sql_round("similarity_score * 100.0::DOUBLE", 1)
BAND = "CASE WHEN pct < 20 THEN '0-20' WHEN pct < 40 THEN '20-40' WHEN pct < 60 THEN '40-60' WHEN pct < 80 THEN '60-80' ELSE '80-100' END"
BANDS = f"(SELECT unnest({B._in(K.SCORE_BANDS)}) AS band)"
TENTHS = "CAST(sum(CAST(round(pct * 10) AS BIGINT)) AS BIGINT)"


def results_with_run(t):
    year = t.raw("orders").select(F.col("o_orderkey").alias("job_id"), F.year("o_orderdate").alias("run_id"))
    return t.results.join(year, "job_id")


@query("H1_latest_run", "SELECT run_id, name, created_on FROM m_run WHERE jobs > 0 ORDER BY created_on DESC LIMIT 1", ("m_run",))
def latest_run(t):
    return analytics.latest_run(t.runs, results_with_run(t).select("run_id"))


@query("H2_score_buckets", f"""
    WITH b AS (SELECT least(4, CAST(floor(greatest(0, similarity_score) * 5) AS INT)) AS bucket, count(*) AS n FROM m_result GROUP BY 1)
    SELECT CAST(i AS INT) AS bucket, ({B._in(K.SCORE_BANDS)})[i + 1] AS label, coalesce(n, 0) AS count,
      (SELECT {B.sql_round('avg(similarity_score) * 100', 1)} FROM m_result) AS average FROM range(5) r(i) LEFT JOIN b ON i = bucket""", ("m_result",))
def score_buckets(t):
    return analytics.score_buckets(t.results)


@query("H3_score_distribution", f"""
    WITH p AS (SELECT {PCT} AS pct FROM m_result), c AS (SELECT {BAND} AS band, count(*) AS n FROM p GROUP BY 1)
    SELECT band, coalesce(n, 0) AS count FROM {BANDS} LEFT JOIN c USING (band)""", ("m_result",))
def score_distribution(t):
    return analytics.score_distribution(t.results)


@query("H4_course_band_heatmap", f"""
    WITH p AS (SELECT course_id, {PCT} AS pct FROM m_result), c AS (SELECT course_id, {BAND} AS band, count(*) AS n FROM p GROUP BY 1, 2),
    a AS (SELECT course_id, {B.sql_round(f'{TENTHS} / count(*)::DOUBLE / 10.0::DOUBLE', 1)} AS avg_score FROM p GROUP BY 1)
    SELECT course_id, avg_score, avg_score < 55 AS mismatch, band, coalesce(n, 0) AS count,
      {B.sql_round('coalesce(n, 0)::DOUBLE / (SELECT max(n) FROM c)::DOUBLE', 3)} AS intensity FROM a CROSS JOIN {BANDS} LEFT JOIN c USING (course_id, band)""", ("m_result",))
def course_band_heatmap(t):
    return analytics.course_bands(t.results)


NAMED = """SELECT r.*, c.code, c.name AS course_name, CASE WHEN university = '' THEN 'Unassigned school' ELSE university END AS school, title AS job, company
    FROM m_result r JOIN m_course c ON r.course_id = c.course_id JOIN m_job j ON r.job_id = j.job_id"""


@query("H5_result_cells", f"""
    SELECT course_id, code AS course, course_name, school, job_id, job, company, {PCT} AS score, CAST(len(matched) AS INT) AS matched_count,
      CAST(len(missing) AS INT) AS missing_count, array_to_string(matched, ', ') AS matched, array_to_string(missing, ', ') AS missing
    FROM ({NAMED})""", ("m_result", "m_course", "m_job"))
def result_cells(t):
    return analytics.result_cells(t.results, t.jobs, t.courses)


@query("H6_matched_missing", """
    SELECT course_id, CAST(sum(len(matched)) AS BIGINT) AS matched_total, CAST(sum(len(missing)) AS BIGINT) AS missing_total FROM m_result GROUP BY 1""", ("m_result",))
def matched_missing(t):
    return analytics.matched_missing(t.results)


SCHOOL_SQL = f"""sch AS (SELECT CASE WHEN university = '' THEN 'Unassigned school' ELSE university END AS school, course_id, matched, missing, {PCT} AS pct
      FROM m_result JOIN m_course USING (course_id)),
    summ AS (SELECT *, avg_score < 55 OR missing_total > matched_total AS mismatch FROM (SELECT school,
      {B.sql_round(f'{TENTHS} / count(*)::DOUBLE / 10.0::DOUBLE', 1)} AS avg_score, CAST(sum(len(matched)) AS BIGINT) AS matched_total,
      CAST(sum(len(missing)) AS BIGINT) AS missing_total, count(DISTINCT course_id) AS course_count FROM sch GROUP BY 1))"""


@query("H7_school_summary", f"WITH {SCHOOL_SQL} SELECT * FROM summ", ("m_result", "m_course"))
def school_summary(t):
    return analytics.school_summary(t.results, t.courses)


def insight_sql(owner: str, rel: str) -> str:
    return f"""cnt AS (SELECT {owner} AS o, side, label, count(*) AS n FROM (
        SELECT {owner}, side, {refine_sql('raw')} AS label FROM (
          SELECT {owner}, 'matched' AS side, unnest(matched) AS raw FROM {rel} UNION ALL SELECT {owner}, 'missing', unnest(missing) FROM {rel})) WHERE label IS NOT NULL GROUP BY ALL),
      rnk AS (SELECT *, row_number() OVER (PARTITION BY o, side ORDER BY n DESC, label) AS r FROM cnt),
      lst AS (SELECT o, coalesce(list(label ORDER BY r) FILTER (side = 'missing' AND r <= 5), []) AS mi, coalesce(list(label ORDER BY r) FILTER (side = 'matched' AND r <= 4), []) AS ma FROM rnk GROUP BY 1),
      ins AS (SELECT o, array_to_string(list_filter([
          CASE WHEN len(mi) > 0 THEN 'Based on the analysed course-to-job data, the curriculum should strengthen ' || {_names('mi')} || '.' END,
          CASE WHEN len(ma) > 0 THEN 'The current evidence already shows coverage in ' || {_names('ma')} || '.' END], lambda x: x IS NOT NULL), ' ') AS insight,
          {_names('mi')} AS missing_names FROM lst)"""


def _names(c: str) -> str:
    return f"CASE WHEN len({c}) = 0 THEN '' WHEN len({c}) = 1 THEN {c}[1] ELSE array_to_string({c}[1:-2], ', ') || ' and ' || {c}[-1] END"


@query("H8_course_insight", f"WITH {insight_sql('course_id', 'm_result')} SELECT o AS course_id, insight, missing_names FROM ins", ("m_result",))
def course_insight(t):
    return analytics.skill_insight(t.results, "course_id")


@query("H8_school_recommendations", f"""
    WITH {SCHOOL_SQL}, {insight_sql('school', 'sch')}
    SELECT school, avg_score AS score, CASE WHEN avg_score < 90 THEN 'Average score is ' || avg_score || '%, below the 90% threshold.'
      ELSE 'Missing skill evidence (' || missing_total || ') exceeds matched evidence (' || matched_total || ').' END
      || ' ' || insight || ' Prioritise curriculum updates in modules linked to the job adverts with the highest missing-skill counts.' AS message
    FROM summ JOIN ins ON school = o WHERE avg_score < 90 OR missing_total > matched_total""", ("m_result", "m_course"))
def school_recommendations(t):
    return analytics.school_recommendations(t.results, t.courses, 90)


@query("H9_skill_suggestions", f"""
    WITH u AS (SELECT course_id, job_id, 1 AS hit, unnest(matched) AS raw FROM m_result UNION ALL SELECT course_id, job_id, 0, unnest(missing) FROM m_result),
    l AS (SELECT DISTINCT course_id, job_id, hit, {refine_sql('raw')} AS skill FROM u),
    g AS (SELECT skill, count(*) AS demand_count, count(DISTINCT job_id) AS job_count, count(DISTINCT course_id) FILTER (hit = 1) AS course_count,
      count_if(hit = 1) AS matched_count, count_if(hit = 0) AS missing_count FROM l WHERE skill IS NOT NULL GROUP BY 1)
    SELECT CAST(skill AS VARCHAR) AS skill, CAST(demand_count AS BIGINT) AS demand_count, job_count, course_count, CAST(matched_count AS BIGINT) AS matched_count,
      CAST(missing_count AS BIGINT) AS missing_count, CAST(round_even(matched_count * 100.0::DOUBLE / demand_count, 0) AS INT) AS coverage,
      CAST(round_even(missing_count * 100.0::DOUBLE / demand_count, 0) AS INT) AS gap_percent,
      CAST(round_even(missing_count * 100.0::DOUBLE / (SELECT max(missing_count) FROM g), 0) AS INT) AS gap_width
    FROM g ORDER BY missing_count DESC, coverage, skill LIMIT 8""", ("m_result",))
def skill_suggestions(t):
    return analytics.skill_suggestions(t.results)


@query("H10_role_profiles", """
    SELECT j.job_id, title AS role, company, category AS sector, s.skills, c.courses, c.schools FROM m_job j
    JOIN (SELECT job_id, string_agg(skill, '|' ORDER BY skill) AS skills FROM m_job_skill GROUP BY 1) s ON j.job_id = s.job_id
    CROSS JOIN (SELECT string_agg(DISTINCT code, '|' ORDER BY code) AS courses, string_agg(DISTINCT CASE WHEN university = '' THEN 'Unassigned school' ELSE university END, '|'
       ORDER BY CASE WHEN university = '' THEN 'Unassigned school' ELSE university END) AS schools FROM m_course) c""", ("m_job", "m_job_skill", "m_course"))
def role_profiles(t):
    p = analytics.role_profiles(t.jobs, t.job_skill, t.results, t.courses)
    return p.select("job_id", "role", "company", "sector", *[F.array_join(c, "|").alias(c) for c in ("skills", "courses", "schools")])


@query("H11_skill_correlation", f"""
    WITH f AS (SELECT skill, count(*)::DOUBLE AS n FROM m_job_skill GROUP BY 1 ORDER BY n DESC, skill LIMIT 16), t AS (SELECT count(DISTINCT job_id)::DOUBLE AS total FROM m_job_skill),
    b AS (SELECT l.skill AS "left", r.skill AS "right", count(*)::DOUBLE AS n_lr FROM m_job_skill l JOIN m_job_skill r ON l.job_id = r.job_id
      WHERE l.skill IN (SELECT skill FROM f) AND r.skill IN (SELECT skill FROM f) GROUP BY 1, 2)
    SELECT x.skill AS "left", y.skill AS "right", {B.sql_round('''CASE WHEN x.skill = y.skill THEN 1.0::DOUBLE ELSE
      (total * coalesce(n_lr, 0) - x.n * y.n) / (sqrt(x.n * (total - x.n)) * sqrt(y.n * (total - y.n))) END''', 2)} AS value
    FROM f x CROSS JOIN f y CROSS JOIN t LEFT JOIN b ON b."left" = x.skill AND b."right" = y.skill""", ("m_job_skill",))
def skill_correlation(t):
    return analytics.skill_correlation(t.job_skill)


@query("H12_role_divergence", f"""
    WITH p AS (SELECT title AS role, j.job_id, skill FROM m_job j JOIN m_job_skill s ON j.job_id = s.job_id),
    c AS (SELECT role, skill, count(*) AS n FROM p GROUP BY 1, 2), rt AS (SELECT role, sum(n) AS t FROM c GROUP BY 1), g AS (SELECT skill, sum(n) AS g FROM c GROUP BY 1),
    z AS (SELECT role, count(DISTINCT job_id) AS profile_count FROM p GROUP BY 1),
    v AS (SELECT z.role, profile_count, g.skill, coalesce(c.n, 0)::DOUBLE / rt.t::DOUBLE - g.g::DOUBLE / (SELECT sum(g) FROM g)::DOUBLE AS raw
      FROM z JOIN rt USING (role) CROSS JOIN g LEFT JOIN c ON c.role = z.role AND c.skill = g.skill),
    w AS (SELECT *, {B.sql_round('raw', 2)} AS value FROM v WHERE abs(raw) >= 0.001)
    SELECT role, profile_count, skill, value FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY abs(value) DESC, skill) AS r FROM w) WHERE r <= 9""".replace("0.001", "0.005"), ("m_job", "m_job_skill"))
def role_divergence(t):
    p = t.jobs.select("job_id", F.col("title").alias("role")).join(t.job_skill, "job_id")
    return analytics.role_divergence(p)


@query("H13_comparison_catalogue", """
    SELECT DISTINCT 'role' AS kind, title AS value FROM m_job UNION ALL SELECT DISTINCT 'sector', category FROM m_job WHERE category <> '' UNION ALL SELECT DISTINCT 'company', company FROM m_job
    UNION ALL SELECT DISTINCT 'skill', skill FROM m_job_skill UNION ALL SELECT 'course', code FROM m_course
    UNION ALL SELECT DISTINCT 'school', CASE WHEN university = '' THEN 'Unassigned school' ELSE university END FROM m_course""", ("m_job", "m_job_skill", "m_course"))
def comparison_catalogue(t):
    p = t.jobs.select(F.col("title").alias("role"), F.col("category").alias("sector"), "company")
    return analytics.comparison_catalogue(p, t.job_skill, t.courses)


@query("H14_filtered_results", """
    SELECT course_id, job_id, similarity_score FROM m_result JOIN orders ON job_id = o_orderkey JOIN m_course USING (course_id)
    WHERE year(o_orderdate) = 1998 AND university = 'University 3'""", ("m_result", "m_course"))
def filtered_results(t):
    return analytics.filter_results(results_with_run(t), t.courses, 1998, "University 3").select("course_id", "job_id", "similarity_score")


@query("H15_result_listing", f"SELECT code, course_name, school, job, company, job_id, {PCT} AS percent FROM ({NAMED})", ("m_result", "m_course", "m_job"))
def result_listing(t):
    return analytics.named_results(t.results, t.jobs, t.courses).select(
        "code", "course_name", "school", "job", "company", "job_id", scores.percent(F.col("similarity_score")).alias("percent"))


@query("H16_top_similarities", """
    SELECT course_id, job_id, similarity_score, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing
    FROM m_result ORDER BY similarity_score DESC, course_id, job_id LIMIT 20""", ("m_result",))
def top_similarities(t):
    return analytics.top_results(t.results).select("course_id", "job_id", "similarity_score",
                                                   F.array_join("matched", "|").alias("matched"), F.array_join("missing", "|").alias("missing"))


@query("H17_crosstab", f"""
    WITH c AS (SELECT course_id, max(similarity_score) AS s FROM m_result GROUP BY 1 ORDER BY s DESC, course_id LIMIT 18),
    j AS (SELECT job_id, max(similarity_score) AS s, min_by(course_id, (-similarity_score, course_id)) AS c FROM m_result GROUP BY 1 ORDER BY s DESC, c, job_id LIMIT 24)
    SELECT course_id, job_id, {PCT} AS score FROM m_result WHERE course_id IN (SELECT course_id FROM c) AND job_id IN (SELECT job_id FROM j)""", ("m_result",))
def crosstab(t):
    return analytics.crosstab(t.results)


@query("H18_demand_line", """
    WITH a AS (SELECT skill, count(*) AS n FROM m_job_skill GROUP BY 1 UNION ALL SELECT skill, count(*) FROM m_job_ent WHERE label_status <> 'candidate' GROUP BY 1),
    b AS (SELECT skill, count(DISTINCT module_id) AS n FROM m_mod_ent GROUP BY 1 UNION ALL SELECT skill, count(*) FROM m_mod_ent WHERE label_status <> 'candidate' GROUP BY 1),
    x AS (SELECT coalesce(j.skill, c.skill) AS skill, CAST(coalesce(j.n, 0) AS BIGINT) AS job_count, CAST(coalesce(c.n, 0) AS BIGINT) AS course_count
      FROM (SELECT skill, sum(n) AS n FROM a GROUP BY 1) j FULL JOIN (SELECT skill, sum(n) AS n FROM b GROUP BY 1) c ON j.skill = c.skill)
    SELECT skill, job_count, course_count FROM x ORDER BY job_count DESC, skill LIMIT 10""", ("m_job_skill", "m_job_ent", "m_mod_ent"))
def demand_line(t):
    from skillgrid.operators.review import is_active
    matrix = pairs.skill_matrix(t.job_skill, t.module_entities.select("module_id", "skill").distinct())
    return analytics.demand_line(matrix, t.job_lines.filter(is_active()).select("skill"), t.module_entities.filter(is_active()).select("skill"))


@query("H19_skill_association", f"""
    WITH {REPORT_SQL}, h AS (SELECT DISTINCT source_label, skill FROM rep), n AS (SELECT skill, count(*) AS n FROM h GROUP BY 1),
    p AS (SELECT l.skill AS "left", r.skill AS "right", count(*) AS pair_count FROM h l JOIN h r ON l.source_label = r.source_label AND l.skill < r.skill GROUP BY 1, 2),
    a AS (SELECT skill, list(DISTINCT sector) AS se, list(DISTINCT source_type) AS ty, list_distinct(string_split(skill, ' ')) AS wo FROM rep GROUP BY 1)
    SELECT "left", "right", {B.sql_round('''0.45::DOUBLE * (pair_count::DOUBLE / greatest(ln.n, rn.n)::DOUBLE) + 0.25::DOUBLE * (len(list_intersect(x.wo, y.wo))::DOUBLE / len(list_distinct(x.wo || y.wo))::DOUBLE)
       + 0.20::DOUBLE * (len(list_intersect(x.se, y.se))::DOUBLE / len(list_distinct(x.se || y.se))::DOUBLE) + 0.10::DOUBLE * (len(list_intersect(x.ty, y.ty))::DOUBLE / len(list_distinct(x.ty || y.ty))::DOUBLE)''', 3)} AS strength, pair_count
    FROM p JOIN n ln ON ln.skill = "left" JOIN n rn ON rn.skill = "right" JOIN a x ON x.skill = "left" JOIN a y ON y.skill = "right"
    ORDER BY strength DESC, pair_count DESC, "left" DESC, "right" DESC LIMIT 18""", REPORT_NEEDS)
def skill_association(t):
    return analytics.skill_association(report(t))


EDGE_SQL = f"""top AS (SELECT skill, count(*) AS n FROM ev WHERE {KEPT} GROUP BY 1 ORDER BY n DESC, skill LIMIT 36),
    ty AS (SELECT skill, min_by(skill_type, (-n, skill_type)) AS t FROM (SELECT skill, skill_type, count(*) AS n FROM ev WHERE {KEPT} GROUP BY 1, 2) GROUP BY 1),
    se AS (SELECT skill, min_by(sector, (-n, sector)) AS s FROM (SELECT skill, sector, count(*) AS n FROM ev WHERE {KEPT} GROUP BY 1, 2) GROUP BY 1),
    ab AS (SELECT skill, t, s FROM top JOIN ty USING (skill) JOIN se USING (skill)),
    edges AS (SELECT l.skill AS "left", r.skill AS "right", {B.sql_round('coalesce(cosine, 0) + CASE WHEN l.t = r.t THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN l.s = r.s THEN 0.12::DOUBLE ELSE 0 END', 3)} AS score
      FROM ab l JOIN ab r ON l.skill < r.skill LEFT JOIN cosines c ON c."left" = l.skill AND c."right" = r.skill)"""


@query("H20_association_edges", f"""WITH {EV_SQL}, {TOKEN_COSINE_SQL}, {EDGE_SQL} SELECT * FROM edges WHERE score >= 0.28""", EV_NEEDS + ("m_part",))
def association_edges(t):
    return analytics.association_edges(filter_evidence(rows(t)), vectors.token_pairs(t.parts))


@query("H21_yearly_forecast", f"""
    WITH {EV_SQL}, c AS (SELECT skill, extracted_year AS y, count(*) AS n FROM ev WHERE {KEPT} GROUP BY 1, 2), ys AS (SELECT DISTINCT y FROM c),
    z AS (SELECT s.skill, ys.y, coalesce(n, 0) AS n FROM (SELECT DISTINCT skill FROM c) s CROSS JOIN ys LEFT JOIN c ON c.skill = s.skill AND c.y = ys.y),
    g AS (SELECT skill, CAST(sum(n) AS BIGINT) AS total, string_agg(y || ':' || n, ',' ORDER BY y) AS counts, CAST(max(y) + 1 AS INT) AS next_year, max_by(n, y) AS last,
      (max_by(n, y) - min_by(n, y))::DOUBLE / (count(*) - 1)::DOUBLE AS slope FROM z GROUP BY 1)
    SELECT skill, total, counts, next_year, CAST(greatest(0, round_even(last + slope, 0)) AS INT) AS forecast FROM g""", EV_NEEDS)
def yearly_forecast(t):
    f = analytics.yearly_forecast(filter_evidence(rows(t)))
    counts = F.array_join(F.zip_with("years", "counts", lambda y, n: F.concat_ws(":", y.cast("string"), n.cast("string"))), ",")
    return f.select("skill", "total", counts.alias("counts"), "next_year", "forecast")


@query("H22_evidence_counts", f"""
    WITH {REPORT_SQL}
    SELECT CASE grouping(skill) * 8 + grouping(skill_type) * 4 + grouping(source_type) * 2 + grouping(extracted_year) WHEN 7 THEN 'skill' WHEN 11 THEN 'skill_type'
      WHEN 13 THEN 'source_type' WHEN 9 THEN 'source_by_type' ELSE 'skill_by_year' END AS chart, skill, skill_type, source_type, extracted_year, count(*) AS n
    FROM rep GROUP BY GROUPING SETS ((skill), (skill_type), (source_type), (source_type, skill_type), (skill, extracted_year))""", REPORT_NEEDS)
def evidence_counts(t):
    return analytics.evidence_counts(report(t))


@query("H26_summary_counts", """
    SELECT 'courses_total' AS measure, count(*) AS value FROM m_course UNION ALL SELECT 'courses_unique_names', count(DISTINCT name) FROM m_course
    UNION ALL SELECT 'courses_unique_codes', count(DISTINCT code) FROM m_course UNION ALL SELECT 'modules_total', count(*) FROM m_module
    UNION ALL SELECT 'modules_unique_names', count(DISTINCT name) FROM m_module UNION ALL SELECT 'jobs_total', count(*) FROM m_job
    UNION ALL SELECT 'jobs_unique_titles', count(DISTINCT title) FROM m_job UNION ALL SELECT 'jobs_unique_companies', count(DISTINCT company) FROM m_job
    UNION ALL SELECT 'jobs_unique_categories', count(DISTINCT category) FROM m_job WHERE category <> ''""", ("m_course", "m_module", "m_job"))
def summary_counts(t):
    return analytics.summary_counts(t.jobs, t.courses, t.modules)


def _top_sql(kind: str, col: str, rel: str) -> str:
    return f"SELECT * FROM (SELECT '{kind}' AS kind, {col} AS value, count(*) AS n FROM {rel} WHERE {col} <> '' GROUP BY 2 ORDER BY n DESC, value LIMIT 8)"


@query("H26_summary_tops", " UNION ALL ".join([
    _top_sql("job_title", "title", "m_job"), _top_sql("company", "company", "m_job"), _top_sql("category", "category", "m_job"),
    _top_sql("course", "name", "m_course"), _top_sql("university", "university", "m_course")]), ("m_job", "m_course"))
def summary_tops(t):
    return analytics.summary_tops(t.jobs, t.courses)


@query("H27_hub_network", f"""
    WITH {REPORT_SQL}, k AS (SELECT * FROM rep WHERE skill IN (SELECT skill FROM rep GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 18))
    SELECT 'skill:' || skill AS "from", '' AS "to", count(*) AS count FROM k GROUP BY 1 UNION ALL SELECT 'type:' || skill_type, '', count(*) FROM k GROUP BY 1
    UNION ALL SELECT 'source:' || source_type, '', count(*) FROM k GROUP BY 1
    UNION ALL SELECT DISTINCT 'skill:' || skill, 'type:' || skill_type, 0 FROM k UNION ALL SELECT DISTINCT 'skill:' || skill, 'source:' || source_type, 0 FROM k""", REPORT_NEEDS)
def hub_network(t):
    nodes, edges = analytics.hub_network(report(t))
    n = nodes.select(F.concat_ws(":", "kind", "label").alias("from"), F.lit("").alias("to"), "count")
    return n.unionByName(edges.withColumn("count", F.lit(0).cast("bigint")))


@query("H28_executive_values", f"""
    SELECT 'schools' AS measure, count(DISTINCT university)::DOUBLE AS value FROM m_course UNION ALL SELECT 'courses', count(*) FROM m_course UNION ALL SELECT 'modules', count(*) FROM m_module
    UNION ALL SELECT 'job_adverts', count(*) FROM m_job UNION ALL SELECT 'comparisons', count(*) FROM m_result
    UNION ALL SELECT 'average_score', {B.sql_round('sum(CAST(round(similarity_score * 100) AS BIGINT)) / count(*)::DOUBLE', 1)} FROM m_result
    UNION ALL SELECT 'reviewed_entities', count_if(label_status = 'reviewed') FROM m_job_ent UNION ALL SELECT 'candidate_entities', count_if(label_status = 'candidate') FROM m_job_ent
    UNION ALL SELECT 'approved_aliases', count_if(status = 'approved') FROM m_alias UNION ALL SELECT 'candidate_aliases', count_if(status = 'candidate') FROM m_alias""",
    ("m_course", "m_module", "m_job", "m_result", "m_job_ent", "m_alias"))
def executive_values(t):
    return analytics.executive_values(t.courses, t.modules, t.jobs, t.results, t.job_lines, t.aliases)
