"""Graph, retrieval and crawled-page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.operators import analytics, crawl, graphs, pairs, retrieval
from skillgrid.operators.evidence import filter_evidence
from skillgrid.plans import binding as B
from skillgrid.plans.evidence_queries import EV_NEEDS, EV_SQL, KEPT, ORDER, rows
from skillgrid.plans.registry import query
from skillgrid.plans.report_queries import NAMED, PCT
from skillgrid.session import cut


@query("H23_similarity_network", f"""
    WITH b AS (SELECT * FROM ({NAMED}) ORDER BY similarity_score DESC, course_id, job_id LIMIT 40),
    e AS (SELECT job_id, entity_id, skill, mention_count, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY job_id, entity_id ORDER BY pos) AS u FROM m_job_ent WHERE job_id IN (SELECT job_id FROM b)) WHERE u = 1)
    SELECT DISTINCT 'node' AS kind, 'course-' || course_id AS a, code AS z, 0.0::DOUBLE AS value FROM b UNION ALL SELECT DISTINCT 'node', 'job-' || job_id, left(job, 28), 0 FROM b
    UNION ALL SELECT DISTINCT 'node', entity_id, left(skill, 26), 0 FROM e WHERE rank <= 10
    UNION ALL SELECT 'edge', 'course-' || course_id, 'job-' || job_id, greatest(1.0, {PCT}) FROM b
    UNION ALL SELECT 'edge', 'job-' || job_id, entity_id, greatest(8, mention_count * 8) FROM e WHERE rank <= 10""", ("m_result", "m_course", "m_job", "m_job_ent"))
def similarity_network(t):
    nodes, edges = graphs.similarity_network(t.results, t.jobs, t.courses, t.job_entities)
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("z"), F.lit(0.0).alias("value"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("z"), "value"))


SPACE_SQL = f"""s0 AS (SELECT * FROM ev WHERE {KEPT} ORDER BY {ORDER} LIMIT 1800),
    few AS (SELECT * FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_type ORDER BY {ORDER}) > 450 THEN 1 ELSE 0 END AS late FROM s0) ORDER BY late, {ORDER} LIMIT 900),
    ctx AS (SELECT entity_id, min((source_type, source_label, source_id, pos)) AS first, min_by(skill, (source_type, source_label, source_id, pos)) AS skill,
      min_by(skill_type, (source_type, source_label, source_id, pos)) AS ty, list(DISTINCT sector) AS se FROM few GROUP BY 1 ORDER BY first, entity_id LIMIT 140),
    bag AS (SELECT skill AS n, w AS t, count(*) AS c FROM (SELECT skill, unnest(string_split(skill, ' ')) AS w FROM ctx) GROUP BY 1, 2), sz AS (SELECT n, sqrt(sum(c * c)) AS s FROM bag GROUP BY 1),
    co AS (SELECT l.n AS a, r.n AS b, sum(l.c * r.c) / (any_value(ls.s) * any_value(rs.s)) AS cosine FROM bag l JOIN bag r ON l.t = r.t AND l.n < r.n JOIN sz ls ON ls.n = l.n JOIN sz rs ON rs.n = r.n GROUP BY 1, 2),
    nr AS (SELECT cosine + CASE WHEN x.ty = y.ty THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN len(list_intersect(x.se, y.se)) > 0 THEN 0.06::DOUBLE ELSE 0 END AS score,
      CASE WHEN x.first <= y.first THEN x.entity_id ELSE y.entity_id END AS source, CASE WHEN x.first <= y.first THEN y.entity_id ELSE x.entity_id END AS target
      FROM co JOIN ctx x ON x.skill = a JOIN ctx y ON y.skill = b),
    edges AS (SELECT CASE WHEN source_type = 'job' THEN 'job-' || source_id ELSE 'course-' || parent_label END AS source, entity_id AS target, 'evidence' AS "group", greatest(1, mention_count)::DOUBLE AS value, 0 AS similarity FROM few
      UNION ALL SELECT source, target, 'similarity', greatest(1.0, least(100, floor(score * 100.0 + 0.5)) / 18.0), CAST(least(100, floor(score * 100.0 + 0.5)) AS INT) FROM nr WHERE score >= 0.26)"""


@query("H24_skill_space_edges", f"""WITH {EV_SQL}, {SPACE_SQL} SELECT source, target, "group", {B.sql_round('value', 6)} AS value, similarity FROM edges""", EV_NEEDS)
def skill_space_edges(t):
    from skillgrid.functions.scores import half_up
    _, edges = graphs.skill_space(filter_evidence(rows(t)))
    return edges.withColumn("value", half_up(F.col("value"), 6))


@query("H25_sub_graph", f"""
    WITH {EV_SQL}, {SPACE_SQL},
    nd AS (SELECT entity_id AS id, max_by(skill_type, (source_type, source_label, source_id, pos)) AS st FROM few GROUP BY 1),
    hit AS (SELECT id FROM nd WHERE st = 'business'),
    vis AS (SELECT id FROM hit UNION SELECT source FROM edges WHERE target IN (SELECT id FROM hit) UNION SELECT target FROM edges WHERE source IN (SELECT id FROM hit))
    SELECT source, target, "group" FROM edges WHERE source IN (SELECT id FROM vis) AND target IN (SELECT id FROM vis)""", EV_NEEDS)
def sub_graph(t):
    nodes, edges = graphs.skill_space(filter_evidence(rows(t)))
    return graphs.sub_graph(nodes, edges, group="skill", skill_type="business")[1].select("source", "target", "group")


# ---- retrieval ---------------------------------------------------------------------------------

def chunks(t, **limits):
    """Chunks of everything stored; of the results, those of the newest run, which is paired alone."""
    year = t.raw("orders").select(F.col("o_orderkey").alias("job_id"), F.year("o_orderdate").alias("run_id"))
    run = cut(analytics.latest_run(t.runs, year).withColumn("status", F.lit("completed")))
    own = t.job_skills.join(year.join(run.select("run_id"), "run_id", "left_semi").select("job_id"), "job_id", "left_semi")
    matrix = pairs.skill_matrix(t.job_skill, t.module_entities.select("module_id", "skill").distinct())
    told = F.when(F.col("university") != "", F.concat(F.lit("Programme of\n "), F.col("university")))
    return retrieval.knowledge_chunks(run, pairs.overlap_results(t.course_skills, own), matrix, t.courses.withColumn("description", told), t.modules, t.jobs, t.job_skill, **limits)


def _names_sql(names: str) -> str:
    return f"coalesce(nullif(array_to_string({names}, ', '), ''), 'None recorded')"


def _known_sql(c: str) -> str:
    return f"coalesce(nullif({c}, ''), 'Unknown')"


def _pct_sql(c: str) -> str:
    return f"{B.sql_round(c, 1)} || '%'"


CHUNKS_SQL = f"""
    lr AS (SELECT run_id, name FROM m_run WHERE jobs > 0 ORDER BY created_on DESC, run_id DESC LIMIT 1),
    res AS (SELECT r.* FROM m_result r JOIN orders ON job_id = o_orderkey WHERE year(o_orderdate) = (SELECT run_id FROM lr)),
    mx AS (SELECT 'jobs' AS side, 'job' AS source, skill, count(*) AS n FROM m_job_skill GROUP BY 3 UNION ALL SELECT 'courses', 'course', skill, count(DISTINCT module_id) FROM m_mod_ent GROUP BY 3),
    tops AS (SELECT * FROM mx QUALIFY row_number() OVER (PARTITION BY side ORDER BY n DESC, skill) <= 60),
    jn AS (SELECT job_id, list_sort(list(skill)) AS names FROM m_job_skill GROUP BY 1),
    cn AS (SELECT course_id, list_sort(list(DISTINCT name)) AS mods FROM m_module GROUP BY 1),
    ck AS (SELECT course_id, list_sort(list(DISTINCT skill)) AS names FROM m_course_skill GROUP BY 1),
    raw AS (
      SELECT 'analysis-summary' AS chunk_id, 'Latest Analysis Summary' AS title, concat_ws(' ', 'Run: ' || (SELECT name FROM lr), 'Status: completed', 'Results: ' || count(*),
        'Average alignment score: ' || {_pct_sql("sum(CAST(round(similarity_score * 100) AS BIGINT))::DOUBLE / count(*)")}, 'Highest alignment score: ' || {_pct_sql("max(similarity_score) * 100")},
        'Lowest alignment score: ' || {_pct_sql("min(similarity_score) * 100")}) AS text, 'comparison' AS source FROM res
      UNION ALL SELECT 'gap-' || course_id || '-' || job_id, code || ' to ' || title, concat_ws(' ', 'Course: ' || name, 'Job: ' || title, 'Company: ' || {_known_sql('company')},
        'Alignment score: ' || {_pct_sql("similarity_score * 100")}, 'Matched skills: ' || {_names_sql('matched')}, 'Missing skills: ' || {_names_sql('missing')}), 'comparison'
        FROM res JOIN m_course USING (course_id) JOIN (SELECT job_id, title, company FROM m_job) USING (job_id)
      UNION ALL SELECT 'skill-matrix-' || side, CASE side WHEN 'jobs' THEN 'Top Jobs Skills' ELSE 'Top Courses Skills' END, string_agg(skill || ': ' || n, ' ' ORDER BY n DESC, skill), source FROM tops GROUP BY side, source
      UNION ALL SELECT 'course-' || course_id, 'Course ' || code || ': ' || name, concat_ws(' ', 'Course: ' || name, 'Code: ' || code, 'University: ' || {_known_sql('university')},
        'Description: ' || CASE WHEN university = '' THEN 'No description recorded' ELSE 'Programme of ' || university END, 'Modules: ' || {_names_sql('mods')}, 'Extracted skills: ' || {_names_sql('names')}), 'course'
        FROM m_course LEFT JOIN cn USING (course_id) LEFT JOIN ck USING (course_id)
      UNION ALL SELECT 'module-' || module_id, 'Module ' || c.code || ': ' || m.name, concat_ws(' ', 'Course: ' || c.name, 'Module: ' || m.name, 'Content: ' || content, 'Extracted skills: ' || {_names_sql('skills')}), 'course'
        FROM m_module m JOIN m_course c USING (course_id)
      UNION ALL SELECT 'job-' || job_id, 'Job ' || title, concat_ws(' ', 'Title: ' || title, 'Company: ' || {_known_sql('company')}, 'Location: ' || {_known_sql('location')}, 'Category: ' || {_known_sql('category')},
        'Date posted: ' || coalesce(strftime(date_posted, '%Y-%m-%d'), 'Unknown'), 'Description: ' || title || ' ' || category || ' ' || description, 'Extracted skills: ' || {_names_sql('names')}), 'job'
        FROM m_job LEFT JOIN jn USING (job_id)),
    ch AS (SELECT chunk_id, {B.sql_squeeze('title')} AS title, {B.sql_squeeze('text')} AS text, source FROM raw)"""
CHUNK_NEEDS = ("m_run", "m_result", "m_job_skill", "m_mod_ent", "m_module", "m_course_skill", "m_course", "m_job")


@query("L1_knowledge_chunks", f"WITH {CHUNKS_SQL} SELECT * FROM ch", CHUNK_NEEDS)
def knowledge_chunks(t):
    return chunks(t)


@query("L2_scoped_chunks", f"WITH {CHUNKS_SQL} SELECT * FROM ch WHERE source = 'job'", CHUNK_NEEDS)
def scoped_chunks(t):
    return retrieval.scoped(chunks(t), "Jobs")


def questions(t):
    c = t.raw("conversations").filter("role = 'user'")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question"))


def doc_chunks(t):
    return t.documents.select("doc_id", F.format_string("d%09d", "doc_id").alias("chunk_id"), F.concat_ws(" ", "lang", "source").alias("title"), "text")


TERMS = f"list_filter(regexp_extract_all(lower({{c}}), '[a-z0-9+#]+'), lambda x: length(x) > 1 AND NOT list_contains({B._in(K.RETRIEVAL_STOP_WORDS)}, x))"
RETRIEVE_SQL = f"""qs AS (SELECT conv_id || '-' || turn AS question_id, text AS question FROM conversations WHERE role = 'user'),
    qt AS (SELECT question_id, term, count(*) AS qn FROM (SELECT question_id, unnest({TERMS.format(c='question')}) AS term FROM qs) GROUP BY 1, 2),
    dc AS (SELECT printf('d%09d', doc_id) AS chunk_id, lang || ' ' || source AS title, text FROM documents),
    dt AS (SELECT chunk_id, term, sum(n) AS n, max(t) AS t FROM (SELECT chunk_id, unnest({TERMS.format(c='text')}) AS term, 1 AS n, 0 AS t FROM dc
      UNION ALL SELECT chunk_id, unnest(list_distinct({TERMS.format(c='title')})), 0, 1 FROM dc) GROUP BY 1, 2),
    sc AS (SELECT question_id, chunk_id, sum(least(qn, n) + t * 1.5)::DOUBLE AS score FROM qt JOIN dt USING (term) GROUP BY 1, 2),
    found AS (SELECT question_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 8
      UNION ALL SELECT question_id, chunk_id, 0, rank FROM (SELECT question_id FROM qs WHERE question_id NOT IN (SELECT question_id FROM sc)) CROSS JOIN
        (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS rank FROM dc QUALIFY rank <= 8))"""


@query("L3_retrieval", f"WITH {RETRIEVE_SQL} SELECT * FROM found")
def retrieval_hits(t):
    return retrieval.retrieve(questions(t), doc_chunks(t))


@query("L4_highlights", f"""
    WITH {RETRIEVE_SQL},
    ln AS (SELECT question_id, chunk_id, rank, title, text, list_filter(list_transform(string_split_regex(text, '[\\n.;]'), lambda l: regexp_replace(l, '^[ -]+|[ -]+$', '', 'g')), lambda l: {B.sql_squeeze('l')} <> '') AS ls,
      list_distinct({TERMS.format(c='question')}) AS qk FROM found JOIN dc USING (chunk_id) JOIN qs USING (question_id)),
    u AS (SELECT question_id, chunk_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i, qk FROM ln),
    b AS (SELECT question_id, chunk_id, max_by(l, (len(list_intersect(list_distinct({TERMS.format(c='l')}), qk)), -i)) AS best FROM u GROUP BY 1, 2),
    f AS (SELECT question_id, chunk_id, rank, title, {B.sql_squeeze('coalesce(best, text)')} AS s FROM ln LEFT JOIN b USING (question_id, chunk_id))
    SELECT question_id, chunk_id, rank, title || ': ' || CASE WHEN length(s) <= 260 THEN s ELSE trim(regexp_replace(left(s, 260), ' [^ ]*$', '')) || '...' END AS highlight FROM f""")
def highlights(t):
    q, d = questions(t), doc_chunks(t)
    return retrieval.highlights(retrieval.retrieve(q, d), q, d)


@query("L5_skill_counts", """
    WITH m AS (SELECT 'Top Jobs Skills' AS title, skill, count(*) AS n FROM m_job_skill GROUP BY 2 UNION ALL SELECT 'Top Courses Skills', skill, count(DISTINCT module_id) FROM m_mod_ent GROUP BY 2)
    SELECT title, skill, CAST(n AS INT) AS n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY n DESC, skill) AS rank FROM m) WHERE rank <= 12""", ("m_job_skill", "m_mod_ent"))
def skill_counts(t):
    # the chunk text is one squeezed line, so entries are set apart again before parsing
    c = chunks(t).filter(F.col("chunk_id").startswith("skill-matrix-"))
    return retrieval.skill_counts(c.withColumn("text", F.regexp_replace("text", r"(\d) ([a-z])", "$1\n$2")))


@query("L6_source_fingerprint", """
    SELECT left(sha256('Course:' || (SELECT count(*) || ':' || max(course_id) FROM m_course) || '|Job:' || (SELECT count(*) || ':' || max(o_orderkey) FROM orders) || '|Line:' ||
      (SELECT count(*) || ':' || max(l_orderkey) FROM lineitem)), 16) AS fingerprint""", ("m_course",))
def source_fingerprint(t):
    return retrieval.source_fingerprint({"Course": (t.courses, "course_id"), "Job": (t.raw("orders"), "o_orderkey"), "Line": (t.raw("lineitem"), "l_orderkey")})


@query("L7_citations", f"""
    WITH {RETRIEVE_SQL}, f AS (SELECT question_id, rank, chunk_id, title, {B.sql_squeeze('text')} AS s, text FROM found JOIN dc USING (chunk_id) WHERE rank <= 5)
    SELECT question_id, rank, chunk_id, title, CASE WHEN length(s) <= 180 THEN s ELSE trim(regexp_replace(left(s, 180), ' [^ ]*$', '')) || '...' END AS quote,
      CAST(greatest(1, len({TERMS.format(c='text')})) AS INT) AS tokens FROM f""")
def citations(t):
    d = doc_chunks(t)
    return retrieval.citations(retrieval.retrieve(questions(t), d), d.drop("doc_id"))


# ---- crawled pages -----------------------------------------------------------------------------

@query("M1_parsed_pages")
def parsed_pages(t):
    return crawl.parse_pages(t.raw("pages")).select("page_id", "title", F.size("headings").alias("headings"), F.size("links").alias("links"), F.length("text").alias("chars"))


PLAIN = "trim(regexp_replace(replace(replace(replace({c}, '&amp;', '&'), '&quot;', '\"'), chr(10), ' '), ' +', ' ', 'g'))"


@query("M1_page_parts", f"""
    WITH l AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS link,
        generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), 1) AS i FROM pages),
    k AS (SELECT page_id, string_agg(link, ' ' ORDER BY i) AS links FROM (SELECT page_id, link, min(i) AS i FROM l GROUP BY 1, 2) GROUP BY 1)
    SELECT p.page_id, {PLAIN.format(c="regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {PLAIN.format(c="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS headings,
      coalesce(links, '') AS links FROM pages p LEFT JOIN k ON k.page_id = p.page_id""")
def page_parts(t):
    p = crawl.parse_pages(t.raw("pages"))
    return p.select("page_id", "title", F.array_join("headings", "|").alias("headings"), F.array_join("links", " ").alias("links"))


def _any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in terms) + ")"


@query("M2_relevance", f"SELECT page_id, {_any('url', K.URL_TERMS)} AS by_url, {_any('html', ('course', 'des'))} AS by_text FROM pages")
def relevance(t):
    return t.raw("pages").select("page_id", crawl.relevant_url(F.col("url")).alias("by_url"), crawl.mentions(F.col("html"), ("course", "des")).alias("by_text"))


HOST_SQL = "lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query("M3_link_frontier", f"""
    WITH l AS (SELECT {HOST_SQL.format(c='url')} AS host, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS p, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS o FROM pages)
    SELECT DISTINCT host, o || p AS url FROM l WHERE o || p NOT IN (SELECT split_part(url, '#', 1) FROM pages)""")
def link_frontier(t):
    p = t.raw("pages")
    origin = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)
    paths = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))
    linked = p.withColumn("o", origin).withColumn("links", F.transform(paths, lambda x: F.concat("o", x, F.lit("#part"))))
    return crawl.frontier(linked, p, relevant=False)


#: Terms that stand for the relevant ones: pages and addresses of the given tables are made of invented words.
LINK_TERMS, TEXT_TERMS = ("/a", "/e", "/d", "/the"), ("ent", "ado", "sch")
PAGE_BUDGET, ROUNDS = 4, 3


def _walk_sql() -> str:
    def step(k):
        earlier = " UNION ALL ".join(f"SELECT url FROM s{i}" for i in range(k))
        had = " UNION ALL ".join(f"SELECT host FROM s{i} WHERE status = 'page'" for i in range(k))
        found = ("SELECT host, url, [1] AS place FROM seed" if k == 0 else
                 f"SELECT host, link AS url, min(list_append(place, i)) AS place FROM s{k - 1} JOIN ln USING (url) WHERE {_any('link', LINK_TERMS)} AND status IN ('page', 'irrelevant') AND link NOT IN ({earlier}) GROUP BY 1, 2")
        if k == ROUNDS:
            return f"s{k} AS (SELECT host, url, place, 'queued' AS status FROM ({found}))"
        count = "0" if k == 0 else f"coalesce((SELECT count(*) FROM ({had}) h WHERE h.host = q.host), 0)"
        return f"""q{k} AS (SELECT f.*, CASE WHEN p.url IS NULL THEN 'missing' WHEN {'true' if k == 0 else 'relevant'} THEN 'page' ELSE 'irrelevant' END AS st FROM ({found}) f LEFT JOIN pg p ON f.url = p.url),
        s{k} AS (SELECT host, url, place, CASE WHEN {count} + count(*) FILTER (WHERE st = 'page') OVER (PARTITION BY host ORDER BY place) - CASE WHEN st = 'page' THEN 1 ELSE 0 END >= {PAGE_BUDGET} THEN 'queued' ELSE st END AS status FROM q{k} q)"""

    parts = ", ".join(step(k) for k in range(ROUNDS + 1))
    return f"""
    WITH pl AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS o, html, list_distinct(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS d, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS l FROM pages),
    fl AS (SELECT page_id, o, html, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM pl),
    pg AS (SELECT o || l[1] AS url, min(page_id) AS page_id, arg_min(l, page_id) AS l, any_value(o) AS o, arg_min({_any("concat_ws(' ', o || l[1], html)", TEXT_TERMS)}, page_id) AS relevant FROM fl WHERE len(l) > 0 GROUP BY 1),
    ln AS (SELECT url, o || unnest(l) AS link, generate_subscripts(l, 1) - 1 AS i FROM pg),
    seed AS (SELECT {HOST_SQL.format(c='url')} AS host, min(url) AS url FROM pg GROUP BY 1), {parts}
    SELECT host, url, CAST(round AS INT) AS round, status FROM ({" UNION ALL ".join(f"SELECT host, url, {k} AS round, status FROM s{k}" for k in range(ROUNDS + 1))})"""


@query("M3_budgeted_walk", _walk_sql())
def budgeted_walk(t):
    """Pages walked from the first address of every host. A page is addressed by its own first link, so that links lead to pages; its text is its source."""
    p = crawl.parse_pages(t.raw("pages")).drop("title", "headings", "text").join(t.raw("pages").select("page_id", F.col("html").alias("text")), "page_id")
    p = p.where(F.size("links") > 0).select("page_id", F.get("links", 0).alias("url"), F.lit("").alias("title"), F.array().cast("array<string>").alias("headings"), "links", "text")
    seeds = p.groupBy(crawl.host(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    return crawl.walk(p, seeds, PAGE_BUDGET, ROUNDS, LINK_TERMS, TEXT_TERMS).select("host", "url", "round", "status")


@query("M4_sitemap_urls", f"""
    SELECT DISTINCT 'https://' || {HOST_SQL.format(c='url')} || '/sitemap.xml' AS url, 'https://' || {HOST_SQL.format(c='url')} || '/programme/' || page_id AS loc FROM pages""")
def sitemap_urls(t):
    """One sitemap per host that names a nested sitemap, a news page and another host's page."""
    h = crawl.host(F.col("url"))
    p = t.raw("pages").select(F.concat(F.lit("https://"), h).alias("o"), "page_id")
    page = F.concat(F.lit("<url><loc> "), F.col("o"), F.lit("/programme/"), F.col("page_id").cast("string"), F.lit(" </loc></url>"))
    inner = p.groupBy("o").agg(F.array_join(F.array_sort(F.collect_list(page)), "").alias("xml"))
    deep = inner.select(F.concat("o", F.lit("/sitemap_pages.xml")).alias("url"), "xml")
    root = inner.select(F.concat("o", F.lit("/sitemap.xml")).alias("url"), F.concat(
        F.lit("<sitemapindex><loc>"), F.col("o"), F.lit("/sitemap_pages.xml</loc><loc>"), F.col("o"), F.lit("/news/1</loc><loc>https://elsewhere.example/course</loc></sitemapindex>")).alias("xml"))
    return crawl.sitemap_urls(deep.unionByName(root)).filter(F.col("url").endswith("/sitemap.xml")).select("url", "loc")


@query("M5_school_alias", """
    SELECT job_id, CASE WHEN contains(lower(description), 'nation_1') THEN 'Nation_1' WHEN contains(lower(description), 'nation_2') THEN 'NATION_2' ELSE '' END AS alias FROM m_job""", ("m_job",))
def school_alias(t):
    names = F.array(F.lit("Nation_1"), F.lit(" NATION_2 "))
    return t.jobs.select("job_id", F.trim(crawl.matched_alias(F.col("description"), names)).alias("alias"))


@query("M6_programme_pages", """
    SELECT module_id, name IN ('PROMO', 'LARGE') AS programme, CASE WHEN name = 'PROMO' THEN 'The MBA of ' || course_id WHEN name = 'LARGE' THEN 'Master of Business Administration' ELSE course_id || ' MBA' END AS course_name FROM m_module""", ("m_module",))
def programme_pages(t):
    m = t.modules.select("module_id", "course_id", F.when(F.col("name") == "PROMO", F.concat(F.lit("The  MBA of "), F.col("course_id"))).otherwise(F.col("name")).alias("title"),
                         F.when(F.col("name") == "LARGE", F.array(F.lit("x"), F.lit("Master of Business Administration"))).otherwise(F.array(F.lit("y"))).alias("headings"), F.col("content").alias("text"))
    return m.select("module_id", crawl.programme_page().alias("programme"), crawl.course_name(F.col("course_id")).alias("course_name"))


@query("M7_page_modules", """
    WITH s AS (SELECT module_id, unnest(skills) AS skill, generate_subscripts(skills, 1) AS i, len(skills) AS n FROM m_module)
    SELECT module_id, skill AS name, 'Module: ' || skill || chr(10) || 'A long line of context on ' || skill AS content FROM s WHERE i <= 40""", ("m_module",))
def page_modules(t):
    line = F.transform("skills", lambda s: F.concat(F.lit("Module: "), s, F.lit("\nA long line of context on "), s, F.lit("\nshort")))
    body = F.array_join(line, "\n")
    return t.modules.select("module_id", F.explode(crawl.modules_of(body)).alias("m")).select("module_id", "m.name", "m.content")


@query("M8_candidate_confidence", """
    SELECT module_id, floor(least(0.35::DOUBLE + CASE WHEN name = 'PROMO' THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE + least(0.25::DOUBLE, len(skills) * 0.025::DOUBLE), 0.98) * 100.0 + 0.5) / 100.0 AS confidence FROM m_module""", ("m_module",))
def candidate_confidence(t):
    body = F.concat_ws(" ", F.when(F.col("name") == "PROMO", "Our MBA"), F.lit("Curriculum"), "content")
    return t.modules.select("module_id", crawl.candidate_confidence(body, F.size("skills")).alias("confidence"))


@query("M9_course_code", """
    SELECT c_custkey, upper(c_name[1]) || n_name[1] || '-' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'MBA' ELSE 'COURSE' END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def course_code(t):
    c = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_mktsegment") == "BUILDING", "Executive MBA").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", crawl.course_code(F.concat_ws(" ", "c_name", "n_name"), name).alias("code"))


@query("M10_merged_candidates", """
    WITH c AS (SELECT p_brand || CASE WHEN p_type = 'PROMO' THEN '-new' ELSE '' END AS code, min(p_type) AS school, min_by('MBA ' || p_type, 'http://x/' || p_partkey) AS nm, min('http://x/' || p_partkey) AS u,
      min_by(p_type, 'http://x/' || p_partkey) AS sc FROM part GROUP BY 1)
    SELECT coalesce(m.code, c.code) AS code, coalesce(m.name, nm) AS name, CASE WHEN coalesce(m.university, '') <> '' THEN m.university ELSE coalesce(sc, '') END AS university,
      CASE WHEN m.code IS NULL THEN 'Imported from ' || sc || ' (' || u || ')' WHEN c.code IS NOT NULL THEN 'Imported source: ' || u ELSE '' END AS description, m.code IS NULL AS created
    FROM m_course m FULL JOIN c ON m.code = c.code""", ("m_course",))
def merged_candidates(t):
    code = F.concat(F.col("p_brand"), F.when(F.col("p_type") == "PROMO", "-new").otherwise(""))
    cand = t.raw("part").select(code.alias("code"), F.concat(F.lit("MBA "), F.col("p_type")).alias("name"), F.col("p_type").alias("school"),
                                F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")).alias("source_url"))
    return crawl.merge_candidates(t.courses.withColumn("description", F.lit("")), cand)


@query("M10_merged_modules", """
    WITH b AS (SELECT course_id AS code, name, content, 1 AS old FROM m_module UNION ALL SELECT course_id, module_name, string_agg(text, ' and ' ORDER BY pos), 0 FROM m_mod_ent GROUP BY 1, 2)
    SELECT code, name, max_by(content, (length(content), old, content)) AS content FROM b GROUP BY 1, 2""", ("m_module", "m_mod_ent"))
def merged_modules(t):
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), " and ")
    new = t.module_entities.groupBy(F.col("course_id").alias("code"), F.col("module_name").alias("name")).agg(texts.alias("content"))
    return crawl.merge_modules(t.modules.withColumnRenamed("course_id", "code"), new)


@query("M11_crawl_outcome", f"""
    SELECT {HOST_SQL.format(c='url')} AS school, count_if(page_id % 3 = 0) AS page, count_if(page_id % 3 = 1) AS blocked, count_if(page_id % 3 = 2) AS skipped FROM pages GROUP BY 1""")
def crawl_outcome(t):
    k = F.col("page_id") % 3
    log = t.raw("pages").select(crawl.host(F.col("url")).alias("school"), "url", F.when(k == 0, "page").when(k == 1, "blocked").otherwise("skipped").alias("outcome"))
    return crawl.outcome_note(log).drop("note")
