"""Skill extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.functions import skills, text
from skillgrid.operators import extract, review
from skillgrid.plans import binding as B
from skillgrid.plans.registry import query


def hits_sql(docs: str, lexicon: str, longest: int) -> str:
    """CTEs ending in ``hits``: every phrase occurrence of a relation (doc_id, text), with offsets and sentence."""
    grams = " UNION ALL ".join(
        f"SELECT doc_id, s, so, go, ws, k, {n} AS n, array_to_string(ws[k:k + {n - 1}], ' ') AS g FROM wd WHERE k + {n - 1} <= len(ws)"
        for n in range(1, longest + 1))
    return f"""src AS ({docs}),
      p1 AS (SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM
              (SELECT doc_id, string_split_regex(text, '[.!?\\n]') AS ps FROM src)),
      p2 AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 AS so FROM p1),
      p3 AS (SELECT doc_id, i, s, so, unnest(gs) AS g, generate_subscripts(gs, 1) AS j FROM
              (SELECT *, string_split_regex(lower(replace(s, '-', ' ')), '[^\\p{{L}}\\p{{N}}+#&/ ]') AS gs FROM p2)),
      p4 AS (SELECT *, sum(length(g) + 1) OVER (PARTITION BY doc_id, i ORDER BY j) - length(g) - 1 AS go FROM p3),
      wd AS (SELECT doc_id, s, so, go, ws, unnest(generate_series(1, len(ws))) AS k FROM (SELECT *, string_split(g, ' ') AS ws FROM p4)),
      gr AS ({grams}),
      hits AS (SELECT doc_id, skill, CAST(so + go + length(array_to_string(ws[1:k - 1], ' ')) + CASE WHEN k > 1 THEN 1 ELSE 0 END AS INT) AS "start",
                 phrase, so, trim(s) AS context, s FROM gr JOIN {lexicon} l ON gr.g = l.phrase AND gr.n = l.n)"""


HIT_COLUMNS = """doc_id, skill, substr(s, CAST("start" - so + 1 AS BIGINT), length(phrase)) AS text, "start", CAST("start" + length(phrase) AS INT) AS "end\""""
DOCS = "SELECT doc_id, text FROM documents"
MODULE_DOCS = "SELECT module_id AS doc_id, content AS text FROM m_module"


def _docs(t):
    return t.documents.select("doc_id", "text")


def _module_docs(t):
    return t.modules.select(F.col("module_id").alias("doc_id"), F.col("content").alias("text"))


def grams_sql(tokens: str, longest: int) -> str:
    """All runs of 1..longest tokens of a relation (doc_id, tk)."""
    leads = ", ".join(f"lead(w, {n}) OVER (PARTITION BY doc_id ORDER BY k) AS w{n}" for n in range(1, longest))
    parts = []
    for n in range(1, longest + 1):
        words = " || ' ' || ".join(["w"] + [f"w{i}" for i in range(1, n)])
        parts.append(f"SELECT doc_id, {n} AS n, {words} AS g FROM q" + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else ""))
    return (f"WITH q AS (SELECT *, {leads} FROM (SELECT doc_id, unnest(tk) AS w, generate_subscripts(tk, 1) AS k FROM {tokens})) "
            + " UNION ALL ".join(parts))


@query("D1_keyword_skills", f"""
    WITH tok AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS tk FROM documents),
    kw AS (SELECT phrase AS skill, trim(regexp_replace(phrase, '[^a-z0-9]+', ' ', 'g')) AS p FROM m_term),
    f AS (SELECT DISTINCT doc_id, skill FROM ({grams_sql('tok', 12)}) g JOIN kw ON g.g = kw.p)
    SELECT d.doc_id, coalesce(string_agg(skill, '|' ORDER BY skill), '') AS skills FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1""", ("m_term",))
def keyword_skills(t):
    phrases = extract.with_words(t.terms.select(
        F.col("phrase").alias("skill"), text.normalise_text(F.col("phrase")).alias("phrase")).filter("phrase <> ''"))
    return extract.keyword_skills(_docs(t), phrases).select("doc_id", F.array_join("skills", "|").alias("skills"))


@query("D1_keyword_skills_modules", f"""
    WITH tok AS (SELECT module_id AS doc_id, list_filter(string_split(trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS tk FROM m_module),
    kw AS (SELECT DISTINCT phrase AS skill, trim(regexp_replace(phrase, '[^a-z0-9]+', ' ', 'g')) AS p FROM (VALUES {", ".join(f"('{k}')" for k in K.KEYWORDS)}) v(phrase)),
    f AS (SELECT DISTINCT doc_id, skill FROM ({grams_sql('tok', 3)}) g JOIN kw ON g.g = kw.p)
    SELECT d.module_id, coalesce(string_agg(skill, '|' ORDER BY skill), '') AS skills FROM m_module d LEFT JOIN f ON module_id = doc_id GROUP BY 1""", ("m_module",))
def keyword_skills_modules(t):
    out = extract.keyword_skills(_module_docs(t), extract.keyword_phrases(t.spark))
    return out.select(F.col("doc_id").alias("module_id"), F.array_join("skills", "|").alias("skills"))


@query("D2_phrase_hits", f"WITH {hits_sql(DOCS, 'm_lexicon', 3)} SELECT {HIT_COLUMNS} FROM hits", ("m_lexicon",))
def phrase_hits(t):
    return extract.phrase_hits(_docs(t), t.lexicon)


@query("D3_lexicon", "SELECT phrase, skill FROM m_module_lexicon", ("m_module_lexicon",))
def lexicon(t):
    return t.module_lexicon.select("phrase", "skill")


@query("D4_approved_aliases", """
    SELECT alias AS phrase, canonical_skill AS skill FROM m_alias WHERE status = 'approved' AND alias <> canonical_skill""", ("m_alias",))
def approved_aliases(t):
    return extract.approved_aliases(t.aliases)


DYNAMIC_SQL = """SELECT skill, count(*) AS frequency FROM (
      SELECT skill FROM m_mod_ent WHERE label_status <> 'candidate' AND label = 'SKILL'
      UNION ALL SELECT skill FROM m_job_ent WHERE label_status <> 'candidate' AND label = 'SKILL'
      UNION ALL SELECT phrase FROM m_term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1500"""


@query("D5_dynamic_lexicon", DYNAMIC_SQL, ("m_mod_ent", "m_job_ent", "m_term"))
def dynamic_lexicon(t):
    keep = ["skill", "text", "label", "label_status"]
    stored = t.module_entities.select(keep).unionByName(t.job_lines.select(keep))
    return extract.dynamic_terms(stored, csv_terms=t.terms.select(F.col("phrase").alias("skill")))


ENTITY_SQL = f"""
    WITH {hits_sql(MODULE_DOCS, 'm_module_lexicon', 4)},
    h AS (SELECT {HIT_COLUMNS}, context FROM hits),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, skill ORDER BY "start", "end", text) AS rn FROM h),
    g AS (SELECT doc_id, skill, CAST(count(*) AS INT) AS mention_count, max(text) FILTER (rn = 1) AS text,
            max("start") FILTER (rn = 1) AS "start", max("end") FILTER (rn = 1) AS "end", max(context) FILTER (rn = 1) AS context,
            string_agg(text || '@' || "start", '|' ORDER BY rn) FILTER (rn <= 5) AS mentions FROM r GROUP BY 1, 2)"""


@query("D6_entities", ENTITY_SQL + f"""
    SELECT w.doc_id, w.skill, {B.sql_entity_id('w.skill')} AS entity_id,
      'chunk-' || left(sha1(w.doc_id || '|' || w.skill || '|' || w."start" || '|' || w."end"), 16) AS chunk_id,
      w.skill_type, n.tier, w.text, w."start", w."end", w.mention_count, w.mentions
    FROM {B.sql_classified('g', 'skill', "skill || ' ' || text || ' ' || context")} w
    JOIN (SELECT doc_id, skill, tier FROM {B.sql_classified('g', 'skill', "skill || ' ' || text")}) n USING (doc_id, skill)
    WHERE NOT list_contains({B._in(K.EXCLUDED_TERMS)}, w.skill) OR w.skill IN (SELECT skill FROM m_mod_ent WHERE label_status <> 'candidate')""",
    ("m_module_lexicon", "m_module", "m_mod_ent"))
def entities(t):
    e = extract.extract_entities(_module_docs(t), t.module_lexicon, extract.dynamic_terms(t.module_entities))
    mentions = F.array_join(F.transform("mentions", lambda m: F.concat_ws("@", m["text"], m["start"].cast("string"))), "|")
    return e.select("doc_id", "skill", "entity_id", "chunk_id", "skill_type", "tier", "text", "start", "end", "mention_count",
                    mentions.alias("mentions"))


@query("D7_accepted_spans", """
    SELECT l_orderkey AS doc_id, p_name AS skill, l_linenumber AS "start", l_linenumber + 10 AS "end", l_suppkey AS supplier,
      floor((0.6::DOUBLE + l_discount) * 100 + 0.5) / 100 AS confidence
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' AND floor((0.6::DOUBLE + l_discount) * 100 + 0.5) / 100 >= 0.65""")
def accepted_spans(t):
    from skillgrid.functions.scores import half_up
    l = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    label = F.when(F.col("l_returnflag") == "A", "skill").when(F.col("l_returnflag") == "R", "B-Skill").otherwise("MISC")
    spans = l.select(
        F.struct("l_orderkey", "l_suppkey").alias("doc_id"), F.concat(F.lit("##"), F.col("p_name"), F.lit(" ")).alias("word"),
        label.alias("label"), half_up(0.6 + F.col("l_discount"), 2).alias("score"),
        F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 10).alias("end"))
    return extract.accepted_spans(spans).select(
        F.col("doc_id.l_orderkey").alias("doc_id"), "skill", "start", "end", F.col("doc_id.l_suppkey").alias("supplier"), "confidence")


@query("D8_mined_phrases", f"""
    WITH tok AS (SELECT p_partkey AS doc_id, string_split(CASE WHEN p_size % 2 = 0 THEN lower(p_type) || ' ' ELSE '' END || skill || ' services', ' ') AS tk FROM m_part),
    gr AS (SELECT DISTINCT doc_id, g FROM ({grams_sql('tok', 4)}) WHERE n >= 2),
    base AS (SELECT phrase, max_by(skill, (rank, skill)) AS skill FROM (SELECT {B.sql_canonical('phrase')} AS phrase, skill, rank
        FROM (VALUES {B._base_values()}) b(phrase, skill, rank)) GROUP BY 1),
    pick AS (SELECT g, min_by(skill, (CASE WHEN phrase = g THEN 0 ELSE 1 END, -length(phrase), phrase)) AS skill
      FROM (SELECT DISTINCT g FROM gr) JOIN base ON len(list_filter(list_distinct(string_split(phrase, ' ')), lambda x: NOT list_contains(string_split(g, ' '), x))) = 0 GROUP BY 1)
    SELECT DISTINCT doc_id, coalesce(pick.skill, gr.g) AS skill FROM gr LEFT JOIN pick ON gr.g = pick.g
    WHERE pick.skill IS NOT NULL OR len(list_intersect(string_split(gr.g, ' '), {B._in(K.HEAD_TERMS)})) > 0""", ("m_part",))
def mined_phrases(t):
    words = F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lower("p_type"), F.lit(" "))).otherwise(""),
                     F.col("skill"), F.lit(" services"))
    docs = t.parts.select(F.col("p_partkey").alias("doc_id"), words.alias("text"))
    return extract.mined_phrases(docs, extract.assemble_lexicon(extract.base_lexicon(t.spark)))


@query("D9_skill_lists", f"""
    WITH {hits_sql(DOCS, 'm_lexicon', 3)}
    SELECT d.doc_id, coalesce(string_agg(DISTINCT skill, '|' ORDER BY skill), '') AS skills
    FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY 1""", ("m_lexicon",))
def skill_lists(t):
    hits = extract.phrase_hits(_docs(t), t.lexicon).select("doc_id", "skill")
    return extract.skill_lists(t.documents.select("doc_id"), hits, "doc_id").select("doc_id", F.array_join("skills", "|").alias("skills"))


@query("D10_extract_missing", f"""
    WITH {hits_sql(MODULE_DOCS + " WHERE name = 'PROMO'", 'm_module_lexicon', 4)}
    SELECT DISTINCT doc_id, skill FROM hits UNION SELECT module_id, skill FROM m_mod_ent WHERE module_name <> 'PROMO'""",
    ("m_module", "m_mod_ent", "m_module_lexicon"))
def extract_missing(t):
    stored = t.module_entities.filter("module_name <> 'PROMO'").select(F.col("module_id").alias("doc_id"), "skill")
    return extract.extract_missing(_module_docs(t), stored, t.module_lexicon)


@query("D11_padded_match", f"""
    WITH tok AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z0-9+# ]+', ' ', 'g'), ' ') AS tk FROM documents),
    f AS (SELECT DISTINCT doc_id, phrase FROM ({grams_sql('tok', 3)}) g JOIN m_term ON g.g = phrase)
    SELECT d.doc_id, coalesce(string_agg(phrase, '|' ORDER BY phrase), '') AS skills FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1""", ("m_term",))
def padded_match(t):
    phrases = extract.with_words(t.terms.select("phrase", F.col("phrase").alias("skill")))
    return extract.padded_skills(_docs(t), phrases).select("doc_id", F.array_join("skills", "|").alias("skills"))


@query("D12_skill_offsets", """
    SELECT module_id, skill, CAST(strpos(content, skill) - 1 AS INT) AS "start", CAST(strpos(content, skill) - 1 + length(skill) AS INT) AS "end"
    FROM (SELECT DISTINCT m.module_id, content, skill FROM m_module m JOIN m_course_skill c ON m.course_id = c.course_id)
    WHERE contains(content, skill)""", ("m_module", "m_course_skill"))
def skill_offsets(t):
    pairs = t.modules.join(t.course_skill, "course_id").select("module_id", F.upper("content").alias("content"), "skill")
    return pairs.withColumn("o", extract.skill_offsets(F.col("content"), F.col("skill"))).filter("o IS NOT NULL").select(
        "module_id", "skill", "o.start", "o.end")


@query("D13_evidence_window", f"""
    WITH {hits_sql(DOCS, 'm_lexicon', 3)}, h AS (SELECT {HIT_COLUMNS} FROM hits),
    f AS (SELECT doc_id, skill, min("start") AS lo, min_by("end", ("start", "end")) AS hi FROM h GROUP BY 1, 2)
    SELECT f.doc_id, skill, CASE WHEN lo - 180 > 0 THEN '...' ELSE '' END
      || {B.sql_squeeze('substr(d.text, greatest(0, lo - 180) + 1, least(length(d.text), hi + 180) - greatest(0, lo - 180))')}
      || CASE WHEN hi + 180 < length(d.text) THEN '...' ELSE '' END AS context
    FROM f JOIN documents d USING (doc_id)""", ("m_lexicon",))
def evidence_window(t):
    hits = extract.phrase_hits(_docs(t), t.lexicon)
    first = hits.groupBy("doc_id", "skill").agg(F.min("start").alias("lo"), F.min_by("end", F.struct("start", "end")).alias("hi"))
    return first.join(_docs(t), "doc_id").select("doc_id", "skill", extract.evidence_window(
        F.col("text"), F.col("lo"), F.col("hi"), F.col("skill")).alias("context"))


@query("D13_paragraph_context", """
    WITH x AS (SELECT module_id, skill, name || chr(10) || chr(10) || content || chr(10) || chr(10) || 'end' AS txt, content FROM m_mod_ent
               JOIN m_module USING (module_id))
    SELECT DISTINCT module_id, skill, CASE WHEN length(content) <= 200 THEN content ELSE
       CASE WHEN lo - 100 > 0 THEN '... ' ELSE '' END || trim(substr(txt, greatest(0, lo - 100) + 1,
         least(length(txt), lo + length(skill) + 100) - greatest(0, lo - 100)), E' \\n')
       || CASE WHEN lo + length(skill) + 100 < length(txt) THEN ' ...' ELSE '' END END AS context
    FROM (SELECT *, strpos(lower(txt), skill) - 1 AS lo FROM x)""", ("m_mod_ent", "m_module"))
def paragraph_context(t):
    j = t.module_entities.select("module_id", "skill").distinct().join(t.modules.select("module_id", "name", "content"), "module_id")
    body = F.concat_ws("\n\n", "name", "content", F.lit("end"))
    none = F.lit(None).cast("int")
    return j.select("module_id", "skill", extract.paragraph_context(body, none, none, F.col("skill"), 200).alias("context"))


@query("D14_sentence_of_mention", f"""
    WITH {hits_sql(DOCS, 'm_lexicon', 3)}
    SELECT doc_id, skill, "start", left(context, 500) AS sentence FROM hits""", ("m_lexicon",))
def sentence_of_mention(t):
    hits = extract.phrase_hits(_docs(t), t.lexicon, with_context=True)
    return hits.select("doc_id", "skill", "start", F.col("context").alias("sentence"))


@query("D15_skill_matrix", f"""
    WITH {hits_sql(DOCS, 'm_lexicon', 3)} SELECT skill, count(DISTINCT doc_id) AS frequency FROM hits GROUP BY 1""", ("m_lexicon",))
def skill_matrix(t):
    return extract.skill_frequency(extract.phrase_hits(_docs(t), t.lexicon))


JOB_DOCS = "SELECT 'job-' || job_id AS doc_id, title || chr(10) || chr(10) || category || chr(10) || chr(10) || description AS text FROM m_job"


@query("D16_reextract_corpus", f"""
    WITH {hits_sql(f"SELECT 'module-' || module_id AS doc_id, content AS text FROM m_module UNION ALL {JOB_DOCS}", 'm_module_lexicon', 4)}
    SELECT split_part(doc_id, '-', 1) AS source_type, skill, count(DISTINCT doc_id) AS documents, count(*) AS mentions
    FROM hits GROUP BY 1, 2""", ("m_module", "m_job", "m_module_lexicon"))
def reextract_corpus(t):
    jobs = t.jobs.select(F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("doc_id"),
                         text.joined_text(F.col("title"), F.col("category"), F.col("description")).alias("text"))
    mods = t.modules.select(F.concat(F.lit("module-"), F.col("module_id")).alias("doc_id"), F.col("content").alias("text"))
    e = extract.extract_entities(mods.unionByName(jobs), t.module_lexicon, t.module_lexicon.select("skill"))
    return e.groupBy(F.substring_index("doc_id", "-", 1).alias("source_type"), "skill").agg(
        F.count("*").alias("documents"), F.sum("mention_count").alias("mentions"))


@query("D17_reclassify", f"""
    WITH c AS (SELECT *, skill || ' ' || text AS ctx FROM m_job_ent),
    k AS (SELECT job_id, pos, skill_type AS new_type, tier AS new_tier FROM {B.sql_classified('c', 'skill', 'ctx', 'job_id, pos')})
    SELECT j.label_status, count(*) AS entities, count_if(new_type <> skill_type OR new_tier <> tier) AS changed
    FROM m_job_ent j JOIN k USING (job_id, pos) GROUP BY 1""", ("m_job_ent",))
def reclassify(t):
    e = t.job_entities.withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int"))
    nested = review.collect_entities(e, "job_id")
    done = nested.withColumn("again", extract.reclassify(F.col("entities")))
    both = done.select(F.explode(F.arrays_zip("entities", "again")).alias("z"))
    moved = (F.col("z.entities.skill_type") != F.col("z.again.skill_type")) | (F.col("z.entities.tier") != F.col("z.again.tier"))
    return both.groupBy(F.col("z.entities.label_status").alias("label_status")).agg(
        F.count("*").alias("entities"), F.count_if(moved).alias("changed"))
