"""Review, alias, verification and training-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import scores, skills, text
from skillgrid.operators import extract, pairs, review, training, verify
from skillgrid.plans import binding as B
from skillgrid.plans.extract_queries import DOCS, HIT_COLUMNS, hits_sql
from skillgrid.plans.registry import query

MOD = ("m_mod_ent",)


@query("I1_hydrate", """
    SELECT module_id, skill, label_status FROM m_mod_ent WHERE label_status = 'reviewed' UNION ALL
    SELECT DISTINCT module_id, skill, 'legacy' FROM m_mod_ent WHERE (module_id, skill) NOT IN (SELECT (module_id, skill) FROM m_mod_ent WHERE label_status = 'reviewed')""", MOD)
def hydrate(t):
    listed = t.modules.select("module_id", F.posexplode("skills").alias("pos", "skill"))
    return review.hydrate(t.module_entities.filter("label_status = 'reviewed'"), listed, "module_id", "module").select("module_id", "skill", "label_status")


def _requests(t):
    """One request per module: its alphabetically first skill."""
    first = t.modules.select("module_id", F.get("skills", 0).alias("skill"))
    return first.select("module_id", "skill", skills.entity_id(F.col("skill")).alias("entity_id"), F.lit("none").alias("chunk_id"),
                        F.xxhash64("module_id").alias("request_id"))


TARGET_SQL = "(SELECT module_id, min(skill) AS first FROM m_mod_ent GROUP BY 1)"


@query("I2_reviewed_edits", f"""
    SELECT m.module_id, pos, CASE WHEN pos = p THEN 'executive ' || skill ELSE skill END AS skill, CASE WHEN pos = p THEN 'reviewed' ELSE tier END AS tier,
      CASE WHEN pos = p THEN 'business' ELSE skill_type END AS skill_type, CASE WHEN pos = p THEN 'human' ELSE source END AS source, text,
      CASE WHEN pos = p THEN 'reviewed' ELSE label_status END AS label_status
    FROM m_mod_ent m JOIN (SELECT e.module_id, min(pos) AS p FROM m_mod_ent e JOIN {TARGET_SQL} f ON e.module_id = f.module_id AND e.skill = f.first GROUP BY 1) x USING (module_id)""", MOD)
def reviewed_edits(t):
    e = _requests(t).withColumn("skill", F.concat(F.lit(" executive "), F.col("skill"))).withColumn("label", F.lit("")).withColumn(
        "tier", F.lit(" ")).withColumn("skill_type", F.lit("business")).withColumn("text", F.lit("")).withColumn("source", F.lit("human"))
    return review.apply_edits(t.module_entities, e, "module_id").select("module_id", "pos", "skill", "tier", "skill_type", "source", "text", "label_status")


@query("I3_added_entities", """
    SELECT module_id, 'treasury solutions' AS skill, 'module-' || module_id || '-manual-skill-treasury-solutions' || x AS chunk_id, 'reviewed' AS label_status
    FROM (SELECT DISTINCT module_id FROM m_mod_ent) CROSS JOIN (VALUES (''), ('-2'), ('-3')) v(x)""", MOD)
def added_entities(t):
    ask = t.modules.select("module_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("request_id"), F.lit(" treasury solutions").alias("skill"))
    out = review.add_entities(t.module_entities, ask, "module_id", "module")
    return out.filter("source = 'human'").select("module_id", "skill", "chunk_id", "label_status")


@query("I4_removed_entities", f"SELECT m.module_id, skill, pos FROM m_mod_ent m JOIN {TARGET_SQL} f ON m.module_id = f.module_id WHERE skill <> first", MOD)
def removed_entities(t):
    return review.remove_entities(t.module_entities, _requests(t), "module_id").select("module_id", "skill", "pos")


@query("I5_bulk_approval", """
    SELECT count(*) AS approved, count(DISTINCT job_id) AS documents FROM m_job_ent WHERE label_status = 'candidate'
    UNION ALL SELECT count(*), count(DISTINCT module_id) FROM m_mod_ent WHERE label_status = 'candidate'""", ("m_mod_ent", "m_job_ent"))
def bulk_approval(t):
    return review.approval_counts(t.job_lines, "job_id").unionByName(review.approval_counts(t.module_entities, "module_id"))


@query("I5_approved_entities", """
    SELECT label_status, tier, count(*) AS n FROM (SELECT CASE WHEN label_status = 'candidate' THEN 'reviewed' ELSE label_status END AS label_status,
      CASE WHEN label_status = 'candidate' AND tier = 'candidate' THEN 'reviewed' ELSE tier END AS tier FROM m_job_ent) GROUP BY 1, 2""", ("m_job_ent",))
def approved_entities(t):
    return review.approve_candidates(t.job_lines).groupBy("label_status", "tier").agg(F.count("*").alias("n"))


EVIDENCE_SQL = "SELECT skill AS canonical_skill, text AS alias, count(*) AS seen, max(confidence) AS conf, min(job_id) AS doc FROM m_job_ent WHERE skill <> text {w} GROUP BY 1, 2"


@query("I6_alias_pairs", "SELECT DISTINCT skill AS canonical_skill, text AS alias FROM m_job_ent WHERE skill <> text AND length(text) >= 2", ("m_job_ent",))
def alias_pairs(t):
    return review.alias_evidence(t.job_lines).select("canonical_skill", "alias").distinct()


def _stored(t):
    return t.aliases.select("canonical_skill", "alias", "status", "confidence", "evidence_count", F.lit("seed").alias("source"), F.lit("").alias("first_doc"))


@query("I7_upserted_aliases", f"""
    SELECT coalesce(a.canonical_skill, e.canonical_skill) AS canonical_skill, coalesce(a.alias, e.alias) AS alias, CASE WHEN e.seen IS NOT NULL THEN 'approved' ELSE a.status END AS status,
      CASE WHEN e.seen IS NOT NULL AND coalesce(a.status, '') <> 'approved' THEN 'human_review' ELSE 'seed' END AS source, greatest(coalesce(a.confidence, 0), coalesce(e.conf, 0)) AS confidence,
      coalesce(a.evidence_count, 0) + coalesce(e.seen, 0) AS evidence_count, CASE WHEN e.seen IS NULL THEN '' ELSE 'job:' || e.doc END AS first_doc
    FROM (SELECT * FROM m_alias WHERE alias NOT LIKE 'red %') a FULL JOIN ({EVIDENCE_SQL.format(w="AND label_status = 'reviewed'")}) e ON a.canonical_skill = e.canonical_skill AND a.alias = e.alias""", ("m_alias", "m_job_ent"))
def upserted_aliases(t):
    e = review.alias_evidence(t.job_lines.filter("label_status = 'reviewed'")).select(
        "canonical_skill", "alias", "confidence", F.concat(F.lit("job:"), F.col("job_id").cast("string")).alias("doc_id"), F.col("job_id").alias("seq"))
    return review.upsert_aliases(_stored(t).filter("alias NOT LIKE 'red %'"), e, "human_review", "approved")


@query("I8_alias_candidates", f"""
    SELECT e.canonical_skill, e.alias, doc AS seq, conf AS confidence FROM ({EVIDENCE_SQL.format(w="AND label_status <> 'candidate'")}) e
    ANTI JOIN (SELECT * FROM m_alias WHERE status = 'approved' AND alias NOT LIKE '%gear') a ON a.canonical_skill = e.canonical_skill AND a.alias = e.alias
    """, ("m_alias", "m_job_ent"))
def alias_candidates(t):
    rows = t.job_lines.withColumn("seq", F.col("job_id"))
    return review.alias_candidates(rows, t.aliases.filter("status = 'approved' AND alias NOT LIKE '%gear'"))


@query("I9_reviewed_aliases", """
    WITH m AS (SELECT *, evidence_count % 3 AS d, split_part(alias, ' ', 2) AS last FROM m_alias),
    r AS (SELECT CASE d WHEN 0 THEN 'shared skill' ELSE canonical_skill END AS canonical_skill, CASE d WHEN 0 THEN last ELSE alias END AS alias,
      CASE d WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE status END AS status, CASE d WHEN 0 THEN 'human_review' ELSE 'seed' END AS source, confidence, evidence_count, d FROM m)
    SELECT canonical_skill, alias, max(status) AS status, max(source) AS source, max(confidence) AS confidence,
      max(evidence_count) + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS evidence_count FROM r GROUP BY 1, 2""", ("m_alias",))
def reviewed_aliases(t):
    k = F.col("evidence_count") % 3
    d = t.aliases.select("canonical_skill", "alias", F.when(k == 0, "approve").when(k == 1, "reject").alias("decision"),
                         F.lit("Shared-Skill").alias("new_skill"), F.substring_index("alias", " ", -1).alias("new_alias")).filter("decision IS NOT NULL")
    return review.review_aliases(_stored(t), d)


@query("I10_alias_counts", """
    SELECT count_if(status = 'candidate') AS candidate, count_if(status = 'approved') AS approved, count_if(status = 'rejected') AS rejected, count(*) AS total FROM m_alias""", ("m_alias",))
def alias_counts(t):
    return review.alias_counts(t.aliases)


@query("I10_alias_queue", "SELECT canonical_skill, alias, evidence_count FROM m_alias WHERE status = 'approved' ORDER BY evidence_count DESC, 1, 2 LIMIT 40", ("m_alias",))
def alias_queue(t):
    return review.alias_queue(t.aliases, "approved").select("canonical_skill", "alias", "evidence_count")


@query("I11_enhanced_skills", f"""
    SELECT module_id, skill, CASE WHEN skill = first THEN 'reviewed' ELSE st END AS label_status, CASE WHEN skill = first THEN src ELSE src END AS source
    FROM (SELECT module_id, skill, max_by(label_status, pos) AS st, 'ner' AS src FROM m_mod_ent GROUP BY 1, 2) JOIN {TARGET_SQL} USING (module_id)
    UNION ALL SELECT DISTINCT module_id, 'wealth planning', 'reviewed', 'manual_enhancement' FROM m_mod_ent""", MOD)
def enhanced_skills(t):
    ask = _requests(t).select("module_id", F.concat(F.initcap("skill"), F.lit("; Wealth-Planning, wealth planning\n")).alias("typed"))
    return review.enhance_skills(t.module_entities, ask, "module_id").select("module_id", "skill", "label_status", "source")


@query("I12_removed_skill", f"SELECT m.module_id, pos FROM m_mod_ent m JOIN {TARGET_SQL} f ON m.module_id = f.module_id WHERE skill <> first", MOD)
def removed_skill(t):
    ask = _requests(t).select("module_id", F.upper(F.replace(F.col("skill"), F.lit(" "), F.lit("-"))).alias("skill"))
    return review.remove_skill(t.module_entities, ask, "module_id").select("module_id", "pos")


@query("I13_saved_candidates", """
    SELECT module_id, skill, 'module-' || module_id || '-candidate-' || entity_id AS chunk_id, 0.55::DOUBLE AS confidence, skill_type
    FROM (SELECT DISTINCT course_id, skill FROM m_course_skill) c JOIN m_skill USING (skill) JOIN m_module USING (course_id)
    WHERE (module_id, skill) NOT IN (SELECT (module_id, skill) FROM m_mod_ent)""", ("m_mod_ent", "m_skill", "m_course_skill", "m_module"))
def saved_candidates(t):
    """Every course skill is suggested to every module of the course."""
    s = t.modules.select("course_id", "module_id").join(t.course_skill, "course_id").select("module_id", F.replace(F.col("skill"), F.lit(" "), F.lit("_")).alias("skill"))
    return review.save_candidates(t.module_entities, s, "module_id", "module").select("module_id", "skill", "chunk_id", "confidence", "skill_type")


@query("I14_import_entities", f"""
    SELECT p_partkey, p_name AS skill, CASE WHEN p_size % 2 = 0 THEN 'given' ELSE {B.sql_entity_id('p_name')} END AS entity_id, CASE WHEN p_size > 25 THEN 'notebook-import' ELSE p_type END AS source FROM part""")
def import_entities(t):
    e = review.import_entity(F.lit(""), F.upper("p_name"), F.when(F.col("p_size") % 2 == 0, "given"), F.when(F.col("p_size") <= 25, F.col("p_type")))
    return t.raw("part").withColumn("e", e).select("p_partkey", "e.skill", "e.entity_id", "e.source")


# ---- verification ------------------------------------------------------------------------------

WARN_SQL = """CASE WHEN n <= 1 AND length(content) >= 20 THEN 'Long text has only ' || n || ' extracted skill(s); expected more evidence for the skill matrix.|' ELSE '' END
    || CASE WHEN n = 0 THEN 'No extracted skills stored.|' ELSE '' END || CASE WHEN d <> n THEN 'Duplicate skill labels found after normalization.|' ELSE '' END"""
WARN_FROM = """(SELECT m.module_id, m.content, count(e.skill) AS n, count(DISTINCT e.skill) AS d FROM m_module m
    LEFT JOIN (SELECT * FROM m_mod_ent WHERE label_status = 'reviewed') e ON e.module_id = m.module_id GROUP BY 1, 2)"""


def _listed(t):
    have = t.module_entities.filter("label_status = 'reviewed'").groupBy("module_id").agg(F.collect_list("skill").alias("skills"))
    return t.modules.drop("skills").join(have, "module_id", "left").select(
        "module_id", F.col("content").alias("text"), F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


@query("J1_heuristic_warnings", f"SELECT module_id, {WARN_SQL} AS warnings FROM {WARN_FROM}", ("m_module", "m_mod_ent"))
def heuristic_warnings(t):
    w = verify.warnings_of(F.col("text"), F.col("skills"), 20)
    return _listed(t).select("module_id", F.array_join(F.transform(w, lambda x: F.concat(x, F.lit("|"))), "").alias("warnings"))


@query("J2_suspicious_records", f"""
    SELECT module_id, n AS skill_count, length(content) AS text_chars, content AS text_sample FROM {WARN_FROM} WHERE {WARN_SQL} <> ''""", ("m_module", "m_mod_ent"))
def suspicious_records(t):
    return verify.suspicious(_listed(t), ["module_id"], None, 20).select("module_id", F.col("skill_count").cast("bigint").alias("skill_count"), F.col("text_chars").cast("bigint").alias("text_chars"), "text_sample")


@query("J3_matrix_health", """
    WITH y AS (SELECT max(year(o_orderdate)) AS run_id FROM orders),
    m AS (SELECT 'jobs' AS source, skill, count(*) AS f FROM m_job_skill JOIN orders ON job_id = o_orderkey WHERE year(o_orderdate) = (SELECT run_id FROM y) GROUP BY 2
      UNION ALL SELECT 'courses', skill, count(DISTINCT module_id) FROM m_mod_ent GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f DESC, skill) AS rn FROM m)
    SELECT source, count(*) AS unique_skills, CAST(sum(f) FILTER (rn <= 20) AS BIGINT) AS top_frequency, count(*) <= 1 AS flagged FROM r GROUP BY 1""", ("m_job_skill", "m_mod_ent"))
def matrix_health(t):
    year = t.raw("orders").select(F.col("o_orderkey").alias("job_id"), F.year("o_orderdate").alias("run_id"))
    jobs = t.job_skill.join(year, "job_id").groupBy("run_id", "skill").agg(F.count("*").alias("frequency")).withColumn("source", F.lit("jobs"))
    mods = t.module_entities.select("module_id", "skill").distinct().groupBy("skill").agg(F.count("*").alias("frequency"))
    last = year.agg(F.max("run_id").alias("run_id"), F.lit(1).alias("k"))
    mods = mods.withColumn("k", F.lit(1)).join(last, "k").select("run_id", "skill", "frequency", F.lit("courses").alias("source"))
    return verify.matrix_health(jobs.unionByName(mods), t.runs)


@query("J4_verifier_responses", """
    SELECT module_id, CASE WHEN name = 'PROMO' THEN 'ok' ELSE 'needs_review' END AS status, name <> 'PROMO' AS suspicious,
      array_to_string(skills, '|') AS suggested, skills[1] AS wrong FROM m_module""", ("m_module",))
def verifier_responses(t):
    body = F.struct(F.when(F.col("name") == "PROMO", "OK").otherwise("odd").alias("status"), F.to_json("skills").alias("suggested_skills"),
                    F.concat(F.upper(F.get("skills", 0)), F.lit("; "), F.replace(F.get("skills", 0), F.lit(" "), F.lit("_"))).alias("false_positive_stored_skills"))
    r = t.modules.withColumn("r", verify.normalised_response(F.to_json(body)))
    return r.select("module_id", "r.status", "r.suspicious", F.array_join("r.suggested_skills", "|").alias("suggested"),
                    F.array_join("r.false_positive_stored_skills", "|").alias("wrong"))


# ---- training data -----------------------------------------------------------------------------

def _doc_spans(t):
    docs = t.documents.select("doc_id", "text")
    hits = extract.phrase_hits(docs, t.lexicon)
    return docs, hits.withColumn("seq", F.struct("start", "end", "skill"))


SPLIT = f"string_split_regex(text, '{text.WS}')"
TOKEN_SQL = f"""tp AS (SELECT doc_id, unnest(ps) AS token, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, {SPLIT} AS ps FROM documents)),
    tq AS (SELECT *, sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(token) - 1 AS a FROM tp),
    tok AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS token_index, token, CAST(a AS INT) AS char_start, CAST(a + length(token) AS INT) AS char_end FROM tq WHERE token <> '')"""


@query("K1_bio_tokens", f"""
    WITH {hits_sql(DOCS, 'm_lexicon', 3)}, h AS (SELECT {HIT_COLUMNS} FROM hits), {TOKEN_SQL},
    m AS (SELECT t.doc_id, token_index, min((h."start", h."end", h.skill)) AS f FROM tok t JOIN h ON h.doc_id = t.doc_id AND h."start" <= char_start AND char_start < h."end" GROUP BY 1, 2)
    SELECT t.doc_id, t.token_index, token, char_start, char_end, CASE WHEN f IS NULL THEN 'O' WHEN f[1] = char_start THEN 'B-SKILL' ELSE 'I-SKILL' END AS bio_label, coalesce(f[3], '') AS skill
    FROM tok t LEFT JOIN m ON m.doc_id = t.doc_id AND m.token_index = t.token_index""", ("m_lexicon",))
def bio_tokens(t):
    docs, spans = _doc_spans(t)
    return training.bio_rows(docs, spans)


@query("K2_training_examples")
def training_examples(t):
    docs, spans = _doc_spans(t)
    return training.examples(docs, spans).select("doc_id", F.size("spans").alias("kept"), "skipped", F.array_max(F.transform("spans", lambda s: s["end"])).alias("last_end"))


# entities of the modules, in the order of the parts: most lie where the module's text names the skill, some too long or outside the text, some without offsets
PLACED_SQL = """me AS (SELECT e.*, strpos(content, e.skill) - 1 AS pl, length(e.skill) AS w, mention_count AS size, length(content) AS len, content FROM m_mod_ent e JOIN m_module USING (module_id)),
    ent AS (SELECT *, CASE WHEN size % 5 <> 0 THEN pl END AS s, CASE WHEN size % 5 = 0 THEN NULL WHEN size % 7 = 0 THEN pl + 100000 WHEN size % 11 = 0 THEN pl + w + 5 ELSE pl + w END AS e FROM me)"""


def _placed_entities(t):
    size, at, width = F.col("mention_count"), F.instr("content", F.col("skill")) - 1, F.length("skill")
    end = F.when(size % 7 == 0, at + 100000).when(size % 11 == 0, at + width + 5).otherwise(at + width)
    return t.module_entities.join(t.modules.select("module_id", "content"), "module_id").select(
        "module_id", F.col("pos").alias("seq"), *training.ENTITY_FIELDS, "text", "label", F.when(size % 5 != 0, at).alias("start"), F.when(size % 5 != 0, end).alias("end"))


@query("K1_training_rows", f"""
    WITH {PLACED_SQL}, tp AS (SELECT module_id, content, unnest(string_split(content, ' ')) AS token, generate_subscripts(string_split(content, ' '), 1) AS i FROM m_module),
    tk AS (SELECT module_id, content, token, CAST(i - 1 AS INT) AS token_index, CAST(sum(length(token) + 1) OVER (PARTITION BY module_id ORDER BY i) - length(token) - 1 AS INT) AS a FROM tp),
    hit AS (SELECT tk.module_id, token_index, min(pos) AS pos FROM tk JOIN ent ON ent.module_id = tk.module_id AND label_status <> 'candidate' AND s <= a AND a < e GROUP BY 1, 2)
    SELECT 'token' AS dataset_row_type, tk.module_id, tk.token_index, token, CASE WHEN ent.skill IS NULL THEN 'O' WHEN s = a THEN 'B-SKILL' ELSE 'I-SKILL' END AS bio_label,
      entity_id, chunk_id, skill, skill_type, tier, source, confidence, label_status, a AS char_start, CAST(a + length(token) AS INT) AS char_end,
      substr(tk.content, greatest(0, a - 160) + 1, least(length(tk.content), a + length(token) + 160) - greatest(0, a - 160)) AS context, m.course_id, m.name
    FROM tk JOIN m_module m ON m.module_id = tk.module_id LEFT JOIN hit ON hit.module_id = tk.module_id AND hit.token_index = tk.token_index LEFT JOIN ent ON ent.module_id = hit.module_id AND ent.pos = hit.pos
    UNION ALL SELECT 'entity_without_offsets', ent.module_id, NULL, '', 'B-SKILL', entity_id, chunk_id, skill, skill_type, tier, source, confidence, label_status, NULL, NULL, text, m.course_id, m.name
    FROM ent JOIN m_module m ON m.module_id = ent.module_id WHERE label_status <> 'candidate' AND s IS NULL""", ("m_mod_ent", "m_module"))
def training_rows(t):
    docs = t.modules.select("module_id", F.col("content").alias("body"), "course_id", "name")
    return training.training_rows(docs, _placed_entities(t), "module_id", "body")


@query("K2_entity_examples", f"""
    WITH RECURSIVE {PLACED_SQL},
    u AS (SELECT module_id, coalesce(s, pl) AS s, CASE WHEN s IS NULL THEN pl + w ELSE e END AS e, len FROM ent WHERE course_id <> 'Brand#11' AND label_status <> 'candidate'
      UNION ALL SELECT module_id, strpos(content, skill) - 1, strpos(content, skill) - 1 + length(skill), length(content) FROM (SELECT module_id, content, unnest(skills) AS skill FROM m_module WHERE course_id = 'Brand#11')),
    o AS (SELECT module_id, s, e, row_number() OVER (PARTITION BY module_id ORDER BY s, e - s) AS n FROM u WHERE e <= len),
    g AS (SELECT module_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS last, CAST([] AS VARCHAR[]) AS kept FROM m_module
      UNION ALL SELECT o.module_id, o.n, CASE WHEN s >= last THEN e ELSE last END, CASE WHEN s >= last THEN list_append(kept, s || ':' || e) ELSE kept END FROM g JOIN o ON o.module_id = g.module_id AND o.n = g.n + 1)
    SELECT module_id, array_to_string(max_by(kept, n), ',') AS spans, CAST((SELECT count(*) FROM u WHERE u.module_id = g.module_id) - len(max_by(kept, n)) AS INT) AS skipped FROM g GROUP BY 1""", ("m_mod_ent", "m_module"))
def entity_examples(t):
    """Training spans of every module; those of one course have no entities and take the listed skills."""
    given = _placed_entities(t).join(t.modules.where("course_id <> 'Brand#11'").select("module_id"), "module_id", "left_semi")
    got = training.training_examples(t.modules, given, t.modules, "module_id", "content")
    return got.select("module_id", F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",").alias("spans"), "skipped")


@query("K3_readiness", f"""
    WITH {hits_sql(DOCS, 'm_lexicon', 3)} SELECT count(DISTINCT doc_id) AS examples, count(DISTINCT doc_id) >= 20 AS ready FROM hits""", ("m_lexicon",))
def readiness(t):
    docs, spans = _doc_spans(t)
    return training.readiness(training.examples(docs, spans), 20).select("examples", "ready")


@query("K4_split_examples", f"""
    SELECT min(doc_id) AS doc_id, sha256(text) AS text_key, CASE WHEN CAST('0x' || left(sha256('42|' || sha256(text)), 8) AS BIGINT) < {int(0.15 * 2 ** 32)} THEN 'dev' ELSE 'train' END AS part
    FROM documents GROUP BY text""")
def split_examples(t):
    return training.split_examples(t.documents)


@query("K5_training_fingerprint", """
    WITH d AS (SELECT sha256(module_id || '|' || content || '|' || array_to_string(skills, ',')) AS h FROM m_module)
    SELECT sha256(array_to_string([CAST(count(*) AS VARCHAR), """ + ", ".join(
        f"CAST(CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS VARCHAR)" for i in range(8)) + "], '|')) AS fingerprint FROM d", ("m_module",))
def training_fingerprint(t):
    rows = t.modules.withColumn("listed", F.array_join("skills", ","))
    return training.training_fingerprint(rows, "module_id", "content", "listed")


@query("K6_span_scores", """
    WITH r AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(B.LINE_ORDER) + """) - 1 AS i,
       CASE l_returnflag WHEN 'A' THEN 'B-SKILL' WHEN 'R' THEN 'I-SKILL' ELSE 'O' END AS truth, CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' AND l_returnflag = 'N' THEN 'B-SKILL'
       WHEN l_returnflag = 'R' THEN 'I-SKILL' ELSE 'O' END AS predicted FROM lineitem),
    s AS (""" + " UNION ALL ".join(f"""SELECT '{c}' AS side, d, min(i) AS lo, max(i) AS hi FROM (SELECT *, sum(o) OVER (PARTITION BY d ORDER BY i) AS n FROM (SELECT d, i, {c} AS x,
        CASE WHEN {c} = 'B-SKILL' OR {c} = 'I-SKILL' AND coalesce(lag({c}) OVER (PARTITION BY d ORDER BY i), 'O') = 'O' THEN 1 ELSE 0 END AS o FROM r)) WHERE x <> 'O' GROUP BY d, n""" for c in ("truth", "predicted")) + """),
    m AS (SELECT count_if(side = 'truth') AS truth, count_if(side = 'predicted') AS predicted FROM s), c AS (SELECT count(*) AS correct FROM (SELECT d, lo, hi FROM s GROUP BY ALL HAVING count(DISTINCT side) = 2))
    SELECT truth, predicted, correct, floor(correct::DOUBLE / predicted * 1e6 + 0.5) / 1e6 AS precision, floor(correct::DOUBLE / truth * 1e6 + 0.5) / 1e6 AS recall, (SELECT floor(avg(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0 END) * 1e6 + 0.5) / 1e6 FROM r) AS accuracy FROM m, c""")
def span_scores(t):
    flag = F.col("label_status")
    truth = F.when(flag == "reviewed", "B-SKILL").when(flag == "candidate", "I-SKILL").otherwise("O")
    guess = F.when((flag == "reviewed") | ((F.col("source") != "phrase_matcher") & (flag == "machine")), "B-SKILL").when(flag == "candidate", "I-SKILL").otherwise("O")
    rows = t.job_entities.select(F.col("job_id").alias("doc_id"), F.col("pos").alias("token_index"), truth.alias("truth"), guess.alias("predicted"))
    s = training.span_scores(rows)
    return s.select("truth", "predicted", "correct", *[scores.half_up(F.col(c), 6).alias(c) for c in ("precision", "recall", "accuracy")])


@query("K7_verbatim_sentences", """
    SELECT job_id, skill, CAST(strpos(description, lower(title)) AS INT) AS never, pos FROM m_job JOIN m_job_ent USING (job_id) WHERE false
    UNION ALL SELECT job_id, skill, CAST(length('Team needs ') AS INT), pos FROM m_job_ent WHERE label_status <> 'candidate'""", ("m_job", "m_job_ent"))
def verbatim_sentences(t):
    """Sentences keep the skill verbatim, but for candidates, where it is broken up."""
    s = F.when(F.col("label_status") == "candidate", F.concat(F.lit("Team needs "), F.replace(F.col("skill"), F.lit(" "), F.lit("-and-"))))
    sentence = F.coalesce(s, F.concat(F.lit("Team needs "), F.upper("skill"), F.lit(", now.")))
    rows = t.job_entities.select("job_id", "pos", "skill", sentence.alias("sentence")).withColumn("o", extract.skill_offsets(F.col("sentence"), F.col("skill")))
    return rows.filter("o IS NOT NULL").select("job_id", "skill", F.col("o.start").alias("never"), "pos")
