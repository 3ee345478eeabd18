"""Vector, pairing and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import scores
from skillgrid.operators import extract, pairs, runs, vectors
from skillgrid.plans import binding as B
from skillgrid.plans.registry import query
from skillgrid.session import shuffle_width, work_dir


def chunk_sql(size: int, most: str) -> str:
    early = int(size * 0.65)
    cut = (f"CASE WHEN strpos(reverse(left(rest, {size})), ' ') = 0 OR {size} - strpos(reverse(left(rest, {size})), ' ') < {early} "
           f"THEN {size} ELSE {size} - strpos(reverse(left(rest, {size})), ' ') END")
    return f"""
    WITH RECURSIVE flat AS (SELECT doc_id, {B.sql_squeeze('text')} AS rest FROM documents),
    step AS (SELECT doc_id, 0 AS chunk_no, CASE WHEN length(rest) <= {size} THEN rest ELSE trim(left(rest, {cut})) END AS chunk,
               CASE WHEN length(rest) <= {size} THEN '' ELSE trim(substr(rest, {cut} + 1)) END AS rest FROM flat
      UNION ALL
      SELECT doc_id, chunk_no + 1, CASE WHEN length(rest) <= {size} THEN rest ELSE trim(left(rest, {cut})) END,
               CASE WHEN length(rest) <= {size} THEN '' ELSE trim(substr(rest, {cut} + 1)) END FROM step WHERE rest <> '' {most})
    SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, chunk FROM step"""


def _chunks(t, size, most):
    return t.documents.select("doc_id", F.posexplode(vectors.text_chunks(F.col("text"), size, most)).alias("chunk_no", "chunk"))


@query("E1_text_chunks", chunk_sql(3500, ""))
def text_chunks(t):
    """Whole texts."""
    return _chunks(t, 3500, None)


@query("E1_text_chunks_limited", chunk_sql(600, "AND chunk_no < 11"))
def text_chunks_limited(t):
    """With the chunk limit as the feature: at most 12 chunks."""
    return _chunks(t, 600, 12)


@query("E2_word_vectors", """
    SELECT doc_id, 100 AS dim, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) <> '' AS known FROM documents""")
def word_vectors(t):
    """Training and document vectors; the values depend on the library, so only shape and support are compared."""
    docs = t.documents.select("doc_id", "text")
    model = vectors.train_word_vectors(docs, rounds=1)
    out = vectors.document_vectors(model, docs)
    return out.select("doc_id", F.size("vector").alias("dim"), (scores.norm(F.col("vector")) > 0).alias("known"))


@query("E4_pooled_vectors", f"""
    WITH v AS (SELECT label, vec_id % 4 AS slot, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    a AS (SELECT label, slot, i, avg(x::DOUBLE) AS x FROM v GROUP BY ALL),
    n AS (SELECT label, slot, sqrt(sum(x * x)) AS s FROM a GROUP BY ALL)
    SELECT label, slot, CAST(i - 1 AS INT) AS dim, {B.sql_round('x / s', 6)} AS value FROM a JOIN n USING (label, slot)""")
def pooled_vectors(t):
    chunks = t.vectors.withColumn("slot", F.col("vec_id") % 4)
    return vectors.pooled_vectors(chunks, ["label", "slot"]).select(
        "label", "slot", F.posexplode("vector").alias("dim", "value")).withColumn("value", scores.half_up(F.col("value"), 6))


@query("E5_neutral_vectors", """
    SELECT failed, count(*) AS jobs, count_if(list_sum(list_transform(vector, lambda x: abs(x))) = 0) AS zeros FROM m_job_vec GROUP BY 1""", ("m_job_vec",))
def neutral_vectors(t):
    return t.job_vectors.groupBy("failed").agg(F.count("*").alias("jobs"), F.count_if(scores.norm(F.col("vector")) == 0).alias("zeros"))


CENTRE_SQL = """v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, list(x ORDER BY i) AS centre FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM v GROUP BY ALL) GROUP BY 1)"""


@query("E6_cosine", f"""
    WITH {CENTRE_SQL}
    SELECT vec_id, {B.sql_round('greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre)))', 6)} AS similarity
    FROM embeddings JOIN c USING (label)""")
def cosine(t):
    centre = vectors.pooled_vectors(t.vectors, ["label"]).withColumnRenamed("vector", "centre")
    return t.vectors.join(centre, "label").select(
        "vec_id", scores.half_up(scores.cosine01(F.col("vector"), F.col("centre")), 6).alias("similarity"))


TOKEN_COSINE_SQL = """
    bag AS (SELECT skill AS n, w AS t, count(*) AS c FROM (SELECT skill, unnest(string_split(skill, ' ')) AS w FROM (SELECT DISTINCT skill FROM m_part)) GROUP BY 1, 2),
    size AS (SELECT n, sqrt(sum(c * c)) AS s FROM bag GROUP BY 1),
    cosines AS (SELECT l.n AS "left", r.n AS "right", sum(l.c * r.c) / (any_value(ls.s) * any_value(rs.s)) AS cosine
      FROM bag l JOIN bag r ON l.t = r.t AND l.n < r.n JOIN size ls ON ls.n = l.n JOIN size rs ON rs.n = r.n GROUP BY 1, 2)"""


@query("E7_token_cosine", f"""WITH {TOKEN_COSINE_SQL} SELECT "left", "right", {B.sql_round('cosine', 6)} AS cosine FROM cosines""", ("m_part",))
def token_cosine(t):
    return vectors.token_pairs(t.parts).withColumn("cosine", scores.half_up(F.col("cosine"), 6))


SEMANTIC_SQL = """sims AS (SELECT course_id, job_id, CASE WHEN list_sum(list_transform(m.vector, lambda x: abs(x))) = 0
          OR list_sum(list_transform(j.vector, lambda x: abs(x))) = 0 THEN 0.0::DOUBLE
          ELSE greatest(0, least(1, list_cosine_similarity(m.vector, j.vector))) END AS sim FROM {mods} m CROSS JOIN {jobs} j),
    sem AS (SELECT course_id, job_id, avg(sim) AS semantic_score FROM
      (SELECT *, row_number() OVER (PARTITION BY course_id, job_id ORDER BY sim DESC) AS rn FROM sims) WHERE rn <= 3 GROUP BY 1, 2)"""


@query("E8_course_job_semantic", f"""
    WITH v AS (SELECT label AS course_id, vec_id % 5 AS module_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    mods AS (SELECT course_id, module_id, list(x ORDER BY i) AS vector FROM (SELECT course_id, module_id, i, avg(x::DOUBLE) AS x FROM v GROUP BY ALL) GROUP BY 1, 2),
    jobs AS (SELECT vec_id AS job_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
    {SEMANTIC_SQL.format(mods='mods', jobs='jobs')}
    SELECT course_id, job_id, {B.sql_round('semantic_score', 6)} AS semantic_score FROM sem""")
def course_job_semantic(t):
    mods = vectors.pooled_vectors(t.vectors.select(F.col("label").alias("course_id"), (F.col("vec_id") % 5).alias("module_id"), "vector"),
                                  ["course_id", "module_id"])
    jobs = t.vectors.select(F.col("vec_id").alias("job_id"), "vector")
    # two module blocks, so that the merge of split courses is part of the check
    out = pairs.semantic_scores(mods, jobs, module_blocks=2)
    return out.withColumn("semantic_score", scores.half_up(F.col("semantic_score"), 6))


@query("F1_course_job_pairs", """
    SELECT course_id, count(*) AS jobs, CAST(sum(job_id) AS BIGINT) AS job_id_sum
    FROM (SELECT DISTINCT course_id FROM m_module WHERE content <> '') CROSS JOIN (SELECT job_id FROM m_job WHERE description <> '') GROUP BY 1""", ("m_module", "m_job"))
def course_job_pairs(t):
    courses = t.modules.filter("trim(content) <> ''").select("course_id").distinct()
    jobs = t.jobs.filter("trim(description) <> ''").select("job_id")
    return pairs.pair_up(courses, jobs).groupBy("course_id").agg(F.count("*").alias("jobs"), F.sum("job_id").alias("job_id_sum"))


@query("F2_skill_gap", """
    SELECT course_id, job_id, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing,
      array_to_string(extra, '|') AS extra FROM m_result""", ("m_result",))
def skill_gap(t):
    g = pairs.gap(t.course_skills, t.job_skills)
    return g.select("course_id", "job_id", *[F.array_join(c, "|").alias(c) for c in ("matched", "missing", "extra")])


@query("F3_skill_coverage", f"""
    SELECT course_id, job_id, CASE WHEN len(job_skills) = 0 THEN 0 ELSE {B.sql_round('len(matched)::DOUBLE / len(job_skills)::DOUBLE', 6)} END AS coverage
    FROM m_result""", ("m_result",))
def skill_coverage(t):
    g = pairs.gap(t.course_skills, t.job_skills)
    return g.select("course_id", "job_id", scores.half_up(scores.coverage(F.size("matched"), F.size("job_skills")), 6).alias("coverage"))


@query("F4_skill_confidence", "SELECT job_id, skill, max(confidence) AS confidence FROM m_job_ent GROUP BY 1, 2", ("m_job_ent",))
def skill_confidence(t):
    return pairs.max_confidence(t.job_lines, "job_id")


@query("F5_matched_confidence", f"""
    WITH c AS (SELECT course_id, skill, max(confidence) AS x FROM m_mod_ent GROUP BY 1, 2),
    j AS (SELECT job_id, skill, max(confidence) AS x FROM m_job_ent GROUP BY 1, 2)
    SELECT course_id, job_id, {B.sql_round('avg((c.x + j.x) / 2)', 6)} AS confidence_score FROM c JOIN j USING (skill) GROUP BY 1, 2""", ("m_mod_ent", "m_job_ent"))
def matched_confidence(t):
    out = pairs.matched_confidence(pairs.max_confidence(t.module_entities, "course_id"), pairs.max_confidence(t.job_lines, "job_id"))
    return out.withColumn("confidence_score", scores.half_up(F.col("confidence_score"), 6))


def policy_sql(s: str, k: str, c: str) -> str:
    return (f"CASE WHEN {s} >= 0.78 AND {k} >= 0.45 AND {c} >= 0.75 THEN 0.95::DOUBLE WHEN {s} >= 0.65 AND ({k} >= 0.35 OR {c} >= 0.80) THEN 0.82::DOUBLE "
            f"WHEN {s} >= 0.50 AND {k} >= 0.25 THEN 0.65::DOUBLE WHEN {s} >= 0.35 AND {k} >= 0.10 AND {c} >= 0.85 THEN 0.50::DOUBLE "
            f"ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE * {s} + 0.3::DOUBLE * {k})) END")


def final_sql(s: str, k: str, c: str, p: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.55::DOUBLE * {s} + 0.2::DOUBLE * {k} + 0.15::DOUBLE * {c} + 0.1::DOUBLE * {p}) / {sum((0.55, 0.2, 0.15, 0.1))!r}::DOUBLE))"


# score inputs read from the order lines: discount, tax and quantity spread over the unit interval
INPUT_SQL = "(SELECT *, l_quantity / 50.0::DOUBLE AS s, l_linenumber / 7.0::DOUBLE AS k, 1.0::DOUBLE - l_discount AS c FROM lineitem)"


def _score_inputs(t):
    l = t.raw("lineitem")
    return l.withColumn("s", F.col("l_quantity") / 50.0).withColumn("k", F.col("l_linenumber") / 7.0).withColumn("c", 1.0 - F.col("l_discount"))


KEYS = ("l_orderkey", "l_partkey", "l_linenumber")


@query("F6_policy_score", f"SELECT l_orderkey, l_partkey, l_linenumber, {B.sql_round(policy_sql('s', 'k', 'c'), 6)} AS policy FROM {INPUT_SQL}")
def policy_score(t):
    c = F.col
    return _score_inputs(t).select(*KEYS, scores.half_up(scores.policy_score(c("s"), c("k"), c("c")), 6).alias("policy"))


@query("F7_final_score", f"""
    SELECT l_orderkey, l_partkey, l_linenumber, {B.sql_round(final_sql('s', 'k', 'c', 'p'), 6)} AS final_score
    FROM (SELECT *, {policy_sql('s', 'k', 'c')} AS p FROM {INPUT_SQL})""")
def final_score(t):
    c = F.col
    parts = scores.score_breakdown(c("s"), c("k"), c("c"))
    return _score_inputs(t).select(*KEYS, parts["final_score"].alias("final_score"))


RUN_SQL = f"""
    {SEMANTIC_SQL.format(mods='m_mod_vec', jobs='m_job_vec')},
    cc AS (SELECT course_id, map_from_entries(list((skill, x))) AS cm FROM (SELECT course_id, skill, max(confidence) AS x FROM m_mod_ent GROUP BY 1, 2) GROUP BY 1),
    jc AS (SELECT job_id, map_from_entries(list((skill, x))) AS jm FROM (SELECT job_id, skill, max(confidence) AS x FROM m_job_ent GROUP BY 1, 2) GROUP BY 1),
    base AS (SELECT r.course_id, r.job_id, r.matched, r.missing, coalesce(sem.semantic_score, 0) AS s,
        CASE WHEN len(r.job_skills) = 0 THEN 0.0::DOUBLE ELSE len(r.matched)::DOUBLE / len(r.job_skills)::DOUBLE END AS k,
        CASE WHEN len(r.matched) = 0 THEN 0.0::DOUBLE ELSE list_reduce(list_transform(r.matched, lambda x: (cm[x] + jm[x]) / 2), lambda a, b: a + b, 0.0::DOUBLE) / len(r.matched)::DOUBLE END AS c
      FROM m_result r JOIN cc ON cc.course_id = r.course_id LEFT JOIN jc ON jc.job_id = r.job_id
      LEFT JOIN sem ON sem.course_id = r.course_id AND sem.job_id = r.job_id),
    scored AS (SELECT *, {policy_sql('s', 'k', 'c')} AS p FROM base)"""
RUN_NEEDS = ("m_result", "m_mod_ent", "m_job_ent", "m_mod_vec", "m_job_vec")


def run_inputs(t):
    return runs.Inputs(
        t.course_skills, t.job_skills, pairs.max_confidence(t.module_entities, "course_id"), pairs.max_confidence(t.job_lines, "job_id"),
        t.module_vectors, t.job_vectors, t.job_skill, t.module_entities.select("module_id", "skill").distinct())


def full_run(t):
    i = run_inputs(t)
    return pairs.gap_analysis(i.course_skills, i.job_skills, i.course_conf, i.job_conf, i.module_vectors, i.job_vectors,
                              job_blocks=max(4 * shuffle_width(t.spark), pairs.block_count(t.raw("orders"))))


@query("F8_gap_analysis", f"""
    WITH {RUN_SQL}
    SELECT course_id, job_id, {B.sql_round('s', 6)} AS semantic_score, {B.sql_round('k', 6)} AS skill_score, {B.sql_round('c', 6)} AS confidence_score,
      {B.sql_round('p', 6)} AS decision_tree_score, {B.sql_round(final_sql('s', 'k', 'c', 'p'), 6)} AS similarity_score,
      CAST(len(matched) AS INT) AS matched, CAST(len(missing) AS INT) AS missing FROM scored""", RUN_NEEDS)
def gap_analysis(t):
    return full_run(t).select(
        "course_id", "job_id", "score_breakdown.semantic_score", "score_breakdown.skill_score", "score_breakdown.confidence_score",
        "score_breakdown.decision_tree_score", "similarity_score", F.size("matched").alias("matched"), F.size("missing").alias("missing"))


NOTE_SQL = """(SELECT count(*) FROM m_job_vec WHERE failed) + (SELECT count(*) FROM (SELECT p_brand, p_type FROM part
      LEFT JOIN embeddings ON vec_id = p_partkey GROUP BY 1, 2 HAVING count(vec_id) = 0))"""


@query("F8_stored_run", f"""
    SELECT 'run' AS section, 'Full' AS name, 'done' AS label, (SELECT count(*) FROM orders) * (SELECT count(DISTINCT p_brand) FROM part) AS n,
      CASE WHEN {NOTE_SQL} = 0 THEN '' ELSE ({NOTE_SQL}) || ' texts had no vector and were scored with a neutral one' END AS notes
    UNION ALL SELECT 'jobs', skill, '', count(*), '' FROM m_job_skill GROUP BY 2
    UNION ALL SELECT 'courses', skill, '', count(DISTINCT module_id), '' FROM m_mod_ent GROUP BY 2
    UNION ALL SELECT 'results', course_id, '', count(*), '' FROM m_result GROUP BY 2""", ("m_job_skill", "m_mod_ent", "m_result", "m_job_vec"))
def stored_run(t):
    """A whole run as it is stored: run row with its note, both skill matrices, results counted by course."""
    store = runs.RunStore(t.spark, work_dir(t.spark, "run-store"))
    runs.run_gap_analysis(store, "Full", run_inputs(t))
    empty = F.lit("")
    return store.runs().select(F.lit("run").alias("section"), "name", F.col("status").alias("label"), F.col("results").alias("n"), "notes").unionAll(
        store.matrices().select("source", "skill", empty, "frequency", empty)).unionAll(
        store.results().groupBy("course_id").count().select(F.lit("results"), "course_id", empty, "count", empty))


@query("F9_newest_jobs", "SELECT job_id, created_on FROM m_job ORDER BY created_on DESC, job_id LIMIT 500", ("m_job",))
def newest_jobs(t):
    return pairs.newest_jobs(t.jobs, 500).select("job_id", "created_on")


@query("F10_remaining_jobs", """
    SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey NOT IN
      (SELECT job_id FROM m_result JOIN m_job USING (job_id) WHERE contract_type <> 'F' AND (contract_type = 'O' OR course_id <> 'Brand#1')
       GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM m_course))""", ("m_result", "m_course", "m_job"))
def remaining_jobs(t):
    """An interrupted run: nothing of the 'F' adverts, one course short for the 'P' adverts."""
    have = t.results.join(t.jobs.select("job_id", "contract_type"), "job_id").filter(
        "contract_type <> 'F' AND (contract_type = 'O' OR course_id <> 'Brand#1')")
    return pairs.remaining_jobs(t.raw("orders").select(F.col("o_orderkey").alias("job_id")), have, t.courses)


@query("F10_resumed_run", f"""
    WITH {RUN_SQL}
    SELECT course_id, job_id, {B.sql_round('s', 6)} AS semantic_score, {B.sql_round('k', 6)} AS skill_score, {B.sql_round('c', 6)} AS confidence_score,
      {B.sql_round('p', 6)} AS decision_tree_score, {B.sql_round(final_sql('s', 'k', 'c', 'p'), 6)} AS similarity_score,
      array_to_string(list_sort(matched), '|') AS matched, array_to_string(list_sort(missing), '|') AS missing FROM scored""", RUN_NEEDS)
def resumed_run(t):
    """A run that ends after a part of its blocks, and is taken up again by its name: each block is scored once, the results are those of one go."""
    store, inputs = runs.RunStore(t.spark, work_dir(t.spark, "run-store")), run_inputs(t)
    first = runs.run_gap_analysis(store, "Nightly", inputs, blocks_per_wave=2 * shuffle_width(t.spark), max_waves=1)
    if runs.run_gap_analysis(store, "Nightly", inputs, resume=True) != first:
        raise RuntimeError("the unfinished run was not found")
    return store.results().select(
        "course_id", "job_id", "score_breakdown.semantic_score", "score_breakdown.skill_score", "score_breakdown.confidence_score",
        "score_breakdown.decision_tree_score", "similarity_score", F.array_join("matched", "|").alias("matched"), F.array_join("missing", "|").alias("missing"))


@query("F11_skill_matrices", """
    SELECT 'jobs' AS source, skill, count(*) AS frequency FROM m_job_skill GROUP BY 2
    UNION ALL SELECT 'courses', skill, count(DISTINCT module_id) FROM m_mod_ent GROUP BY 2""", ("m_job_skill", "m_mod_ent"))
def skill_matrices(t):
    return pairs.skill_matrix(t.job_skill, t.module_entities.select("module_id", "skill").distinct())


@query("F12_overlap_score", "SELECT course_id, job_id, similarity_score FROM m_result", ("m_result",))
def overlap_score(t):
    return t.results.select("course_id", "job_id", "similarity_score")


@query("F13_score_audit", f"""
    WITH {RUN_SQL},
    st AS (SELECT *, {B.sql_round('s', 6)} AS s6, {B.sql_round('k', 6)} AS k6, {B.sql_round('c', 6)} AS c6, {B.sql_round('p', 6)} AS p6,
      {B.sql_round(final_sql('s', 'k', 'c', 'p'), 6)} AS f FROM scored)
    SELECT course_id, job_id, {B.sql_round('f * 100.0::DOUBLE', 1)} AS stored_score,
      {B.sql_round(f"((0.55::DOUBLE * s6 + 0.2::DOUBLE * k6 + 0.15::DOUBLE * c6 + 0.1::DOUBLE * p6) / {sum((0.55, 0.2, 0.15, 0.1))!r}::DOUBLE) * 100.0::DOUBLE", 2)} AS calculated_score,
      {B.sql_round('s6', 4)} AS semantic, {B.sql_round('k6', 4)} AS skill, {B.sql_round('c6', 4)} AS confidence, {B.sql_round('p6', 4)} AS policy,
      CAST(len(matched) AS INT) AS matched_count, CAST(len(matched) + len(missing) AS INT) AS job_skill_count FROM st""", RUN_NEEDS)
def score_audit(t):
    return pairs.score_audit(full_run(t))
