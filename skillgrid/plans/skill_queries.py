"""Skill name queries: canonical form, identity, class, sector, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.functions import skills
from skillgrid.plans import binding as B
from skillgrid.plans.registry import query


@query("C1_canonical_skill", f"SELECT DISTINCT {B.sql_canonical('text')} AS name FROM documents")
def canonical_skill(t):
    return t.documents.select(skills.canonical(F.col("text")).alias("name")).distinct()


# names with punctuation, digits and accents: the texts of the benchmark and of the conversations
NAMES_SQL = "(SELECT text AS n FROM benchmark UNION SELECT text FROM conversations UNION SELECT p_name || ' c#' FROM part UNION SELECT p_name FROM part)"


def _names(t):
    texts = t.raw("benchmark").select(F.col("text").alias("n")).union(t.raw("conversations").select("text"))
    parts = t.raw("part").select(F.concat(F.col("p_name"), F.lit(" c#"))).union(t.raw("part").select("p_name"))
    return texts.union(parts).distinct()


@query("C2_entity_id", f"SELECT n, {B.sql_entity_id('c')} AS entity_id FROM (SELECT n, {B.sql_canonical('n')} AS c FROM {NAMES_SQL})")
def entity_id(t):
    return _names(t).select("n", skills.entity_id(F.col("n")).alias("entity_id"))


@query("C3_chunk_id", """
    SELECT DISTINCT l_orderkey AS job_id, skill, l_linenumber AS line,
      'chunk-' || left(sha1('job-' || l_orderkey || '|' || skill || '|' || l_linenumber || '|'
        || CASE WHEN l_returnflag = 'R' THEN 'None' ELSE CAST(l_linenumber + length(skill) AS VARCHAR) END), 16) AS chunk_id
    FROM lineitem JOIN m_part ON l_partkey = p_partkey""", ("m_part",))
def chunk_id(t):
    l = t.raw("lineitem").join(t.parts, F.col("l_partkey") == F.col("p_partkey"))
    end = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber") + F.length("skill"))
    doc = F.concat(F.lit("job-"), F.col("l_orderkey").cast("string"))
    return l.select(F.col("l_orderkey").alias("job_id"), "skill", F.col("l_linenumber").alias("line"),
                    skills.chunk_id(doc, F.col("skill"), F.col("l_linenumber"), end).alias("chunk_id")).distinct()


@query("C4_classify_skill", f"""
    SELECT p_partkey, skill, skill_type, tier, CAST(technical AS INT) AS technical, CAST(soft AS INT) AS soft, CAST(business AS INT) AS business
    FROM {B.sql_classified("(SELECT *, skill || ' ' || CASE WHEN p_size % 2 = 0 THEN 'stakeholder reporting tool' ELSE lower(p_type) || ' data service' END AS ctx FROM m_part)",
                           'skill', 'ctx')}""", ("m_part",))
def classify_skill(t):
    context = F.when(F.col("p_size") % 2 == 0, "Stakeholder reporting-tool").otherwise(F.concat(F.col("p_type"), F.lit(" data service")))
    k = t.parts.withColumn("k", skills.classify(F.col("skill"), F.col("skill"), context))
    return k.select("p_partkey", "skill", "k.skill_type", "k.tier", "k.technical", "k.soft", "k.business")


@query("C5_surface_pattern", f"""
    SELECT n, array_to_string(list_transform(list_filter(string_split({B.sql_squeeze('n')}, ' '), lambda x: x <> ''),
      lambda x: CASE WHEN regexp_full_match(x, '\\p{{L}}+') THEN 'WORD' ELSE 'TOKEN' END), ' ') AS pattern FROM {NAMES_SQL}""")
def surface_pattern(t):
    return _names(t).select("n", skills.surface_pattern(F.col("n")).alias("pattern"))


def refine_sql(c: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.REFINE_LABELS.items())
    return f"CASE WHEN list_contains({B._in(K.REFINE_DROP)}, lower(trim({c}))) THEN NULL ELSE CASE lower(trim({c})) {arms} ELSE {c} END END"


# part names read as skills, with technical names mixed in by part type
RAW_SKILL_SQL = """(SELECT *, CASE p_type WHEN 'PROMO' THEN 'Python' WHEN 'ECONOMY' THEN 'c++' WHEN 'LARGE' THEN 'SQL' ELSE skill END AS raw_skill FROM m_part)"""


def _raw_skills(t):
    raw = F.when(F.col("p_type") == "PROMO", "Python").when(F.col("p_type") == "ECONOMY", "c++").when(
        F.col("p_type") == "LARGE", "SQL").otherwise(F.col("skill"))
    return t.parts.withColumn("raw_skill", raw)


@query("C6_refine_business_skill", f"""
    SELECT p_partkey, label FROM (SELECT p_partkey, {refine_sql('raw_skill')} AS label FROM {RAW_SKILL_SQL}) WHERE label IS NOT NULL""", ("m_part",))
def refine_business_skill(t):
    return _raw_skills(t).select("p_partkey", skills.refined_label(F.col("raw_skill")).alias("label")).filter("label IS NOT NULL")


@query("C7_refined_counter", f"""
    SELECT label AS skill, CAST(sum(l_quantity) AS BIGINT) AS frequency FROM
      (SELECT p_partkey, {refine_sql('raw_skill')} AS label FROM {RAW_SKILL_SQL}) JOIN lineitem ON l_partkey = p_partkey
    WHERE label IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", ("m_part",))
def refined_counter(t):
    from skillgrid.operators.evidence import refined_counts
    rows = t.raw("lineitem").join(_raw_skills(t), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("raw_skill").alias("skill"), F.col("l_quantity").cast("bigint").alias("frequency"))
    return refined_counts(rows).orderBy(F.desc("frequency"), "skill").limit(10)


def sector_sql(text: str) -> str:
    scored = ", ".join(
        f"{{'n': {' + '.join(f'''CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END''' for w in words)}, 's': '{sector}'}}"
        for sector, words in K.SECTOR_KEYWORDS.items())
    best = f"list_max([{scored}])"
    return f"CASE WHEN ({best}).n > 0 THEN ({best}).s ELSE '' END"


@query("C8_infer_sector", f"""
    SELECT job_id, {sector_sql('t')} AS sector FROM (SELECT job_id, lower(title || ' ' || description || ' ' || category) AS t FROM m_job)""", ("m_job",))
def infer_sector(t):
    return t.jobs.select("job_id", skills.infer_sector(F.col("title"), F.col("description"), F.col("category")).alias("sector"))


def clean_sector_sql(c: str) -> str:
    flat = B.sql_squeeze(c)
    return f"CASE WHEN list_contains({B._in(K.MISSING_SECTORS)}, lower({flat})) THEN '' ELSE {flat} END"


@query("C9_sector_precedence", f"""
    SELECT job_id, coalesce(nullif({clean_sector_sql('category')}, ''), nullif({sector_sql("lower(title)")}, ''), 'Unclassified') AS sector FROM m_job""", ("m_job",))
def sector_precedence(t):
    sector = F.coalesce(F.nullif(skills.clean_sector(F.concat(F.lit(" "), F.col("category"))), F.lit("")),
                        F.nullif(skills.infer_sector(F.col("title")), F.lit("")), F.lit("Unclassified"))
    return t.jobs.select("job_id", sector.alias("sector"))


@query("C10_tokenisers", f"""
    SELECT doc_id, CAST(len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS INT) AS plain,
      array_to_string(list_filter(string_split(regexp_replace(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}+#]', ' ', 'g')), ' +', ' ', 'g'), ' '),
        lambda x: x <> '' AND NOT list_contains({B._in(K.SKILL_STOP_WORDS)}, x)), ' ') AS skill_words,
      array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#]+'),
        lambda x: length(x) > 1 AND NOT list_contains({B._in(K.RETRIEVAL_STOP_WORDS)}, x)), ' ') AS query_words FROM documents""")
def tokenisers(t):
    from skillgrid.functions import text
    c = F.col("text")
    return t.documents.select("doc_id", F.size(text.words(c)).alias("plain"),
                              F.array_join(skills.skill_tokens(c), " ").alias("skill_words"),
                              F.array_join(skills.retrieval_tokens(c), " ").alias("query_words"))


@query("C11_excluded_terms", f"""
    SELECT job_id, skill FROM m_job_skill WHERE NOT list_contains({B._in(K.EXCLUDED_TERMS)}, skill)
      OR skill IN (SELECT skill FROM m_part WHERE p_type = 'PROMO')""", ("m_job_skill", "m_part"))
def excluded_terms(t):
    from skillgrid.operators.extract import drop_excluded
    return drop_excluded(t.job_skill, t.parts.filter("p_type = 'PROMO'")).select("job_id", "skill")
