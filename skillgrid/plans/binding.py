"""Binding of the given star-schema tables to the model tables (jobs, courses, modules, entities, ...).

Orders are job adverts, order lines their skill entities, part brands the courses, part types the
modules of a brand. The two words of a part name stand for two words of a skill name, so that the
classifier, the refinement and the sector rules meet realistic names. Nothing is filtered out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgrid.functions import scores, skills, text
from skillgrid.operators import extract, pairs, vectors
from skillgrid.session import spread

FIRST_WORD = {
    "blue": "financial", "cold": "digital", "hot": "project", "large": "data",
    "new": "customer", "old": "risk", "red": "machine", "small": "team",
}
SECOND_WORD = {
    "anvil": "analysis", "bolt": "analytics", "gear": "management", "gizmo": "learning",
    "plate": "leadership", "ring": "communication", "rod": "engineering", "widget": "modelling",
}
TITLES = {
    "1-URGENT": "Risk Analyst", "2-HIGH": "Data Engineer", "3-MEDIUM": "Project Manager",
    "4-NOT SPECIFIED": "Marketing Specialist", "5-LOW": "Sales Consultant",
}
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def skill_name(part_name: Column) -> Column:
    parts = F.split(part_name, " ")
    return F.concat_ws(" ", _lookup(FIRST_WORD, F.get(parts, 0)), _lookup(SECOND_WORD, F.get(parts, 1)))


class Tables:
    """Lazy access to the given tables and the model tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def jobs(self) -> DataFrame:
        o = spread(self.raw("orders"))
        c = self.raw("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        n = self.raw("nation").select("n_nationkey", "n_name")
        posted = F.col("o_orderdate").cast("date")
        joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
        title = _lookup(TITLES, F.col("o_orderpriority"))
        return joined.select(
            F.col("o_orderkey").alias("job_id"),
            title.alias("title"),
            text.text_or_empty(F.col("c_name")).alias("company"),
            F.when(F.col("o_orderstatus") == "F", "").otherwise(
                F.concat(text.text_or_empty(F.col("n_name")), F.lit(" Agency"))).alias("recruiter"),
            F.concat(F.lit("REF-"), F.col("o_orderkey").cast("string")).alias("job_reference"),
            text.text_or_empty(F.col("n_name")).alias("location"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Other")
            .otherwise(text.text_or_empty(F.col("c_mktsegment"))).alias("category"),
            F.col("o_orderstatus").alias("contract_type"),
            F.concat(title, F.lit(" wanted by "), text.text_or_empty(F.col("c_name")), F.lit(" in "),
                     text.text_or_empty(F.col("n_name")), F.lit(". Budget "),
                     F.floor("o_totalprice").cast("string"), F.lit(" per year.")).alias("description"),
            F.lit("csv").alias("source"),
            F.concat(F.lit("ext-"), F.col("o_orderkey").cast("string")).alias("external_id"),
            F.when(F.col("o_orderstatus") != "F", F.floor(F.col("o_totalprice") / 10).cast("int")).alias("salary_min"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.floor(F.col("o_totalprice") / 8).cast("int")).alias("salary_max"),
            F.when(F.col("o_orderstatus") != "P", posted).alias("date_posted"),
            F.date_add(posted, 30).alias("created_on"),
        )

    @cached_property
    def parts(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        return p.withColumn("skill", skill_name(F.col("p_name")))

    @cached_property
    def typed_parts(self) -> DataFrame:
        """Parts with the class of their skill, computed once per part and not per order line."""
        return self.parts.withColumn("kind", skills.classify(F.col("skill"))).withColumn(
            "entity_id", skills.entity_id(F.col("skill")))

    @cached_property
    def courses(self) -> DataFrame:
        number = F.substring_index("course_id", "#", -1).try_cast("int") % 5
        return (
            self.raw("part").select(F.col("p_brand").alias("course_id")).distinct()
            .select(
                "course_id",
                F.col("course_id").alias("code"),
                F.concat(F.lit("MBA "), F.col("course_id")).alias("name"),
                F.when(number == 0, "").otherwise(F.concat(F.lit("University "), number.cast("string"))).alias("university"),
                F.lit("South Africa").alias("country"),
            )
        )

    @cached_property
    def modules(self) -> DataFrame:
        """One row per brand and type; the content lists the module's skills."""
        return (
            self.parts.groupBy("p_brand", "p_type")
            .agg(F.array_sort(F.collect_set("skill")).alias("skills"))
            .select(
                F.concat_ws("/", "p_brand", "p_type").alias("module_id"),
                F.col("p_brand").alias("course_id"),
                F.col("p_type").alias("name"),
                F.concat(F.array_join("skills", ". "), F.lit(".")).alias("content"),
                "skills",
                F.lit("1999-06-01").cast("date").alias("created_on"),
            )
        )

    @cached_property
    def job_lines(self) -> DataFrame:
        """Flat skill entities of the jobs, without an order."""
        l, p = spread(self.raw("lineitem")), self.typed_parts.select("p_partkey", "p_name", "skill", "kind", "entity_id")
        j = l.join(p, l.l_partkey == p.p_partkey)
        ner = F.col("l_linestatus") == "F"
        return j.select(
            F.col("l_orderkey").alias("job_id"),
            "skill", "entity_id",
            F.when(ner, F.col("skill")).otherwise(F.col("p_name")).alias("text"),
            F.when(F.col("l_tax") >= 0.08, "sector").otherwise("SKILL").alias("label"),
            F.when(F.col("l_returnflag") == "R", "candidate").otherwise(F.col("kind.tier")).alias("tier"),
            F.col("kind.skill_type").alias("skill_type"),
            F.when(ner & (F.col("l_tax") == 0), "regex").when(ner, "ner").otherwise("phrase_matcher").alias("source"),
            scores.half_up(1.0 - F.col("l_discount"), 2).alias("confidence"),
            F.col("l_quantity").cast("int").alias("mention_count"),
            F.when(F.col("l_returnflag") == "A", "reviewed").when(F.col("l_returnflag") == "R", "candidate")
            .otherwise("machine").alias("label_status"),
            *LINE_ORDER,
        )

    @cached_property
    def job_entities(self) -> DataFrame:
        """Job entities with their position (0-based) inside the advert."""
        w = W.partitionBy("job_id").orderBy(*LINE_ORDER)
        return (
            self.job_lines.withColumn("pos", F.row_number().over(w) - 1)
            .withColumn("chunk_id", skills.chunk_id(
                F.concat(F.lit("job-"), F.col("job_id").cast("string")), F.col("skill"),
                F.col("pos") * 20, F.col("pos") * 20 + F.length("skill")))
            .drop(*LINE_ORDER)
        )

    @cached_property
    def module_entities(self) -> DataFrame:
        w = W.partitionBy("p_brand", "p_type").orderBy("p_partkey")
        module = F.concat_ws("/", "p_brand", "p_type")
        return self.typed_parts.withColumn("pos", F.row_number().over(w) - 1).select(
            module.alias("module_id"),
            F.col("p_brand").alias("course_id"),
            F.col("p_type").alias("module_name"),
            "skill",
            F.when(F.col("p_size") > 25, F.col("skill")).otherwise(F.col("p_name")).alias("text"),
            F.lit("SKILL").alias("label"),
            F.col("kind.tier").alias("tier"),
            F.col("kind.skill_type").alias("skill_type"),
            F.lit("ner").alias("source"),
            scores.half_up(0.5 + F.col("p_size") / 100.0, 2).alias("confidence"),
            F.col("p_size").alias("mention_count"),
            F.when(F.col("p_size") % 3 == 0, "candidate").when(F.col("p_size") % 3 == 1, "reviewed")
            .otherwise("machine").alias("label_status"),
            "pos",
            "entity_id",
            skills.chunk_id(F.concat(F.lit("module-"), module), F.col("skill"), F.col("pos"), F.lit(None)).alias("chunk_id"),
        )

    @cached_property
    def job_skill(self) -> DataFrame:
        return (
            self.raw("lineitem").select("l_orderkey", "l_partkey")
            .join(self.parts.select("p_partkey", "skill"), F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("job_id"), "skill").distinct()
        )

    @cached_property
    def course_skill(self) -> DataFrame:
        return self.parts.select(F.col("p_brand").alias("course_id"), "skill").distinct()

    @cached_property
    def job_skills(self) -> DataFrame:
        """Every advert with its sorted skills; adverts without lines keep an empty list."""
        have = self.job_skill.groupBy("job_id").agg(F.array_sort(F.collect_set("skill")).alias("job_skills"))
        ids = self.raw("orders").select(F.col("o_orderkey").alias("job_id"))
        return ids.join(have, "job_id", "left").withColumn(
            "job_skills", F.coalesce("job_skills", F.array().cast("array<string>")))

    @cached_property
    def course_skills(self) -> DataFrame:
        return self.course_skill.groupBy("course_id").agg(F.array_sort(F.collect_set("skill")).alias("course_skills"))

    @cached_property
    def results(self) -> DataFrame:
        """Every course with every job, scored by overlap."""
        return pairs.overlap_results(self.course_skills, self.job_skills)

    @cached_property
    def runs(self) -> DataFrame:
        """One finished run per order year and one newer run that has no results yet."""
        years = self.raw("orders").select(F.year("o_orderdate").alias("run_id")).groupBy("run_id").agg(F.count("*").alias("jobs"))
        empty = years.agg((F.max("run_id") + 1).alias("run_id")).withColumn("jobs", F.lit(0).cast("bigint"))
        return years.unionByName(empty).select(
            "run_id", F.concat(F.lit("Run "), F.col("run_id").cast("string")).alias("name"),
            F.make_date("run_id", F.lit(12), F.lit(31)).alias("created_on"), "jobs")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.raw("documents"))

    @cached_property
    def terms(self) -> DataFrame:
        """Phrases of one to three words: the punctuation-free runs of the benchmark texts."""
        runs = F.split(F.lower(F.translate("text", "-", " ")), r"[^\p{L}\p{N}+#&/ ]")
        return (
            self.raw("benchmark").select(F.explode(runs).alias("run"))
            .select(text.squeeze(F.col("run")).alias("phrase")).filter("phrase <> ''").distinct()
            .filter(F.size(F.split("phrase", " ")) <= 3)
        )

    @cached_property
    def lexicon(self) -> DataFrame:
        """Lexicon for the documents: the terms, and the first two words of longer terms as their aliases."""
        base = self.terms.select("phrase", F.col("phrase").alias("skill"), F.lit(0).alias("rank"))
        longer = self.terms.filter(F.size(F.split("phrase", " ")) == 3)
        short = longer.select(F.substring_index("phrase", " ", 2).alias("phrase"), F.col("phrase").alias("skill"))
        return extract.assemble_lexicon(base, short)

    @cached_property
    def aliases(self) -> DataFrame:
        """Stored aliases: the part name as alias of the skill, one row per pair."""
        status = F.when(F.col("p_size") > 45, "rejected").when(F.col("p_size") > 20, "candidate").otherwise("approved")
        return self.parts.groupBy(F.col("skill").alias("canonical_skill"), F.col("p_name").alias("alias")).agg(
            F.min(status).alias("status"), F.max(F.col("p_size") / 50.0).alias("confidence"),
            F.count("*").alias("evidence_count"), F.min_by("p_type", "p_partkey").alias("first_text"))

    @cached_property
    def module_lexicon(self) -> DataFrame:
        stored = extract.dynamic_terms(self.module_entities)
        return extract.assemble_lexicon(
            extract.base_lexicon(self.spark), extract.approved_aliases(self.aliases), stored)

    @cached_property
    def job_vectors(self) -> DataFrame:
        """Vector of the advert's company; zeros where it has none."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("vec_id"))
        return vectors.with_neutral(o, self.vectors, "vec_id", 64).select("job_id", "vector", "failed")

    @cached_property
    def module_vectors(self) -> DataFrame:
        """Module vector: pooled vectors of its parts; zeros where there are none."""
        module = F.concat_ws("/", "p_brand", "p_type")
        p = self.raw("part").select("p_partkey", F.col("p_brand").alias("course_id"), module.alias("module_id"))
        chunks = p.join(self.vectors, p.p_partkey == F.col("vec_id"))
        pooled = vectors.pooled_vectors(chunks, ["module_id"])
        return vectors.with_neutral(p.select("course_id", "module_id").distinct(), pooled, "module_id", 64)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")

    @cached_property
    def adverts(self) -> DataFrame:
        """Advert text with labelled lines, one per order."""
        j = self.jobs
        line = F.lit("\n")
        date_line = F.when(F.col("contract_type") == "F", F.date_format("created_on", "d MMMM yyyy")).otherwise(
            F.date_format("created_on", "yyyy-MM-dd"))
        return j.select(
            "job_id",
            F.concat(
                F.lit("  "), F.col("title"), line,
                F.when(F.col("contract_type") == "O", F.concat(F.lit("Job Summary: "), F.col("description"), line))
                .otherwise(F.concat(F.lit("Summary"), line, F.col("description"), line)),
                F.lit("Location:"), line, line, F.col("location"), line,
                F.when(F.col("recruiter") != "", F.concat(F.lit("Agency: "), F.col("recruiter"), line)).otherwise(""),
                F.lit("Date Posted: "), date_line, line,
                F.lit("Key Responsibilities:"), line, F.lit("Handle "), F.col("category"), F.lit(" accounts"), line,
                F.lit("Qualifications "), line, F.lit(" Degree in "), F.col("category"), line,
                F.lit("Ref: "), F.col("job_reference"),
            ).alias("description"),
        )


# ---- the same model in SQL ---------------------------------------------------------------------

def _case(column: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {column} END"


def _in(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_canonical(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({c}), '-', ' '), '{text.WS}+', ' ', 'g'))"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{text.WS}+', ' ', 'g'))"


def sql_round(c: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(floor(({c}) * {scale} + 0.5) / {scale})"


def sql_entity_id(name: str) -> str:
    """SQL of the entity id of an already canonical name."""
    slug = f"regexp_replace(regexp_replace({name}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return (
        f"CASE WHEN {slug} = '' THEN 'skill-' || left(sha1({name}), 8) "
        f"WHEN {slug} <> replace({name}, ' ', '-') THEN 'skill-' || left({slug}, 63) || '-' || left(sha1({name}), 8) "
        f"ELSE 'skill-' || left({slug}, 72) END"
    )


def sql_classified(relation: str, skill: str, tokens: str, extra: str = "*", source: str = "''") -> str:
    """SQL subquery adding technical, soft, business, skill_type and tier to a relation."""
    from skillgrid.functions import constants as K

    def ov(vocabulary):
        return f"len(list_intersect(tk, {_in(vocabulary)}))"

    signs = "(ph LIKE '%#%' OR ph LIKE '%+%')"
    led = "(ph LIKE '%project management%' OR ph LIKE '%stakeholder management%' OR ph LIKE '%change management%')"
    return f"""(
      SELECT *, CASE WHEN greatest(technical, soft, business) = 0 THEN 'domain'
                     WHEN technical >= soft AND technical >= business THEN 'technical'
                     WHEN soft >= business THEN 'soft' ELSE 'business' END AS skill_type,
        CASE WHEN {ov(K.TOOL_TERMS)} > 0 OR {signs} THEN 'tool'
             WHEN {ov(K.METHOD_TERMS)} > 0 THEN 'method'
             WHEN greatest(technical, soft, business) > 0 AND soft > technical AND soft >= business THEN 'transferable'
             WHEN {source} = 'noun_chunk' THEN 'candidate'
             WHEN len(tk) >= 4 THEN 'specialized' ELSE 'capability' END AS tier
      FROM (SELECT *, {ov(K.BUSINESS_TERMS)} + CASE WHEN {led} THEN 2 ELSE 0 END
                 + CASE WHEN list_contains(tk, 'management') AND technical = 0 THEN 1 ELSE 0 END AS business
        FROM (SELECT *, {ov(K.TECHNICAL_TERMS)}
              + CASE WHEN {ov(('data', 'software', 'technical'))} > 0 THEN 2 ELSE 0 END
              + CASE WHEN {signs} THEN 2 ELSE 0 END AS technical,
              {ov(K.SOFT_TERMS)}
              + CASE WHEN ph LIKE '%problem solving%' OR ph LIKE '%critical thinking%' THEN 3 ELSE 0 END
              + CASE WHEN {led} THEN 1 ELSE 0 END
              + CASE WHEN {ov(('leadership', 'communication', 'teamwork'))} > 0 THEN 3 ELSE 0 END AS soft
          FROM (SELECT {extra}, {sql_canonical(skill)} AS ph,
                  list_distinct(list_filter(string_split({sql_canonical(tokens)}, ' '), lambda x: x <> '')) AS tk
                FROM {relation}))))"""


def _base_values() -> str:
    from skillgrid.functions import constants as K

    rows = [(k, k, 0) for k in K.KEYWORDS if k not in K.EXCLUDED_TERMS]
    for skill, phrases in K.ALIASES.items():
        rows += [(skill, skill, 1)] + [(p, skill, 1) for p in phrases]
    return ", ".join(f"('{p}', '{s}', {r})" for p, s, r in rows)


_LINE = ", ".join(LINE_ORDER)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "m_part": ((), f"""
        SELECT p_partkey, p_name, p_brand, p_type, p_size,
          {_case("split_part(p_name, ' ', 1)", FIRST_WORD)} || ' ' || {_case("split_part(p_name, ' ', 2)", SECOND_WORD)} AS skill
        FROM part"""),
    "m_skill": (("m_part",), f"""
        SELECT skill, technical, soft, business, skill_type, tier, {sql_entity_id('skill')} AS entity_id
        FROM {sql_classified('(SELECT DISTINCT skill FROM m_part)', 'skill', 'skill')}"""),
    "m_job": ((), f"""
        SELECT o_orderkey AS job_id, {_case('o_orderpriority', TITLES)} AS title, coalesce(c_name, '') AS company,
          CASE WHEN o_orderstatus = 'F' THEN '' ELSE coalesce(n_name, '') || ' Agency' END AS recruiter,
          'REF-' || o_orderkey AS job_reference, coalesce(n_name, '') AS location,
          CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Other' ELSE coalesce(c_mktsegment, '') END AS category,
          o_orderstatus AS contract_type,
          {_case('o_orderpriority', TITLES)} || ' wanted by ' || coalesce(c_name, '') || ' in ' || coalesce(n_name, '')
            || '. Budget ' || CAST(floor(o_totalprice) AS BIGINT) || ' per year.' AS description,
          'csv' AS source, 'ext-' || o_orderkey AS external_id,
          CASE WHEN o_orderstatus <> 'F' THEN CAST(floor(o_totalprice / 10) AS INT) END AS salary_min,
          CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice / 8) AS INT) END AS salary_max,
          CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS date_posted,
          CAST(o_orderdate AS DATE) + 30 AS created_on
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    "m_course": ((), """
        SELECT course_id, course_id AS code, 'MBA ' || course_id AS name,
          CASE WHEN k = 0 THEN '' ELSE 'University ' || k END AS university, 'South Africa' AS country
        FROM (SELECT DISTINCT p_brand AS course_id, CAST(split_part(p_brand, '#', 2) AS INT) % 5 AS k FROM part)"""),
    "m_module": (("m_part",), """
        SELECT p_brand || '/' || p_type AS module_id, p_brand AS course_id, p_type AS name,
          list_sort(list(DISTINCT skill)) AS skills,
          array_to_string(list_sort(list(DISTINCT skill)), '. ') || '.' AS content, DATE '1999-06-01' AS created_on
        FROM m_part GROUP BY ALL"""),
    "m_job_ent": (("m_part", "m_skill"), f"""
        SELECT l_orderkey AS job_id, m.skill,
          CASE WHEN l_linestatus = 'F' THEN m.skill ELSE p_name END AS text,
          CASE WHEN l_tax >= 0.08 THEN 'sector' ELSE 'SKILL' END AS label,
          CASE WHEN l_returnflag = 'R' THEN 'candidate' ELSE tier END AS tier, skill_type,
          CASE WHEN l_linestatus = 'F' AND l_tax = 0 THEN 'regex' WHEN l_linestatus = 'F' THEN 'ner'
               ELSE 'phrase_matcher' END AS source,
          {sql_round('1.0::DOUBLE - l_discount', 2)} AS confidence, CAST(l_quantity AS INT) AS mention_count,
          CASE l_returnflag WHEN 'A' THEN 'reviewed' WHEN 'R' THEN 'candidate' ELSE 'machine' END AS label_status,
          pos, entity_id,
          'chunk-' || left(sha1('job-' || l_orderkey || '|' || m.skill || '|' || pos * 20 || '|'
            || (pos * 20 + length(m.skill))), 16) AS chunk_id
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS pos
              FROM lineitem JOIN m_part ON l_partkey = p_partkey) m JOIN m_skill s ON m.skill = s.skill"""),
    "m_mod_ent": (("m_part", "m_skill"), f"""
        SELECT p_brand || '/' || p_type AS module_id, p_brand AS course_id, p_type AS module_name, m.skill,
          CASE WHEN p_size > 25 THEN m.skill ELSE p_name END AS text, 'SKILL' AS label, tier, skill_type,
          'ner' AS source, {sql_round('0.5::DOUBLE + p_size / 100.0::DOUBLE', 2)} AS confidence, p_size AS mention_count,
          CASE p_size % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'reviewed' ELSE 'machine' END AS label_status,
          pos, entity_id,
          'chunk-' || left(sha1('module-' || p_brand || '/' || p_type || '|' || m.skill || '|' || pos || '|None'), 16) AS chunk_id
        FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS pos FROM m_part) m
        JOIN m_skill s ON m.skill = s.skill"""),
    "m_job_skill": (("m_part",), "SELECT DISTINCT l_orderkey AS job_id, skill FROM lineitem JOIN m_part ON l_partkey = p_partkey"),
    "m_course_skill": (("m_part",), "SELECT DISTINCT p_brand AS course_id, skill FROM m_part"),
    "m_result": (("m_job_skill", "m_course_skill"), f"""
        SELECT course_id, job_id, js AS job_skills, cs AS course_skills,
          list_sort(list_intersect(js, cs)) AS matched,
          list_sort(list_filter(js, lambda x: NOT list_contains(cs, x))) AS missing,
          list_sort(list_filter(cs, lambda x: NOT list_contains(js, x))) AS extra,
          CASE WHEN len(js) = 0 OR len(cs) = 0 THEN 0.0::DOUBLE ELSE {sql_round('''least(0.96::DOUBLE,
            0.35::DOUBLE + 0.45::DOUBLE * (len(list_intersect(js, cs))::DOUBLE / len(js)::DOUBLE)
            + 0.2::DOUBLE * (len(list_intersect(js, cs))::DOUBLE
               / (len(js) + len(cs) - len(list_intersect(js, cs)))::DOUBLE))''', 2)} END AS similarity_score
        FROM (SELECT o_orderkey AS job_id, coalesce(js, []) AS js FROM orders LEFT JOIN
                (SELECT job_id, list(skill) AS js FROM m_job_skill GROUP BY 1) ON o_orderkey = job_id)
        CROSS JOIN (SELECT course_id, list(skill) AS cs FROM m_course_skill GROUP BY 1)"""),
    "m_term": ((), f"""
        SELECT phrase, len(string_split(phrase, ' ')) AS n FROM (SELECT DISTINCT {sql_squeeze('g')} AS phrase FROM
          (SELECT unnest(string_split_regex(lower(replace(text, '-', ' ')), '[^\\p{{L}}\\p{{N}}+#&/ ]')) AS g FROM benchmark))
        WHERE phrase <> '' AND len(string_split(phrase, ' ')) <= 3"""),
    "m_lexicon": (("m_term",), """
        SELECT phrase, max_by(skill, (rank, skill)) AS skill, len(string_split(phrase, ' ')) AS n FROM (
          SELECT phrase, phrase AS skill, 0 AS rank FROM m_term
          UNION ALL SELECT phrase, phrase, 2 FROM m_term WHERE n = 3
          UNION ALL SELECT split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), phrase, 2 FROM m_term WHERE n = 3)
        GROUP BY phrase"""),
    "m_alias": (("m_part",), """
        SELECT skill AS canonical_skill, p_name AS alias,
          min(CASE WHEN p_size > 45 THEN 'rejected' WHEN p_size > 20 THEN 'candidate' ELSE 'approved' END) AS status,
          max(p_size / 50.0::DOUBLE) AS confidence, count(*) AS evidence_count, min_by(p_type, p_partkey) AS first_text
        FROM m_part GROUP BY 1, 2"""),
    "m_module_lexicon": (("m_alias", "m_mod_ent"), f"""
        SELECT phrase, max_by(skill, (rank, skill)) AS skill, len(string_split(phrase, ' ')) AS n FROM (
          SELECT {sql_canonical('phrase')} AS phrase, {sql_canonical('skill')} AS skill, rank FROM (VALUES {_base_values()}) AS b(phrase, skill, rank)
          UNION ALL SELECT alias, canonical_skill, 2 FROM m_alias WHERE status = 'approved' AND alias <> canonical_skill
          UNION ALL SELECT canonical_skill, canonical_skill, 2 FROM m_alias WHERE status = 'approved' AND alias <> canonical_skill
          UNION ALL SELECT DISTINCT skill, skill, 3 FROM m_mod_ent WHERE label_status <> 'candidate')
        WHERE phrase <> '' GROUP BY phrase"""),
    "m_job_vec": ((), """
        SELECT o_orderkey AS job_id, coalesce(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda x: 0.0::DOUBLE)) AS vector,
          embedding IS NULL AS failed FROM orders LEFT JOIN embeddings ON vec_id = o_custkey"""),
    "m_mod_vec": ((), """
        WITH v AS (SELECT p_brand || '/' || p_type AS module_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
                   FROM part JOIN embeddings ON p_partkey = vec_id),
        a AS (SELECT module_id, i, avg(x::DOUBLE) AS x FROM v GROUP BY 1, 2),
        n AS (SELECT module_id, list(x ORDER BY i) AS m, sqrt(sum(x * x)) AS s FROM a GROUP BY 1)
        SELECT DISTINCT p_brand AS course_id, p_brand || '/' || p_type AS module_id,
          coalesce(list_transform(m, lambda x: CASE WHEN s > 0 THEN x / s ELSE x END), list_transform(range(64), lambda x: 0.0::DOUBLE)) AS vector
        FROM part LEFT JOIN n ON n.module_id = p_brand || '/' || p_type"""),
    "m_run": ((), """
        SELECT run_id, 'Run ' || run_id AS name, make_date(run_id, 12, 31) AS created_on, jobs FROM (
          SELECT CAST(year(o_orderdate) AS INT) AS run_id, count(*) AS jobs FROM orders GROUP BY 1
          UNION ALL SELECT CAST(max(year(o_orderdate)) + 1 AS INT), 0 FROM orders)"""),
    "m_advert": (("m_job",), """
        SELECT job_id, '  ' || title || chr(10)
          || CASE WHEN contract_type = 'O' THEN 'Job Summary: ' || description || chr(10)
                  ELSE 'Summary' || chr(10) || description || chr(10) END
          || 'Location:' || chr(10) || chr(10) || location || chr(10)
          || CASE WHEN recruiter <> '' THEN 'Agency: ' || recruiter || chr(10) ELSE '' END
          || 'Date Posted: ' || CASE WHEN contract_type = 'F' THEN strftime(created_on, '%-d %B %Y')
               ELSE strftime(created_on, '%Y-%m-%d') END || chr(10)
          || 'Key Responsibilities:' || chr(10) || 'Handle ' || category || ' accounts' || chr(10)
          || 'Qualifications ' || chr(10) || ' Degree in ' || category || chr(10)
          || 'Ref: ' || job_reference AS description
        FROM m_job"""),
}


def with_views(sql: str, needs: tuple[str, ...]) -> str:
    """Prefix a SQL text with the model views it reads."""
    ordered: list[str] = []

    def visit(name):
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return sql
    views = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name][1]})" for name in ordered)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
