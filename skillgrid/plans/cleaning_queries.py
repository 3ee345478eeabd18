"""Advert cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.functions import text
from skillgrid.operators import cleaning
from skillgrid.plans import binding as B
from skillgrid.plans.registry import query

NORM = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _norm(c: str) -> str:
    return NORM.format(c=c)


@query("B1_normalise_text", f"SELECT doc_id, {_norm('text')} AS normalised FROM documents")
def normalise_text(t):
    return t.documents.select("doc_id", text.normalise_text(F.col("text")).alias("normalised"))


FP_SQL = "sha256(" + " || '|' || ".join(
    [_norm(c) for c in ("title", "company", "recruiter", "location", "job_reference")]
    + [_norm("description")]) + ")"


@query("B2_advert_fingerprint", f"SELECT job_id, {FP_SQL} AS fingerprint FROM m_job", ("m_job",))
def advert_fingerprint(t):
    c = F.col
    return t.jobs.select("job_id", text.fingerprint(
        c("title"), c("company"), c("recruiter"), c("location"), c("job_reference"), c("description")).alias("fingerprint"))


@query("B3_deduplicate_documents", f"""
    WITH d AS (SELECT doc_id, source, sha256({_norm('text')}) AS fingerprint FROM documents)
    SELECT min(doc_id) AS doc_id, fingerprint FROM d GROUP BY fingerprint""")
def deduplicate_documents(t):
    fp = F.sha2(text.normalise_text(F.col("text")), 256)
    docs = t.documents.select(F.col("doc_id").alias("job_id"), "source", F.lit("").alias("external_id"), fp.alias("fingerprint"))
    return cleaning.unique_adverts(docs).select(F.col("job_id").alias("doc_id"), "fingerprint")


def _like_label(labels) -> str:
    return " OR ".join(f"k = '{l}' OR starts_with(k, '{l} ')" for l in labels)


LINES_SQL = f"""lines AS (SELECT job_id, generate_subscripts(ls, 1) AS i, trim(unnest(ls), E' \\t\\r') AS l
      FROM (SELECT job_id, string_split(description, chr(10)) AS ls FROM m_advert)),
    keyed AS (SELECT *, {_norm('l')} AS k FROM lines)"""


@query("B4_advert_sections", f"""
    WITH {LINES_SQL},
    labelled AS (SELECT *, CASE WHEN {_like_label(K.SECTION_LABELS['summary'])} THEN 'summary'
        WHEN {_like_label(K.SECTION_LABELS['position_info'])} THEN 'position_info' END AS own FROM keyed),
    state AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY i) AS s,
        trim(regexp_replace(l, '^[A-Za-z /&+-]+:\\s*', '')) AS rest FROM labelled),
    kept AS (SELECT job_id, i, s, CASE WHEN own IS NULL THEN l WHEN rest <> '' AND lower(rest) <> lower(l) THEN rest ELSE '' END AS v FROM state)
    SELECT a.job_id, coalesce(string_agg(v, chr(10) ORDER BY i) FILTER (s = 'summary' AND v <> ''), '') AS summary,
      coalesce(string_agg(v, chr(10) ORDER BY i) FILTER (s = 'position_info' AND v <> ''), '') AS position_info
    FROM m_advert a LEFT JOIN kept USING (job_id) GROUP BY a.job_id""", ("m_advert",))
def advert_sections(t):
    return cleaning.advert_sections(t.adverts).select("job_id", *K.SECTION_LABELS)


@query("B5_advert_metadata", f"""
    WITH {LINES_SQL},
    ahead AS (SELECT *, first_value(nullif(l, '') IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY i
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM keyed),
    vals AS (SELECT *, coalesce(nullif(CASE WHEN contains(l, ':') THEN trim(substr(l, strpos(l, ':') + 1)) ELSE '' END, ''), nxt) AS v FROM ahead)
    SELECT job_id, """ + ", ".join(
        f"coalesce(left(max_by(v, i) FILTER (v IS NOT NULL AND ({_like_label(ls)})), 255), '') AS {f}"
        for f, ls in K.METADATA_LABELS.items()) + " FROM vals GROUP BY job_id", ("m_advert",))
def advert_metadata(t):
    return cleaning.advert_metadata(t.adverts, prefix="").select("job_id", *K.METADATA_LABELS)


@query("B6_parse_dates", """
    SELECT job_id, date_text, CASE WHEN contract_type = 'F' THEN created_on WHEN contract_type = 'O' THEN date_posted
        WHEN job_id % 3 = 0 THEN created_on ELSE NULL END AS parsed
    FROM (SELECT *, CASE WHEN contract_type = 'F' THEN CASE job_id % 3 WHEN 0 THEN strftime(created_on, '%A, %B %-d, %Y')
              WHEN 1 THEN strftime(created_on, '%B %-d, %Y') ELSE strftime(created_on, '%-d %B %Y') END
            WHEN contract_type = 'O' THEN strftime(date_posted, '%Y-%m-%d') || CASE WHEN job_id % 2 = 0 THEN 'T00:00:00Z' ELSE '' END
            ELSE CASE job_id % 3 WHEN 0 THEN strftime(created_on, '%Y%m%d') WHEN 1 THEN 'soon' ELSE '' END END AS date_text FROM m_job)""",
    ("m_job",))
def parse_dates(t):
    j, k = t.jobs, F.col("job_id") % 3
    day = F.col("created_on")
    written = (
        F.when(F.col("contract_type") == "F",
               F.when(k == 0, F.concat(F.date_format(day, "EEEE"), F.lit(", "), F.date_format(day, "MMMM d, yyyy")))
               .when(k == 1, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "d MMMM yyyy")))
        .when(F.col("contract_type") == "O", F.concat(
            F.date_format("date_posted", "yyyy-MM-dd"), F.when(F.col("job_id") % 2 == 0, "T00:00:00Z").otherwise("")))
        .otherwise(F.when(k == 0, F.date_format(day, "yyyyMMdd")).when(k == 1, "soon").otherwise("")))
    return j.select("job_id", written.alias("date_text")).withColumn("parsed", text.parse_date(F.col("date_text")))


@query("B7_lenient_numbers", """
    SELECT l_orderkey AS job_id, l_partkey AS part_id, l_linenumber AS line, l_suppkey AS supplier, l_shipdate AS shipped,
      CAST(trunc(l_extendedprice) AS BIGINT) AS whole,
      CASE l_returnflag WHEN 'R' THEN NULL ELSE l_extendedprice END AS real FROM lineitem""")
def lenient_numbers(t):
    l = t.raw("lineitem")
    money = F.format_string("%,.2f", "l_extendedprice")
    other = F.when(F.col("l_returnflag") == "R", F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.format_string("%.2f", "l_extendedprice")))
    return l.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("shipped"),
        text.lenient_int(money).alias("whole"), text.lenient_double(other).alias("real"))


@query("B8_fallback_chains", """
    SELECT job_id, CASE WHEN recruiter <> '' THEN recruiter ELSE company END AS recruiter,
      CASE WHEN category IN ('', 'Other') THEN location ELSE category END AS place FROM m_job""", ("m_job",))
def fallback_chains(t):
    j = cleaning.advert_metadata(t.adverts).join(t.jobs.drop("description"), "job_id")
    return j.select("job_id", text.first_filled(F.col("recruiter"), F.col("meta_recruiter"), F.col("company")).alias("recruiter"),
                    text.first_filled(F.nullif("category", F.lit("Other")), F.col("meta_location")).alias("place"))


@query("B9_analysis_text", """
    SELECT job_id, array_to_string(list_filter([title, company, recruiter, category, description], lambda x: x <> ''),
      chr(10) || chr(10)) AS analysis_text FROM m_job""", ("m_job",))
def analysis_text(t):
    j = t.jobs.withColumn("summary", F.lit("")).withColumn("position_info", F.lit(None).cast("string"))
    return j.select("job_id", cleaning.analysis_text(j).alias("analysis_text"))


@query("B10_save_defaults", f"""
    SELECT job_id, CASE WHEN contract_type = 'F' THEN 'kept' ELSE description END AS raw_description,
      CASE WHEN contract_type = 'O' THEN 'given' ELSE {FP_SQL} END AS fingerprint, contract_type <> 'P' AS stamped FROM m_job""", ("m_job",))
def save_defaults(t):
    kind = F.col("contract_type")
    j = (
        t.jobs.withColumn("raw_description", F.when(kind == "F", "kept").otherwise(""))
        .withColumn("cleaned_payload", F.when(kind != "P", F.lit("{}")))
        .withColumn("cleaned_at", F.lit(None).cast("timestamp"))
        .withColumn("fingerprint", F.when(kind == "O", "given").otherwise(""))
    )
    return cleaning.with_save_defaults(j).select(
        "job_id", "raw_description", "fingerprint", F.col("cleaned_at").isNotNull().alias("stamped"))


def _payload(t):
    """Cleaning answers for every advert, as JSON text: lists come as text or as JSON lists."""
    lines = t.raw("lineitem").join(t.parts, F.col("l_partkey") == F.col("p_partkey"))
    wanted = lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.array_join(F.array_sort(F.collect_list("skill")), "; ").alias("req"),
        F.array_sort(F.collect_list(F.initcap("p_name"))).alias("pref"))
    body = F.struct(
        F.concat(F.lit("  "), F.upper("title"), F.lit("  ")).alias("clean_title"),
        F.col("category").alias("sector"), F.col("req").alias("required_skills"),
        F.to_json("pref").alias("preferred_skills"),
        F.format_string("%,d", "salary_min").alias("salary_min"),
        F.when(F.col("contract_type") == "O", "unknown").alias("salary_max"))
    return t.jobs.join(wanted, "job_id").select("job_id", F.to_json(body).alias("payload_json"))


PAYLOAD_SQL = """lines AS (SELECT l_orderkey AS job_id, skill, p_name FROM lineitem JOIN m_part ON l_partkey = p_partkey),
    pay AS (SELECT job_id, array_to_string(list_sort(list(DISTINCT skill)), ', ') AS required_skills,
       array_to_string(list_sort(list(DISTINCT upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' '
         || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2))), ', ') AS preferred_skills
       FROM lines GROUP BY 1)"""


@query("B11_cleaned_payload", f"""
    WITH {PAYLOAD_SQL}
    SELECT job_id, upper(title) AS clean_title, category AS sector, '' AS seniority, required_skills, preferred_skills,
      CAST(salary_min AS BIGINT) AS salary_min, CAST(NULL AS BIGINT) AS salary_max
    FROM pay JOIN m_job USING (job_id)""", ("m_job", "m_part"))
def cleaned_payload(t):
    p = _payload(t).withColumn("p", cleaning.cleaned_payload(F.col("payload_json")))
    return p.select("job_id", "p.clean_title", "p.sector", "p.seniority",
                    F.array_join("p.required_skills", ", ").alias("required_skills"),
                    F.array_join("p.preferred_skills", ", ").alias("preferred_skills"), "p.salary_min", "p.salary_max")


@query("B12_clamp_text", """
    SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE
      rtrim(left(text, 2800), E' \\n\\t\\r') || chr(10) || chr(10) || '[... ' || (length(text) - 4000)
      || ' characters omitted to stay inside the model context window ...]' || chr(10) || chr(10)
      || ltrim(right(text, 1200), E' \\n\\t\\r') END AS clamped FROM documents""")
def clamp_text(t):
    return t.documents.select("doc_id", text.clamp_text(F.col("text"), 4000).alias("clamped"))


@query("B13_compact_text", f"""
    SELECT doc_id, CASE WHEN length(flat) <= 900 THEN flat
      ELSE trim(regexp_replace(left(flat, 900), ' [^ ]*$', '')) || '...' END AS compact
    FROM (SELECT doc_id, {B.sql_squeeze('text')} AS flat FROM documents)""")
def compact_text(t):
    return t.documents.select("doc_id", text.compact_text(F.col("text"), 900).alias("compact"))


@query("B14_strip_tags", f"""
    SELECT page_id, {B.sql_squeeze("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS plain FROM pages""")
def strip_tags(t):
    return t.raw("pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query("B15_salary_text", """
    SELECT job_id, CASE WHEN coalesce(salary_min, 0) <> 0 AND coalesce(salary_max, 0) <> 0 THEN salary_min || '-' || salary_max
      WHEN coalesce(salary_min, 0) <> 0 THEN 'from ' || salary_min WHEN coalesce(salary_max, 0) <> 0 THEN 'up to ' || salary_max
      ELSE 'Unknown' END AS salary FROM m_job""", ("m_job",))
def salary_text(t):
    return t.jobs.select("job_id", text.salary_text(F.col("salary_min"), F.col("salary_max")).alias("salary"))


@query("B16_typed_skill_list", """
    WITH typed AS (SELECT module_id, list(text ORDER BY pos) AS ts FROM m_mod_ent GROUP BY 1),
    u AS (SELECT module_id, unnest(ts) AS s, generate_subscripts(ts, 1) AS i FROM typed),
    f AS (SELECT module_id, s, min(i) AS i FROM u GROUP BY 1, 2)
    SELECT module_id, string_agg(s, '|' ORDER BY i) AS skills FROM f GROUP BY 1""", ("m_mod_ent",))
def typed_skill_list(t):
    from skillgrid.functions import skills
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    joined = F.array_join(F.transform(ordered, lambda e: F.concat(
        F.when(e["pos"] % 2 == 0, "; ").otherwise(" ,"), F.upper(F.replace(e["text"], F.lit(" "), F.lit("-"))))), "")
    typed = t.module_entities.groupBy("module_id").agg(joined.alias("typed"))
    return typed.select("module_id", F.array_join(text.typed_list(F.col("typed"), skills.canonical), "|").alias("skills"))


@query("B17_merge_content", """
    SELECT module_id, CASE WHEN name = 'PROMO' THEN content ELSE name || chr(10) || chr(10) || content END AS merged FROM m_module""", ("m_module",))
def merge_content(t):
    pasted = F.when(F.col("name") == "PROMO", "  ").otherwise(F.concat(F.lit(" "), F.col("name")))
    return t.modules.select("module_id", text.merge_content(pasted, F.concat(F.col("content"), F.lit("\n"))).alias("merged"))


@query("B18_lift_payload", f"""
    WITH {PAYLOAD_SQL}
    SELECT job_id, upper(title) || chr(10) || chr(10) || company
      || CASE WHEN recruiter <> '' THEN chr(10) || chr(10) || recruiter ELSE '' END
      || CASE WHEN category <> '' THEN chr(10) || chr(10) || category ELSE '' END
      || chr(10) || chr(10) || description || chr(10) || chr(10) || replace(required_skills, ', ', ' ') || ' ' || replace(preferred_skills, ', ', ' ')
      || chr(10) || replace(required_skills, ', ', ' ') || ' ' || replace(preferred_skills, ', ', ' ') AS skill_text
    FROM pay JOIN m_job USING (job_id) WHERE contract_type <> 'F'""", ("m_job", "m_part"))
def lift_payload(t):
    jobs = t.jobs.withColumn("summary", F.lit("")).withColumn("position_info", F.lit("")).withColumn(
        "cleaned_payload", F.when(F.col("contract_type") == "F", F.lit("{}")))
    return cleaning.lift_payload(jobs, _payload(t)).select("job_id", "skill_text")
