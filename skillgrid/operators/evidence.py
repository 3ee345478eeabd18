"""Skill-evidence table and the reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgrid.functions import skills, text
from skillgrid.operators.review import is_active

EVIDENCE = (
    "source_type", "source_id", "source_label", "parent_label", "entity_id", "chunk_id", "skill", "label", "tier", "skill_type",
    "sector", "job_title", "extracted_date", "extracted_year", "source", "confidence", "mention_count", "text", "label_status",
    "unique_key", "pos",
)


def refined_counts(rows: DataFrame) -> DataFrame:
    """Frequencies summed per refined business label."""
    return (
        rows.withColumn("skill", skills.refined_label(F.col("skill"))).filter("skill IS NOT NULL AND skill <> ''")
        .groupBy("skill").agg(F.sum("frequency").alias("frequency"))
    )


def evidence_rows(job_entities: DataFrame, jobs: DataFrame, module_entities: DataFrame, modules: DataFrame, courses: DataFrame) -> DataFrame:
    """One row per entity of an advert or a module, with label, sector, date and a unique key.

    The sector text of an advert or module is searched once per owner, before the entities multiply it.
    """
    j = jobs.select(
        "job_id", "title", "category", F.coalesce("date_posted", "created_on").alias("extracted_date"),
        F.when(F.col("company") != "", F.concat_ws(" @ ", "title", "company")).otherwise(F.col("title")).alias("source_label"),
        F.concat_ws(" ", "title", "description", "category", "company").alias("_about"))
    jr = job_entities.join(j, "job_id").select(
        F.lit("job").alias("source_type"), F.col("job_id").cast("string").alias("source_id"), "source_label", F.lit("").alias("parent_label"),
        *_entity_columns(),
        _sector(F.col("category"), F.lit(""), F.lit("")).alias("sector"),
        F.col("title").alias("job_title"), "extracted_date", F.year("extracted_date").alias("extracted_year"),
        F.concat_ws(":", F.lit("job"), F.col("job_id").cast("string"), "entity_id").alias("unique_key"), "pos")
    m = modules.join(courses.select("course_id", "code", F.col("name").alias("course_name")), "course_id").select(
        "module_id", F.col("name").alias("source_label"), text.first_filled(F.col("code"), F.col("course_name")).alias("parent_label"),
        F.col("created_on").alias("extracted_date"),
        F.concat_ws(" ", F.col("name"), "code", "content", "code", "course_name").alias("_about"))
    mr = module_entities.select("module_id", *_ENTITY_IN, "pos").join(m, "module_id").select(
        F.lit("module").alias("source_type"), F.col("module_id").alias("source_id"), "source_label", "parent_label",
        *_entity_columns(),
        _sector(F.lit(""), F.col("parent_label"), F.lit("Course module")).alias("sector"),
        F.lit("").alias("job_title"), "extracted_date", F.year("extracted_date").alias("extracted_year"),
        F.concat_ws(":", F.lit("module"), "module_id", "entity_id").alias("unique_key"), "pos")
    return jr.unionByName(mr)


_ENTITY_IN = ("entity_id", "chunk_id", "skill", "label", "tier", "skill_type", "source", "confidence", "mention_count", "text", "label_status")


def _entity_columns() -> list[Column]:
    banned = skills.is_excluded(F.col("skill"))
    c = {n: F.col(n) for n in _ENTITY_IN}
    c["label"] = F.when(banned, "exclude").otherwise(text.first_filled(F.col("label"), F.lit("SKILL")))
    c["skill_type"] = F.when(banned, "exclude").otherwise(text.first_filled(F.col("skill_type"), F.lit("domain")))
    c["label_status"] = text.first_filled(F.col("label_status"), F.lit("machine"))
    return [v.alias(n) for n, v in c.items()]


def _sector(category: Column, parent: Column, last: Column) -> Column:
    """Explicit sector entity, then the category, then the inferred sector, then the parent, then a default."""
    explicit = F.when(F.lower("label").isin("sector", "industry"), text.first_filled(F.col("skill"), F.col("text")))
    inferred = skills.infer_sector(F.col("_about"), F.col("skill"), F.col("text"))
    return text.first_filled(skills.clean_sector(explicit), skills.clean_sector(category), inferred,
                             skills.clean_sector(parent), last, F.lit("Unclassified"))


def filter_evidence(rows: DataFrame, source=(), skill_type=(), sector=(), job_title=(), label_status=(), q: str = "") -> DataFrame:
    """Rows that are not excluded and match every given value list and the free text."""
    out = rows.filter((F.col("skill_type") != "exclude") & (F.col("label") != "exclude"))
    for name, values in (("source_type", source), ("skill_type", skill_type), ("sector", sector),
                         ("job_title", job_title), ("label_status", label_status)):
        if values:
            out = out.filter(F.col(name).isin(*values))
    if q.strip():
        fields = ("skill", "source_label", "sector", "job_title", "chunk_id", "entity_id")
        found = [F.lower(f).contains(q.strip().lower()) for f in fields]
        hit = found[0]
        for f in found[1:]:
            hit = hit | f
        out = out.filter(hit)
    return out


EVIDENCE_ORDER = ("source_type", "source_label", "source_id", "pos")


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows in evidence order: jobs before modules, then by label."""
    return rows.orderBy(*EVIDENCE_ORDER).limit(limit)


def bundle_counts(rows: DataFrame, sample: int | None = None, chart: int | None = None) -> DataFrame:
    """Counts by type and source, and the facet values. ``chart`` and ``sample`` limit what is counted and listed to the first rows in evidence order."""
    columns = [*EVIDENCE_ORDER, "skill_type", "label_status", "sector", "job_title"]
    listed = first_rows(rows, sample).select(*columns) if sample else rows.select(*columns)
    charted = listed.orderBy(*EVIDENCE_ORDER).limit(chart) if chart else listed

    def values(of, prefix, names):
        pairs = F.array(*[F.struct(F.lit(prefix + n).alias("kind"), F.col(n).alias("value")) for n in names])
        return of.select(F.explode(pairs).alias("f")).select("f.*").groupBy("kind", "value").agg(F.count("*").alias("n"))

    facets = values(listed, "facet_", ("skill_type", "label_status", "sector", "job_title")).filter("value <> ''")
    return values(charted, "", ("skill_type", "source_type")).unionByName(facets.withColumn("n", F.lit(0).cast("bigint")))


def is_counted() -> Column:
    return is_active() & ~F.col("source").eqNullSafe("regex")


def document_frequency(entities: DataFrame, owner: str) -> DataFrame:
    """Documents per active skill; regex, candidate and excluded evidence does not count.

    A document names a skill once: duplicates are removed per (owner, skill), never per skill alone.
    """
    name = skills.canonical(text.first_filled(F.col("skill"), F.col("text")))
    seen = entities.filter(is_counted()).select(owner, name.alias("skill")).filter((F.col("skill") != "") & ~skills.is_excluded(F.col("skill")))
    return seen.distinct().groupBy("skill").agg(F.count("*").alias("frequency"))


def top(counts: DataFrame, n: int, by: str = "frequency", name: str = "skill") -> DataFrame:
    return counts.orderBy(F.desc(by), name).limit(n)


def display_skills(entities: DataFrame, owner: str, limit: int = 12) -> DataFrame:
    """First distinct active skills of an owner, in entity order.

    Distinct names come before the ranking, so only the names of an owner are sorted, not its entities.
    """
    name = skills.canonical(text.first_filled(F.col("skill"), F.col("text")))
    first = entities.filter(is_active()).withColumn("_n", name).filter("_n <> ''").groupBy(owner, "_n").agg(F.min("pos").alias("_p"))
    w = W.partitionBy(owner).orderBy("_p", "_n")
    kept = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_n"))), lambda s: s["_n"])
    return kept.groupBy(owner).agg(names.alias("skills"))


def course_display_skills(module_entities: DataFrame, limit: int = 12) -> DataFrame:
    """Skills named by most modules of a course."""
    name = skills.canonical(text.first_filled(F.col("skill"), F.col("text")))
    seen = module_entities.filter(is_active()).select("course_id", "module_id", name.alias("skill")).filter("skill <> ''")
    first = seen.join(display_skills(module_entities, "module_id", 2 * limit).select(
        "module_id", F.explode("skills").alias("skill")), ["module_id", "skill"], "left_semi").distinct()
    counts = first.groupBy("course_id", "skill").agg(F.count("*").alias("n"))
    w = W.partitionBy("course_id").orderBy(F.desc("n"), "skill")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def unique_entities(entities: DataFrame, owner: str, limit: int = 10) -> DataFrame:
    """First entities of an owner with distinct ids."""
    first = entities.filter("skill <> ''").groupBy(owner, "entity_id").agg(
        F.min("pos").alias("pos"), F.min_by(F.struct("skill", "source", "confidence", "mention_count"), "pos").alias("e"))
    w = W.partitionBy(owner).orderBy("pos")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(owner, "rank", "entity_id", "e.*")


def report_rows(job_entities: DataFrame, jobs: DataFrame, module_entities: DataFrame, courses: DataFrame) -> DataFrame:
    """Evidence of the report: the sector is the category or the university; repeats are kept."""
    name = skills.canonical(text.first_filled(F.col("skill"), F.col("text")))
    j = jobs.select(
        "job_id", F.when(F.col("company") != "", F.concat_ws(" @ ", "title", "company")).otherwise(F.col("title")).alias("source_label"),
        text.first_filled(F.col("category"), F.lit("Unclassified")).alias("sector"),
        F.year(F.coalesce("date_posted", "created_on")).alias("extracted_year"))
    a = job_entities.filter(is_active()).select("job_id", name.alias("skill")).filter("skill <> ''").join(j, "job_id").select(
        "skill", F.lit("job").alias("skill_type"), F.lit("job").alias("source_type"), "sector", "extracted_year", "source_label")
    c = courses.select("course_id", text.first_filled(F.col("university"), F.lit("Course module")).alias("sector"))
    b = module_entities.filter(is_active()).select("course_id", "module_name", name.alias("skill")).filter("skill <> ''").join(c, "course_id").select(
        "skill", F.lit("course").alias("skill_type"), F.lit("module").alias("source_type"), "sector",
        F.lit(1999).alias("extracted_year"), F.col("module_name").alias("source_label"))
    return a.unionByName(b)


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """Fallback evidence: every matrix row repeated by its frequency."""
    return matrix.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.col("frequency"))))).select(
        "skill", F.regexp_replace("source", "s$", "").alias("skill_type"),
        F.when(F.col("source") == "jobs", "job").otherwise("module").alias("source_type"), F.lit("Analysis aggregate").alias("sector"))


def balanced_sample(rows: DataFrame, limit: int = 900) -> DataFrame:
    """Half jobs, half modules; the rest is filled from what remains, jobs first.

    Only the first ``limit`` rows of either side can be drawn, so each side is cut by a top-k first.
    """
    def side(name):
        # a constant-size input to the window: at most `limit` rows per side
        part = rows.filter(F.col("source_type") == name).orderBy(*EVIDENCE_ORDER).limit(limit)
        return part.withColumn("_rn", F.row_number().over(W.partitionBy("source_type").orderBy(*EVIDENCE_ORDER)))

    both = side("job").unionByName(side("module"))
    later = (F.col("_rn") > limit // 2).cast("int")
    return both.withColumn("_late", later).orderBy("_late", "source_type", "_rn").limit(limit).drop("_rn", "_late")


def status_counts(rows: DataFrame) -> DataFrame:
    status = F.col("label_status")
    return rows.agg(*[F.count_if(status == s).alias(s) for s in ("candidate", "reviewed", "legacy", "machine")], F.count("*").alias("total"))


def course_audit(modules: DataFrame, module_entities: DataFrame, context: Column) -> DataFrame:
    """Listed skills of every module next to their entity; a listed skill without entity keeps blanks.

    ``context`` is a column over content, text, skill, start and end.
    """
    listed = modules.select("course_id", "module_id", F.col("name").alias("module_name"), "content", F.explode("skills").alias("skill"))
    last = module_entities.groupBy("module_id", F.lower(F.trim("skill")).alias("_k")).agg(
        F.max_by(F.struct("entity_id", "chunk_id", "label", "source", "confidence", "skill_type", "tier", "label_status", "text"), "pos").alias("e"))
    keyed = listed.withColumn("_k", F.lower(F.trim("skill"))).filter("_k <> ''")
    joined = keyed.join(last, ["module_id", "_k"], "left").select(
        "course_id", "module_id", "module_name", "content", "skill", "e.*")
    blank = [text.text_or_empty(F.col(n)).alias(n) for n in ("entity_id", "chunk_id", "source", "skill_type", "tier", "label_status")]
    return joined.select(
        "course_id", "module_id", "module_name", "skill", *blank, text.first_filled(F.col("label"), F.lit("SKILL")).alias("label"),
        "confidence", context.alias("context"))


def candidate_queue(rows: DataFrame, limit: int = 60) -> DataFrame:
    return first_rows(rows.filter((F.col("label_status") == "candidate") & (F.col("skill_type") != "exclude") & (F.col("label") != "exclude")), limit)


def recently_reviewed(rows: DataFrame, limit: int = 24) -> DataFrame:
    """Last reviewed rows of the evidence order, last first."""
    kept = rows.filter((F.col("label_status") == "reviewed") & (F.col("skill_type") != "exclude") & (F.col("label") != "exclude"))
    return kept.orderBy(*[F.desc(c) for c in EVIDENCE_ORDER]).limit(limit)


def course_list(courses: DataFrame, university: str = "", country: str = "") -> DataFrame:
    out = courses
    if university:
        out = out.filter(F.col("university") == university)
    if country:
        out = out.filter(F.col("country") == country)
    return out.orderBy("name")


def course_facets(courses: DataFrame) -> DataFrame:
    facet = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in ("university", "country")]))
    return courses.select(facet.alias("f")).select("f.*").filter("value <> ''").distinct()
