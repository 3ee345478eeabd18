"""Merges into stored tables and exported files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions import skills, text

ENTITY_COLUMNS = (
    "chunk_id", "entity_id", "skill", "label", "tier", "skill_type", "source_type", "source_id", "source_label", "parent_label", "sector",
    "job_title", "extracted_date", "extracted_year", "source", "confidence", "mention_count", "pattern", "pos_signature", "text", "start", "end",
    "label_status", "unique_key",
)


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows plus the first incoming row of every new key."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti").select(stored.columns))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Full snapshot after an upsert: the last incoming row of a key replaces the stored one; ``change`` tells which."""
    values = [c for c in stored.columns if c not in keys]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("n"))
    m = stored.select(*keys, F.struct(*values).alias("o")).join(last, keys, "full")
    change = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNotNull(), "updated").otherwise("kept")
    return m.select(*keys, F.coalesce("n", "o").alias("v"), change.alias("change")).select(*keys, "v.*", "change")


def with_external_id(rows: DataFrame, index: Column) -> DataFrame:
    """Rows without an external id get one from their number in the file."""
    return rows.withColumn("external_id", text.first_filled(F.col("external_id"), F.format_string("notebook-%06d", index)))


def all_present(seed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: is every seed key stored already?"""
    keys = seed.select(key).distinct()
    have = keys.join(stored.select(key).distinct().withColumn("here", F.lit(1)), key, "left")
    return have.agg((F.count("*") == F.count("here")).alias("present"))


def delete_loaded(stored: DataFrame, source: str, prefix: str) -> DataFrame:
    return stored.filter(~((F.col("source") == source) & F.coalesce(F.col("external_id").startswith(prefix), F.lit(False))))


def entity_export(evidence: DataFrame) -> DataFrame:
    have = set(evidence.columns)
    return evidence.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ENTITY_COLUMNS])


def advert_export(jobs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adverts with their distinct skills and entity ids as text."""
    per = entities.groupBy("job_id").agg(
        F.array_sort(F.collect_set(F.nullif("skill", F.lit("")))).alias("s"), F.array_sort(F.collect_set(F.nullif("entity_id", F.lit("")))).alias("i"))
    none = F.array().cast("array<string>")
    j = jobs.join(per, "job_id", "left")
    return j.select("job_id", "title", "company", "location", "category", "source", text.text_or_empty(F.col("date_posted")).alias("date_posted"),
                    F.size(F.coalesce("i", none)).alias("skill_count"), F.array_join(F.coalesce("s", none), "; ").alias("skills"),
                    F.array_join(F.coalesce("i", none), "; ").alias("skill_entity_ids"))


def visual(df: DataFrame, name: str, *dimensions, value, notes: str = "") -> DataFrame:
    """One tagged long-format row per chart point."""
    dims = [F.coalesce(d.cast("string"), F.lit("")).alias(f"dimension_{i + 1}") for i, d in enumerate(dimensions)]
    dims += [F.lit("").alias(f"dimension_{i + 1}") for i in range(len(dimensions), 3)]
    return df.select(F.lit(name).alias("visual"), *dims, value.cast("double").alias("value"), F.lit(notes).alias("notes"))


def evidence_visuals(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """All chart points of the evidence page: counts (one pass) and association edges."""
    c = F.col
    names = F.create_map(*[F.lit(v) for pair in (
        ("skill", "top_skill_evidence"), ("skill_type", "skill_type_donut"), ("source_type", "source_bar"), ("source_by_type", "skill_heatmap"),
        ("skill_by_year", "skill_forecast")) for v in pair])
    first = F.coalesce(F.when(c("chart") == "source_by_type", c("source_type")), c("skill"), c("skill_type"), c("source_type"))
    second = F.when(c("chart") == "source_by_type", c("skill_type")).otherwise(c("extracted_year").cast("string"))
    points = counts.select(F.element_at(names, c("chart")).alias("visual"), text.text_or_empty(first).alias("dimension_1"), text.text_or_empty(second).alias("dimension_2"),
                           F.lit("").alias("dimension_3"), c("n").cast("double").alias("value"))
    links = edges.select(F.lit("semantic_skill_cluster").alias("visual"), c("left").alias("dimension_1"), c("right").alias("dimension_2"),
                         F.lit("association_score").alias("dimension_3"), c("score").alias("value"))
    return points.unionByName(links)


def refined_summary(rows: DataFrame) -> DataFrame:
    """Three sections of counts: source type, skill type, skill."""
    parts = [rows.filter(F.col(c) != "").groupBy(F.lit(c).alias("section"), F.col(c).alias("label")).agg(F.count("*").alias("count"))
             for c in ("source_type", "skill_type", "skill")]
    return reduce(DataFrame.unionByName, parts)


def advert_blocks(jobs: DataFrame, names: DataFrame, most: int = 40, width: int = 1200) -> DataFrame:
    """One text block per advert from a fixed template, with at most ``most`` skills."""
    c = F.col

    def known(name):
        return text.first_filled(text.strip_tags(c(name)), F.lit("Unknown"))

    j = jobs.join(names, "job_id", "left").withColumn("_s", F.slice(F.coalesce("skills", F.array().cast("array<string>")), 1, most))
    listed = F.when(F.size("_s") > 0, F.array_join(F.transform("_s", lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise("- Unknown")
    day = text.first_filled(c("date_posted").cast("string"), F.lit("Unknown"))
    lines = [
        F.concat(F.lit("## JOB "), c("job_id").cast("string")), F.lit(""),
        *[F.concat(F.lit(k + ": "), v) for k, v in (
            ("Title", text.strip_tags(c("title"))), ("Company", known("company")), ("Recruiter", known("recruiter")), ("Location", known("location")),
            ("Category", known("category")), ("Contract", F.concat(known("contract_type"), F.lit(" / Unknown"))),
            ("Salary", text.salary_text(c("salary_min"), c("salary_max"))), ("Source", text.strip_tags(c("source"))), ("Date posted", day),
            ("Date stored", c("created_on").cast("string")))],
        F.lit(""), F.lit("Description evidence:"), text.first_filled(text.compact_text(text.strip_tags(c("description")), width), F.lit("Unknown")),
        F.lit(""), F.lit("Existing extracted skills:"), listed, F.lit("")]
    return j.select("job_id", F.concat_ws("\n", *lines).alias("block"))


def embedded_export(jobs: DataFrame, names: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adverts with lexicon skills, vector and cleaned payload, ready for a JSON sink."""
    tools = ("excel", "power bi", "python", "salesforce", "sql", "tableau")
    soft = ("communication", "leadership", "negotiation", "presentation", "problem solving", "stakeholder management")
    j = jobs.filter((F.col("title") != "") & (F.col("description") != "")).join(names, "job_id").join(vectors.select("job_id", "vector"), "job_id")

    def among(terms):
        return F.array_intersect("skills", skills.literal_array(terms))

    return j.select("external_id", "title", "company", "location", "category", "description", F.col("skills").alias("skills_extracted"), "vector",
                    F.struct(F.col("skills").alias("required_skills"), among(tools).alias("tools"), among(soft).alias("soft_skills"),
                             F.col("category").alias("sector"), F.col("title").alias("clean_title")).alias("cleaned_payload"))


def verification_report(summary: dict[str, DataFrame]) -> DataFrame:
    """Sections of the verification report as JSON rows: (section, body)."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("body")) for name, df in summary.items()])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
