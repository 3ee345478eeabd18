"""Outputs of a job that are written in one pass and counted from what was written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.functions import scores, text
from skillgrid.operators import analytics

# The headers of the stored files.
REFINED_COLUMNS = ("source_type", "source_id", "parent_label", "source_label", "entity_id", "chunk_id", "skill", "label", "skill_type", "tier", "source",
                   "confidence", "mention_count", "text", "start", "end", "label_status")
DASHBOARD_COLUMNS = ("visual", "run", "source", "course_id", "course", "job_id", "job", "dimension", "value", "score_percent", "matched_skills", "missing_skills", "notes")

#: Blanks and line ends around a text are kept.
WHOLE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_tagged(rows: DataFrame, path: str, tag: str) -> DataFrame:
    """Writes ``rows`` as CSV with a folder for every value of ``tag`` and returns the rows that each folder holds: (tag, rows).

    The rows are computed once, in one write; every task writes what it has of each output, so no output passes through one task, and the counts are
    read from the files. All outputs have the same columns. Text keeps its quotes and line ends, an empty one stays apart from a null one; rows with a null tag
    are under '' as those with an empty one.
    """
    tagged = rows.withColumn(tag, F.coalesce(F.col(tag).cast("string"), F.lit("")))
    tagged.write.mode("overwrite").partitionBy(tag).csv(path, header=True, escape='"', **WHOLE)
    return read_tagged(rows.sparkSession, path, rows.schema, tag).groupBy(tag).agg(F.count("*").alias("rows"))


def read_tagged(spark: SparkSession, path: str, schema: T.StructType, tag: str) -> DataFrame:
    """All outputs that ``write_tagged`` wrote, with the types of ``schema``."""
    inner = T.StructType([f for f in schema.fields if f.name != tag] + [T.StructField(tag, T.StringType())])
    # a field without quotes is read as this value and so as null; without it, "" would be null too
    back = spark.read.schema(inner).csv(path, header=True, escape='"', multiLine=True, nullValue="\u0001null", **WHOLE)
    return back.withColumn(tag, F.coalesce(tag, F.lit(""))).select(*schema.names)


def refined_rows(job_entities: DataFrame, jobs: DataFrame, module_entities: DataFrame, modules: DataFrame, courses: DataFrame) -> DataFrame:
    """One audit row per entity of an advert or a module, with the names of its owner. Entities without an owner are left out; missing values are empty."""
    own = REFINED_COLUMNS[4:]
    j = jobs.select("job_id", F.col("category").alias("parent_label"), F.when(F.col("company") != "", F.concat_ws(" @ ", "title", "company")).otherwise(F.col("title")).alias("source_label"))
    m = modules.select("module_id", "course_id", F.col("name").alias("source_label")).join(
        courses.select("course_id", text.first_filled(F.col("code"), F.col("name")).alias("parent_label")), "course_id")
    sides = [
        job_entities.select("job_id", *own).join(j, "job_id").withColumn("source_type", F.lit("job")).withColumn("source_id", F.col("job_id").cast("string")),
        module_entities.select("module_id", *own).join(m, "module_id").withColumn("source_type", F.lit("module")).withColumn("source_id", F.col("module_id").cast("string"))]
    rows = reduce(DataFrame.unionByName, [s.select(*REFINED_COLUMNS) for s in sides])
    return rows.withColumn("label", text.first_filled(F.col("label"), F.lit("SKILL"))).withColumn("label_status", text.first_filled(F.col("label_status"), F.lit("machine")))


def dashboard_visuals(run: str, results: DataFrame, matrix: DataFrame, jobs: DataFrame, courses: DataFrame, skills: int = 50, edges: int = 100) -> DataFrame:
    """Chart points of the dashboard in one long table: score buckets, the leading ``skills`` of either matrix and the best ``edges`` pairs.

    Equal scores come by course and job, equal frequencies by skill. Without results there are no buckets.
    """
    c = F.col

    def points(df, visual, notes, **values):
        blank = {n: F.lit(None).cast("double" if n in ("value", "score_percent") else "string") for n in DASHBOARD_COLUMNS}
        return df.select(*[{**blank, "visual": F.lit(visual), "run": F.lit(run), "notes": F.lit(notes), **values}[n].alias(n) for n in DASHBOARD_COLUMNS])

    buckets = points(analytics.score_buckets(results).where("average IS NOT NULL"), "score_bucket_summary", "Pairs of course and job with a score in the range",
                     source=F.lit("analysis"), dimension=c("label"), value=c("count").cast("double"))
    sides = [points(matrix.where(c("source") == s).orderBy(F.desc("frequency"), "skill").limit(skills), "skill_demand_vs_curriculum", "Documents of the side with the skill",
                    source=c("source"), dimension=c("skill"), value=c("frequency").cast("double")) for s in ("jobs", "courses")]
    best = analytics.named_results(analytics.top_results(results, edges), jobs, courses)
    links = points(best, "course_to_job_network_edge", "Edge of the similarity network",
                   source=F.lit("similarity"), course_id=c("course_id"), course=c("course_name"), job_id=c("job_id").cast("string"), job=c("job"), dimension=F.lit("cosine_similarity"),
                   value=c("similarity_score"), score_percent=scores.percent(c("similarity_score")), matched_skills=F.array_join("matched", "; "), missing_skills=F.array_join("missing", "; "))
    return reduce(DataFrame.unionByName, [buckets, *sides, links])


def verification_records(modules: DataFrame, jobs: DataFrame, health: DataFrame) -> DataFrame:
    """The rows of a verification report: (section, record, skill_count, text_chars, warnings, sample, value, flagged).

    ``modules`` and ``jobs`` are suspicious records (``verify.suspicious``) with their id as ``record``, ``health`` is that of the skill matrices. Of a matrix, ``skill_count`` is the number
    of its skills and ``value`` the frequency of the leading ones.
    """
    c = F.col
    records = [df.select(F.lit(name).alias("section"), c("record").cast("string").alias("record"), c("skill_count").cast("long").alias("skill_count"), c("text_chars").cast("long").alias("text_chars"),
                         F.array_join("warnings", " | ").alias("warnings"), c("text_sample").alias("sample"), F.lit(None).cast("long").alias("value"), F.lit(True).alias("flagged"))
               for name, df in (("modules", modules), ("jobs", jobs))]
    blank = F.lit(None).cast("string")
    sides = health.select(F.lit("skill_matrix").alias("section"), c("source").alias("record"), c("unique_skills").alias("skill_count"), F.lit(None).cast("long").alias("text_chars"),
                          blank.alias("warnings"), blank.alias("sample"), c("top_frequency").cast("long").alias("value"), "flagged")
    return records[0].unionByName(records[1]).unionByName(sides)
