"""Checks on stored skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions import skills, text


def warnings_of(body: Column, names: Column, min_chars: int = 260, few: int = 1) -> Column:
    """Heuristic warnings on a text and its listed skills."""
    n = F.size(names)
    thin = F.when((F.length(text.text_or_empty(body)) >= min_chars) & (n <= few), F.concat(
        F.lit("Long text has only "), n.cast("string"), F.lit(" extracted skill(s); expected more evidence for the skill matrix.")))
    none = F.when(n == 0, "No extracted skills stored.")
    twice = F.when(F.size(F.array_distinct(names)) != n, "Duplicate skill labels found after normalization.")
    return F.filter(F.array(thin, none, twice), lambda w: w.isNotNull())


def suspicious(docs: DataFrame, order: list, limit: int | None = None, min_chars: int = 260, few: int = 1) -> DataFrame:
    """Records with warnings: adds skill_count, warnings and a text sample. ``docs``: text, skills and ids."""
    out = (
        docs.filter(F.col("text") != "").withColumn("warnings", warnings_of(F.col("text"), F.col("skills"), min_chars, few))
        .filter(F.size("warnings") > 0).withColumn("text_chars", F.length("text"))
        .withColumn("skill_count", F.size("skills")).withColumn("text_sample", text.compact_text(F.col("text"), 1800))
    )
    return out.orderBy(*order).limit(limit) if limit else out


def matrix_health(matrix: DataFrame, runs: DataFrame, top_n: int = 20) -> DataFrame:
    """Per side of the latest run with a matrix: distinct skills, frequency of the leading skills, flag."""
    latest = runs.join(matrix.select("run_id").distinct(), "run_id", "left_semi").agg(
        F.max_by("run_id", F.struct("created_on", "run_id")).alias("run_id"))
    rows = matrix.join(F.broadcast(latest), "run_id", "left_semi")
    sides = []
    for side in ("jobs", "courses"):
        own = rows.filter(F.col("source") == side)
        lead = own.orderBy(F.desc("frequency"), "skill").limit(top_n).agg(
            F.sum("frequency").alias("top_frequency"), F.lit(1).alias("k"))
        sides.append(own.agg(F.count("*").alias("unique_skills"), F.lit(1).alias("k")).join(lead, "k").select(
            F.lit(side).alias("source"), "unique_skills", F.coalesce("top_frequency", F.lit(0)).alias("top_frequency"),
            (F.col("unique_skills") <= 1).alias("flagged")))
    return sides[0].unionByName(sides[1])


def skill_names(c: Column) -> Column:
    """Skills of a verifier answer, a JSON list or typed text."""
    given = F.when(c.rlike(r"^\s*\["), F.from_json(c, "array<string>")).otherwise(F.split(c, r"[,;\n]"))
    names = F.transform(F.coalesce(given, F.array().cast("array<string>")), skills.canonical_loose)
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def _first(names: Column, most: int | None) -> Column:
    return F.slice(names, 1, most) if most else names


def normalised_response(answer: Column, most: int | None = None) -> Column:
    """STRUCT<status, suspicious, suggested_skills, false_positive_stored_skills, notes> of a verifier answer (JSON)."""
    p = F.from_json(answer, "status string, suspicious boolean, suggested_skills string, false_positive_stored_skills string, notes string")
    suggested, wrong = skill_names(p["suggested_skills"]), skill_names(p["false_positive_stored_skills"])
    given = F.lower(text.text_or_empty(p["status"]))
    status = F.when(given.isin("ok", "needs_review"), given).when((F.size(suggested) > 0) | (F.size(wrong) > 0), "needs_review").otherwise("ok")
    return F.struct(
        status.alias("status"), F.coalesce(p["suspicious"], status == "needs_review").alias("suspicious"),
        _first(suggested, most).alias("suggested_skills"), _first(wrong, most).alias("false_positive_stored_skills"),
        text.compact_text(p["notes"], 700).alias("notes"))
