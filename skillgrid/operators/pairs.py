"""Course x job pairs, skill gap and ensemble score."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skillgrid.functions import constants as K
from skillgrid.functions import scores
from skillgrid.session import shuffle_width


def pair_up(courses: DataFrame, jobs: DataFrame, job_key: str = "job_id", copies: int | None = None) -> DataFrame:
    """Every course next to every job of a run.

    The result holds |courses| x |jobs| rows by definition. Courses are copied once per slot and
    met by an equi-join on the slot, so each task sees one share of the jobs whatever the size of
    either side; a small course table is broadcast by Spark itself, after measuring it. With ``copies`` a
    slot's jobs stay together, so that results split by slot are written as whole files.
    """
    n = copies or shuffle_width(courses.sparkSession)
    spread = F.pmod(F.xxhash64(job_key), F.lit(n)).cast("int")
    slots = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # one row becomes |courses| rows here: spread the jobs over all tasks before, however small they are
    keys = ["_slot"] if copies else [job_key, "_slot"]
    even = jobs.withColumn("_slot", spread).repartition(n, *keys)
    return even.join(courses.withColumn("_slot", slots), "_slot").drop("_slot")


def gap_columns(course: Column, job: Column) -> list[Column]:
    """Matched, missing and extra skills of two sorted lists of distinct names.

    Each operation hashes its second list, so the short one stands there: a job's skills for the matched ones, the matched ones for what is left of either side. The
    lists are in the same order, so the result is in order whichever comes first.
    """
    matched = F.array_intersect(course, job)
    return [
        matched.alias("matched"),
        F.array_except(job, matched).alias("missing"),
        F.array_except(course, matched).alias("extra"),
    ]


def in_order(df: DataFrame, skills: str) -> DataFrame:
    """Sorted distinct skills, once per owner and not once per pair."""
    return df.withColumn(skills, F.sort_array(F.array_distinct(skills)))


def gap(courses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Matched, missing and extra skills of every pair of (course_id, course_skills) and (job_id, job_skills)."""
    both = pair_up(in_order(courses, "course_skills"), in_order(jobs, "job_skills"))
    return both.select("course_id", "job_id", "course_skills", "job_skills",
                       *gap_columns(F.col("course_skills"), F.col("job_skills")))


def overlap_results(courses: DataFrame, jobs: DataFrame) -> DataFrame:
    pairs = gap(courses, jobs)
    return pairs.withColumn("similarity_score", scores.overlap_score(
        F.size("matched"), F.size("course_skills"), F.size("job_skills")))


def max_confidence(entities: DataFrame, owner: str) -> DataFrame:
    """Largest confidence per owner and lower-cased skill; unusable values count as 0."""
    sure = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    return (
        entities.withColumn("skill", F.lower(F.trim("skill"))).filter(F.col("skill") != "")
        .groupBy(owner, "skill").agg(F.max(F.greatest(F.lit(0.0), sure)).alias("confidence"))
    )


def matched_confidence(course_conf: DataFrame, job_conf: DataFrame) -> DataFrame:
    """Mean of (course + job) / 2 over the matched skills of a pair, skills without any confidence left out.

    Only pairs that share a skill appear; all others have confidence 0. The skill join is skewed by
    popular skills: the course side is a catalogue, so Spark broadcasts it when small, and AQE splits
    hot skills otherwise. Sums are pre-aggregated before the shuffle on the pair.
    """
    c = course_conf.withColumnRenamed("confidence", "course_conf")
    j = job_conf.withColumnRenamed("confidence", "job_conf")
    both = F.col("course_conf") + F.col("job_conf")
    usable = (F.col("course_conf") != 0) | (F.col("job_conf") != 0)
    return (
        j.join(c, "skill").groupBy("course_id", "job_id")
        .agg(F.avg(F.when(usable, both / 2)).alias("mean_conf"))
        .select("course_id", "job_id", F.coalesce("mean_conf", F.lit(0.0)).alias("confidence_score"))
    )


def confidence_array(conf: DataFrame, owner: str, name: str) -> DataFrame:
    """One map skill -> confidence per owner; a job or course has a bounded number of distinct skills."""
    return conf.groupBy(owner).agg(F.map_from_entries(F.collect_list(F.struct("skill", "confidence"))).alias(name))


def block_count(rows: DataFrame, per_block: int = 20_000) -> int:
    """Blocks that keep one block near ``per_block`` rows (a parquet count reads only footers)."""
    return max(1, math.ceil(rows.count() / per_block))


def numbered(courses: DataFrame) -> DataFrame:
    """The different courses with a place from 0 on, by id; a catalogue, not a table that grows with the jobs."""
    ids = courses.select("course_id").distinct()
    return ids.withColumn("place", F.row_number().over(W.orderBy("course_id")) - 1)


def semantic_rows(modules: DataFrame, jobs: DataFrame, places: DataFrame, top: int = K.TOP_MODULES,
                  job_blocks: int | None = None, module_blocks: int | None = None) -> DataFrame:
    """(job_id, semantic): one row per job with the mean of the best ``top`` module similarities of every course, by the course's place.

    ``modules``: course_id, module_id, vector; ``jobs``: job_id, vector. Both sides are hashed into
    blocks of bounded size, every job block meets every module block in one task as a matrix product,
    and the best values of a course split over several module blocks are merged afterwards. No group
    grows with the data, whatever the size of a course. Courses without modules have null.
    """
    jb = job_blocks or max(shuffle_width(jobs.sparkSession), block_count(jobs))
    mb = module_blocks or block_count(modules)
    out = T.StructType([T.StructField("job_id", jobs.schema["job_id"].dataType), T.StructField("best", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def unit(column):
        m = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def score(job_part: pa.Table, module_part: pa.Table) -> pa.Table:
        empty = pa.table({"job_id": job_part["job_id"].slice(0, 0), "best": pa.array([], pa.list_(pa.list_(pa.float64())))})
        if not job_part.num_rows or not module_part.num_rows:
            return empty
        module_part = module_part.sort_by("place")
        matrix = unit(module_part["vector"]).T
        places, starts, counts = np.unique(module_part["place"].to_numpy(), return_index=True, return_counts=True)
        width = np.zeros(int(places[-1]) + 1, np.int64)
        width[places] = np.minimum(counts, top)
        parts = []
        for at in range(0, job_part.num_rows, 2048):
            piece = job_part.slice(at, 2048)
            sims = np.clip(unit(piece["vector"]) @ matrix, 0.0, 1.0)
            best = [-np.sort(-sims[:, lo:lo + n], axis=1)[:, :top] for lo, n in zip(starts, counts)]
            flat = pa.array(np.concatenate(best, axis=1).ravel())
            inner = np.concatenate([[0], np.cumsum(np.tile(width, len(sims)))]).astype(np.int32)
            outer = (np.arange(len(sims) + 1) * len(width)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), flat))
            parts.append(pa.table({"job_id": piece["job_id"], "best": lists}))
        return pa.concat_tables(parts)

    def slot(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = jobs.select("job_id", "vector", slot("job_id", jb).alias("js"), every(mb).alias("ms"))
    right = modules.join(places, "course_id").select("place", "vector", slot("module_id", mb).alias("ms"), every(jb).alias("js"))
    best = left.groupBy("js", "ms").cogroup(right.groupBy("js", "ms")).applyInArrow(score, schema=out)
    if mb > 1:
        each = best.select("job_id", F.posexplode("best").alias("place", "best")).groupBy("job_id", "place").agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, top).alias("best"))
        best = each.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "best"))), lambda x: x["best"]).alias("best"))
    mean = F.transform("best", lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(b), F.lit(1))))
    return best.select("job_id", mean.alias("semantic"))


def semantic_scores(modules: DataFrame, jobs: DataFrame, top: int = K.TOP_MODULES,
                    job_blocks: int | None = None, module_blocks: int | None = None) -> DataFrame:
    """Mean of the best ``top`` module similarities per course and job, one row per pair."""
    places = numbered(modules)
    rows = semantic_rows(modules, jobs, places, top, job_blocks, module_blocks)
    each = rows.select("job_id", F.posexplode("semantic").alias("place", "semantic_score")).where("semantic_score IS NOT NULL")
    return each.join(places, "place").select("course_id", "job_id", "semantic_score")


def ensemble(pairs: DataFrame, weights=None) -> DataFrame:
    """Breakdown and final score of pairs that carry matched skills, a semantic and a confidence score."""
    parts = scores.score_breakdown(
        F.coalesce("semantic_score", F.lit(0.0)),
        scores.coverage(F.size("matched"), F.size("job_skills")),
        F.coalesce("confidence_score", F.lit(0.0)), weights)
    return pairs.withColumn("score_breakdown", parts).withColumn(
        "similarity_score", F.col("score_breakdown.final_score"))


def with_confidences(owners: DataFrame, skills: str, owner_map: str, name: str) -> DataFrame:
    """The confidence of every listed skill next to the list, 0 where the map has none; a list is one owner's, so it is short."""
    def sure(s):
        return F.coalesce(F.try_element_at(F.col(owner_map), F.lower(F.trim(s))), F.lit(0.0))

    return owners.withColumn(name, F.when(F.col(owner_map).isNull(), F.transform(skills, lambda s: F.lit(0.0))).otherwise(F.transform(skills, sure))).drop(owner_map)


def confidence_rows(courses: DataFrame, jobs: DataFrame, job_blocks: int) -> DataFrame:
    """(job_id, confidence): one row per job with the matched confidence of every course, by the course's place.

    ``courses``: place, course_skills, course_sure; ``jobs``: job_id, job_skills, job_sure (confidences next to the skills). A block of jobs meets the
    catalogue as one matrix of skills x courses; the mean over the matched skills leaves out skills without any confidence, as ``matched_confidence`` does.
    """
    out = T.StructType([T.StructField("job_id", jobs.schema["job_id"].dataType), T.StructField("confidence", T.ArrayType(T.DoubleType()))])

    def flat(column):
        column = column.combine_chunks()
        return np.asarray(column.flatten()), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def score(job_part: pa.Table, course_part: pa.Table) -> pa.Table:
        if not job_part.num_rows or not course_part.num_rows:
            return pa.table({"job_id": job_part["job_id"].slice(0, 0), "confidence": pa.array([], pa.list_(pa.float64()))})
        names, count = flat(course_part["course_skills"])
        place = np.repeat(course_part["place"].to_numpy(), count)
        n = int(course_part["place"].to_numpy().max()) + 1
        code = {s: k for k, s in enumerate(dict.fromkeys(names.tolist()))}
        has, sure = np.zeros((len(code) + 1, n), bool), np.zeros((len(code) + 1, n))
        at = np.array([code[s] for s in names.tolist()], np.int64)
        has[at, place], sure[at, place] = True, flat(course_part["course_sure"])[0].astype(float)
        parts = []
        for at in range(0, job_part.num_rows, 2048):
            piece = job_part.slice(at, 2048)
            names, count = flat(piece["job_skills"])
            k = np.array([code.get(s, len(code)) for s in names.tolist()], np.int64)
            own = flat(piece["job_sure"])[0].astype(float)[:, None]
            usable = has[k] & ((sure[k] != 0) | (own != 0))
            total, used = np.zeros((piece.num_rows, n)), np.zeros((piece.num_rows, n))
            value = np.where(usable, (sure[k] + own) / 2, 0.0)
            first = np.cumsum(count) - count
            for j in range(int(count.max())):  # one skill of every job at a time: sums run in the order of the skills
                rows = np.flatnonzero(count > j)
                total[rows] += value[first[rows] + j]
                used[rows] += usable[first[rows] + j]
            mean = np.divide(total, used, out=np.zeros_like(total), where=used > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1, dtype=np.int32) * n), pa.array(mean.ravel()))
            parts.append(pa.table({"job_id": piece["job_id"], "confidence": lists}))
        return pa.concat_tables(parts)

    left = jobs.select("job_id", "job_skills", "job_sure", F.pmod(F.xxhash64("job_id"), F.lit(job_blocks)).cast("int").alias("js"))
    right = courses.select("place", "course_skills", "course_sure", F.explode(F.sequence(F.lit(0), F.lit(job_blocks - 1))).alias("js"))
    return left.groupBy("js").cogroup(right.groupBy("js")).applyInArrow(score, schema=out)


def gap_analysis(course_skills: DataFrame, job_skills: DataFrame, course_conf: DataFrame, job_conf: DataFrame,
                 module_vectors: DataFrame, job_vectors: DataFrame, weights=None, job_blocks: int | None = None) -> DataFrame:
    """The whole run: gap, coverage, semantic score, confidence and final score of every pair.

    Everything that belongs to a job, its semantic score and its confidence with all courses among it, meets in one row by the job's id; courses come to the
    jobs and rows are multiplied last, so no table of pairs is ever shuffled.
    """
    blocks = job_blocks or max(shuffle_width(job_skills.sparkSession), block_count(job_skills))
    places = numbered(course_skills)
    courses = in_order(course_skills, "course_skills").join(confidence_array(course_conf, "course_id", "course_map"), "course_id", "left").join(places, "course_id")
    courses = with_confidences(courses, "course_skills", "course_map", "course_sure")
    jobs = in_order(job_skills, "job_skills").join(confidence_array(job_conf, "job_id", "job_map"), "job_id", "left")
    jobs = with_confidences(jobs, "job_skills", "job_map", "job_sure")
    sure = confidence_rows(courses, jobs, blocks)
    jobs = jobs.drop("job_sure").join(sure, "job_id", "left").join(semantic_rows(module_vectors, job_vectors, places, job_blocks=blocks), "job_id", "left")
    matched, missing, extra = gap_columns(F.col("course_skills"), F.col("job_skills"))
    pairs = pair_up(courses.drop("course_sure"), jobs, copies=blocks)
    pairs = pairs.select("course_id", "job_id", "course_skills", "job_skills", matched, missing, extra,
                         F.get("semantic", "place").alias("semantic_score"), F.get("confidence", "place").alias("confidence_score"))
    return ensemble(pairs, weights)


def newest_jobs(jobs: DataFrame, max_jobs: int | None, created: str = "created_on") -> DataFrame:
    """Optional cap on the scored jobs, newest first."""
    return jobs if max_jobs is None else jobs.orderBy(F.desc(created), "job_id").limit(max_jobs)


def remaining_jobs(jobs: DataFrame, results: DataFrame, courses: DataFrame) -> DataFrame:
    """Jobs without a full set of results: the work left of an interrupted run."""
    wanted = courses.agg(F.countDistinct("course_id").alias("wanted"))
    have = results.groupBy("job_id").agg(F.count("*").alias("have"))
    # one-row table joined by a constant key
    done = have.withColumn("k", F.lit(1)).join(wanted.withColumn("k", F.lit(1)), "k").filter("have >= wanted")
    return jobs.join(done.select("job_id"), "job_id", "left_anti")


def skill_matrix(job_skill: DataFrame, module_skill: DataFrame) -> DataFrame:
    """Document frequency of every skill, for jobs and for course modules."""
    sides = job_skill.select(F.lit("jobs").alias("source"), "skill").unionByName(
        module_skill.select(F.lit("courses").alias("source"), "skill"))
    return sides.groupBy("source", "skill").agg(F.count("*").alias("frequency"))


def score_audit(results: DataFrame, weights=None) -> DataFrame:
    """Stored percent next to the percent recomputed from the stored score parts."""
    w = weights or K.WEIGHTS
    b = "score_breakdown."
    mix = (F.lit(w["semantic"]) * F.col(b + "semantic_score") + F.lit(w["skill"]) * F.col(b + "skill_score")
           + F.lit(w["confidence"]) * F.col(b + "confidence_score")
           + F.lit(w["policy"]) * F.col(b + "decision_tree_score")) / F.lit(max(0.01, sum(w.values())))
    return results.select(
        "course_id", "job_id",
        scores.percent(F.col("similarity_score")).alias("stored_score"),
        scores.half_up(mix * 100.0, 2).alias("calculated_score"),
        scores.half_up(F.col(b + "semantic_score"), 4).alias("semantic"),
        scores.half_up(F.col(b + "skill_score"), 4).alias("skill"),
        scores.half_up(F.col(b + "confidence_score"), 4).alias("confidence"),
        scores.half_up(F.col(b + "decision_tree_score"), 4).alias("policy"),
        F.size("matched").alias("matched_count"),
        F.size(F.array_union("matched", "missing")).alias("job_skill_count"),
    )
