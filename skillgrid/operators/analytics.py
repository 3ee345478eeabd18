"""Reports on gap results and skill evidence.

Results are rows (course_id, job_id, similarity_score, matched, missing). Reports that need skills expand
one result into its skills and group at once, so partial aggregation keeps the shuffle at groups x tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgrid.functions import constants as K
from skillgrid.functions import scores, skills, text
from skillgrid.session import cut


def latest_run(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Newest run that has results, else the newest run."""
    have = results.select("run_id").distinct().withColumn("has", F.lit(1))
    marked = runs.join(have, "run_id", "left")
    return marked.agg(F.max_by(F.struct("run_id", "name", "created_on"), F.struct(F.coalesce("has", F.lit(0)), "created_on", "run_id")).alias("r")).select("r.*")


def score_buckets(results: DataFrame) -> DataFrame:
    """Results per fifth of the raw score, with the average percent of all results."""
    by = results.groupBy(scores.bucket_index(F.col("similarity_score")).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("similarity_score").alias("s"))
    labels = skills.literal_array(K.SCORE_BANDS)
    total = by.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n")).select(
        F.posexplode(labels).alias("bucket", "label"), scores.half_up(F.col("all_s") / F.col("all_n") * 100.0, 1).alias("average"))
    return total.join(by, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("count"), "average")


def score_distribution(results: DataFrame) -> DataFrame:
    """Results per band of the rounded percent; empty bands appear with 0."""
    band = scores.band_label(scores.percent(F.col("similarity_score")))
    by = results.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    pivoted = by.agg(*[F.coalesce(F.sum(F.when(F.col("band") == b, F.col("n"))), F.lit(0)).alias(b) for b in K.SCORE_BANDS])
    return pivoted.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"`{b}`").alias("count")) for b in K.SCORE_BANDS])).alias("x")).select("x.*")


def course_bands(results: DataFrame, threshold: float = K.MISMATCH_THRESHOLD) -> DataFrame:
    """Band counts per course, their share of the largest cell, the average percent and the mismatch mark."""
    pct = scores.percent(F.col("similarity_score"))
    band = scores.band_label(pct)
    # tenths of a percent are summed as integers, so the average does not depend on the order of rows
    rows = results.groupBy("course_id").agg(
        F.count("*").alias("n"), F.sum(F.round(pct * 10).cast("bigint")).alias("tenths"),
        *[F.count_if(band == b).alias(b) for b in K.SCORE_BANDS])
    cells = rows.select(
        "course_id", scores.half_up(F.col("tenths") / F.col("n") / 10.0, 1).alias("avg_score"),
        F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"`{b}`").alias("count")) for b in K.SCORE_BANDS])).alias("c"))
    # one number over a courses-sized table
    peak = cells.agg(F.greatest(F.lit(1).cast("bigint"), F.max("c.count")).alias("peak"), F.lit(1).alias("k"))
    return cells.withColumn("k", F.lit(1)).join(peak, "k").select(
        "course_id", "avg_score", (F.col("avg_score") < threshold).alias("mismatch"), "c.band", "c.count",
        scores.half_up(F.col("c.count") / F.col("peak"), 3).alias("intensity"))


def result_cells(results: DataFrame, jobs: DataFrame, courses: DataFrame, limit: int | None = None) -> DataFrame:
    """Course-to-job cells in course order, best score first, with all matched and missing names."""
    cells = named_results(results, jobs, courses).select(
        "course_id", F.col("code").alias("course"), "course_name", "school", "job_id", "job", "company",
        scores.percent(F.col("similarity_score")).alias("score"), F.size("matched").alias("matched_count"),
        F.size("missing").alias("missing_count"), F.array_join("matched", ", ").alias("matched"),
        F.array_join("missing", ", ").alias("missing"))
    ordered = cells.orderBy("course_name", F.desc("score"), "job_id")
    return ordered.limit(limit) if limit else ordered


def named_results(results: DataFrame, jobs: DataFrame, courses: DataFrame) -> DataFrame:
    """Results with the names of course, school and job."""
    c = courses.select("course_id", "code", F.col("name").alias("course_name"),
                       text.first_filled(F.col("university"), F.lit("Unassigned school")).alias("school"))
    j = jobs.select("job_id", F.col("title").alias("job"), "company")
    return results.join(c, "course_id").join(j, "job_id")


def matched_missing(results: DataFrame) -> DataFrame:
    return results.groupBy("course_id").agg(
        F.sum(F.size("matched")).alias("matched_total"), F.sum(F.size("missing")).alias("missing_total"))


def school_summary(results: DataFrame, courses: DataFrame, threshold: float = K.MISMATCH_THRESHOLD) -> DataFrame:
    """Averages and totals per school. Results are summed per course first, then the few courses per school."""
    pct = F.round(scores.percent(F.col("similarity_score")) * 10).cast("bigint")
    per = results.groupBy("course_id").agg(
        F.count("*").alias("n"), F.sum(pct).alias("tenths"), F.sum(F.size("matched")).alias("matched"), F.sum(F.size("missing")).alias("missing"))
    school = text.first_filled(F.col("university"), F.lit("Unassigned school"))
    g = per.join(courses.select("course_id", school.alias("school")), "course_id").groupBy("school").agg(
        scores.half_up(F.sum("tenths") / F.sum("n") / 10.0, 1).alias("avg_score"), F.sum("matched").alias("matched_total"),
        F.sum("missing").alias("missing_total"), F.countDistinct("course_id").alias("course_count"))
    return g.withColumn("mismatch", (F.col("avg_score") < threshold) | (F.col("missing_total") > F.col("matched_total")))


def _skill_counts(results: DataFrame, owner: str) -> DataFrame:
    """Refined matched and missing counts per owner, ranked: (owner, side, skill, n, rank)."""
    sides = F.explode(F.concat(
        F.transform("matched", lambda s: F.struct(F.lit("matched").alias("side"), s.alias("raw"))),
        F.transform("missing", lambda s: F.struct(F.lit("missing").alias("side"), s.alias("raw")))))
    raw = results.select(owner, sides.alias("x")).groupBy(owner, F.col("x.side").alias("side"), F.col("x.raw").alias("raw")).agg(F.count("*").alias("n"))
    refined = raw.withColumn("skill", skills.refined_label(F.col("raw"))).filter("skill IS NOT NULL")
    counts = refined.groupBy(owner, "side", "skill").agg(F.sum("n").alias("n"))
    w = W.partitionBy(owner, "side").orderBy(F.desc("n"), "skill")
    return counts.withColumn("rank", F.row_number().over(w))


def skill_insight(results: DataFrame, owner: str) -> DataFrame:
    """Sentences on the most missing (5) and most matched (4) refined skills of an owner."""
    ranked = _skill_counts(results, owner).filter((F.col("rank") <= 4) | ((F.col("side") == "missing") & (F.col("rank") <= 5)))

    def names(side):
        picked = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "skill"))))
        return F.transform(picked, lambda s: s["skill"])

    lists = ranked.groupBy(owner).agg(names("missing").alias("missing"), names("matched").alias("matched"))
    owners = results.select(owner).distinct().join(lists, owner, "left")
    none = F.array().cast("array<string>")
    miss, hit = F.coalesce("missing", none), F.coalesce("matched", none)
    gap = F.when(F.size(miss) > 0, F.concat(
        F.lit("Based on the analysed course-to-job data, the curriculum should strengthen "), text.join_names(miss), F.lit(".")))
    covered = F.when(F.size(hit) > 0, F.concat(F.lit("The current evidence already shows coverage in "), text.join_names(hit), F.lit(".")))
    nothing = F.lit("No repeated skill pattern is visible yet, so inspect the lowest-scoring job matches first.")
    return owners.select(owner, text.first_filled(F.concat_ws(" ", gap, covered), nothing).alias("insight"), text.join_names(miss).alias("missing_names"))


def school_recommendations(results: DataFrame, courses: DataFrame, threshold: float = K.MISMATCH_THRESHOLD) -> DataFrame:
    """A message for every school with a mismatch; when there is none, one for the best school."""
    summary = school_summary(results, courses, threshold)
    school = text.first_filled(F.col("university"), F.lit("Unassigned school")).alias("school")
    insight = skill_insight(results.join(courses.select("course_id", school), "course_id"), "school")
    low = F.concat(F.lit("Average score is "), F.col("avg_score").cast("string"), F.lit(f"%, below the {threshold}% threshold."))
    more = F.concat(F.lit("Missing skill evidence ("), F.col("missing_total").cast("string"),
                    F.lit(") exceeds matched evidence ("), F.col("matched_total").cast("string"), F.lit(")."))
    reason = F.when(F.col("avg_score") < threshold, low).otherwise(more)
    tail = F.lit("Prioritise curriculum updates in modules linked to the job adverts with the highest missing-skill counts.")
    bad = summary.filter("mismatch").join(insight, "school").select(
        "school", F.col("avg_score").alias("score"), F.concat_ws(" ", reason, F.col("insight"), tail).alias("message"))
    calm = F.lit("No curriculum is below the current threshold. Use the scatter plot to inspect outlier courses with high "
                 "missing-skill counts before changing module content.")
    best = summary.agg(F.max_by(F.struct("school", "avg_score"), F.struct("avg_score", "school")).alias("b"), F.count_if("mismatch").alias("bad"))
    fallback = best.filter("bad = 0 AND b IS NOT NULL").select("b.school", F.col("b.avg_score").alias("score"), calm.alias("message"))
    return bad.unionByName(fallback)


def skill_suggestions(results: DataFrame, limit: int | None = 8) -> DataFrame:
    """Per refined skill: jobs, covering courses, matched and missing pairs, coverage and gap.

    Pairs are counted by skill and course, which the tasks combine before they shuffle. Jobs are counted from the different lists of a job, mostly
    one for all its courses, so no row per pair and skill is shuffled; a popular skill never gathers its pairs in one group.
    """
    def labels(c):
        return F.array_distinct(F.filter(F.transform(c, skills.refined_label), lambda s: s.isNotNull()))

    marks = F.concat(
        F.transform(labels(F.col("matched")), lambda s: F.struct(s.alias("skill"), F.lit(1).alias("hit"), F.lit(0).alias("miss"))),
        F.transform(labels(F.col("missing")), lambda s: F.struct(s.alias("skill"), F.lit(0).alias("hit"), F.lit(1).alias("miss"))))
    rows = results.select("course_id", F.explode(marks).alias("m")).select("course_id", "m.*")
    per_course = rows.groupBy("skill", "course_id").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    total = per_course.groupBy("skill").agg(F.sum("hit").alias("matched_count"), F.sum("miss").alias("missing_count"), F.count_if(F.col("hit") > 0).alias("course_count"))
    lists = results.select("job_id", F.sort_array(F.array_union("matched", "missing")).alias("names")).distinct()
    jobs = lists.select("job_id", F.explode(labels(F.col("names"))).alias("skill")).distinct().groupBy("skill").agg(F.count("*").alias("job_count"))
    g = total.join(jobs, "skill").withColumn("k", F.lit(1))
    peak = g.groupBy("k").agg(F.max("missing_count").alias("peak"))
    demand = F.col("matched_count") + F.col("missing_count")

    def share(part, whole):
        return F.bround(part / F.greatest(whole, F.lit(1)) * 100).cast("int")

    out = g.join(peak, "k").select(
        "skill", demand.alias("demand_count"), "job_count", "course_count",
        "matched_count", "missing_count", share(F.col("matched_count"), demand).alias("coverage"),
        share(F.col("missing_count"), demand).alias("gap_percent"), share(F.col("missing_count"), F.col("peak")).alias("gap_width"))
    return out.orderBy(F.desc("missing_count"), "coverage", "skill").limit(limit) if limit else out


# ---- role profiles -----------------------------------------------------------------------------

def role_profiles(jobs: DataFrame, job_skill: DataFrame, results: DataFrame, courses: DataFrame) -> DataFrame:
    """Per job of the results its skills, courses and schools. One job has a bounded number of either."""
    seen = results.select("job_id", "course_id").join(courses.select(
        "course_id", "code", text.first_filled(F.col("university"), F.lit("Unassigned school")).alias("school")), "course_id")
    sides = seen.groupBy("job_id").agg(F.array_sort(F.collect_set("code")).alias("courses"), F.array_sort(F.collect_set("school")).alias("schools"))
    have = job_skill.groupBy("job_id").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    return jobs.select("job_id", text.squeeze(F.col("title")).alias("role"), "company", F.col("category").alias("sector")).join(have, "job_id").join(sides, "job_id")


def skill_correlation(profile_skill: DataFrame, limit: int = 16) -> DataFrame:
    """Correlation of the presence of the most frequent skills over profiles (owner, skill): left, right, value.

    Profiles become bit masks over the selected skills; equal masks are counted before any pair is formed, so
    the pair step runs on at most 2^limit rows whatever the number of profiles.
    """
    owner = profile_skill.columns[0]
    freq = profile_skill.groupBy("skill").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(limit)
    ranked = freq.withColumn("bit", F.row_number().over(W.orderBy(F.desc("n"), "skill")) - 1)  # `limit` rows only
    bits = profile_skill.join(F.broadcast(ranked.select("skill", "bit")), "skill")
    masks = bits.groupBy(owner).agg(F.sum(F.pow(F.lit(2.0), F.col("bit")).cast("bigint")).alias("mask")).groupBy("mask").agg(F.count("*").alias("c"))
    total = profile_skill.select(owner).distinct().agg(F.count("*").cast("double").alias("N"), F.lit(1).alias("k"))
    places = F.filter(F.sequence(F.lit(0), F.lit(limit - 1)), lambda b: F.getbit(F.col("mask"), b) == 1)
    held = masks.withColumn("p", places)
    both = held.select("c", F.explode("p").alias("l"), "p").select("c", "l", F.explode("p").alias("r")).groupBy("l", "r").agg(F.sum("c").cast("double").alias("n_lr"))
    name = ranked.select(F.col("bit"), "skill", F.col("n").cast("double").alias("cnt"), F.lit(1).alias("k"))
    left = name.select(F.col("bit").alias("l"), F.col("skill").alias("left"), F.col("cnt").alias("n_l"), "k")
    right = name.select(F.col("bit").alias("r"), F.col("skill").alias("right"), F.col("cnt").alias("n_r"), "k")
    grid = left.join(right, "k").join(total, "k").join(both, ["l", "r"], "left")  # limit x limit rows
    n, a, b, ab = F.col("N"), F.col("n_l"), F.col("n_r"), F.coalesce("n_lr", F.lit(0.0))
    spread = F.sqrt(a * (n - a)) * F.sqrt(b * (n - b))
    value = F.when(F.col("l") == F.col("r"), 1.0).when(spread == 0, 0.0).otherwise((n * ab - a * b) / spread)
    return grid.select("left", "right", scores.half_up(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)), 2).alias("value"))


def role_divergence(profiles: DataFrame, role_limit: int | None = None, skill_limit: int = 9) -> DataFrame:
    """Share of a skill in a role minus its share overall, the largest differences per role.

    ``profiles``: job_id, role, skill. The role x skill grid is formed over distinct names only.
    """
    counts = profiles.groupBy("role", "skill").agg(F.count("*").alias("n"))
    sizes = profiles.select("job_id", "role").distinct().groupBy("role").agg(F.count("*").alias("profile_count"))
    roles = sizes.orderBy(F.desc("profile_count"), "role").limit(role_limit) if role_limit else sizes
    role_total = counts.groupBy("role").agg(F.sum("n").alias("role_total"))
    overall = counts.groupBy("skill").agg(F.sum("n").alias("g")).withColumn("k", F.lit(1))
    total = overall.groupBy("k").agg(F.sum("g").alias("total"))
    grid = roles.join(role_total, "role").withColumn("k", F.lit(1)).join(overall.join(total, "k"), "k").join(counts, ["role", "skill"], "left")
    value = F.coalesce("n", F.lit(0)) / F.greatest("role_total", F.lit(1)) - F.col("g") / F.col("total")
    kept = grid.withColumn("raw", value).filter(F.abs("raw") >= 0.005).withColumn("value", scores.half_up(F.col("raw"), 2))
    w = W.partitionBy("role").orderBy(F.desc(F.abs("value")), "skill")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= skill_limit).select("role", "profile_count", "skill", "value")


def comparison_catalogue(profiles: DataFrame, profile_skill: DataFrame, courses: DataFrame) -> DataFrame:
    """Distinct names by kind: role, skill, sector, company, course, school."""
    names = profiles.select(F.explode(F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("role", "role"), ("sector", "sector"), ("company", "company"))])).alias("x")).select("x.*")
    more = profile_skill.select(F.lit("skill").alias("kind"), F.col("skill").alias("value"))
    sides = courses.select(F.explode(F.array(
        F.struct(F.lit("course").alias("kind"), F.col("code").alias("value")),
        F.struct(F.lit("school").alias("kind"), text.first_filled(F.col("university"), F.lit("Unassigned school")).alias("value")))).alias("x")).select("x.*")
    return names.unionByName(more).unionByName(sides).filter("value <> ''").distinct()


def filter_results(results: DataFrame, courses: DataFrame, run_id=None, school: str = "") -> DataFrame:
    out = results
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if school:
        out = out.join(courses.filter(F.col("university") == school).select("course_id"), "course_id", "left_semi")
    return out


def top_results(results: DataFrame, limit: int = 20) -> DataFrame:
    return results.orderBy(F.desc("similarity_score"), "course_id", "job_id").limit(limit)


def crosstab(results: DataFrame, course_limit: int = 18, job_limit: int = 24) -> DataFrame:
    """Percent of the best courses with the best jobs: one row per course and job of the selection."""
    courses = results.groupBy("course_id").agg(F.max_by(F.struct("similarity_score", "job_id"), F.struct("similarity_score", -F.col("job_id"))).alias("b"))
    jobs = results.groupBy("job_id").agg(F.max("similarity_score").alias("s"), F.min_by("course_id", F.struct(-F.col("similarity_score"), "course_id")).alias("c"))
    best_courses = courses.orderBy(F.desc("b.similarity_score"), "course_id").limit(course_limit).select("course_id")
    best_jobs = jobs.orderBy(F.desc("s"), "c", "job_id").limit(job_limit).select("job_id")
    kept = results.join(F.broadcast(best_jobs), "job_id", "left_semi").join(F.broadcast(best_courses), "course_id", "left_semi")
    return kept.select("course_id", "job_id", scores.percent(F.col("similarity_score")).alias("score"))


def demand_line(matrix: DataFrame, job_skill_rows: DataFrame, module_skill_rows: DataFrame, limit: int = 10) -> DataFrame:
    """Stored matrix plus live counts per side for the ten leading labels, jobs first."""
    live = job_skill_rows.groupBy("skill").agg(F.count("*").alias("frequency")).withColumn("source", F.lit("jobs")).unionByName(
        module_skill_rows.groupBy("skill").agg(F.count("*").alias("frequency")).withColumn("source", F.lit("courses")))
    both = matrix.select("skill", "frequency", "source").unionByName(live).groupBy("skill").agg(
        F.coalesce(F.sum(F.when(F.col("source") == "jobs", F.col("frequency"))), F.lit(0)).alias("job_count"),
        F.coalesce(F.sum(F.when(F.col("source") == "courses", F.col("frequency"))), F.lit(0)).alias("course_count"))
    jobs = both.filter("job_count > 0").orderBy(F.desc("job_count"), "skill").limit(limit)
    courses = both.filter("course_count > 0").orderBy(F.desc("course_count"), "skill").limit(limit)
    picked = jobs.withColumn("side", F.lit(0)).unionByName(courses.join(jobs.select("skill"), "skill", "left_anti").withColumn("side", F.lit(1)))
    order = F.when(F.col("side") == 0, F.col("job_count")).otherwise(F.col("course_count"))
    return picked.orderBy("side", F.desc(order), "skill").limit(limit).select("skill", "job_count", "course_count")


def skill_association(rows: DataFrame, limit: int | None = 18) -> DataFrame:
    """Strength of skill pairs that occur in one source: co-occurrence, shared words, sectors and source types.

    ``rows``: source_label, skill, sector, source_type. Equal skill sets are counted before pairs are formed:
    sources that hold the same skills yield each pair once, with their number as weight.
    """
    held = rows.select("source_label", "skill").distinct()
    counts = held.groupBy("skill").agg(F.count("*").alias("n"))
    sets = held.groupBy("source_label").agg(F.array_sort(F.collect_set("skill")).alias("s")).groupBy("s").agg(F.count("*").alias("w"))
    pairs = sets.select("s", "w", F.posexplode("s").alias("i", "left")).select(
        "w", "left", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("right"))
    together = pairs.groupBy("left", "right").agg(F.sum("w").alias("pair_count"))
    about = rows.groupBy("skill").agg(F.collect_set("sector").alias("sectors"), F.collect_set("source_type").alias("types")).join(counts, "skill").withColumn(
        "words", F.array_distinct(F.split("skill", " ")))
    def side(tag, name):
        return about.select(F.col("skill").alias(name), *[F.col(c).alias(tag + c) for c in ("sectors", "types", "words", "n")])

    def jaccard(c):
        a, b = F.col("l_" + c), F.col("r_" + c)
        return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))

    d = together.join(side("l_", "left"), "left").join(side("r_", "right"), "right")
    strength = 0.45 * (F.col("pair_count") / F.greatest("l_n", "r_n")) + 0.25 * jaccard("words") + 0.20 * jaccard("sectors") + 0.10 * jaccard("types")
    out = d.select("left", "right", scores.half_up(strength, 3).alias("strength"), "pair_count")
    return out.orderBy(F.desc("strength"), F.desc("pair_count"), F.desc("left"), F.desc("right")).limit(limit) if limit else out


def modal(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key from counted rows (key, value, n), ties by the smaller value."""
    per = counts.groupBy(key, value).agg(F.sum("n").alias("n"))
    return per.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def association_edges(rows: DataFrame, cosines: DataFrame, top_n: int = 36, keep: float = 0.28) -> DataFrame:
    """Edges among the most frequent skills: word cosine, same usual type, same usual sector.

    An edge needs a shared word, or the same type and sector together; both are equi-joins. The evidence is
    read once: everything follows from its counts per skill, type and sector.
    """
    counts = cut(rows.groupBy("skill", "skill_type", "sector").agg(F.count("*").alias("n")))
    names = counts.groupBy("skill").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "skill").limit(top_n).select("skill")
    few = counts.join(F.broadcast(names), "skill", "left_semi")
    about = cut(modal(few, "skill", "skill_type").join(modal(few, "skill", "sector"), "skill"))
    l = about.select(F.col("skill").alias("left"), F.col("skill_type").alias("lt"), F.col("sector").alias("ls"))
    r = about.select(F.col("skill").alias("right"), F.col("skill_type").alias("rt"), F.col("sector").alias("rs"))
    alike = l.join(r, (F.col("lt") == F.col("rt")) & (F.col("ls") == F.col("rs"))).filter("left < right").select("left", "right")
    wordy = cosines.join(l.select("left"), "left", "left_semi").join(r.select("right"), "right", "left_semi").select("left", "right")
    pairs = alike.unionByName(wordy).distinct().join(l, "left").join(r, "right").join(cosines, ["left", "right"], "left")
    score = F.coalesce("cosine", F.lit(0.0)) + F.when(F.col("lt") == F.col("rt"), 0.18).otherwise(0.0) + F.when(F.col("ls") == F.col("rs"), 0.12).otherwise(0.0)
    return pairs.select("left", "right", scores.half_up(score, 3).alias("score")).filter(F.col("score") >= keep)


def yearly_forecast(rows: DataFrame) -> DataFrame:
    """Counts per skill for all years (zero-filled) and the forecast of the next year."""
    counts = rows.filter("extracted_year IS NOT NULL AND skill <> ''").groupBy("skill", "extracted_year").agg(F.count("*").alias("n"))
    years = counts.agg(F.min("extracted_year").alias("first"), F.max("extracted_year").alias("last"),
                       F.array_sort(F.collect_set("extracted_year")).alias("years"), F.lit(1).alias("k"))
    per = counts.groupBy("skill").agg(F.map_from_entries(F.collect_list(F.struct("extracted_year", "n"))).alias("m"), F.sum("n").alias("total")).withColumn("k", F.lit(1))
    d = per.join(years, "k").withColumn("counts", F.transform("years", lambda y: F.coalesce(F.try_element_at("m", y), F.lit(0).cast("bigint"))))
    first, last, n = F.get("counts", 0), F.element_at("counts", -1), F.size("years")
    slope = F.when(n > 1, (last - first) / F.greatest(n - 1, F.lit(1))).otherwise(F.greatest(F.lit(1.0), first * 0.15))
    return d.select("skill", "total", "years", "counts", (F.col("last") + 1).alias("next_year"),
                    F.greatest(F.lit(0), F.bround(last + slope).cast("int")).alias("forecast"))


def evidence_counts(rows: DataFrame) -> DataFrame:
    """All chart counts in one pass: by skill, type, source, source x type and skill x year."""
    g = rows.groupingSets(
        [["skill"], ["skill_type"], ["source_type"], ["source_type", "skill_type"], ["skill", "extracted_year"]],
        "skill", "skill_type", "source_type", "extracted_year").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    chart = F.create_map(*[F.lit(v) for pair in ((7, "skill"), (11, "skill_type"), (13, "source_type"), (9, "source_by_type"), (6, "skill_by_year")) for v in pair])
    return g.select(F.element_at(chart, F.col("g").cast("int")).alias("chart"), "skill", "skill_type", "source_type", "extracted_year", "n")


def summary_counts(jobs: DataFrame, courses: DataFrame, modules: DataFrame) -> DataFrame:
    """Totals and distinct names, as (measure, value). Distinct names are grouped, not collected."""
    def distinct(df, col, name):
        return df.filter(F.col(col) != "").select(col).distinct().agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")

    def total(df, name):
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")

    parts = [
        total(courses, "courses_total"), distinct(courses, "name", "courses_unique_names"), distinct(courses, "code", "courses_unique_codes"),
        total(modules, "modules_total"), distinct(modules, "name", "modules_unique_names"), total(jobs, "jobs_total"),
        distinct(jobs, "title", "jobs_unique_titles"), distinct(jobs, "company", "jobs_unique_companies"),
        distinct(jobs, "category", "jobs_unique_categories"),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary_tops(jobs: DataFrame, courses: DataFrame, limit: int = 8) -> DataFrame:
    def leading(df, col, name):
        g = df.filter(F.col(col) != "").groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
        return g.orderBy(F.desc("n"), "value").limit(limit).select(F.lit(name).alias("kind"), "value", "n")

    return reduce(DataFrame.unionByName, [
        leading(jobs, "title", "job_title"), leading(jobs, "company", "company"), leading(jobs, "category", "category"),
        leading(courses, "name", "course"), leading(courses, "university", "university")])


def hub_network(rows: DataFrame, top_n: int = 18) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, label, count) and distinct skill-type and skill-source edges of the leading skills."""
    names = rows.groupBy("skill").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(top_n).select("skill")
    few = rows.join(F.broadcast(names), "skill", "left_semi")
    counts = few.groupBy("skill", "skill_type", "source_type").agg(F.count("*").alias("n"))
    ends = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("label")) for k, c in (("skill", "skill"), ("type", "skill_type"), ("source", "source_type"))])
    nodes = counts.select("n", F.explode(ends).alias("e")).groupBy("e.kind", "e.label").agg(F.sum("n").alias("count"))
    link = F.array(F.concat(F.lit("type:"), F.col("skill_type")), F.concat(F.lit("source:"), F.col("source_type")))
    edges = counts.select(F.concat(F.lit("skill:"), F.col("skill")).alias("from"), F.explode(link).alias("to")).distinct()
    return nodes, edges


def executive_values(courses: DataFrame, modules: DataFrame, jobs: DataFrame, results: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Key values of the report, one row per value."""
    def value(df, name, expr):
        return df.agg(expr.cast("double").alias("value")).select(F.lit(name).alias("measure"), "value")

    schools = courses.select(text.first_filled(F.col("university"), F.lit("Unassigned school")).alias("s")).distinct()
    tenths = F.sum(F.round(F.col("similarity_score") * 100).cast("bigint")) / F.greatest(F.count("*"), F.lit(1))
    return reduce(DataFrame.unionByName, [
        value(schools, "schools", F.count("*")), value(courses, "courses", F.count("*")), value(modules, "modules", F.count("*")),
        value(jobs, "job_adverts", F.count("*")), value(results, "comparisons", F.count("*")),
        value(results, "average_score", scores.half_up(tenths, 1)),
        value(entities, "reviewed_entities", F.count_if(F.col("label_status") == "reviewed")),
        value(entities, "candidate_entities", F.count_if(F.col("label_status") == "candidate")),
        value(aliases, "approved_aliases", F.count_if(F.col("status") == "approved")),
        value(aliases, "candidate_aliases", F.count_if(F.col("status") == "candidate"))])
