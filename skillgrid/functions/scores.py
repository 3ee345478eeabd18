"""Column functions of the course/job score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillgrid.functions import constants as K


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def half_up(c: Column, digits: int) -> Column:
    """Round half up in plain double arithmetic, the same in every engine."""
    scale = float(10 ** digits)
    return F.floor(c * scale + F.lit(0.5)) / F.lit(scale)


def percent(score: Column) -> Column:
    return half_up(score * 100.0, 1)


def coverage(matched: Column, wanted: Column) -> Column:
    return F.when(wanted == 0, 0.0).otherwise(matched / F.greatest(wanted, F.lit(1)))


def policy_score(semantic: Column, skill: Column, confidence: Column) -> Column:
    return (
        F.when((semantic >= 0.78) & (skill >= 0.45) & (confidence >= 0.75), 0.95)
        .when((semantic >= 0.65) & ((skill >= 0.35) | (confidence >= 0.80)), 0.82)
        .when((semantic >= 0.50) & (skill >= 0.25), 0.65)
        .when((semantic >= 0.35) & (skill >= 0.10) & (confidence >= 0.85), 0.50)
        .otherwise(clamp01(F.lit(0.70) * semantic + F.lit(0.30) * skill))
    )


def weighted_score(semantic: Column, skill: Column, confidence: Column, policy: Column, weights=None) -> Column:
    w = weights or K.WEIGHTS
    total = max(0.01, sum(w.values()))
    mix = (
        F.lit(w["semantic"]) * semantic + F.lit(w["skill"]) * skill
        + F.lit(w["confidence"]) * confidence + F.lit(w["policy"]) * policy
    )
    return clamp01(mix / F.lit(total))


def score_breakdown(semantic: Column, skill: Column, confidence: Column, weights=None) -> Column:
    """Final score and its parts, rounded to six digits."""
    sure = clamp01(confidence)
    policy = policy_score(semantic, skill, sure)
    final = weighted_score(semantic, skill, sure, policy, weights)
    return F.struct(
        F.lit("semantic_skill_confidence_decision_tree_ensemble").alias("model"),
        half_up(clamp01(semantic), 6).alias("semantic_score"),
        half_up(skill, 6).alias("skill_score"),
        half_up(sure, 6).alias("confidence_score"),
        half_up(policy, 6).alias("decision_tree_score"),
        half_up(final, 6).alias("final_score"),
    )


def overlap_score(matched: Column, course_size: Column, job_size: Column) -> Column:
    """Score from skill overlap alone, two digits; 0 when either side is empty."""
    union = course_size + job_size - matched
    raw = F.lit(0.35) + F.lit(0.45) * (matched / F.greatest(job_size, F.lit(1))) \
        + F.lit(0.2) * (matched / F.greatest(union, F.lit(1)))
    return F.when((course_size == 0) | (job_size == 0), 0.0).otherwise(half_up(F.least(F.lit(0.96), raw), 2))


def bucket_index(score: Column) -> Column:
    """Five buckets on the raw score."""
    return F.least(F.lit(4), F.floor(F.greatest(F.lit(0.0), score) * 5.0).cast("int"))


def band_label(pct: Column) -> Column:
    """Five bands on the rounded percent."""
    c = F.when(pct < 20, K.SCORE_BANDS[0])
    for limit, label in zip((40, 60, 80), K.SCORE_BANDS[1:4]):
        c = c.when(pct < limit, label)
    return c.otherwise(K.SCORE_BANDS[4])


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine01(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 when a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(clamp01(dot(a, b) / size))
