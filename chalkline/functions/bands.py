"""score bands and classroom climate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.maths import half_up

# Comprehension thresholds by grade (below, at, above); grade 2 is the default.
COMPREHENSION = {
    0: (2, 3, 4),
    1: (2, 3, 4),
    2: (2, 3, 4),
    3: (2, 3, 5),
    4: (3, 4, 5),
    5: (3, 4, 5),
}


def mastery(pct: Column) -> Column:
    """Mastery level of a percentage."""
    return F.when(pct >= 80, "mastered").when(pct >= 60, "developing").otherwise("needs_practice")


def performance(pct: Column) -> Column:
    """Four bands at 80, 60 and 40."""
    return F.when(pct >= 80, "excellent").when(pct >= 60, "proficient").when(pct >= 40, "developing").otherwise("emerging")


def performance_swahili(pct: Column) -> Column:
    """Four bands at 85, 70 and 55."""
    return (
        F.when(pct >= 85, "bora_sana").when(pct >= 70, "mwenye_uwezo").when(pct >= 55, "inakua").otherwise("inajitokeza")
    )


def class_band(mean: Column, mastered: Column, completed: Column) -> Column:
    """Class insight: strong, weak or mixed."""
    share = mastered / completed
    return (
        F.when(completed == 0, "mixed")
        .when((mean >= 80) & (share >= 0.7), "strong")
        .when((mean < 60) | (share < 0.3), "weak")
        .otherwise("mixed")
    )


def comprehension(correct: Column, grade: Column) -> Column:
    """Comprehension status by grade."""

    def limit(i: int) -> Column:
        out = F.lit(COMPREHENSION[2][i])
        for g, cuts in COMPREHENSION.items():
            out = F.when(grade == g, F.lit(cuts[i])).otherwise(out)
        return out

    return (
        F.when(correct < limit(0), "urgent_intervention")
        .when(correct < limit(1), "below_benchmark")
        .when(correct < limit(2), "at_benchmark")
        .otherwise("above_benchmark")
    )


def objective_status(confidence: Column, evidence: Column, addressed: Column) -> Column:
    """status of one lesson objective."""
    level = F.lower(F.coalesce(confidence, F.lit("")))
    return (
        F.when(~addressed, "NOT_ADDRESSED")
        .when((level == "high") & (evidence >= 2), "ACHIEVED")
        .when(level == "high", "LIKELY_ACHIEVED")
        .when(level == "medium", "NEEDS_EVIDENCE")
        .when((level == "low") | (evidence == 0), "NOT_ASSESSED")
        .otherwise("UNKNOWN")
    )


def emotional_support(praise: Column, negative: Column, minutes: Column) -> Column:
    """status from praise per 30 minutes and negative language."""
    per_half_hour = praise / (F.greatest(minutes, F.lit(1)) / F.lit(30.0))
    return (
        F.when(negative > 3, "CONCERNING")
        .when((per_half_hour >= 5) & (negative <= 1), "POSITIVE")
        .when((per_half_hour >= 3) | (negative <= 2), "GOOD")
        .otherwise("NEEDS_IMPROVEMENT")
    )


def instructional_support(why: Column, higher_order: Column, scaffolding: Column) -> Column:
    """status from reasoning questions, higher-order questions and scaffolding."""
    signs = why + higher_order + scaffolding
    return (
        F.when(signs >= 10, "EXCELLENT").when(signs >= 5, "GOOD").when(signs >= 2, "ROOM_TO_GROW").otherwise("NEEDS_IMPROVEMENT")
    )


def classroom_organization(cues: Column, redirections: Column) -> Column:
    """status from transition cues and redirections."""
    return (
        F.when((redirections == 0) & (cues > 0), "WELL_ORGANIZED")
        .when(redirections <= 3, "GOOD")
        .otherwise("NEEDS_ATTENTION")
    )


def objective_coverage(objectives: Column) -> Column:
    """total, addressed, achieved and percentage over an array of
    ``struct<addressed boolean, mastery_confidence string, evidence int>``."""
    total = F.coalesce(F.size(objectives), F.lit(0))
    addressed = F.size(F.filter(objectives, lambda o: F.coalesce(o["addressed"], F.lit(True))))
    achieved = F.size(
        F.filter(
            objectives,
            lambda o: objective_status(
                o["mastery_confidence"], o["evidence"], F.coalesce(o["addressed"], F.lit(True))
            ).isin("ACHIEVED", "LIKELY_ACHIEVED"),
        )
    )
    empty = objectives.isNull() | (F.size(objectives) == 0)
    return F.struct(
        F.when(empty, 0).otherwise(total).alias("total"),
        F.when(empty, 0).otherwise(addressed).alias("addressed"),
        F.when(empty, 0).otherwise(achieved).alias("achieved"),
        F.when(empty, F.lit(0)).otherwise(half_up(addressed / total * 100)).cast("int").alias("percentage"),
    )
