"""Functions by name for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from chalkline.functions import norms

SCALAR_FUNCTIONS = {
    "calculate_attendance_percentage": (
        "present INT, total INT",
        "DOUBLE",
        "CASE WHEN total <= 0 THEN 0.0D ELSE round(CAST(present AS DOUBLE) / total * 100, 2) END",
    ),
    "calculate_wcpm": (
        "correct INT, seconds DOUBLE",
        "DOUBLE",
        "CASE WHEN seconds <= 0 THEN 0.0D ELSE round(CAST(correct AS DOUBLE) / seconds * 60, 2) END",
    ),
}


def _benchmark_body() -> str:
    """J7 for a single call as one SELECT of literals: the norm map, the fallback by grade, the rank reached."""
    lang = "CASE WHEN language = 'ur' AND second_language THEN 'ur' ELSE 'en' END"
    rate = "floor(wcpm + 0.5D)"
    cells = ", ".join(f"'{g}|{lng}|{ssn}', array({', '.join(map(str, cuts))})" for (g, lng, ssn), cuts in norms.WORD_NORMS.items())
    cuts = f"try_element_at(map({cells}), concat_ws('|', CAST(grade AS STRING), {lang}, season))"

    def fallback(i: int) -> str:
        def by_grade(factor: float) -> str:
            whens = " ".join(f"WHEN {g} THEN {int(pair[i] * factor + 0.5)}" for g, pair in norms.WORD_FALLBACK.items())
            return f"CASE grade {whens} ELSE {int(norms.WORD_FALLBACK_OTHER[i] * factor + 0.5)} END"

        return f"CASE WHEN ({lang}) = 'ur' THEN {by_grade(norms.URDU_FACTOR)} ELSE {by_grade(1)} END"

    low, high = (f"coalesce({cuts}[{place}], {fallback(i)})" for i, place in enumerate((1, 3)))
    reached = " ".join(f"WHEN {cuts}[{i}] <= {rate} THEN {p}" for i, p in reversed(list(enumerate(norms.PERCENTILES))))
    rank = f"CASE WHEN {rate} IS NULL THEN NULL WHEN {rate} = 0 THEN 1 {reached} ELSE 10 END"
    return f"SELECT {low}, {high}, {rate} >= {low}, {rank}"


def register_functions(spark: SparkSession) -> None:
    """Scalar functions, N2: ``check_benchmark_status(wcpm, grade, language, second_language, season)``, a
    table function with benchmark range, on-track flag and percentile of one reading rate. All are SQL, so
    they stay in the JVM; a lateral call becomes a projection. A null rate has a range, but no flag and no rank."""
    for name, (args, kind, body) in SCALAR_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION check_benchmark_status(wcpm DOUBLE, grade INT, language STRING, second_language BOOLEAN, season STRING) "
        "RETURNS TABLE (benchmark_min INT, benchmark_max INT, on_track BOOLEAN, percentile_rank INT) "
        f"RETURN {_benchmark_body()}"
    )
