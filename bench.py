"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, warm, and print one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "A1_dashboard_stats_snapshot",
    "A8_period_compare",
    "A13_retention_cohorts",
    "A14_retention_curve",
    "A15_country_rollup",
    "A17_brief_daily",
    "A19_brief_weekly",
    "A25_reading_by_grade",
    "A27_unit_attention",
    "A32_attendance_register",
    "A36_dominant_language",
    "J1_users_with_activity",
    "J6_interval_join",
    "J7_threshold_lookup",
    "J11_fuzzy_match",
    "J14_fanout_safe_counts",
    "P9_next_question",
    "N4_ordered_aggregates",
    "W1_sessionize",
    "W4_silences",
    "W9_prior_feedback",
    "T2_word_counts_documents",
    "Z2_missed_roster",
    "Z6_replay_adaptive",
    "C1_framework_scores",
    "R1_align_words",
    "V2_qa_checks",
    "G4_co_taught",
    "G7_ring_cuts",
    "E1_vector_search",
    "E2_mutual_knn",
    "E4_cosine_profile",
]


#: counted runs of each query; the best one is reported
ROUNDS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from chalkline.plans import QUERIES
    from chalkline.session import local_session

    spark = local_session("bench", cores, **{"spark.sql.shuffle.partitions": cores})
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderpriority").count().collect()  # start-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(ROUNDS + 1):  # the first run compiles code and is not counted
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs[1:]), 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
