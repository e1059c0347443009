"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once and its whole result is written to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "time_score_matrix", "optimal_windows", "timing_scenarios", "timing_lookup", "engagement_forecast", "top_windows",
    "rate_engine", "schedule_features", "loo_rate", "loo_target_encoding", "msisdn_tier", "fatigue_24h", "interactions",
    "normalize_messages", "classify_messages", "text_signals", "manual_text_features", "campaign_stats", "budget_ledger",
    "audience", "audience_sizes", "contact_import", "route_match", "clean_corpus", "lexicon", "named_entities", "bigrams",
    "prefix_completion", "fuzzy_completion", "next_word", "recommend", "recommender_eval", "bandit_replay", "bandit_choice",
    "bandit_drift", "decision_feedback", "pr_curve", "adaptive_thresholds", "stratified_folds", "stream_bandit",
]


def main() -> None:
    from smsight.plans.queries import QUERIES
    from smsight.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the session outside the timings
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
