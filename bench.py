"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 1 timed run after one shared warm-up query),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "merge_notes_labels", "dedupe_concat", "label_frequency", "dataset_report", "coverage_curve", "encode_labels",
    "js_divergence", "split_subject_stratified", "split_manifest", "tokenize", "build_vocab", "encode_tokens",
    "chunk_sequences", "tfidf_word", "tfidf_char", "combine_features", "tune_label_thresholds", "precision_at_k",
    "evaluate_probs", "aggregate_chunk_scores", "predict_ovr", "fit_ovr_logreg", "token_attribution", "explain_candidates",
]


def main() -> None:
    from tagloom import catalog
    from tagloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(catalog.QUERIES["label_frequency"](spark, sf_dir))
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            noop(catalog.QUERIES[name](spark, sf_dir))
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
