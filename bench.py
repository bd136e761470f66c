"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is fully executed with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "user_vector",
    "attach_user_vector",
    "feat_mean_response_time",
    "ensemble_vote",
    "label_band",
    "chunk_text",
    "tokenize_topic_words",
    "split_exact",
    "class_report",
    "roc_auc_ovr",
    "wilcoxon_signed_rank",
    "tfidf",
    "class_tfidf",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from chatspark.plans.registry import load_all
    from chatspark.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    qs = load_all()
    # warm the JVM (JIT, regex and codegen caches, Python workers) by running
    # the same queries once on the smallest data set; only the runs on
    # $BENCH_SF_DIR are timed
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if warm_dir and os.path.isdir(warm_dir):
        for n in names:
            if n in qs:
                qs[n].build(spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        if n not in qs:
            continue
        t0 = time.time()
        df = qs[n].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
