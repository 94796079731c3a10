"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "corpus_scan", "mask_text", "policy_action", "detect_email", "detect_internal_url", "overlap_resolution",
    "context_hint", "residual_terms", "nearest_prototype", "entity_spans", "line_scan", "error_triage",
]


def main() -> None:
    from veilscan.plans.queries import QUERIES
    from veilscan.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in HEADLINE if os.path.isdir(small) else []:  # warm-up: code is compiled before anything is timed
        QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        begin = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text)) AS n").first()["n"]
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "document_chars": docs,
                "document_chars_per_second": {name: round(docs / max(t, 1e-3)) for name, t in times.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
