"""Times the headline queries: warm run, all rows produced, nothing collected. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skillgrid.plans import catalog  # noqa: E402
from skillgrid.session import build_session  # noqa: E402

HEADLINE = (
    "B2_advert_fingerprint", "B3_deduplicate_documents", "C8_infer_sector", "D2_phrase_hits", "E1_text_chunks", "E8_course_job_semantic",
    "F2_skill_gap", "F8_gap_analysis", "G4_document_frequency", "H2_score_buckets", "H4_course_band_heatmap", "H11_skill_correlation",
    "H16_top_similarities", "H22_evidence_counts", "I7_upserted_aliases", "K4_split_examples",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    slots = "8" if cpus == "*" else cpus
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": slots, "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    for name in names:
        for warm in (False, True):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = round(time.time() - start, 3)
            print(f"{name} {'warm' if warm else 'cold'} {took}", file=sys.stderr, flush=True)
            if warm:
                times[name] = took
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
