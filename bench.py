"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
names given as arguments replace the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from quillspark.plans import catalog
from quillspark.session import local_session

HEADLINE = (
    "index_build",
    "keyword_topk",
    "keyword_expanded_topk",
    "cosine_topk",
    "chunks",
    "semantic_topk",
    "rrf_fusion",
    "route_briefs",
    "hybrid_search",
    "recall_tier",
    "routing_sweep",
    "mode_compare",
    "wikilink_resolve",
    "lint_report",
    "stale_briefs",
    "digest_candidates",
    "repoint",
    "apply_edits",
    "redact_secrets",
    "capture_notes",
    "suppress_repeat",
    "bootstrap_ci",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    # Start-up of the JVM and of the Python workers is not part of any query.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
