"""Wall seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``--all`` times every registered query instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslens.plans import registry  # noqa: E402
from corpuslens.session import local_session  # noqa: E402

HEADLINE = [
    "review_findings", "rank_issues", "parse_issues", "severity_summary", "review_log",
    "scan_files", "chunk_documents", "full_index_manifest", "index_diff", "incremental_index",
    "vector_search", "cross_repo_search", "find_usages", "lexical_search", "normalize_hits",
    "parse_diff", "changed_code", "change_complexity", "symbols_js", "resolve_imports", "import_edges",
    "upstream_k", "rank_imports", "strategy_select", "learned_patterns", "tool_budget",
    "page_extract", "page_links", "crawl_bfs", "parse_sse", "reassemble_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(registry.QUERIES) if "--all" in sys.argv else HEADLINE
    spark = local_session("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if "-v" in sys.argv:
            print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
