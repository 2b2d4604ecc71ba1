"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# index_statistics comes first of the searches: it builds the stored index.
HEADLINE = ("usage_by_dimension", "usage_daily_trend", "topology", "queue_position", "latest_task", "index_statistics", "bm25_keyword_search", "bm25_match_groups", "cosine_topk", "rrf_fusion", "search_excerpt", "title_jaccard_merge", "source_ref_sweep", "graph_degree", "graph_core", "split_chunks", "atoms_windows_segments", "html_to_markdown")


def main() -> None:
    from tessella.plans import catalog
    from tessella.session import session

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    found["usage_by_dimension"](spark, sf).count()  # starts the session
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
