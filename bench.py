"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full with the ``noop`` sink (no collect to the driver).
All queries run once as a warm-up (JVM JIT, expression codegen, Python workers),
then once more timed; ``cold`` reports the first-run total too.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from presslink.plans import catalog  # noqa: E402
from presslink.session import get_session  # noqa: E402

HEADLINE = [
    "text_paragraphs", "segment_paragraphs", "build_articles", "extraction_prompts", "build_analyses",
    "explode_mentions", "summary_report", "normalize_names", "token_set_scores", "topk_names", "topk_employers",
    "rank_candidates", "adjudication_prompts", "kept_matches", "match_report_lines",
]


def run(name, spark, sf):
    t0 = time.perf_counter()
    catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = get_session()
    cold = {n: run(n, spark, sf) for n in names}
    times = {n: round(run(n, spark, sf), 3) for n in names}
    paragraphs = catalog.QUERIES["clean_paragraphs"](spark, sf).count()
    t_art = times.get("build_articles")
    # scored pairs per field = distinct mention strings x distinct contributor strings
    n_m = catalog._mentions_n(spark, sf).select("norm").distinct().count()
    cn = catalog._contribs_n(spark, sf)
    pairs = {"name": n_m * cn.select("name_norm").distinct().count(),
             "employer": n_m * cn.select("emp_norm").distinct().count()}
    t_names = times.get("topk_names")
    out = {
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
        "cold_total_sec": round(sum(cold.values()), 3),
        "article_assembly_paragraphs_per_sec": round(paragraphs / t_art, 1) if t_art else None,
        # each top-k query scores both fields (the block scorer handles them together)
        "fuzzy_join_pairs_per_sec": round((pairs["name"] + pairs["employer"]) / t_names, 1) if t_names else None,
        "fuzzy_join_pairs": pairs["name"] + pairs["employer"],
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
