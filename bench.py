"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names, or ``all``) are read
from the environment. Every query runs to completion into the no-op sink, so the time is
that of the whole result and of nothing else. Each runs once to load classes and compile
(``cold``), then is timed."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fitlens.catalog import all_queries  # noqa: E402
from fitlens.session import get_session  # noqa: E402

HEADLINE = (
    "html_clean", "whitespace_normalize", "section_split", "bullet_extract", "qualification_parse",
    "responsibility_parse", "posting_transform", "keyword_skills", "domain_tags", "entity_gazetteer",
    "hashed_embedding", "topk_matches", "topk_per_section", "score_and_rank", "multi_profile_rank",
    "posting_intake", "ingest_stats_rollup", "dedup_exact_text", "left_join_meta", "unique_violations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = get_session("bench", f"local[{cpus}]",
                        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in names}
    times = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cores": int(cpus),
        "cold": cold, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
