"""Bench: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query runs to completion through the ``noop`` sink (the whole plan executes; nothing is
collected). ``*_naive`` entries time the plain single-partition / all-pairs forms the scaled
operators replace, for comparison at the same scale factor.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from refrank.operators.ranking import single_partition_row_number  # noqa: E402
from refrank.plans.batch import STATIC_RANKS  # noqa: E402
from refrank.plans.queries import QUERIES  # noqa: E402
from refrank.session import local_session  # noqa: E402
from refrank.sources.testdata import TestTables  # noqa: E402

HEADLINE = [
    "recommend_weighted",
    "recommend_cosine",
    "top_cited",
    "keyword_search",
    "author_profile_vector",
    "profiles_from_papers",
    "hash_embedding",
    "segment_pooling",
    "profile_upsert",
    "global_ranks",
    "batch_recommend_cosine",
    "batch_recommend_weighted",
    "stream_likes",
    "incremental_profile",
]


def naive_global_ranks(spark, d):
    ranked = TestTables(spark, d).papers.select("paper_id", "reference_count", "citation_count",
                                                 "influential_citation_count", "year")
    for name, field in STATIC_RANKS:
        ranked = single_partition_row_number(ranked, [F.col(field).desc(), F.col("paper_id").asc()], name)
    return ranked


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="refrank-bench")
    # Warm-up, not timed: JIT/codegen and Python workers, on the tiny sf0.001 tables only (never on
    # the measured folder), so the timings below are steady-state throughput.
    run(spark.range(64).repartition(int(cpus) if cpus.isdigit() else 8).mapInPandas(lambda it: it, "id long"))
    tiny = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(tiny) and os.path.abspath(tiny) != os.path.abspath(sf_dir):
        for name in ("recommend_weighted", "keyword_search", "batch_recommend_cosine"):
            run(QUERIES[name](spark, tiny))
    else:
        run(TestTables(spark, sf_dir).papers.limit(10))
    timings: dict[str, float] = {}
    queries = {name: QUERIES[name] for name in HEADLINE}
    queries["global_ranks_naive"] = naive_global_ranks
    for name, fn in queries.items():
        t0 = time.perf_counter()
        run(fn(spark, sf_dir))
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(v for k, v in timings.items() if not k.endswith("_naive")), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
