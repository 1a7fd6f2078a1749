"""Print the scale-relevant facts of the physical plans of key operators (for PLANS.md).

python tools/plans.py [sf_dir] > PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from refrank.operators.papers import require_paper  # noqa: E402
from refrank.operators.profiles import author_vectors, known_papers  # noqa: E402
from refrank.operators.ranking import global_row_number, top_k  # noqa: E402
from refrank.plans.recommend import scored_candidates  # noqa: E402
from refrank.operators.embedding import long_text_counts  # noqa: E402
from refrank.session import local_session  # noqa: E402
from refrank.sources.testdata import TestTables  # noqa: E402

KEEP = re.compile(
    r"(Exchange|BroadcastHashJoin|SortMergeJoin|BroadcastNestedLoop|TakeOrderedAndProject|Window|"
    r"HashAggregate|ObjectHashAggregate|SortAggregate|Scan parquet|FileScan|PushedFilters|ReadSchema|"
    r"Generate|FlatMapCoGroupsInPandas|WholeStageCodegen|ExistingRDD|Scan ExistingRDD|LogicalRDD)"
)


def facts(title, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    print(f"## {title}\n\n```")
    for line in plan.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", line)
            print(line[:220])
    print("```\n")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    t = TestTables(spark, sf)
    print(f"# Physical plan facts ({sf}, AQE initial plans)\n")
    print("Generated by `tools/plans.py`; only lines about exchanges, joins, aggregates, scans "
          "(pushed filters / read schema) and Python stages are kept.\n")
    facts("P2 paper lookup: the id filter reaches both parquet scans", require_paper(t.papers, 7))
    facts(
        "A4 author vector for one author: filter pushed to orders, partial ObjectHashAggregate",
        author_vectors(t.interactions.where(F.col("author_id") == 7), t.paper_embeddings),
    )
    facts(
        "C2/C3 candidates: anti-join before scoring, narrow columns",
        scored_candidates(t.papers, t.paper_embeddings, [0.1] * 64, known_papers(t.interactions, 7), keep=("year",)),
    )
    facts("T2 top-k: TakeOrderedAndProject, no global sort", top_k(t.papers, [F.col("citation_count").desc(), "paper_id"], 10))
    facts(
        "R3 global row number: checkpointed ranges + broadcast prefix sums (no SinglePartition over data)",
        global_row_number(t.papers.select("paper_id", "year"), [F.col("year").desc(), "paper_id"], "rn"),
    )
    facts("F5/F7/F8 segment token counts: explode + codegen'd projections, partial aggregation",
          long_text_counts(t.documents, "doc_id"))
    from refrank.operators.blocked import blocked_top_k
    from refrank.operators.ranking import global_row_numbers
    from refrank.plans.batch import candidate_vectors

    facts(
        "W1-W5 stacked: five rankings numbered in one pass (checkpointed ranges, broadcast offsets, pivot)",
        global_row_numbers(
            t.papers.select("paper_id", "year", "citation_count"),
            "paper_id",
            [("year_rank", "year", True), ("cite_rank", "citation_count", True)],
        ),
    )
    vecs = author_vectors(t.interactions, t.paper_embeddings).select("author_id", "embedding")
    facts(
        "R1 blocked top-k: co-grouped (author block, paper block) groups, Arrow to numpy, local top-k only",
        blocked_top_k(vecs, candidate_vectors(t.papers, t.paper_embeddings), known_papers(t.interactions), 10),
    )
    spark.stop()


if __name__ == "__main__":
    main()
