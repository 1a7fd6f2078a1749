"""Schemas of the stored tables and of the paper JSON input."""

from pyspark.sql import types as T

# The four kinds of known paper an author profile holds.
KIND_WRITE = "write"
KIND_REFERENCE = "reference"
KIND_LIKED = "liked"
KIND_NOT_LIKED = "not liked"
# Kinds that feed the profile vector; "not liked" is excluded from results but never averaged.
PROFILE_KINDS = (KIND_WRITE, KIND_REFERENCE, KIND_LIKED)

AUTHOR_REF = T.StructType(
    [T.StructField("authorId", T.StringType()), T.StructField("name", T.StringType())]
)
PAPER_REF = T.StructType([T.StructField("paperId", T.StringType())])

# One paper record as the search API lands it (JSON); resolved by name, not by position.
PAPER_JSON = T.StructType(
    [
        T.StructField("paperId", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("referenceCount", T.LongType()),
        T.StructField("citationCount", T.LongType()),
        T.StructField("influentialCitationCount", T.LongType()),
        T.StructField("authors", T.ArrayType(AUTHOR_REF)),
        T.StructField("references", T.ArrayType(PAPER_REF)),
    ]
)

# Ids are strings in production and BIGINT in the test mapping; operators know stored tables by column name.

# Orderable numeric fields of a paper (browse by field and the weighted model).
RANK_FIELDS = ("year", "reference_count", "citation_count", "influential_citation_count")
