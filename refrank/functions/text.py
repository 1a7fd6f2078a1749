"""Text column functions: sliding segments and token feature hashing (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment width and step in characters (half-overlapping windows).
SEGMENT_WIDTH = 5500
SEGMENT_STEP = 2750
# Width of the hashed token vector.
DEFAULT_DIM = 64
# Tokens are maximal runs of ASCII letters and digits, lower-cased.
TOKEN_SPLIT = "[^A-Za-z0-9]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segments(text: Column | str, width: int = SEGMENT_WIDTH, step: int = SEGMENT_STEP) -> Column:
    """array of substrings starting at 0, step, 2*step, … while start < length; each at most
    ``width`` characters (the last may lie inside the previous one). Empty/NULL text -> []."""
    t = _c(text)
    n = F.length(t)
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.substring(t, i + 1, width))
    )


def token_bucket(token: Column | str, dim: int = DEFAULT_DIM) -> Column:
    """Bucket of a token: first 32 bits of its MD5, modulo ``dim`` (reproducible in any SQL engine)."""
    return (F.conv(F.substring(F.md5(_c(token)), 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int")
