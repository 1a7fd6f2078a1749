"""Vector column functions (JVM-side higher-order expressions, no Python per row)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0.0 when either vector has zero norm (as scikit-learn does)."""
    denom = norm(a) * norm(b)
    return F.when(denom == 0, F.lit(0.0)).otherwise(dot(a, b) / denom)


def cosine_to_constant(a: Column | str, q: Sequence[float]) -> Column:
    """Cosine of each row vector against one fixed query vector (its norm folded on the driver)."""
    qn = sum(x * x for x in q) ** 0.5
    if qn == 0:
        return F.lit(0.0)
    qlit = F.array(*[F.lit(float(x)) for x in q])
    an = norm(a)
    return F.when(an == 0, F.lit(0.0)).otherwise(dot(a, qlit) / (an * F.lit(qn)))


def vector_add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vector_scale(a: Column | str, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def unit(a: Column | str) -> Column:
    """``a`` divided by its norm; the norm is computed once a row, not once a component."""
    scaled = lambda n: F.when(n == 0, _c(a)).otherwise(F.transform(_c(a), lambda x: x / n))
    return F.transform(F.array(norm(a)), scaled)[0]


# Default weights of the weighted model (cosine, references, citations,
# influential citations, year) and the tolerance of the weight-sum check.
DEFAULT_WEIGHTS = (0.6, 0.1, 0.1, 0.1, 0.1)
WEIGHT_SUM_TOLERANCE = 1e-5


def check_weights(weights: Sequence[float]) -> bool:
    """Warn (never fail) when the weights do not sum to one; returns whether they do."""
    if len(weights) != 5:
        raise ValueError("the weighted model takes exactly five weights")
    ok = abs(sum(weights) - 1.0) <= WEIGHT_SUM_TOLERANCE
    if not ok:
        warnings.warn(f"weights sum to {sum(weights)}, not 1; the ranking still runs", stacklevel=2)
    return ok


def linear_score(ranks: Sequence[Column | str], weights: Sequence[float]) -> Column:
    """w1*r1 + w2*r2 + ... evaluated left to right in double precision."""
    out = None
    for r, w in zip(ranks, weights, strict=True):
        term = F.lit(float(w)) * _c(r)
        out = term if out is None else out + term
    return out
