"""Vector expressions as Catalyst higher-order functions (JVM side).

Vectors are stored as ``array<float>``; arithmetic is done in double so that
results agree with other engines that widen the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def sq_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def unit_length(v) -> Column:
    """Unit-length vector of floats; a zero vector stays zero, and one that is of
    unit length already (to 1e-6) stays as it is, cell by cell."""
    v = _c(v)
    n = l2_norm(v)
    scaled = F.transform(v, lambda x: (x.cast("double") / n).cast("float"))
    return F.when((n == 0) | (F.abs(n - 1) < 1e-6), v.cast("array<float>")).otherwise(scaled)


def sq_l2(a, b) -> Column:
    """Squared Euclidean distance, summed left to right in double."""
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double"))
                       * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, d: acc + d)


def l2_score(d2) -> Column:
    """Relevance score for an L2 space: 1 / (1 + d2)."""
    return F.lit(1.0) / (F.lit(1.0) + _c(d2))


def dim(v) -> Column:
    return F.size(_c(v))
