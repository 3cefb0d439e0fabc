"""Vector expressions over ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigfolio.functions._util import as_col


def _dsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _dsum(F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_dsum(F.transform(as_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a, b) -> Column:
    """Cosine of two vectors; a zero vector gives 0 (never NaN or an error)."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
