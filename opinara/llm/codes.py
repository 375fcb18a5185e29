"""Vectors as whole numbers, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers stop here, so that their sums over a table fit decimals.
MOST = 2.0**62


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has finite components alone."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as long; beyond 2^62 it stops there."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))).cast("long"))


def coded(vectors: DataFrame, scale: int, column: str = "embedding") -> DataFrame:
    """``vectors`` that are usable, with ``code``."""
    return vectors.filter(usable(F.col(column))).withColumn("code", whole(F.col(column), scale))
