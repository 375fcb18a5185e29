"""Vector arithmetic as column expressions, and block products for volume."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_NORM = 1e-12
#: Items of one part that meets a block of centroids, about.
ITEMS = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """``a`` over its norm, which is worked out once."""
    once = F.array(F.greatest(norm(a), F.lit(LEAST_NORM)))
    return F.transform(once, lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def mean_vectors(df: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(key, n, centroid): the normalised mean vector of each key, summed by component."""
    w = F.lit(1.0) if weight is None else weight
    flat = df.select(key, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = flat.groupBy(key, "i").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.sum("w").alias("n"))
    out = sums.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v"))
    return out.select(key, "n", l2_normalize(F.col("v.s")).alias("centroid"))


def nearest(items: DataFrame, centroids: DataFrame, k: int = 1, item: str = "id", vector: str = "vector", limit: int = 200_000) -> DataFrame:
    """(item, topic_id, similarity, rank): the k nearest centroids by inner product.

    Centroids of at most ``limit`` numbers are broadcast and multiplied in blocks; above it they are
    cut into blocks that each block of items is joined to.  Equal similarities go to the lesser id.
    """
    found = centroids.select("topic_id", F.col("centroid").cast("array<double>").alias("c"))
    size = found.agg(F.count(F.lit(1)), F.max(F.size("c"))).first()
    schema = f"{item} {dict(items.dtypes)[item]}, topic_id {dict(centroids.dtypes)['topic_id']}, similarity double"
    if size[0] * (size[1] or 0) <= limit:
        rows = sorted((r.topic_id, r.c) for r in found.collect())
        shared = items.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)))

        def run(batches: Iterator[pd.DataFrame]):
            ids, matrix = shared.value
            for b in batches:
                if not len(ids) or not len(b):
                    continue
                s = np.stack(b[vector].to_numpy()).astype(float) @ matrix.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({item: np.repeat(b[item].to_numpy(), best.shape[1]), "topic_id": ids[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()})

        out = items.select(item, vector).mapInPandas(run, schema)
    else:
        # parts of the items in proportion to their number, so that a part is a bounded block
        salts = max(1, -(-items.count() // ITEMS))
        blocks = found.withColumn("block", F.pmod(F.xxhash64("topic_id"), F.lit(-(-size[0] * size[1] // limit))))
        wide = items.select(item, vector).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-size[0] * size[1] // limit) - 1).cast("long"))))

        def pair(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({item: [], "topic_id": [], "similarity": []})
            right = right.sort_values("topic_id")
            s = np.stack(left[vector].to_numpy()).astype(float) @ np.stack(right["c"].to_numpy()).T
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            return pd.DataFrame({item: np.repeat(left[item].to_numpy(), best.shape[1]), "topic_id": right["topic_id"].to_numpy()[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()})

        salt = F.pmod(F.xxhash64(item), F.lit(salts))
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        out = wide.withColumn("salt", salt).groupBy("block", "salt").cogroup(blocks.groupBy("block", "salt")).applyInPandas(pair, schema)
    from pyspark.sql import Window as W

    best = W.partitionBy(item).orderBy(F.desc("similarity"), "topic_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def running_mean(old: Column, n: Column, total: Column, m: Column) -> Column:
    """Normalised mean of ``n`` vectors with mean ``old`` and ``m`` with sum ``total``."""
    return l2_normalize(F.zip_with(old, total, lambda x, y: (x.cast("double") * n + y) / (n + m)))
