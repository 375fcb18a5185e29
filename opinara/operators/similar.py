"""Pairs of vectors from a similarity on, without the products of those that are far apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.leaders import arrays, in_blocks, near_pairs, numbered
from opinara.scratch import tidy, written

#: Rows of a block: smaller ones have smaller radii, so more pairs of blocks are left out.
BLOCK = 500


@tidy
def similar_pairs(topics: DataFrame, least: float, vector: str = "centroid", block: int = BLOCK) -> DataFrame:
    """(topic_a, topic_b, similarity) of topic pairs a < b whose inner product is ``least`` or more, best first.

    Vectors are dealt to blocks around pivots; by the triangle inequality pairs of blocks too far apart are
    left out before anything is multiplied.  A low ``least`` leaves none out.  Topic ids are unique; rows without
    a vector take no part; vectors have one length.
    """
    rows = topics.select("topic_id", F.col(vector).cast("array<double>").alias("vector")).dropna()
    rows = numbered(rows, ["topic_id"], "place")
    blocks = in_blocks(rows, block)
    pairs = near_pairs(blocks, least).unionAll(blocks.select(F.col("block").alias("a"), F.col("block").alias("b")))
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("places", "vectors", "fresh")])
    work = pairs.repartition("a", "b").hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                (one, u, _), (two, v, _) = arrays(r, "a_"), arrays(r, "b_")
                s = u @ v.T
                x, y = np.nonzero(s >= least)
                p, q, s = one[x], two[y], s[x, y]
                keep = (p < q) if r["a"] == r["b"] else np.ones(len(p), bool)
                p, q = np.minimum(p, q)[keep], np.maximum(p, q)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(s[keep])], ["p", "q", "similarity"])

    found = written(work.mapInArrow(run, "p long, q long, similarity double"), "similar-found")
    name = lambda c, to: rows.select(F.col("place").alias(c), F.col("topic_id").alias(to))
    out = found.hint("merge").join(name("p", "topic_a"), "p").hint("merge").join(name("q", "topic_b"), "q")
    return out.select("topic_a", "topic_b", "similarity").orderBy(F.desc("similarity"), "topic_a", "topic_b")
