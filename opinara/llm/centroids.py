"""Centroid clustering with subvector dictionaries.

Vectors of whole numbers are encoded without loss: the dimensions are cut into blocks, and each
distinct subvector of a block gets a code.  Blocks are as wide as the numbers of distinct values of
their dimensions allow: the product bounds a block's dictionary.  In each round the exact squared
distances of every dictionary entry to the centroids are worked out once; a vector's distance is the
sum of its codes' entries.  New centroids are sums by cluster and code as well, weighted with the
entries' values.

Dictionaries, distances and centroids are the only things that leave Spark, all of a counted size.
Where the distinct values are too many for that, every Arrow batch of vectors has dictionaries of its
own, with the same results.  A round is one job over the codes, without a shuffle but that of
the sums (one row for each task, cluster and dimension).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.codes import coded
from opinara.scratch import tidy, written

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Bytes of the table of distances that goes to all executors, and entries of a block wider than one dimension.
TABLE_BYTES, BLOCK = 32_000_000, 4096
_MOST = (1 << 63) - 1


class Dictionary:
    """Distinct values by dimension, and blocks of dimensions with their distinct subvectors."""

    def __init__(self, values: list[np.ndarray], blocks: list[tuple[int, int]] | None = None, keys: list[np.ndarray] | None = None):
        self.values = values
        self.blocks = blocks or [(d, d + 1) for d in range(len(values))]
        #: A subvector as one number: its values' places, the last dimension's as the lowest digit.
        self.keys = keys or [np.arange(len(v)) for v in values]
        sizes = [len(k) for k in self.keys]
        self.begin = np.r_[0, np.cumsum(sizes)]

    @classmethod
    def of(cls, vectors: np.ndarray) -> tuple[Dictionary, np.ndarray]:
        """A dictionary of these vectors alone, and their codes."""
        found = [np.unique(vectors[:, d], return_inverse=True) for d in range(vectors.shape[1])]
        own = cls([v for v, _ in found])
        return own, np.stack([inverse + own.begin[d] for d, (_, inverse) in enumerate(found)], 1) if found else np.zeros(vectors.shape, np.int64)

    def wide_blocks(self, most: int = BLOCK) -> list[tuple[int, int]]:
        """Neighbouring dimensions together, as long as no more than ``most`` subvectors are possible."""
        out, begin, product = [], 0, 1
        for d, v in enumerate(self.values):
            if d > begin and product * len(v) > most:
                out.append((begin, d))
                begin, product = d, 1
            product *= len(v)
        return [*out, (begin, len(self.values))] if self.values else []

    def numbers(self, vectors: np.ndarray, blocks: list[tuple[int, int]]) -> list[np.ndarray]:
        """Each block's subvectors as numbers."""
        out = []
        for a, b in blocks:
            number = np.zeros(len(vectors), np.int64)
            for d in range(a, b):
                number = number * len(self.values[d]) + np.searchsorted(self.values[d], vectors[:, d])
            out.append(number)
        return out

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, blocks) places of their subvectors in the table of all entries."""
        numbers = self.numbers(vectors, self.blocks)
        return np.stack([np.searchsorted(k, n) + b for k, n, b in zip(self.keys, numbers, self.begin[:-1], strict=True)], 1)

    def entries(self, block: int) -> list[np.ndarray]:
        """Values of the block's entries, by dimension."""
        a, b = self.blocks[block]
        rest, out = self.keys[block], []
        for d in range(b - 1, a - 1, -1):
            rest, digit = np.divmod(rest, len(self.values[d]))
            out.append(self.values[d][digit])
        return out[::-1]

    def distances(self, centroids: list[list[int]]) -> np.ndarray:
        """(entries, centroids): exact squared distances of all entries."""
        far = max((int(abs(v).max(initial=0)) for v in self.values), default=0) + max((abs(x) for c in centroids for x in c), default=0)
        kind = np.int64 if far * far * max(1, len(self.values)) < 1 << 62 else object
        out = np.zeros((int(self.begin[-1]), len(centroids)), kind)
        for i, (a, b) in enumerate(self.blocks):
            for d, values in zip(range(a, b), self.entries(i), strict=True):
                off = values.astype(kind)[:, None] - np.array([c[d] for c in centroids], kind)[None]
                out[self.begin[i] : self.begin[i + 1]] += off * off
        return out


def nearest_codes(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance): the sums of the codes' entries, and which is least (ties: smaller number)."""
    total = np.zeros((len(codes), table.shape[1]), table.dtype)
    for block in codes.T:
        total += table[block]
    cluster = np.argmin(total, 1) if len(codes) else np.zeros(0, np.int64)
    return cluster, total[np.arange(len(codes)), cluster]


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _distinct_values(rows: DataFrame, dim: int) -> DataFrame:
    """(d, value), each once."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = [np.unique(v) for v in _flat(b.column(0), dim).T]
            d = np.repeat(np.arange(dim, dtype=np.int32), [len(v) for v in found])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["d", "value"])

    return written(rows.select("code").mapInArrow(run, "d int, value long").distinct(), "cluster-values")


def dictionary(rows: DataFrame, dim: int, most: int) -> Dictionary | None:
    """The dictionary of all rows, None if it has more than ``most`` entries."""
    spark, values = rows.sparkSession, _distinct_values(rows, dim)
    if values.count() > most:
        return None
    table = values.toArrow()  # counted
    d, v = np.asarray(table["d"]), np.asarray(table["value"])
    narrow = Dictionary([np.sort(v[d == i]) for i in range(dim)])
    blocks = narrow.wide_blocks()
    if len(blocks) == dim:
        return narrow
    shared = spark.sparkContext.broadcast(narrow)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = [np.unique(n) for n in shared.value.numbers(_flat(b.column(0), dim), blocks)]
            block = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(n) for n in found])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.concatenate(found))], ["block", "number"])

    # no more than BLOCK a block, or than the values of a dimension
    table = rows.select("code").mapInArrow(run, "block int, number long").distinct().toArrow()
    block, number = np.asarray(table["block"]), np.asarray(table["number"])
    return Dictionary(narrow.values, blocks, [np.sort(number[block == i]) for i in range(len(blocks))])


@tidy
def centroid_clusters(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each usable vector.

    Usable are vectors of exactly ``dim`` components, none null or non-finite.  Components count as
    floor(scale * x), beyond 2^62 as that.  The first centroids are the ``k`` vectors of the least sha256 of
    ``seed:key``; ties go to the lesser vector, null keys are last.  With fewer vectors there are as many
    centroids; an empty table gives an empty one.  Ties of distances go to the smaller number.  Rows that
    repeat a key count each.  distance and the inertias stop at the bound of 64 bits.  Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = coded(vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).filter(F.size("v") == dim), scale, "v").select("id", "code")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select("code", draw.alias("draw")).orderBy(F.asc_nulls_last("draw"), "code").limit(k).collect()
    centroids = [list(r.code) for r in first]
    known = dictionary(rows, dim, max(1, table_bytes // (8 * k)))
    if known:
        shared = spark.sparkContext.broadcast(known)
        small = "int" if known.begin[-1] < 1 << 31 else "long"

        def encode(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                codes = shared.value.encode(_flat(b.column(1), dim))
                offsets = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel().astype(np.int32 if small == "int" else np.int64)))], ["id", "code"])

        rows = rows.mapInArrow(encode, f"id long, code array<{small}>")
    rows = written(rows, "cluster-codes")
    width = len(known.blocks) if known else dim

    def assigned(centroids: list[list[int]]):
        """A function of a batch: (codes, dictionary, cluster, distance)."""
        table = spark.sparkContext.broadcast(known.distances(centroids)) if known else None

        def run(column: pa.Array):
            flat = _flat(column, width)
            own, codes = (shared.value, flat) if known else Dictionary.of(flat)
            return codes, own, *nearest_codes(codes, table.value if known else own.distances(centroids))

        return run

    n_centroids = len(centroids)
    for _ in range(rounds if n_centroids else 0):
        near = assigned(centroids)

        def sums(batches: Iterator[pa.RecordBatch], near=near):
            total, count = [[0] * dim for _ in range(n_centroids)], np.zeros(n_centroids, np.int64)
            uses, own = None, None

            def add():
                for i, (a, b) in enumerate(own.blocks):
                    n = uses[:, own.begin[i] : own.begin[i + 1]]
                    for d, values in zip(range(a, b), own.entries(i), strict=True):
                        most = int(abs(values).max(initial=0)) * int(n.sum(1).max(initial=0))
                        for c, s in enumerate((n if most < 1 << 62 else n.astype(object)) @ (values if most < 1 << 62 else values.astype(object))):
                            total[c][d] += int(s)

            for b in batches:
                codes, own, cluster, _ = near(b.column(0))
                n = int(own.begin[-1])
                batch = sum((np.bincount(cluster * n + block, minlength=n_centroids * n) for block in codes.T), np.zeros(n_centroids * n, np.int64)).reshape(n_centroids, n)
                count += np.bincount(cluster, minlength=n_centroids)
                uses = batch if uses is None or not known else uses + batch
                if not known:
                    add()
            if known and own:
                add()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n_centroids, dtype=np.int32), dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), n_centroids)), pa.array(np.repeat(count, dim)), pa.array([Decimal(x) for t in total for x in t], pa.decimal128(38, 0))], ["cluster", "d", "n", "total"])

        sums_ = rows.select("code").mapInArrow(sums, "cluster int, d int, n long, total decimal(38,0)").groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in sums_.collect():  # k * dim rows
            if r.n:
                centroids[r.cluster][r.d] = int(r.total) // r.n
    near = assigned(centroids) if n_centroids else None

    def last(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            *_, cluster, distance = near(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array([min(int(x), _MOST) for x in distance], pa.int64())], [key, "cluster", "distance"])

    found = written((rows.mapInArrow(last, f"`{key}` long, cluster int, distance long") if near else rows.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))), "cluster-found")
    # one row a cluster
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    all_ = min(sum(inertia.values()), _MOST)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, min(n, _MOST), all_, sha[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    """Every round as two tables: assignments, then centroids."""
    out = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "e AS MATERIALIZED (SELECT own, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM v)",
        f"f AS (SELECT c, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, c) - 1 AS k FROM v)",
        f"c0 AS MATERIALIZED (SELECT k, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM f WHERE k < {K})",
    ]
    for r in range(rounds + 1):
        out.append(f"d{r} AS (SELECT own, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS distance FROM e JOIN c{r} USING (i) GROUP BY 1, 2)")
        out.append(f"a{r} AS MATERIALIZED (SELECT own, arg_min(k, (distance, k)) AS k, min(distance) AS distance FROM d{r} GROUP BY 1)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{r} USING (own) GROUP BY 1, 2)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{r} c LEFT JOIN s{r} s ON c.k = s.k AND c.i = s.i)")
    out.append(f"h AS (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)")
    return f"""WITH {", ".join(out)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (own) JOIN h USING (k)"""


ORACLE = _oracle()
