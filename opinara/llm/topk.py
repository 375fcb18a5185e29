"""Exact top-k by inner product in norm buckets.

Vectors are sorted by length over the cluster and cut into blocks; each block is a bucket of
vectors of nearly one length.  Queries are cut into blocks too, and each pair of a query block and
a bucket is one unit of work, so neither side is ever whole in one place.  A first round over the
longest bucket gives each query a lower bound of its k-th score.  From it follows, by bucket, a
local cosine threshold: over 1 for all queries of a block, the pair is left out before anything is
shipped; high, and the feasible interval of the query's largest coordinates prunes the bucket;
low, and the bucket's vectors are pruned by length.  Products of the rest are verified in integers.

Components are whole numbers of 32 bits as a rule.  Vectors with a wider one ("wide") stand in buckets of
their own, as doubles that are exact multiples of 1 / scale; those pairs are not pruned, and
products that 64 bits may not hold are worked out in integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.scratch import tidy, written

SCALE, K = 64, 20
BUCKET, QUERY_BLOCK, SALTS = 4096, 1024, 64
#: Local cosine threshold from which coordinates prune better than lengths, and coordinates used.
COORDINATE_FROM, FOCUS = 0.7, 3
_LARGEST = 2.0**31
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Bytes of a score beyond 64 bits, and what is added to it so that it is not negative.
_WIDE_BYTES = 272
_SHIFT = 1 << (8 * _WIDE_BYTES - 8)


def quantized(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, id, dim, wide, norm, code) of usable vectors.  code: floor(scale * x) of each component as int32, or
    of wide vectors floor(scale * x) / scale as doubles (``scale`` is a power of two).  row numbers the rows.

    Null ids, null vectors and vectors with a null or non-finite component take no part; an empty
    vector does, with products 0.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            number, ids, column = b.columns
            flat = column.flatten()
            values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
            ends = np.cumsum(sizes)
            none = np.r_[0, np.cumsum(~np.isfinite(values))]
            rows = np.flatnonzero((none[ends] == none[ends - sizes]) & np.array(column.is_valid()) & np.array(ids.is_valid()))
            with np.errstate(over="ignore", invalid="ignore"):
                code = np.floor(values * scale)
            over = np.r_[0, np.cumsum(~(np.abs(code) < _LARGEST))]
            wide = over[ends[rows]] > over[ends[rows] - sizes[rows]]
            out, norms = [], []
            for i, w in zip(rows, wide, strict=True):
                own = slice(ends[i] - sizes[i], ends[i])
                if w:
                    # from 2^53 on a double is whole, and scaling it might overflow
                    out.append(np.where(np.abs(values[own]) < 2.0**53, np.where(np.isfinite(code[own]), code[own], 0) / scale, values[own]).tobytes())
                    norms.append(np.inf)
                else:
                    out.append(code[own].astype(np.int32).tobytes())
                    norms.append(float(np.sqrt((code[own] ** 2).sum())))
            cols = [number.take(pa.array(rows)), ids.take(pa.array(rows)), pa.array(sizes[rows].astype(np.int32)), pa.array(wide, pa.bool_()), pa.array(norms, pa.float64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "id", "dim", "wide", "norm", "code"])

    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    return source.mapInArrow(run, "row long, id long, dim int, wide boolean, norm double, code binary")


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of ``size`` rows of one dimension and width, longest vectors first, written: (block, dim, wide,
    top, n, rows, ids, norms, codes)."""
    order = ["dim", F.desc("norm"), "id", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]):
        held, kind, part, seq = [], None, 0, 0

        def close():
            nonlocal seq
            seq += 1
            number, ids, norms, codes = zip(*held, strict=True)
            return pa.RecordBatch.from_pylist([{"block": part * 10_000_000 + seq, "dim": kind[0], "wide": kind[1], "top": norms[0], "n": len(ids), "rows": np.array(number, np.int64).tobytes(), "ids": np.array(ids, np.int64).tobytes(), "norms": np.array(norms).tobytes(), "codes": b"".join(codes)}], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("wide", pa.bool_()), ("top", pa.float64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("rows", "ids", "norms", "codes")]])
        for b in batches:
            for number, i, d, wide, norm, code, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and ((d, wide) != kind or len(held) == size):
                    yield close()
                    held.clear()
                kind, part = (d, wide), p
                held.append((number, i, norm, code))
        if held:
            yield close()

    return written(ranged.mapInArrow(run, "block long, dim int, wide boolean, top double, n int, rows binary, ids binary, norms binary, codes binary"), name)


def _whole(codes: np.ndarray, scale: int) -> np.ndarray:
    """Codes of a block as Python integers."""
    if codes.dtype != np.float64:
        return codes.astype(object)
    flat = [int(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in codes.ravel().tolist()]
    out = np.empty(codes.size, dtype=object)
    out[:] = flat
    return out.reshape(codes.shape)


def _products(q: np.ndarray, p: np.ndarray, scale: int) -> np.ndarray:
    """Exact integer products: in floating point or 64 bits only where these hold them, else Python integers."""
    if q.shape[1] == 0:
        return np.zeros((len(q), len(p)), np.int64)
    if q.dtype != np.float64 and p.dtype != np.float64:
        bound = float(np.abs(q.astype(np.int64)).max(initial=0)) * float(np.abs(p.astype(np.int64)).max(initial=0)) * q.shape[1]
        if bound < 2.0**53:
            return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
        if bound < 2.0**62:
            return q.astype(np.int64) @ p.astype(np.int64).T
    return _whole(q, scale) @ _whole(p, scale).T


def _best(own: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows but ``own``."""
    keep = rows != own
    ids, scores = ids[keep], scores[keep]
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[order], scores[order]
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(query, bounds, limits, bucket, k, scale):
    """(row, id, ids, scores) of each query: its best of the bucket among scores above its bound, or at it with an
    id up to its limit: the bound's k-th row stands before all others, so copies of one vector are few."""
    qrows, qids, qnorms, q = query
    rows, ids, norms, p = bucket
    if q.dtype == np.float64 or p.dtype == np.float64:
        for at in range(0, len(qids), 64):
            for i, s in enumerate(_products(q[at : at + 64], p, scale), at):
                yield qrows[i], qids[i], *_best(qrows[i], rows, ids, s, k)
        return
    unit = None
    local = np.where(qnorms * norms[0] > 0, bounds / np.maximum(qnorms * norms[0], 1e-300), np.where(bounds > 0, 2.0, -1.0))
    by_length = np.flatnonzero(local < COORDINATE_FROM)
    for at in range(0, len(by_length), 64):
        some = by_length[at : at + 64]
        least = np.where(bounds[some] > 0, bounds[some] / np.maximum(qnorms[some], 1e-300) * (1 - 1e-9), -1.0)
        upto = int(np.searchsorted(-norms, -least.min(), "right"))
        scores = _products(q[some], p[:upto], scale)
        for i, s in zip(some, scores, strict=True):
            good = ((s > bounds[i]) | ((s == bounds[i]) & (ids[:upto] <= limits[i]))).astype(bool)
            yield qrows[i], qids[i], *_best(qrows[i], rows[:upto][good], ids[:upto][good], s[good], k)
    for i in np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + 1e-9)):
        if unit is None:
            unit = p / np.maximum(norms, 1e-300)[:, None]
        t, qu = min(1.0, local[i]), q[i] / qnorms[i]
        good = np.ones(len(p), bool)
        for f in np.argsort(-np.abs(qu))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - qu[f] ** 2))) + 1e-9
            # a cosine of t or more needs this coordinate at least so near to the query's
            good &= (unit[:, f] >= qu[f] * t - spread) if qu[f] > 0 else (unit[:, f] <= qu[f] * t + spread)
        some = np.flatnonzero(good)
        s = _products(q[i : i + 1], p[some], scale)[0]
        enough = ((s > bounds[i]) | ((s == bounds[i]) & (ids[some] <= limits[i]))).astype(bool)
        yield qrows[i], qids[i], *_best(qrows[i], rows[some][enough], ids[some][enough], s[enough], k)


def _beyond(score: int) -> bytes | None:
    """What orders scores that 64 bits do not hold: None for those that they do."""
    return None if _LEAST < score < _MOST else (int(score) + _SHIFT).to_bytes(_WIDE_BYTES, "big")


def salted(df: DataFrame, by: str) -> DataFrame:
    """One dimension is the rule, so its rows are dealt by a salt too."""
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def over_salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _arrays(row, prefix: str):
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    codes = np.frombuffer(row[f"{prefix}codes"], np.float64 if row[f"{prefix}wide"] else np.int32)
    return np.frombuffer(row[f"{prefix}rows"], np.int64), ids, np.frombuffer(row[f"{prefix}norms"], np.float64), codes.reshape(len(ids), row["dim"])


@tidy
def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", column: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each query row.

    Ties go to the smaller id.  Candidates are all rows but the query's own: a row that repeats an id is
    one too, and a repeated query row has results of its own.  Vectors are compared with those of
    their own dimension.  With fewer candidates than k, all are returned; an empty table gives an
    empty one.  Columns beyond key and vector are ignored.  ``score`` stops at the bounds of 64 bits; the
    order beyond them is that of the true products.
    """
    rows = written(quantized(vectors, key, column, scale), "topk-vectors")
    buckets = blocks(rows, BUCKET, "topk-buckets")
    parts = ("wide", "rows", "ids", "norms", "codes")
    asked = blocks(rows.filter(is_query), QUERY_BLOCK, "topk-queries").select(F.col("block").alias("q"), "dim", *[F.col(c).alias(f"q_{c}") for c in parts])
    # any bucket gives a valid bound: the longest of vectors that are not wide, if there is one
    first = buckets.groupBy("dim").agg(F.max_by("block", F.struct(~F.col("wide"), "top", "block")).alias("block"))
    first = first.hint("merge").join(buckets.drop("dim"), "block")
    longest = salted(asked, "q").join(over_salts(first).hint("shuffle_hash"), ["dim", "salt"])

    def seed(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                qrows, qids, qnorms, q = _arrays(r, "q_")
                others, ids, _, p = _arrays(r, "")
                bounds, limits = np.full(len(qids), _LEAST, np.int64), np.full(len(qids), _MOST, np.int64)
                if not (r["wide"] or r["q_wide"]):
                    for i, s in enumerate(_products(q, p, scale)):
                        v, best = _best(qrows[i], others, ids, s, k)
                        if len(v) == k and _LEAST < best[-1] < _MOST:
                            bounds[i], limits[i] = best[-1], v[-1]
                need = float(np.where(bounds > 0, bounds / np.maximum(qnorms, 1e-300), -1.0).min())
                yield pa.RecordBatch.from_arrays([pa.array([r["q"]]), pa.array([need]), pa.array([bounds.tobytes()], pa.binary()), pa.array([limits.tobytes()], pa.binary())], ["q", "need", "bounds", "limits"])

    bounds = written(longest.mapInArrow(seed, "q long, need double, bounds binary, limits binary"), "topk-bounds")
    ready = bounds.hint("merge").join(asked, "q")
    # ids of blocks alone are paired, a few bytes for each BUCKET * QUERY_BLOCK products
    ids = salted(bounds.select("q", "need").hint("merge").join(asked.select("q", "dim"), "q"), "q")
    pairs = ids.hint("shuffle_hash").join(over_salts(buckets.select("block", "dim", "top")), ["dim", "salt"]).filter(F.col("top") >= F.col("need") * (1 - 1e-9)).select("q", "block")
    work = written(pairs.repartition("q", "block"), "topk-pairs")
    work = work.hint("merge").join(ready, "q").hint("merge").join(buckets.drop("dim"), "block")

    def search(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                bounds, limits = (np.frombuffer(r[c], np.int64) for c in ("bounds", "limits"))
                qrows, qids, ids, scores = [], [], [], []
                for row, qid, v, s in _search(_arrays(r, "q_"), bounds, limits, _arrays(r, ""), k, scale):
                    qrows += [row] * len(v)
                    qids += [qid] * len(v)
                    ids += v.tolist()
                    scores += s.tolist()
                held = [min(max(x, _LEAST), _MOST) for x in scores]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (qrows, qids, ids, held)], pa.array(map(_beyond, scores), pa.binary())], ["row", "query_id", "vec_id", "score", "beyond"])

    found = work.mapInArrow(search, "row long, query_id long, vec_id long, score long, beyond binary")
    # a product of exactly the bound is marked too, so null is below every mark above it and no null stands at the lower one
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT own, vec_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM v),
s AS (SELECT q.own, p.own AS other, q.vec_id AS query_id, p.vec_id, CAST(sum(q.x * p.x) AS BIGINT) AS score FROM e q JOIN e p ON q.i = p.i AND q.own <> p.own
  WHERE q.vec_id % 20 = 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
