"""Hard-negative mining by a secondary sort.

Anchors are a query set, compared in blocks with blocks of all rows.  A first pass keeps each block's
best rows of the anchor's label, which gives every anchor's positives.  A second pass knows the
positives' scores and keeps, for each of their windows, the block's best rows of other labels in it;
so only pairs that may stand in the result are shuffled.

A pair is a packed key: anchor, score (negated, so that higher scores come first), positive before
negative, id.  ``repartitionAndSortWithinPartitions`` brings each anchor's keys together in this order,
and an iterator passes over them once: a positive opens a window, a negative is given out for every
window that it lies in and that is not full, a window closes when the scores fall below it.  It
holds an anchor's open windows, no anchor's pairs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.codes import coded
from opinara.scratch import tidy, written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Rows and anchors of a block, and anchors that are multiplied at a time.
BLOCK, ANCHORS, STEP, SALTS = 4096, 512, 64, 64
#: Scores are sums of products of whole numbers up to 2^62, so 20 bytes hold them with up to 2^31 components.
_WIDTH, _ZERO = 20, 1 << 157
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: anchor's row, score, kind, id, row, anchor's id
_KEY = struct.Struct(f">q{_WIDTH}sBQqq")
POSITIVE, NEGATIVE = 0, 1


def pack(anchor: int, score: int, kind: int, id_: int, row: int, anchor_id: int) -> bytes:
    """A pair as bytes that sort by anchor, falling score, kind and id."""
    return _KEY.pack(anchor, (_ZERO - int(score)).to_bytes(_WIDTH, "big"), kind, id_ - _LEAST, row, anchor_id)


def unpack(key: bytes) -> tuple[int, int, int, int, int, int]:
    anchor, score, kind, id_, row, anchor_id = _KEY.unpack(key)
    return anchor, _ZERO - int.from_bytes(score, "big"), kind, id_ + _LEAST, row, anchor_id


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point or 64 bits only where these hold them, else Python integers."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(p.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if bound < 2.0**53:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ p.astype(np.int64).T
    return q.astype(object) @ p.astype(object).T if q.shape[1] else np.zeros((len(q), len(p)), np.int64)


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of about ``size`` rows of one dimension, written: (block, dim, rows, ids, labels, codes)."""
    parts = max(1, -(-rows.count() // size))

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4).to_numpy(zero_copy_only=False), strict=True):
                held.setdefault(r[3], []).append(r)
                if len(held[r[3]]) == size:
                    yield block(held.pop(r[3]))
        for some in held.values():
            yield block(some)

    def block(some: list) -> pa.RecordBatch:
        number, ids, labels, dims, codes = zip(*some, strict=True)
        flat = np.concatenate(codes).astype(np.int64)
        narrow = flat.astype(np.int32)
        wide = not np.array_equal(narrow, flat)
        arrays = [np.array(x, np.int64).tobytes() for x in (number, ids, labels)]
        # a row stands in one block, so its number names the block
        return pa.RecordBatch.from_pylist([{"block": number[0], "dim": dims[0], "wide": wide, **dict(zip(("rows", "ids", "labels"), arrays, strict=True)), "codes": (flat if wide else narrow).tobytes()}], schema=schema)

    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("wide", pa.bool_()), *[(c, pa.binary()) for c in ("rows", "ids", "labels", "codes")]])
    dealt = rows.select("row", "id", "label", F.size("code").alias("dim"), "code").repartition(parts)
    return written(dealt.mapInArrow(run, "block long, dim int, wide boolean, rows binary, ids binary, labels binary, codes binary"), name)


def _arrays(r: dict, prefix: str = ""):
    rows, ids, labels = (np.frombuffer(r[f"{prefix}{c}"], np.int64) for c in ("rows", "ids", "labels"))
    return rows, ids, labels, np.frombuffer(r[f"{prefix}codes"], np.int64 if r[f"{prefix}wide"] else np.int32).reshape(len(rows), r["dim"])


def _first(some: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> list[int]:
    """The ``n`` first places of ``some``: higher scores, then smaller ids, then rows."""
    if scores.dtype == object:
        return sorted(some.tolist(), key=lambda i: (-scores[i], ids[i], rows[i]))[:n]
    if len(some) > n:
        own = scores[some]
        some = some[own >= np.partition(own, len(own) - n)[len(own) - n]]
    return some[np.lexsort((rows[some], ids[some], -scores[some]))][:n].tolist()


def _steps(r: dict):
    """(anchor's row, id, label, scores, row block) of every anchor of a pair of blocks."""
    rows, ids, labels, q = _arrays(r, "q_")
    block = _arrays(r)
    for at in range(0, len(rows), STEP):
        for i, scores in enumerate(products(q[at : at + STEP], block[3]), at):
            yield int(rows[i]), int(ids[i]), int(labels[i]), scores, block


def positives_of(r: dict, n: int) -> Iterator[bytes]:
    """The block's first rows of each anchor's label."""
    for row, id_, label, scores, (rows, ids, labels, _) in _steps(r):
        for i in _first(np.flatnonzero((labels == label) & (rows != row)), scores, ids, rows, n):
            yield pack(row, scores[i], POSITIVE, int(ids[i]), int(rows[i]), id_)


def negatives_of(r: dict, n: int, low: int, high: int) -> Iterator[bytes]:
    """The block's first rows of other labels in each window of ``positives``."""
    windows: dict[int, set[int]] = {}
    for key in r["positives"]:
        anchor, score, *_ = unpack(key)
        windows.setdefault(anchor, set()).add(score)
    for row, id_, label, scores, (rows, ids, labels, _) in _steps(r):
        others = np.flatnonzero(labels != label)
        own, kept = scores[others], set()
        if len(own) and own.dtype != object and max(abs(int(own.max())), abs(int(own.min()))) > _MOST // max(low, high, 100):
            own, scores = own.astype(object), scores.astype(object)
        for top in windows.get(row, ()):
            # 100 * score between low and high times the positive's, in whole numbers
            least, most = -(-low * top // 100), high * top // 100
            if own.dtype != object:
                least, most = max(least, _LEAST), min(most, _MOST)
            kept.update(_first(others[((own >= least) & (own <= most)).astype(bool)], scores, ids, rows, n))
        for i in kept:
            yield pack(row, scores[i], NEGATIVE, int(ids[i]), int(rows[i]), id_)


def mined(keys: Iterator[bytes], n: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of the result from sorted keys, in one pass."""
    anchor, open_ = None, []
    held = lambda x: min(max(x, _LEAST), _MOST)
    for key in keys:
        row, score, kind, id_, _, anchor_id = unpack(key)
        if row != anchor:
            anchor, open_ = row, []
        if kind == POSITIVE:
            open_.append([score, id_, 0])
            continue
        open_ = [w for w in open_ if w[2] < n and 100 * score >= low * w[0]]
        for w in open_:
            if 100 * score <= high * w[0]:
                w[2] += 1
                yield anchor_id, w[1], w[2], id_, held(w[0]), held(score)


@tidy
def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", column: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of components floor(scale * x) (beyond 2^62: that); higher ones come first,
    ties by smaller id.  An anchor (``is_anchor`` on id) has its first ``positives`` other rows of its label; each
    has the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score
    <= high * positive_score.  All, if fewer; an anchor without positives, and a positive without negatives, give no row.
    ``high`` is 100 at most: a window opens with its positive.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.  Labels are
    whole numbers.  Vectors are compared with those of their own dimension.  Rows that repeat an id are rows
    of their own, as anchors and as partners.  Scores stop at the bounds of 64 bits; their order is that
    of the true products.  Other columns are ignored; an empty table gives an empty one.
    """
    if high > 100:
        raise ValueError("a window must not reach above its positive's score")
    spark = vectors.sparkSession
    source = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(column).alias("v")).dropna(subset=["id", "label"])
    rows = written(coded(source, scale, "v").select(F.monotonically_increasing_id().alias("row"), "id", "label", "code"), "negatives-rows")
    blocks = _blocks(rows, BLOCK, "negatives-blocks")
    parts = ("wide", "rows", "ids", "labels", "codes")
    asked = _blocks(rows.filter(is_anchor), ANCHORS, "negatives-anchors").select(F.col("block").alias("q"), "dim", *[F.col(c).alias(f"q_{c}") for c in parts])
    # numbers of blocks alone are paired, a few bytes for each BLOCK * ANCHORS products; one dimension is the rule, so a salt deals them
    own = asked.select("q", "dim").withColumn("salt", F.pmod(F.xxhash64("q"), F.lit(SALTS)).cast("int"))
    every = blocks.select("block", "dim").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = written(own.hint("shuffle_hash").join(every, ["dim", "salt"]).select("q", "block").repartition("q", "block"), "negatives-pairs")

    def work(pairs: DataFrame) -> DataFrame:
        return pairs.hint("merge").join(asked, "q").hint("merge").join(blocks.drop("dim"), "block")

    def keys(make):
        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    yield pa.RecordBatch.from_arrays([pa.array(out := list(make(r)), pa.binary()), pa.array([r["q"]] * len(out), pa.int64())], ["key", "q"])

        return run

    near = work(pairs).mapInArrow(keys(lambda r: positives_of(r, positives)), "key binary, q long").withColumn("anchor", F.substring("key", 1, 8))
    first = F.row_number().over(W.partitionBy("anchor").orderBy("key"))
    near = written(near.withColumn("i", first).filter(F.col("i") <= positives).select("q", "key"), "negatives-positives")
    # ``positives`` keys an anchor, so a bounded list a block
    windows = near.groupBy("q").agg(F.collect_list("key").alias("positives"))
    far = work(pairs).hint("merge").join(windows, "q").mapInArrow(keys(lambda r: negatives_of(r, negatives, low, high)), "key binary, q long")
    both = near.select("key").unionByName(far.select("key"))
    # the packed keys are whole records, so the values are empty
    packed = both.rdd.map(lambda r: (bytes(r[0]), None))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = packed.repartitionAndSortWithinPartitions(n, lambda k: zlib.crc32(k[:8]))
    out = sorted_.mapPartitions(lambda pairs: mined((k for k, _ in pairs), negatives, low, high))
    found = spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)
    return written(found, "negatives-found")


ORACLE = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT own, vec_id, label, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM v),
s AS MATERIALIZED (SELECT a.own, a.vec_id AS anchor_id, b.own AS other, b.vec_id, a.label = b.label AS alike, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.i = b.i AND a.own <> b.own WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS i FROM s WHERE alike),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.own, p.other ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.own = p.own AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.i <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
