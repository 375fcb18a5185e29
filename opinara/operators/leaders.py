"""Leaders of the sequential clustering rule, settled in parallel.

Going through rows in order, a row is a leader if no leader before it is within the threshold.  So a
row is settled as soon as all rows before it that are within the threshold are settled, and the
rows of one region do not wait for those of others.

* Rows are dealt to cells around pivots and each cell is cut into blocks in order.  Each block has a
  centre, a radius and a greatest norm; by the triangle inequality two blocks that are too far apart
  hold no pair within the threshold, and are never multiplied.
* A round marks, for all near pairs of blocks at once, the rows that a new leader strikes and those that wait
  for an open row before them; then each block settles its other rows by the sequential rule.  At least the first
  open row is settled, and a region that lies in one block is settled whole.
* Turns take ever larger heads of the open rows: the first is one block, and each one's leaders strike
  the rows after it, so few rows are left where leaders are few.

The number of jobs follows the logarithm of the rows and the longest chain of rows that wait for each other
from block to block, not the number of leaders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.functions.vectors import nearest
from opinara.scratch import tidy, written

#: Rows of a block, pivots, parts of a pairing of blocks, and growth of the turns.
BLOCK, PIVOTS, SALTS, GROWTH = 2000, 64, 32, 16
_BLOCKS = "block long, places binary, vectors binary, fresh binary, open boolean, centre array<double>, radius double, norm double"


def numbered(rows: DataFrame, order: list[str], to: str) -> DataFrame:
    """``rows`` with their place in ``order``, counted by partitions, written."""
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered-rows")
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return written(rows.join(F.broadcast(before), "_part").withColumn(to, place.cast("long")).drop("_part", "_before"), "numbered")


def sequential(vectors: np.ndarray, threshold: float, struck: np.ndarray, waits: np.ndarray) -> np.ndarray:
    """0 open, 1 leader, 2 struck, for rows in order; ``waits``: some open row elsewhere stands before it."""
    similar = vectors @ vectors.T >= threshold
    state = np.where(struck, 2, 0)
    for i in range(len(vectors)):
        if state[i] == 2:
            continue
        before = state[:i][similar[i, :i]]
        if (before == 1).any():
            state[i] = 2
        elif not waits[i] and not (before == 0).any():
            state[i] = 1
    return state


def as_block(number: int, places: np.ndarray, vectors: np.ndarray, fresh: np.ndarray) -> dict:
    centre = vectors.mean(0)
    radius = float(np.sqrt(((vectors - centre) ** 2).sum(1).max()))
    norm = float(np.sqrt((vectors**2).sum(1).max()))
    return {"block": number, "places": places.tobytes(), "vectors": vectors.tobytes(), "fresh": fresh.tobytes(), "open": bool((~fresh).any()), "centre": centre.tolist(), "radius": radius, "norm": norm}


def arrays(r: dict, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places, fresh = np.frombuffer(r[f"{side}places"], np.int64), np.frombuffer(r[f"{side}fresh"], bool)
    return places, np.frombuffer(r[f"{side}vectors"]).reshape(len(places), -1), fresh


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of ``rows`` (place, vector) by cell, written."""
    # PIVOTS rows
    pivots = np.array([r.vector for r in rows.select("vector").orderBy(F.xxhash64("place")).limit(PIVOTS).collect()])

    def cells(batches: Iterator[pd.DataFrame]):
        for b in batches:
            if len(b):
                v = np.stack(b["vector"].to_numpy())
                yield b.assign(cell=((pivots**2).sum(1) - 2 * (v @ pivots.T)).argmin(1))

    dealt = rows.select("place", "vector").mapInPandas(cells, "place long, vector array<double>, cell long")
    dealt = numbered(dealt, ["cell", "place"], "at")
    begins = dealt.groupBy("cell").agg(F.min("at").alias("begin"))  # PIVOTS rows
    dealt = dealt.join(F.broadcast(begins), "cell").withColumn("block", F.col("cell") * (1 << 40) + F.floor((F.col("at") - F.col("begin")) / block))

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("place")
        return pd.DataFrame([as_block(key[0], b["place"].to_numpy(), np.stack(b["vector"].to_numpy()), np.zeros(len(b), bool))])

    return written(dealt.groupBy("block").applyInPandas(pack, _BLOCKS), "leader-blocks")


def near_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of blocks that may hold a pair within the threshold, of which one is open, written."""
    shape = [F.col(c) for c in ("block", "centre", "radius", "norm", "open")]
    a = blocks.select(F.struct(*shape).alias("x"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    b = blocks.select(F.struct(*shape).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    off = F.aggregate(F.zip_with("x.centre", "y.centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z)
    # |u - v|^2 = |u|^2 + |v|^2 - 2 u.v, at most this where u.v reaches the threshold
    reach = F.col("x.norm") * F.col("x.norm") + F.col("y.norm") * F.col("y.norm") - 2 * threshold
    near = (reach >= -1e-9) & (F.sqrt(off) <= F.col("x.radius") + F.col("y.radius") + F.sqrt(F.greatest(reach, F.lit(0.0))) + 1e-9)
    both = a.hint("shuffle_hash").join(b, "salt").filter((F.col("x.block") < F.col("y.block")) & (F.col("x.open") | F.col("y.open")) & near)
    return written(both.select(F.col("x.block").alias("a"), F.col("y.block").alias("b")), "leader-pairs")


def _round(blocks: DataFrame, threshold: float) -> DataFrame:
    """The blocks after one round: rows that are still open, and new leaders."""

    def marks(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                a, b = arrays(r, "a_"), arrays(r, "b_")
                similar = a[1] @ b[1].T >= threshold
                out = []
                for number, hit, (places, _, fresh), (others, _, led) in ((r["a"], similar, a, b), (r["b"], similar.T, b, a)):
                    waits = (hit & ~led[None] & (others[None] < places[:, None])).any(1)
                    out.append({"block": number, "struck": np.packbits((hit & led[None]).any(1) & ~fresh).tobytes(), "waits": np.packbits(waits).tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("struck", pa.binary()), ("waits", pa.binary())]))

    columns = ("places", "vectors", "fresh")
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    work = near_pairs(blocks, threshold).hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    told = work.mapInArrow(marks, "block long, struck binary, waits binary")
    # a mark is a bit a row, and a block has one for each block near it
    told = told.groupBy("block").agg(F.collect_list("struck").alias("struck"), F.collect_list("waits").alias("waits"))

    def settle(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                places, vectors, fresh = arrays(r)
                union = lambda masks: np.bitwise_or.reduce([np.unpackbits(np.frombuffer(m, np.uint8), count=len(places)) for m in masks], axis=0).astype(bool) if masks else np.zeros(len(places), bool)  # noqa: B023, E731
                struck, waits = union(r["struck"]), union(r["waits"])
                # leaders of the round before have struck their own block then
                left = np.flatnonzero(~fresh & ~struck)
                state = sequential(vectors[left], threshold, np.zeros(len(left), bool), waits[left])
                kept, led = left[state != 2], (state == 1)[state != 2]
                if len(kept):
                    yield pa.RecordBatch.from_pylist([as_block(r["block"], places[kept], vectors[kept], led)], schema=schema)

    schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in columns], ("open", pa.bool_()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64())])
    ready = blocks.select("block", *columns).hint("merge").join(told, "block", "left")
    return written(ready.mapInArrow(settle, _BLOCKS), "leader-blocks")


def _fresh(blocks: DataFrame) -> DataFrame:
    """Places of a round's new leaders."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for places, fresh in zip(b["places"], b["fresh"], strict=True):
                yield pd.DataFrame({"place": np.frombuffer(places, np.int64)[np.frombuffer(fresh, bool)]})

    return blocks.select("places", "fresh").mapInPandas(run, "place long")


@tidy
def _settled(rows: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Leaders among ``n`` rows (id, vector, place), written."""
    if n <= block:

        def run(batches: Iterator[pd.DataFrame]):
            held = [b for b in batches if len(b)]  # one block
            if held:
                b = pd.concat(held, ignore_index=True)
                none = np.zeros(len(b), bool)
                yield b[sequential(np.stack(b["vector"].to_numpy()), threshold, none, none) == 1]

        return written(rows.coalesce(1).sortWithinPartitions("place").mapInPandas(run, rows.schema), "leaders")
    blocks, found = in_blocks(rows, block), None
    while blocks.filter("open").head(1):
        blocks = _round(blocks, threshold)
        found = _fresh(blocks) if found is None else found.unionAll(_fresh(blocks))
    return written(rows.hint("merge").join(found, "place").select(*rows.columns), "leaders")


@tidy
def leaders(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, vector) of the rows that are within ``threshold`` (inner product) of no leader before them in id order.

    Ids are unique, vectors of one length, neither is null.  An empty table gives an empty one.
    """
    columns = ["id", "vector"]
    open_ = numbered(rows.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector")), ["id"], "place")
    found, size = None, block
    while True:
        n = open_.count()
        head = open_ if n <= size else open_.filter(F.col("place") < size)
        own = _settled(head, min(n, size), threshold, block)
        found = own if found is None else found.unionAll(own)
        if n <= size:
            return found.select(*columns)
        rest = open_.filter(F.col("place") >= size)
        struck = nearest(rest, own.select(F.col("place").alias("topic_id"), F.col("vector").alias("centroid")), 1).filter(F.col("similarity") >= threshold)
        rest = rest.hint("merge").join(struck.select("id"), "id", "left_anti").select(*columns)
        open_, size = numbered(rest, ["id"], "place"), size * GROWTH
