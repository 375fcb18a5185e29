"""N-gram Jaccard join: near-duplicate documents by rare-first prefix filtering.

Two documents link when their shingle sets have Jaccard similarity of at least 3/4; the result
is the connected component of each document.

1. Documents with equal sets become one *entity* (keyed by the set's signature).
2. Document frequencies of all shingles are counted over all entities.  A shingle that one
   entity has cannot be shared, so of each set only the *shared* shingles are kept, ordered rare
   first; the others are known by number and stand before them in the order.
3. The prefix of a set of n is its n - ceil(3n/4) + 1 rarest shingles: similar sets share one of
   them.  Entities whose prefix has no shared shingle are alone.
4. Prefix entries are joined by shingle.  In a few turns each entity is first compared with some
   *hubs* only (one entity of each shingle), which joins large groups of copies by a few pairs
   for each member.  The last round takes every pair of entities of different
   components that share a prefix shingle and pass the length, positional and suffix filters: after it
   no link between different texts is missing, whatever the group sizes.  Entities of a crowded
   shingle are first grouped by size and place; only groups that can link by the length and
   positional filters are paired, in blocks of a bounded number of entities.
5. Each pair is verified once, on the shared shingles of both.

Very frequent shingles (at most ``HOT_GRAMS``, by count) are not listed by document anywhere;
they stand last in the order, by steps of their count.  Hashes have 48 bits: a pair of sets of 1,000 shingles has a chance
of about 4e-9 to count one shingle too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.components import contract
from opinara.llm.memory import release
from opinara.llm.shingles import GRAM_BITS, mix, shingle_sets, signatures
from opinara.scratch import tidy, written
from opinara.skew import heavy_keys, salted_join

#: Bound on the list of very frequent shingles that goes to every task (8 bytes each).
HOT_GRAMS = 1 << 20
#: A shingle in fewer sets than this is never very frequent.
HOT_LEAST = 1000
#: Shingles in one task of the frequency count.
PER_PART = 1_000_000
#: Shingles of one batch of postings.
BATCH = 1_000_000
#: Hubs that an entity is compared with in one of the later turns, and turns at most.
HUBS, HUB_TURNS = 4, 4
#: A shingle of more prefix entries than this is crowded; entities of a block of a crowded shingle.
CROWDED, BLOCK = 1000, 1000
#: 64-bit words of an entity's bitmap in the last round.
BITMAP = 8
#: Classes of document frequency in 16 bits: exact below RARE, above it by steps of a logarithm.
RARE = 50_000
TOP = 65_535
_MASK = np.uint64((1 << GRAM_BITS) - 1)


def _sets_of(batches: Iterator[pa.RecordBatch], k: int):
    """Of each run of texts with some BATCH shingles: first row in the batch, ids, sizes, sets."""
    for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
        ids = batch.column(0)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        held, n, first = [], 0, 0
        for a, sizes, sets in shingle_sets(texts, k):
            held.append((sizes, sets))
            n += len(sets)
            if n >= BATCH:
                yield ids.slice(first, a + len(sizes) - first), np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                held, n, first = [], 0, a + len(sizes)
        if held:
            yield ids.slice(first), np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    release()


def _distinct(sizes: np.ndarray, sets: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty sets, each once."""
    _, at = np.unique(sigs, return_index=True)
    take = np.zeros(len(sigs), dtype=bool)
    take[at] = True
    take &= sizes > 0
    return sizes[take], sets[np.repeat(take, sizes)], sigs[take]


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """Written rows of two kinds: (doc_id, n, sig) of each document, and (gram, count) of shingles
    that are frequent in one batch."""

    def run(batches):
        for ids, sizes, sets in _sets_of(batches, k):
            sigs = signatures(sizes, sets)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sigs.view(np.int64)), none, none], ["doc_id", "n", "sig", "gram", "count"])
            grams = np.sort(_distinct(sizes, sets, sigs)[1])
            at = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
            count = np.diff(np.r_[at, len(grams)])
            often = count >= max(3, len(grams) // (2 * HOT_GRAMS))
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(grams[at][often].view(np.int64)), pa.array(count[often])], ["doc_id", "n", "sig", "gram", "count"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sig long, gram long, count long"), "join-sets")


def _pack(sigs: np.ndarray, counts: np.ndarray, *more: bytes) -> bytes:
    return b"".join([np.uint32(len(sigs)).tobytes(), sigs.tobytes(), counts.astype(np.uint32).tobytes(), *more])


def _unpack(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    sigs = np.frombuffer(blob, np.uint64, n, 4)
    counts = np.frombuffer(blob, np.uint32, n, 4 + 8 * n)
    rest = np.frombuffer(blob, np.uint8, -1, 4 + 12 * n) if len(blob) > 4 + 12 * n else np.zeros(0, np.uint8)
    wide = np.zeros((len(rest) // width, 8), dtype=np.uint8)
    wide[:, :width] = rest.reshape(-1, width)
    return sigs, counts, wide.view(np.uint64).ravel()


def _by_part(part: np.ndarray, of: np.ndarray, values: np.ndarray, parts: int):
    """Yields (part, entity indices, their counts, values); ``of`` ascends within a part."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16 if parts <= TOP else np.uint32), kind="stable")
    part, of, values = part[order], of[order], values[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(part)], strict=True):
        o = of[a:b]
        at = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        yield int(part[a]), o[at], np.diff(np.r_[at, len(o)]), values[a:b]


def shared_grams(docs: DataFrame, k: int, hot: tuple[np.ndarray, np.ndarray], total: int) -> DataFrame:
    """(sig, n, keys) of each entity with a shared shingle in its prefix, written.  keys: its shared
    shingles, ascending by (document frequency, hash), as unsigned 64-bit numbers."""
    parts = max(1, -(-total // PER_PART))
    hot_list = docs.sparkSession.sparkContext.broadcast(hot)

    def postings(batches):
        for _, sizes, sets in _sets_of(batches, k):
            sizes, sets, sigs = _distinct(sizes, sets, signatures(sizes, sets))
            of = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            known, classes = hot_list.value
            at = np.minimum(np.searchsorted(known, sets), max(0, len(known) - 1))
            is_hot = known[at] == sets if len(known) else np.zeros(len(sets), bool)
            ordered = sets[is_hot] | (classes[at[is_hot]] << np.uint64(GRAM_BITS)) if len(known) else sets[:0]
            out = []
            for p, at, n, grams in _by_part(sets[~is_hot] % np.uint64(parts), of[~is_hot], sets[~is_hot], parts):
                out.append((p, 0, _pack(sigs[at], n, np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())))
            home = (sigs % np.uint64(parts)).astype(np.int64)
            every = np.arange(len(sizes))
            for p, at, _, own in _by_part(home, every, sizes.astype(np.uint64), parts):
                out.append((p, 1, _pack(sigs[at], own, b"")))
            hot_of = of[is_hot]
            for p, at, n, grams in _by_part(home[hot_of], hot_of, ordered, parts):
                out.append((p, 2, _pack(sigs[at], n, grams.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["part", "kind", "blob"])

    def count(key, pdf):
        out = []
        rows = [_unpack(b, 6) for b in pdf.blob[pdf.kind == 0]]
        if rows:
            names, idx = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
            of = np.repeat(idx.astype(np.uint32), np.concatenate([r[1] for r in rows]))
            grams = np.concatenate([r[2] for r in rows])
            order = np.lexsort((of, grams))
            of, grams = of[order], grams[order]
            once = np.r_[True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])]
            of, grams = of[once], grams[once]
            at = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            df = np.repeat(d := np.diff(np.r_[at, len(grams)]), d)
            of, keys = of[df > 1], grams[df > 1] | (np.minimum(df[df > 1], RARE - 1).astype(np.uint64) << np.uint64(GRAM_BITS))
            order = np.argsort(of, kind="stable")
            of, keys = of[order], keys[order]
            for q, o, n, own in _by_part((names[of] % np.uint64(parts)).astype(np.int64), of, keys, parts):
                out.append((q, 0, _pack(names[o], n, own.tobytes())))
        release()
        home = pdf[pdf.kind > 0]
        out += zip(home.part, home.kind, home.blob, strict=True)
        return pd.DataFrame(out, columns=["part", "kind", "blob"])

    def gather(key, pdf):
        sized = [_unpack(b, 8) for b in pdf.blob[pdf.kind == 1]]
        names, first = np.unique(np.concatenate([r[0] for r in sized]), return_index=True)
        sizes = np.concatenate([r[1] for r in sized])[first].astype(np.int64)
        rows = [_unpack(b, 8) for b in pdf.blob[pdf.kind != 1]]
        if not rows:
            return pd.DataFrame({"sig": [], "n": [], "keys": []})
        of = np.searchsorted(names, np.repeat(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])))
        keys = np.concatenate([r[2] for r in rows])
        order = np.lexsort((keys, of))
        of, keys = of[order], keys[order]
        once = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])] if len(keys) else np.zeros(0, bool)
        of, keys = of[once], keys[once]
        have = np.bincount(of, minlength=len(names))
        ends = np.cumsum(have)
        take = np.flatnonzero(prefix_shared(sizes, have) > 0)
        return pd.DataFrame({"sig": names[take].view(np.int64), "n": sizes[take], "keys": [keys[ends[i] - have[i] : ends[i]].tobytes() for i in take]})

    kinds = "part int, kind int, blob binary"
    listed = docs.select("doc_id", "text").mapInArrow(postings, kinds).groupBy("part").applyInPandas(count, kinds)
    return written(listed.groupBy("part").applyInPandas(gather, "sig long, n long, keys binary"), "join-entities")


def prefix_shared(n: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """How many of a set's shared shingles are in its prefix."""
    return np.minimum(n - -(-3 * n // 4) + 1 - (n - shared), shared)


def prefix_entries(entities: DataFrame) -> DataFrame:
    """(gram, sig, n, pos) of each shared prefix shingle; pos counts from 0 in the whole set."""

    def run(batches):
        for b in batches:
            sig, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            blobs = b.column(2).to_pylist()
            have = np.array([len(x) // 8 for x in blobs])
            take = prefix_shared(n, have)
            keys = np.concatenate([np.frombuffer(x, np.uint64, t) for x, t in zip(blobs, take, strict=True)]) if len(blobs) else np.zeros(0, np.uint64)
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(n - have, take)
            yield pa.RecordBatch.from_arrays([pa.array((keys & _MASK).view(np.int64)), pa.array(np.repeat(sig, take)), pa.array(np.repeat(n, take).astype(np.int32)), pa.array(at.astype(np.int32))], ["gram", "sig", "n", "pos"])

    return entities.mapInArrow(run, "gram long, sig long, n int, pos int")


def _similar(n1: int, k1: np.ndarray, n2: int, k2: np.ndarray) -> bool:
    """Whether the sets link.  The suffix filter bounds the overlap by cutting both at the middle key."""
    if not len(k1) or not len(k2):
        return False

    def enough(overlap: int) -> bool:
        return 100 * overlap >= 75 * (n1 + n2 - overlap)

    a = k1.searchsorted(pivot := k2[len(k2) // 2])
    b = k2.searchsorted(pivot)
    if not enough(min(a, b) + min(len(k1) - a, len(k2) - b)):
        return False
    both = np.concatenate([k1, k2])
    both.sort(kind="stable")
    return enough(int((both[1:] == both[:-1]).sum()))


def verify(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ca, cb: entities and their components; written), each once, with ``hit``: whether they link."""
    left = entities.select(F.col("sig").alias("a"), F.col("n").alias("n1"), F.col("keys").alias("k1"))
    right = entities.select(F.col("sig").alias("b"), F.col("n").alias("n2"), F.col("keys").alias("k2"))
    # a hub may stand in a third of all pairs
    both = salted_join(pairs, left, ["a"], heavy_keys(pairs, ["a"]), by=F.xxhash64("b"))
    both = salted_join(both, right, ["b"], heavy_keys(pairs, ["b"]), by=F.xxhash64("a")).select("ca", "cb", "n1", "k1", "n2", "k2")

    def run(batches):
        for x in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            cols = [c.to_pylist() for c in x.columns[2:]]
            hit = [_similar(n1, np.frombuffer(k1, np.uint64), n2, np.frombuffer(k2, np.uint64)) for n1, k1, n2, k2 in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(hit, pa.bool_())], ["a", "b", "hit"])
        release()

    return both.mapInArrow(run, "a long, b long, hit boolean")


def _may_link(n1, n2, p1, p2):
    """Length filter, and positional filter: the rarest shingle that two sets share has no shared one
    before it, so at places p1 and p2 it leaves room for the whole overlap that a link needs."""
    least, most = F.least(n1, n2), F.greatest(n1, n2)
    need = F.ceil(F.lit(3) * (n1 + n2) / F.lit(7))
    return (100 * least >= 75 * most) & (p1 + need <= n1) & (p2 + need <= n2)


def hub_pairs(entries: DataFrame, turn: int, heavy: DataFrame) -> DataFrame:
    """Pairs (a, b) of an entity and a hub of another component: of the hubs of its prefix shingles
    the one that most of them have in common, in later turns HUBS.  First the least entity of a
    shingle is its hub, later one by a hash that differs by shingle and turn."""
    order = F.col("sig") if turn == 0 else F.xxhash64("sig", "gram", F.lit(turn))
    hub = entries.groupBy("gram").agg(F.min(F.struct(order.alias("at"), "comp", "sig", "n", "pos")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").drop("lo", "hi")
    near = salted_join(entries, hub, ["gram"], heavy, by=F.xxhash64("sig")).filter(F.col("comp") != F.col("hub.comp")).filter(_may_link(F.col("n"), F.col("hub.n"), F.col("pos"), F.col("hub.pos")))
    counts = near.groupBy(F.col("sig").alias("a"), F.col("hub.sig").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("ca"), F.min("hub.comp").alias("cb"))
    if turn == 0:
        return counts.groupBy("a").agg(F.max_by(F.struct("b", "ca", "cb"), F.struct("c", "b")).alias("x")).select("a", "x.*")
    best = W.partitionBy("a").orderBy(F.col("c").desc(), F.xxhash64("a", "b"))
    return counts.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= HUBS).select("a", "b", "ca", "cb")


def bitmaps(entities: DataFrame) -> DataFrame:
    """(sig, alone, b0, ...): number of shingles that no other entity has, and a bitmap of the others."""
    schema = "sig long, alone int, " + ", ".join(f"b{i} long" for i in range(BITMAP))

    def run(batches):
        for b in batches:
            out = np.zeros((b.num_rows, BITMAP), np.uint64)
            blobs = b.column(2).to_pylist()
            for row, blob in zip(out, blobs, strict=True):
                bit = mix(np.frombuffer(blob, np.uint64) & _MASK) % np.uint64(64 * BITMAP)
                np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            alone = b.column(1).to_numpy() - np.array([len(x) // 8 for x in blobs], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(alone.astype(np.int32)), *[pa.array(out[:, i].view(np.int64)) for i in range(BITMAP)]], ["sig", "alone", *[f"b{i}" for i in range(BITMAP)]])

    return entities.mapInArrow(run, schema)


def _crossed(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows of equal ``on`` that pass all filters.

    Suffix filter: a bit that one bitmap has and the other has not is a shingle that they do not
    share, so the bits that differ bound the overlap from above before a pair is made.
    """
    differ = F.col("alone_1") + F.col("alone_2")
    for i in range(BITMAP):
        differ = differ + F.bit_count(F.col(f"b{i}_1").bitwiseXOR(F.col(f"b{i}_2")))
    n = F.col("n_1") + F.col("n_2")
    near = x.hint("merge").join(y, on).filter(F.col("comp_1") != F.col("comp_2"))
    near = near.filter(_may_link(F.col("n_1"), F.col("n_2"), F.col("pos_1"), F.col("pos_2"))).filter(differ + 2 * F.ceil(3 * n / F.lit(7)) <= n)
    first = F.col("comp_1") < F.col("comp_2")
    return near.select(*[F.when(first, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(a) for c, a in (("sig", "a"), ("comp", "ca"))], *[F.when(first, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1")).alias(b) for c, b in (("sig", "b"), ("comp", "cb"))])


def _sided(df: DataFrame, side: int, same: tuple[str, ...]) -> DataFrame:
    return df.select(*same, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in same])


def crowded_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of crowded shingles' entries.

    With its first s shared-or-later places from a shingle on, a set of n links to sets of at most
    m = floor(7 s / 3) - n shingles: a pair needs n2 <= m1 and n1 <= m2.  Groups are bands of n and m;
    their number for one shingle is bounded, and pairs of groups that can link are cut into pairs of
    blocks, each a task's work of at most about BLOCK entities a side.
    """
    m = F.floor(F.lit(7) * (F.col("n") - F.col("pos")) / F.lit(3)) - F.col("n")
    band = F.when(F.col("n") <= 64, F.col("n")).otherwise(64 + F.floor(F.log2(F.col("n") / 64) * 32)).cast("int")
    level = F.when(F.col("n") <= 64, F.col("m")).otherwise(F.floor(F.col("m") / F.col("n") * 24)).cast("int")
    e = entries.withColumn("m", m).withColumn("band", band).withColumn("level", level)
    key = ["gram", "band", "level"]
    groups = e.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("m").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    groups = written(groups.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).drop("c"), "join-groups")
    both = _sided(groups, 1, ("gram",)).hint("merge").join(_sided(groups, 2, ("gram",)), "gram")
    order = F.struct("band_1", "level_1") <= F.struct("band_2", "level_2")
    alike = (F.col("lo_1") == F.col("hi_1")) & (F.col("lo_2") == F.col("hi_2")) & (F.col("lo_1") == F.col("lo_2"))
    both = both.filter(order & ~alike & (F.col("least_1") <= F.col("most_2")) & (F.col("least_2") <= F.col("most_1")))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    units = both.withColumn("block_1", numbers("blocks_1")).withColumn("block_2", numbers("blocks_2"))
    same = (F.col("band_1") == F.col("band_2")) & (F.col("level_1") == F.col("level_2"))
    units = units.filter(~same | (F.col("block_1") <= F.col("block_2"))).select("gram", "band_1", "level_1", "block_1", "band_2", "level_2", "block_2")
    units = written(units.withColumn("unit", F.xxhash64(*units.columns)), "join-units")
    placed = e.hint("merge").join(groups.select(*key, "blocks"), key).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).drop("blocks", "m")
    sides = []
    for side in (1, 2):
        own = units.select("gram", *[F.col(f"{c}_{side}").alias(c) for c in ("band", "level", "block")], "unit")
        sides.append(_sided(placed.hint("merge").join(own, [*key, "block"]).drop(*key, "block"), side, ("unit",)))
    return _crossed(*sides, ["unit"])


def all_pairs(entries: DataFrame, entities: DataFrame, heavy: DataFrame) -> DataFrame:
    """Every pair of entities of different components that share a prefix shingle and may link, each once."""
    mixed = entries.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo < hi")
    mixed = mixed.select("gram", (F.col("c") > CROWDED).alias("crowded"))
    kept = salted_join(entries, mixed, ["gram"], heavy, by=F.xxhash64("sig")).hint("merge").join(bitmaps(entities), "sig")
    kept = written(kept, "join-open")
    few, many = kept.filter("NOT crowded").drop("crowded"), kept.filter("crowded").drop("crowded")
    pairs = _crossed(_sided(few, 1, ("gram",)), _sided(few, 2, ("gram",)), ["gram"])
    if many.head(1):
        pairs = pairs.unionByName(crowded_pairs(many))
    return pairs.distinct()


@tidy
def near_duplicates(docs: DataFrame, k: int = 5, hub_turns: int = HUB_TURNS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, ...).

    component_id is the smallest doc_id reachable by links.  Null, empty and word-less texts have
    no shingles and are components of their own; repeated rows and equal texts share one; a null
    doc_id stays null and its component is that of the documents it links to, or null.  Other
    columns are ignored.  An empty table gives an empty one.
    """
    rows = document_sets(docs, k)
    totals = rows.filter("gram IS NULL").agg(F.sum("n")).first()[0] or 0
    if not totals:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    least = max(HOT_LEAST, totals // HOT_GRAMS)
    frequent = rows.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("count").alias("c")).filter(F.col("c") >= least)
    rows_hot = frequent.orderBy("gram").toArrow()  # HOT_GRAMS at most
    known = rows_hot.column("gram").to_numpy().view(np.uint64)
    step = np.log2(rows_hot.column("c").to_numpy().astype(float)) * 256
    hot = known, np.minimum(RARE + step.astype(np.int64), TOP).astype(np.uint64)
    entities = shared_grams(docs, k, hot, totals)
    entries = written(prefix_entries(entities), "join-entries")
    heavy = heavy_keys(entries, ["gram"])
    comps, hubs, turn = None, True, 0
    while True:
        placed = entries.withColumn("comp", F.col("sig")) if comps is None else entries.hint("merge").join(comps, "sig")
        pairs = written(hub_pairs(placed, turn, heavy) if hubs else all_pairs(placed, entities, heavy), "join-pairs")
        checked = written(verify(pairs, entities), "join-checked")
        roots = contract(checked.filter("hit")).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        known = entities.select("sig", F.col("sig").alias("comp")) if comps is None else comps
        moved = salted_join(known, roots, ["comp"], heavy_keys(known, ["comp"]), "left")
        comps = written(moved.select("sig", F.coalesce("root", "comp").alias("comp")), "join-components")
        if not hubs:
            break
        turn += 1
        tried, linked = checked.agg(F.count(F.lit(1)), F.count_if("hit")).first()
        hubs = turn < hub_turns and linked * 20 > tried  # hubs still join groups; all other links come in the last round
    # copies of one text, and large components, are dealt to many tasks
    found = rows.filter("gram IS NULL").select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    root = salted_join(found, comps, ["sig"], heavy_keys(found, ["sig"]), "left", by=F.xxhash64("doc_id", "n"))
    root = written(root.select("doc_id", "n", F.coalesce("comp", "sig").alias("root")), "join-roots")
    least_id = root.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("first"))
    out = salted_join(root, least_id, ["root"], heavy_keys(root, ["root"]), "left", by=F.xxhash64("doc_id", "n"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


#: The same by an inverted index over all shingles, for tables of some thousand documents.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS grams FROM w),
d AS MATERIALIZED (SELECT doc_id, len(grams) AS n, md5(array_to_string(grams, chr(10))) AS sig, grams FROM l),
e AS MATERIALIZED (SELECT sig, any_value(n) AS n, any_value(grams) AS grams, min(doc_id) AS first FROM d WHERE n > 0 GROUP BY sig),
s AS MATERIALIZED (SELECT first, n, unnest(grams) AS gram FROM e),
p AS (SELECT a.first AS a, b.first AS b FROM s a JOIN s b ON a.gram = b.gram AND a.first < b.first AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
k AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT first AS a, first AS b FROM e UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b),
c AS (SELECT a AS first, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN e ON e.sig = d.sig AND d.n > 0 LEFT JOIN c ON c.first = e.first"""
