"""Clustering, hard negatives and packing against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from opinara.llm import centroids, codes, negatives, packing
from pyspark.sql import functions as F

# ids, labels, vectors; the other columns bear names that the operators use
VECTORS = "vec_id long, label int, embedding array<float>, id string, code int, cluster string, row double, block int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, "x", 1, "c", 0.5, 3, 4) for i, y, v in rows], VECTORS).repartition(5)


def whole(v, scale):
    return [min(max(int(np.floor(min(max(float(np.float32(x)) * scale, -(2.0**62)), 2.0**62))), -(2**62)), 2**62) for x in v]


def random_rows(rng, n, dim, spread=1.0):
    rows = [(i, rng.randrange(4), [rng.choice([rng.uniform(-spread, spread), 0.25, -0.5]) for _ in range(dim)]) for i in range(n)]
    # copies, a repeated id, ids and labels that are null, vectors that take no part
    rows += [(n + i, 1, rows[3][2]) for i in range(40)] + [(5, 2, rows[9][2]), (5, 2, rows[9][2]), (100, 0, rows[7][2])]
    return rows + [(None, 1, rows[1][2]), (n + 50, None, rows[2][2]), (n + 51, 1, None), (n + 52, 1, []), (n + 53, 1, [None] * dim), (n + 54, 1, [float("nan")] + [0.0] * (dim - 1)), (n + 55, 1, [float("inf")] + [0.0] * (dim - 1)), (n + 56, 1, [0.0] * (dim + 1))]


# ---- clustering


def brute_clusters(rows, dim, k, rounds, scale, seed):
    kept = [(i, whole(v, scale)) for i, _, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    sha = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c[j], strict=True)), j) for j in range(len(c))) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(kept, near, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near, most = assign(), 2**63 - 1
    held = [min(d, most) for d, _ in near]
    each = collections.Counter()
    for d, (_, a) in zip(held, near, strict=True):
        each[a] += d
    shas = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(map(repr, [(i, a, d, min(each[a], most), min(sum(held), most), shas[a]) for (i, _), (_, a), d in zip(kept, near, held, strict=True)]))


@pytest.mark.parametrize(("dim", "spread", "scale", "table_bytes"), [(6, 1.0, 1024, 32_000_000), (6, 1.0, 4, 32_000_000), (6, 1.0, 1024, 64), (3, 3e38, 1024, 32_000_000), (3, 3e38, 1024, 64)])
def test_clusters(spark, dim, spread, scale, table_bytes):
    """Narrow and wide blocks, dictionaries of all rows and of batches, numbers beyond 64 bits."""
    rows = random_rows(random.Random(dim), 150, dim, spread)
    got = centroids.centroid_clusters(vectors(spark, rows), dim=dim, k=5, rounds=3, scale=scale, table_bytes=table_bytes)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_clusters(rows, dim, 5, 3, scale, 3)


def test_few_and_no_vectors(spark):
    rows = [(1, 0, [0.5, 0.5]), (2, 0, [0.5, 0.5]), (3, 0, None)]
    got = centroids.centroid_clusters(vectors(spark, rows), dim=2)
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in got.collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert centroids.centroid_clusters(vectors(spark, rows[2:])).collect() == []
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(1)
    v = np.stack([rng.integers(-9, 9, 200) // rng.integers(1, 5) for _ in range(7)], 1)
    narrow = centroids.Dictionary([np.unique(x) for x in v.T])
    blocks = narrow.wide_blocks(400)
    assert 1 < len(blocks) < 7 and [a for a, _ in blocks[1:]] == [b for _, b in blocks[:-1]]
    wide = centroids.Dictionary(narrow.values, blocks, [np.unique(n) for n in narrow.numbers(v, blocks)])
    at = wide.encode(v)
    every = [np.stack(wide.entries(i), 1) for i in range(len(blocks))]
    assert np.array_equal(np.concatenate([every[i][at[:, i] - wide.begin[i]] for i in range(len(blocks))], 1), v)
    c = v[:3].tolist()
    assert centroids.nearest_codes(at, wide.distances(c))[1].tolist() == [min(sum((x - y) ** 2 for x, y in zip(r, d, strict=True)) for d in c) for r in v.tolist()]


# ---- hard negatives


def brute_negatives(rows, scale, anchors, n=5, m=5):
    kept = [(i, y, whole(v, scale)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, held = [], lambda x: min(max(x, -(2**63)), 2**63 - 1)
    for own, (i, y, v) in enumerate(kept):
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for o, (j, z, w) in enumerate(kept) if o != own and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:n]:
            window = [(t, k) for t, k, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r, k, held(-s), held(-t)) for r, (t, k) in enumerate(window[:m], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "anchors", "spread", "scale"), [(4096, 512, 1.0, 256), (7, 3, 1.0, 256), (11, 2, 1.0, 2), (30, 4, 1e18, 256), (30, 4, 3e38, 256)])
def test_hard_negatives(spark, monkeypatch, block, anchors, spread, scale):
    """Small blocks, many ties (scale 2), products beyond 64 bits."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = random_rows(random.Random(block), 120, 5, spread)
    got = negatives.hard_negatives(vectors(spark, rows), F.col("id") % 5 == 0, scale=scale)
    want = brute_negatives(rows, scale, lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_no_anchors(spark):
    assert negatives.hard_negatives(vectors(spark, [(1, 0, [0.5]), (100, 0, [0.5]), (200, None, [0.5])]), F.col("id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(1, 0, None)]), F.col("id") % 100 == 0).collect() == []


def test_packed_keys_sort_and_come_back():
    rng = random.Random(2)
    some = [(rng.randrange(3), rng.choice([0, 1, -1, 2**130, -(2**130), rng.randrange(-99, 99)]), rng.randrange(2), rng.choice([-(2**63), 2**63 - 1, 0, 4]), rng.randrange(9), -7) for _ in range(300)]
    assert [negatives.unpack(k) for k in sorted(negatives.pack(*x) for x in some)] == sorted(some, key=lambda x: (x[0], -x[1], *x[2:]))
    assert int(codes.MOST) ** 2 * 2**31 < negatives._ZERO < 2 ** (8 * negatives._WIDTH - 1)


def test_one_anchor_is_never_held():
    """The iterator reads a key only when its rows are asked for."""
    keys = itertools.chain([negatives.pack(1, 100, 0, 1, 1, 1)], (negatives.pack(1, 90, 1, i, i, 1) for i in itertools.count()))
    assert [x[3] for x in itertools.islice(negatives.mined(keys, 10**9, 80, 100), 50)] == list(range(50))


# ---- packing


def fewest(counts, capacity):
    pieces = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= pieces[i]}):
            j = rooms.index(room)
            go(i + 1, [*rooms[:j], room - pieces[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best


def used(plan):
    out = collections.Counter()
    for times, filling in plan:
        for n, use in filling:
            out[n] += times * use
    return out


def test_bin_completion_is_optimal_on_small_tables():
    rng, better = random.Random(1), 0
    for _ in range(300):
        capacity = rng.choice([20, 30, 60, 100])
        counts = collections.Counter(rng.randrange(max(1, capacity // 6), capacity * 2 // 3) for _ in range(rng.randrange(11)))
        plan = packing.complete(counts, capacity, 20_000)
        assert used(plan) == counts and all(sum(n * u for n, u in f) <= capacity for _, f in plan)
        n = sum(t for t, _ in plan)
        assert packing.least_sequences(counts, capacity) <= n == fewest(counts, capacity)
        better += n < sum(t for t, _ in packing.best_fit(counts, capacity))
    assert better  # best fit alone does not do


def test_fillings_that_are_dominated_go():
    counts = {50: 1, 30: 2, 20: 1, 10: 5}
    every = packing.fillings(counts, 50, 50, most=10**6, steps=10**6)
    assert every == [(0, ((50, 1),))]  # all others give way to the one of 50
    assert {f for _, f in packing.fillings({30: 1, 21: 1, 20: 1}, 50, 50, 10**6, 10**6)} == {((30, 1), (20, 1))}


def test_millions_of_pieces_are_few_fillings():
    rng = random.Random(4)
    counts = {rng.randrange(1, 4096): rng.randrange(1, 10**7) for _ in range(2000)}
    plan = packing.complete(counts, 4096)
    assert used(plan) == counts and len(packing.places(plan)) < 40_000
    assert sum(t for t, _ in plan) <= 1.01 * packing.least_sequences(counts, 4096)


TEXTS = [None, "", "  \n\t", "one", "don't  STOP now", "<|endoftext|> ǘ ́x Σ İ 123", "\U0001f600 é▁", "word " * 5000, "Été, ÉTÉ. été! naïve; ŁÓDŹ: Straße. it's 'tis ﬁn ǅ ªº µm x., ,x.",  "x" * 30_000, "one", "one"]


@pytest.mark.parametrize("capacity", [4096, 7])
def test_packing(spark, monkeypatch, capacity):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CHUNK", 20_000)
    rng = random.Random(3)
    rows = [(i % 9 if i < 11 else i, t) for i, t in enumerate(TEXTS + [" ".join(rng.choice(["alpha", "Beta,", "gam-ma", "42"]) for _ in range(rng.randrange(300))) for _ in range(60)])] + [(None, "a b"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0, 3) for i, t in rows], "doc_id long, text string, part int, ids string, length double, rank int").repartition(3)
    got = packing.pack_documents(docs, capacity=capacity).collect()
    coder, want = Tokenizer.from_file(packing.vocabulary_path()), collections.Counter()
    for i, t in rows:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            own = np.array(ids[k : k + capacity], "<u4").tobytes()
            want[i, k // capacity, k, len(own) // 4, zlib.crc32(own), own] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == [0, *itertools.accumulate(n for _, n in placed)][:-1] and sum(placed[-1]) <= capacity
    counts = collections.Counter(r.length for r in got)
    assert len(sequences) == sum(t for t, _ in packing.complete(counts, capacity)) <= packing.least_sequences(counts, capacity) + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
