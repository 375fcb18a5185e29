"""Clustering in parallel against the sequential loop."""

import os

import numpy as np
import pytest
from opinara import scratch
from opinara.operators import leaders, similar, topics
from pyspark.sql import functions as F


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clustered(seed, n, dim, centres, spread):
    rng = np.random.default_rng(seed)
    return unit(rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim)))


def woven(n, step):
    """Chains of rows ``step`` apart: each waits for one in another block."""
    i = np.arange(n)
    v = np.zeros((n, 2 * step))
    v[i, 2 * (i % step)], v[i, 2 * (i % step) + 1] = np.cos(0.5 * (i // step)), np.sin(0.5 * (i // step))
    return v


CASES = {
    "clusters": (clustered(2, 300, 8, 6, 0.15), 0.75),
    "all alike": (np.repeat(unit(np.ones((1, 4))), 150, 0), 0.9),
    "woven chains": (woven(40, 9), float(np.cos(0.51))),
    "not normal": (np.random.default_rng(3).normal(size=(150, 3)) * np.random.default_rng(4).uniform(0.1, 5, (150, 1)), 1.5),
}


def sequential(v, threshold):
    out = []
    for i, x in enumerate(v):
        if not out or float((v[out] @ x).max()) < threshold:
            out.append(i)
    return out


@pytest.mark.parametrize("case", CASES)
def test_leaders(spark, case):
    v, threshold = CASES[case]
    rows = [(3 * i + 1, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    want = [3 * i + 1 for i in sequential(v, threshold)]
    assert sorted(r.id for r in leaders.leaders(df, threshold, 9).collect()) == want
    assert case != "clusters" or sorted(r.id for r in leaders.leaders(df, threshold).collect()) == want


def jobs(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    try:
        f()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_follow_the_number_of_topics(spark):
    """Twice the topics take as many jobs; one block after the other would take twice as many turns."""
    df = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(3)
    count, found = [], []
    for n in (160, 320):
        table = df(np.eye(n))
        count.append(jobs(spark, f"topics-{n}", lambda t=table: found.append(leaders.leaders(t, 0.75, 20).count())))
    assert found == [160, 320] and abs(count[1] - count[0]) <= 8


def test_far_blocks_are_not_multiplied(spark):
    v = clustered(7, 400, 16, 20, 0.02)
    rows = leaders.numbered(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>"), ["id"], "place")
    blocks = leaders.in_blocks(rows, 20)
    pairs = leaders.near_pairs(blocks, 0.9).count()
    assert pairs < 0.5 * blocks.count() * (blocks.count() - 1) / 2


def test_similar_pairs(spark):
    """The pairs of a full product, at a high and a low threshold; far blocks are left out at the high one."""
    v = clustered(8, 300, 16, 15, 0.03)
    ids = np.random.default_rng(3).permutation(1000)[:300]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)] + [(2000, None)], "topic_id long, centroid array<double>").repartition(3)
    s = v @ v.T
    for least in (0.9, 0.2):
        got = [(r.topic_a, r.topic_b, round(r.similarity, 9)) for r in similar.similar_pairs(df, least, block=8).collect()]
        want = {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))): s[i, j] for i in range(300) for j in range(i) if s[i, j] >= least}
        assert len(got) == len(want) and all(abs(want[a, b] - x) < 1e-8 for a, b, x in got)
        assert [x for *_, x in got] == sorted((x for *_, x in got), reverse=True)
    rows = leaders.numbered(df.dropna().withColumnRenamed("centroid", "vector"), ["topic_id"], "place")
    blocks = leaders.in_blocks(rows, 8)
    size = {r.block: r.n for r in blocks.selectExpr("block", "length(places) div 8 AS n").collect()}
    products = sum(size[r.a] * size[r.b] for r in leaders.near_pairs(blocks, 0.9).collect()) + sum(n * n for n in size.values()) / 2
    assert products < 0.2 * 300 * 300 / 2
    assert similar.similar_pairs(df.limit(0), 0.5).count() == 0


def test_scratch_of_clustering_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: f"file://{tmp_path}")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(CASES["clusters"][0][:60])], "id long, vector array<double>")
    empty = spark.createDataFrame([], "topic_id long, n long, centroid array<double>")
    done, found = topics.cluster_incremental(df, empty, 0.75, batch=40)
    assert done.count() == 60 and found.agg(F.sum("n")).first()[0] == 60
    assert sorted(x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)) == ["cluster-assigned", "cluster-topics"]


def test_a_model_of_the_user_embeds(spark):
    def model():
        def predict(texts):
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])

        return predict

    texts = ["banana", "", None, "a " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    got = {r.id: r.vector for r in topics.embed(df, model=model, batch_size=2).collect()}
    for i, t in enumerate(texts):
        v = np.array([len(t or ""), (t or "").count("a"), 1.0])
        assert np.allclose(got[i], v / np.linalg.norm(v))
    empty = spark.createDataFrame([(1, None), (2, [])], "id long, tokens array<string>")
    assert [r.vector for r in topics.embed(empty, dim=3).collect()] == [[0.0] * 3] * 2


def test_batches_see_the_topics_at_their_begin(spark):
    v, threshold = CASES["clusters"][0], 0.75
    topic, want = {}, {}
    for at in range(0, len(v), 150):
        rows = range(at, min(at + 150, len(v)))
        known = {t: c / np.linalg.norm(c) for t, (c, _) in topic.items()}
        near = lambda i, c: max(c, key=lambda t: (float(c[t] @ v[i]), -t), default=None)
        hit = {i: near(i, known) for i in rows if known and float(known[near(i, known)] @ v[i]) >= threshold}
        left = [i for i in rows if i not in hit]
        fresh = {len(topic) + 1 + k: left[j] for k, j in enumerate(sequential(v[left], threshold))}
        starts = {t: v[i] for t, i in fresh.items()}
        hit |= {i: near(i, starts) for i in left}
        hit |= {i: t for t, i in fresh.items()}
        topic |= {t: (v[i] * 0, 0) for t, i in fresh.items()}
        # a centroid is normalised after each batch
        for t in set(hit.values()):
            c, n = topic[t]
            own = [i for i in rows if hit[i] == t]
            c = c / np.linalg.norm(c) * n if n else c
            topic[t] = c + v[own].sum(0), n + len(own)
        want |= hit
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(4)
    empty = spark.createDataFrame([], "topic_id long, n long, centroid array<double>")
    done, found = topics.cluster_incremental(df, empty, threshold, batch=150)
    assert {r.id: r.topic_id for r in done.collect()} == want
    assert {r.topic_id: r.n for r in found.collect()} == {t: n for t, (_, n) in topic.items()}
