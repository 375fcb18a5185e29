"""Streams on file sources give what the same job gives on tables."""

from datetime import datetime

import numpy as np
import pytest
from opinara import scratch
from opinara.operators.topics import cluster_incremental
from opinara.plans import more_queries, payload_queries
from opinara.streaming import buckets, streams
from pyspark.sql import functions as F

RAW = "note_id string, title string, liked_count string, last_modify_ts long, add_ts long"


def test_unify_stream_keeps_the_latest_row_of_a_key(spark, tmp_path):
    for number, rows in enumerate([[("a", "x", "1", 5, 1), ("a", "y", "2", 9, 2), ("b", "z", "3", 1, 1)], [("a", "w", "7", 20, 3), ("c", "v", "4", 2, 2)]]):
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        source = spark.readStream.schema(RAW).parquet(f"{tmp_path}/raw")
        streams.stream_unify(spark, source, "xhs", f"file://{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        table = buckets.BucketTable(spark, f"file://{tmp_path}/out", streams.KEYS)
        got = {r.content_id: (r.title, r.liked_count) for r in table.read().collect()}
        assert table.versions()[-1] == number
        assert got == [{"a": ("y", 2), "b": ("z", 3)}, {"a": ("w", 7), "b": ("z", 3), "c": ("v", 4)}][number]


def data_files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*.parquet")}


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    schema = "k long, v long, w long"
    make = lambda keys, v: spark.createDataFrame([(k, v, v) for k in keys], schema)
    table = buckets.BucketTable(spark, f"file://{tmp_path}/t", ["k"], buckets=16, keep=2)
    table.upsert(make([None, *range(200)], 0), 0)
    first = data_files(tmp_path / "t/data")
    table.upsert(make([5, 900], 1), 1, ["v"])
    second = data_files(tmp_path / "t/data")
    fresh = {f.split("/")[1] for f in second if f.startswith("v1/")}
    assert first.items() <= second.items() and 1 <= len(fresh) <= 2
    want = {k: (0, 0) for k in [None, *range(200)]} | {5: (1, 0), 900: (1, 1)}
    assert {r.k: (r.v, r.w) for r in table.read().collect()} == want
    # a batch that failed before its list was written, and one that is repeated whole
    spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/t/lists/v1").getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/t/lists/v1"), True)
    assert table.versions() == [0] and table.read().filter("v = 1").count() == 0
    for _ in range(2):
        table.upsert(make([5, 900], 1), 1, ["v"])
        assert {r.k: (r.v, r.w) for r in table.read().collect()} == want and table.read().count() == len(want)
    # old versions go, an empty batch changes nothing
    table.upsert(make([None], 2), 2)
    table.upsert(make([], 3), 3)
    assert table.versions() == [2, 3]
    assert {r.k: (r.v, r.w) for r in table.read().collect()} == want | {None: (2, 2)}
    named = {f"v{v}/bucket={b}" for n in (2, 3) for b, v in table.owners(n).items()}
    assert {f.rsplit("/", 1)[0] for f in data_files(tmp_path / "t/data")} == named


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i % 7, datetime(2024, 1, 1, i % 5), "好 https://a.cn text" if i % 2 else None) for i in range(40)]
    spark.createDataFrame(rows, "k long, ts timestamp, content string").coalesce(1).write.parquet(f"{tmp_path}/events")
    table = spark.read.parquet(f"{tmp_path}/events")
    return table, spark.readStream.schema(table.schema).parquet(f"{tmp_path}/events")


def run(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(str, df.sparkSession.table(name).collect()))


def test_streams_equal_batches(events):
    table, stream = events
    assert run(streams.stream_process(stream), "processed") == sorted(map(str, streams.stream_process(table).collect()))
    assert len(run(streams.stream_dedupe(stream, ["k"], "ts", "1 day"), "deduped")) == 7
    heat = lambda df: streams.stream_daily_heat(df, "1 day", "ts", "k")
    assert run(heat(stream), "heat", "complete") == sorted(map(str, heat(table).collect()))
    hot = lambda df: streams.stream_hot_counts(df, "2 hours", "ts", "k")
    assert run(hot(stream), "hot", "complete") == sorted(map(str, hot(table).collect()))


def test_late_rows_come_back_by_refresh(spark, tmp_path):
    """A late row is dropped from the stream, stands in the side table, and a refresh gives the batch result."""
    day = lambda d, h=0: datetime(2024, 1, d, h)
    batches = [[(1, day(1, 3)), (1, day(1, 5)), (2, day(2))], [(1, day(1, 23)), (1, day(5)), (3, None)], [(1, day(1, 4)), (2, day(2, 1)), (1, day(5, 1)), (2, day(4, 23))], [(2, day(2, 2)), (9, day(30))]]
    schema = spark.createDataFrame([], "k long, ts timestamp").schema
    root, every = f"file://{tmp_path}", []
    for rows in [*batches, [(9, day(30, 1))]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        every += rows
        streams.stream_route_late(spark.readStream.schema(schema).parquet(f"{root}/in"), "ts", "1 day", "1 days", root, f"{root}/c1").awaitTermination()
        streams.stream_final_counts(spark, root, schema, "ts", "1 day", ["k"], "1 days", f"{root}/c2").awaitTermination()
    late = spark.read.parquet(f"{root}/late").drop("batch")
    assert sorted(map(tuple, late.collect())) == [(1, day(1, 4)), (2, day(2, 1)), (2, day(2, 2))]
    final = spark.read.parquet(f"{root}/final")
    whole = streams.windowed_counts(spark.createDataFrame(every, schema), "ts", "1 day", ["k"]).filter("start IS NOT NULL AND k < 9")
    as_set = lambda df: {(r.start, r.k, r.n) for r in df.collect()}
    assert as_set(final.filter("k < 9")) < as_set(whole) | {(day(1), 1, 3), (day(2), 2, 1)} and as_set(final.filter("k < 9")) != as_set(whole)
    assert as_set(streams.refresh_counts(final, late, "ts", "1 day", ["k"]).filter("k < 9")) == as_set(whole)


def test_clustering_stream_keeps_topics_as_state(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = np.eye(8)[rng.integers(0, 4, 40)] + 0.1 * rng.normal(size=(40, 8))
    rows = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]
    schema = "id long, vector array<double>"
    topics = empty = spark.createDataFrame([], "topic_id long, n long, centroid array<double>")
    want = {}
    for number, own in enumerate((rows[:25], rows[25:])):
        df = spark.createDataFrame(own, schema).coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streams.stream_cluster(source, f"file://{tmp_path}/out", f"{tmp_path}/checkpoint", empty).awaitTermination()
        assigned, topics = cluster_incremental(df, topics)
        want |= {r.id: r.topic_id for r in assigned.collect()}
        now = buckets.BucketTable(spark, f"file://{tmp_path}/out/topics", ["topic_id"]).read()
        assert {r.topic_id: r.n for r in now.collect()} == {r.topic_id: r.n for r in topics.collect()}
        assert {r.id: r.topic_id for r in spark.read.parquet(f"{tmp_path}/out/assigned/v*").collect()} == want
    assert 4 <= len(set(want.values())) < 40


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError):
        scratch.scratch_root(Session)


@pytest.mark.parametrize("name", ["flat_xhs_note", "flat_douyin_video", "flat_weibo_note", "flat_zhihu_content", "forum_comments", "forum_profile", "crawl_plan", "upsert_edges", "upsert_raw", "times_and_texts", "assign_topics"])
def test_more_sql(spark, sf, name):
    from test_library import test_sql

    assert name in payload_queries.QUERIES or name in more_queries.QUERIES
    test_sql(spark, sf, name)
