"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opinara.functions.text import clean
from opinara.operators.adapters import adapt_content
from opinara.operators.tokens import drop_stopwords, latin_tokens
from opinara.operators.topics import cluster_incremental
from opinara.operators.upsert import latest
from opinara.streaming.buckets import BUCKETS, BucketTable

KEYS = ["platform", "content_id"]
#: Columns that a repeated delivery does not renew.
KEPT = ["user_id", "gender", "content_url", "source_keyword", "original_created_at", "add_ts"]


def stream_unify(spark: SparkSession, source: DataFrame, platform: str, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Raw rows of a platform, upserted into unified content batch by batch: ``BucketTable(spark, root, KEYS)``."""

    def step(batch: DataFrame, number: int) -> None:
        rows = latest(adapt_content(batch, platform), KEYS, [F.col("last_modify_ts"), F.col("add_ts"), F.col("content")])
        BucketTable(batch.sparkSession, root, KEYS, buckets).upsert(rows, number, [c for c in rows.columns if c not in KEYS + KEPT])

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_process(df: DataFrame, col: str = "content") -> DataFrame:
    """Clean text and tokens; the same on a stream and on a table."""
    return df.withColumn("clean_content", clean(F.col(col))).withColumn("tokens", drop_stopwords(latin_tokens(F.col("clean_content"))))


def windowed_counts(df: DataFrame, ts: str, width: str, keys: list[str]) -> DataFrame:
    g = df.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), *keys, "n")


def stream_daily_heat(df: DataFrame, delay: str, ts: str = "topic_assigned_at", key: str = "topic_id") -> DataFrame:
    """Contents by topic and day of assignment."""
    return windowed_counts(df.withWatermark(ts, delay) if df.isStreaming else df, ts, "1 day", [key])


def stream_hot_counts(df: DataFrame, delay: str, ts: str = "fetched_at", key: str = "platform_code") -> DataFrame:
    return windowed_counts(df.withWatermark(ts, delay) if df.isStreaming else df, ts, "2 hours", [key])


def stream_cluster(source: DataFrame, root: str, checkpoint: str, empty_topics: DataFrame, cluster: Callable = cluster_incremental, buckets: int = BUCKETS) -> StreamingQuery:
    """Vectors (id, vector) clustered batch by batch.  The state is the topic table, ``BucketTable`` under
    ``root``/topics: a batch rewrites the buckets of the topics that it moves or starts.  Its
    assignments stand under ``root``/assigned/v<batch>."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = BucketTable(spark, f"{root}/topics", ["topic_id"], buckets)
        before = [v for v in table.versions() if v < number]
        assigned, topics = cluster(batch, table.read(before[-1]) if before else empty_topics)
        assigned.write.mode("overwrite").parquet(f"{root}/assigned/v{number}")
        moved = spark.read.schema(assigned.schema).parquet(f"{root}/assigned/v{number}").select("topic_id").distinct()
        table.upsert(topics.hint("merge").join(moved, "topic_id", "left_semi"), number)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _window_end(ts: str, width: str):
    return F.window(ts, width)["end"]


def split_late(batch: DataFrame, ts: str, width: str, high: datetime | None, delay: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a batch, by the rule of a watermark: a row is late if its window has ended
    ``delay`` before ``high``, the highest time of the batches before.  Rows without a time are in time."""
    if high is None:
        return batch, batch.limit(0)
    late = F.coalesce(_window_end(ts, width) <= F.lit(high) - F.expr(f"INTERVAL {delay}"), F.lit(False))
    return batch.filter(~late), batch.filter(late)


def stream_route_late(source: DataFrame, ts: str, width: str, delay: str, root: str, checkpoint: str) -> StreamingQuery:
    """Rows in time go to ``root``/in_time/batch=n, late ones to the side table ``root``/late/batch=n.

    The highest time is kept between batches under ``root``/high.  A repeated batch writes the same files'
    rows again, but not rows in time that are whole already: a stream may have read them.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        high = spark.read.parquet(f"{root}/high/v{number - 1}").first()[0] if number else None
        good, late = split_late(batch, ts, width, high, delay)
        late.write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        batch.agg(F.greatest(F.max(ts), F.lit(high).cast(dict(batch.dtypes)[ts])).alias("high")).write.mode("overwrite").parquet(f"{root}/high/v{number}")
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/in_time/batch={number}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            good.write.mode("overwrite").parquet(f"{root}/in_time/batch={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_final_counts(spark: SparkSession, root: str, schema: T.StructType, ts: str, width: str, keys: list[str], delay: str, checkpoint: str) -> StreamingQuery:
    """Counts of windows that have ended, from ``stream_route_late``'s rows in time, appended to ``root``/final.

    The watermark closes a window and drops its state.  It is never ahead of the rule by which rows were told
    apart, since it comes from the same rows a batch or more later: nothing in time is dropped here, and
    what is late stands in the side table.
    """
    rows = spark.readStream.schema(schema).parquet(f"{root}/in_time").drop("batch")
    counts = windowed_counts(rows.withWatermark(ts, delay), ts, width, keys)
    return counts.writeStream.format("parquet").option("path", f"{root}/final").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refresh_counts(final: DataFrame, late: DataFrame, ts: str, width: str, keys: list[str]) -> DataFrame:
    """``final`` with the late rows folded into their windows, which have all ended."""
    both = final.unionByName(windowed_counts(late, ts, width, keys).select(*final.columns))
    return both.groupBy(*[c for c in final.columns if c != "n"]).agg(F.sum("n").alias("n")).select(*final.columns)
