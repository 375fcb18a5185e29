"""Topics: clustering, merging, life cycle, heat, evolution and reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.vectors import l2_normalize, mean_vectors, nearest
from opinara.operators.leaders import leaders, numbered
from opinara.operators.similar import similar_pairs
from opinara.operators.upsert import upsert
from opinara.scratch import new_table, tidy, written

MATCH, MERGE = 0.75, 0.90
GROW, IDLE_DAYS, END_DAYS = 10, 7, 30
STATUSES = ("emerging", "active", "declining", "ended", "merged")


def unclustered(content: DataFrame, processed: DataFrame) -> DataFrame:
    """Processed rows with a text and no topic, by id."""
    p = processed.filter("status = 'completed' AND clean_content != ''").select(F.col("unified_id").alias("id"), "clean_content")
    return content.filter("topic_id IS NULL").join(p, "id").orderBy("id")


def embed(df: DataFrame, tokens: str = "tokens", dim: int = 64, to: str = "vector", model: Callable | None = None, text: str = "text", batch_size: int = 64) -> DataFrame:
    """``df`` with a normalised vector.

    ``model`` is a function that loads the user's model, once in each worker, and returns a function from an
    array of ``batch_size`` texts to a matrix; null texts count as empty.  Without it the vector is made
    of ``dim`` signed hashed counts of the tokens; rows without tokens get zeros.
    """
    if model is not None:
        run = predict_batch_udf(model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
        return df.withColumn(to, run(F.coalesce(text, F.lit("")))).withColumn(to, l2_normalize(F.col(to)))
    # 32 bits of a hash choose the slot, the next the sign
    slot = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim
    codes = F.transform(F.transform(tokens, lambda w: F.md5(w)), lambda h: (slot(h) * 2 + (F.substring(h, 9, 1) >= "8").cast("long")).cast("int"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def counted(codes: pd.Series) -> pd.Series:
        sums = (np.bincount(c, minlength=2 * dim) if c is not None and len(c) else np.zeros(2 * dim) for c in codes)
        return pd.Series([(n[::2] - n[1::2]).astype(float) for n in sums])

    return df.withColumn(to, counted(codes)).withColumn(to, l2_normalize(F.col(to)))


def update_centroids(topics: DataFrame, assigned: DataFrame) -> DataFrame:
    """Topics (topic_id, n, centroid) moved to the running mean over their new rows (topic_id, vector)."""
    both = topics.select("topic_id", F.col("n").cast("double").alias("w"), F.col("centroid").alias("v"), F.col("n").cast("long").alias("m"))
    more = assigned.select("topic_id", F.lit(1.0).alias("w"), F.col("vector").alias("v"), F.lit(1).cast("long").alias("m"))
    every = both.unionByName(more)
    # each vector counts once, whatever its number of components
    counts = every.groupBy("topic_id").agg(F.sum("m").alias("n"))
    return counts.hint("merge").join(mean_vectors(every, "topic_id", "v", F.col("w")).drop("n"), "topic_id")


def _batches(items: DataFrame, batch: int) -> tuple[str, int]:
    """``items`` written by batch, their place in id order over ``batch``: the folder, and the number of batches."""
    rows = numbered(items, ["id"], "place").withColumn("batch", F.floor(F.col("place") / batch).cast("long")).drop("place")
    root = new_table(items.sparkSession, "cluster-batches")
    rows.write.partitionBy("batch").parquet(root)
    last = rows.agg(F.max("batch")).first()[0]
    return root, 0 if last is None else last + 1


@tidy
def cluster_batch(rows: DataFrame, topics: DataFrame, threshold: float = MATCH) -> tuple[DataFrame, DataFrame]:
    """(assigned, topics) of one batch of rows (id, vector) against topics (topic_id, n, centroid), written.

    Rows are compared with the topics as they are; those left whose vectors are within the threshold of no
    leader before them in id order are leaders and start topics, and the others join the nearest
    leader.  Centroids move at the end.
    """
    topics = topics.select("topic_id", F.col("n").cast("long").alias("n"), "centroid")
    next_id = (topics.agg(F.max("topic_id")).first()[0] or 0) + 1
    near = written(nearest(rows, topics, 1).filter(F.col("similarity") >= threshold).select("id", "topic_id", "similarity"), "cluster-near")
    left = written(rows.hint("merge").join(near.select("id"), "id", "left_anti"), "cluster-left")
    # numbered by place in id order
    fresh = numbered(leaders(left, threshold), ["id"], "place").select("id", F.col("vector").alias("centroid"), (F.col("place") + next_id).alias("topic_id"))
    fresh = written(fresh, "cluster-fresh")
    first = fresh.select("id", "topic_id", F.lit(1.0).alias("similarity"))
    rest = nearest(left.hint("merge").join(fresh.select("id"), "id", "left_anti"), fresh.select("topic_id", "centroid"), 1)
    assigned = written(near.unionByName(first).unionByName(rest.select("id", "topic_id", "similarity")), "cluster-assigned")
    moved = rows.hint("merge").join(assigned.select("id", "topic_id"), "id").hint("merge").join(fresh.select("id"), "id", "left_anti")
    every = topics.unionByName(fresh.select("topic_id", F.lit(1).cast("long").alias("n"), "centroid"))
    return assigned, written(update_centroids(every, moved.select("topic_id", "vector")), "cluster-topics")


@tidy
def cluster_incremental(items: DataFrame, topics: DataFrame, threshold: float = MATCH, batch: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(assigned, topics): items (id, vector) in batches by id join the nearest topic from
    ``threshold`` on, or start topics of their own.

    A batch is synchronous, see ``cluster_batch``; with batches of one row this is the sequential rule.
    A batch of any size takes a few jobs, so large ones are cheap; only the rows of a batch are read for it.
    ``assigned`` has id, topic_id and the similarity before the update, 1.0 for a topic's first row.
    Ids are unique; rows without an id or a vector take no part.
    """
    spark = items.sparkSession
    items = items.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).dropna()
    root, batches = _batches(items, batch)
    schema = f"id {dict(items.dtypes)['id']}, topic_id long, similarity double"
    topics = written(topics.select("topic_id", F.col("n").cast("long").alias("n"), "centroid"), "cluster-topics")
    if not batches:
        return spark.createDataFrame([], schema), topics
    assigned = new_table(spark, "cluster-assigned")
    for turn in range(batches):
        rows = spark.read.schema(items.schema).parquet(f"{root}/batch={turn}")
        found, topics = cluster_batch(rows, topics, threshold)
        found.write.parquet(f"{assigned}/turn={turn}")
    return spark.read.schema(schema).parquet(assigned).select("id", "topic_id", "similarity"), topics


def new_topics(seeds: DataFrame) -> DataFrame:
    """A topic's first name and keywords from its seed (topic_id, keywords, title)."""
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    name = F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 5), "/"), F.lit("")), F.nullif(F.substring("title", 1, 50), F.lit("")), F.lit("话题-未命名"))
    top = F.transform(F.slice(words, 1, 10), lambda w: F.struct(w.alias("word"), F.lit(1.0).alias("weight")))
    return seeds.withColumns({"name": name, "keywords": top, "status": F.lit("emerging"), "content_count": F.lit(1).cast("long")})


def assign_topics(content: DataFrame, assigned: DataFrame, now: datetime) -> DataFrame:
    """Assignments (id, topic_id, similarity) written to their rows."""
    rows = assigned.select("id", "topic_id", F.col("similarity").alias("topic_similarity"), F.lit(now).alias("topic_assigned_at"))
    return upsert(content, rows.join(content.select("id"), "id", "left_semi"), ["id"], ["topic_id", "topic_similarity", "topic_assigned_at"])


def recluster(content: DataFrame, vectors: DataFrame, threshold: float = MATCH, batch: int = 100_000, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Everything clustered anew from an empty topic table."""
    empty = vectors.sparkSession.createDataFrame([], "topic_id long, n long, centroid array<double>")
    assigned, topics = cluster_incremental(vectors, empty, threshold, batch)
    blank = content.withColumns({c: F.lit(None).cast(t) for c, t in content.dtypes if c in ("topic_id", "topic_similarity", "topic_assigned_at")})
    return assign_topics(blank, assigned, now or datetime(1970, 1, 1)), topics


def topic_pairs(topics: DataFrame, min_sim: float) -> DataFrame:
    return similar_pairs(topics, min_sim)


@tidy
def merge_topics(topics: DataFrame, pairs: DataFrame, threshold: float = MERGE) -> DataFrame:
    """(source, target, similarity): greedy merging of pairs from ``threshold`` on, best first, the
    smaller topic into the larger (equal: into the lesser id); a merged topic is in no later pair.

    Rounds of locally first pairs give the sequential result: a pair is taken when no open pair
    before it has its source or target; then pairs go whose source is merged, or whose target was
    merged before their turn.
    """
    n = topics.select("topic_id", F.coalesce("content_count", F.lit(0)).alias("c"))
    p = pairs.filter(F.col("similarity") >= threshold)
    p = p.hint("merge").join(n.select(F.col("topic_id").alias("topic_a"), F.col("c").alias("ca")), "topic_a").hint("merge").join(n.select(F.col("topic_id").alias("topic_b"), F.col("c").alias("cb")), "topic_b")
    into_a = F.col("ca") >= F.col("cb")
    p = p.select(
        F.when(into_a, F.col("topic_b")).otherwise(F.col("topic_a")).alias("source"),
        F.when(into_a, F.col("topic_a")).otherwise(F.col("topic_b")).alias("target"),
        "similarity",
        F.struct((-F.col("similarity")).alias("s"), "topic_a", "topic_b").alias("rank"),
    )
    open_, done = written(p, "merge-open"), None
    while open_.head(1):
        ends = open_.select(F.col("source").alias("t"), "rank").unionAll(open_.select(F.col("target").alias("t"), "rank"))
        best = ends.groupBy("t").agg(F.min("rank").alias("best"))
        x = open_.join(best.select(F.col("t").alias("source"), F.col("best").alias("bs")), "source").join(best.select(F.col("t").alias("target"), F.col("best").alias("bt")), "target")
        taken = written(x.filter((F.col("rank") == F.col("bs")) & (F.col("rank") == F.col("bt"))).select("source", "target", "similarity", "rank"), "merge-taken")
        done = taken if done is None else done.unionByName(taken)
        gone = taken.select(F.col("source").alias("g"), F.col("rank").alias("at"))
        left = open_.join(gone.select(F.col("g").alias("source")), "source", "left_anti")
        left = left.join(gone.select(F.col("g").alias("target"), "at"), "target", "left").filter(F.col("at").isNull() | (F.col("rank") < F.col("at")))
        open_ = written(left.select("source", "target", "similarity", "rank"), "merge-open")
    return (done if done is not None else open_).select("source", "target", "similarity")


@tidy
def resolve_merges(merges: DataFrame) -> DataFrame:
    """(source, target) with chains followed to their end, by pointer jumping."""
    m = written(merges.select("source", "target"), "merge-chain")
    while True:
        up = m.select(F.col("source").alias("target"), F.col("target").alias("next"))
        j = written(m.join(up, "target", "left").select("source", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")), "merge-chain")
        m = j.select("source", "target")
        if not j.filter("moved").head(1):
            return m


def reassign_merged(content: DataFrame, merges: DataFrame) -> DataFrame:
    """Contents of merged topics moved to where their chain ends."""
    m = resolve_merges(merges).select(F.col("source").alias("topic_id"), F.col("target").alias("_to"))
    return content.join(m, "topic_id", "left").withColumn("topic_id", F.coalesce("_to", "topic_id")).select(*content.columns)


def merge_log(merges: DataFrame, topics: DataFrame) -> DataFrame:
    """Log rows: similarity, a reason, the source's size and keywords."""
    t = topics.select(F.col("topic_id").alias("source"), F.col("content_count").alias("source_content_count"), "keywords")
    return merges.join(t, "source").withColumn("reason", F.format_string("相似度 %.4f", "similarity"))


def active_topics(t: DataFrame) -> DataFrame:
    return t.filter(~F.col("status").isin("merged", "ended"))


def non_merged(t: DataFrame) -> DataFrame:
    return t.filter(F.col("status") != "merged")


def update_lifecycle(topics: DataFrame, stats: DataFrame, now: datetime) -> DataFrame:
    """Topics with their next status from stats (topic_id, content_count, last_at).  Idle days are whole
    spans of 24 hours; topics without a content time stay as they are."""
    s = stats.select("topic_id", F.col("content_count").alias("_n"), "last_at")
    idle = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_at").cast("timestamp"))) / 86_400)
    next_ = (
        F.when(F.col("last_at").isNull(), F.col("status"))
        .when((F.col("status") == "emerging") & (F.col("_n") >= GROW), "active")
        .when(F.col("status").isin("emerging", "active") & (idle >= IDLE_DAYS), "declining")
        .when((F.col("status") == "declining") & (idle >= END_DAYS), "ended")
        .otherwise(F.col("status"))
    )
    return topics.join(s, "topic_id", "left").withColumn("status", next_).select(*topics.columns)


def with_interaction(df: DataFrame) -> DataFrame:
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("liked_count", "comment_count", "share_count")), F.lit(0))
    return df.withColumn("interaction", total.cast("long"))


def topic_content_stats(content: DataFrame) -> DataFrame:
    """One row a topic: counts, mean score, sentiment counts, interactions, first and last time and the
    day with most contents; one aggregate for all topics."""
    c = content.filter("topic_id IS NOT NULL")
    named = {"pos": "positive", "neu": "neutral", "neg": "negative"}
    out = c.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("content_count"),
        F.avg("sentiment_score").alias("mean_score"),
        *[F.count_if(F.col("sentiment") == v).alias(k) for k, v in named.items()],
        *[F.sum(F.coalesce(F.col(x), F.lit(0))).cast("long").alias(to) for x, to in (("liked_count", "likes"), ("comment_count", "comments"), ("share_count", "shares"))],
        F.min("original_created_at").alias("first_at"),
        F.max("original_created_at").alias("last_at"),
    )
    days = c.filter("original_created_at IS NOT NULL").groupBy("topic_id", F.to_date("original_created_at").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    peak = days.groupBy("topic_id").agg(F.max_by("d", F.struct("n", (-F.unix_date("d")).alias("x"))).alias("peak_at"))
    out = out.withColumn("interaction", F.col("likes") + F.col("comments") + F.col("shares"))
    return out.join(peak, "topic_id", "left")


def platform_distribution(content: DataFrame) -> DataFrame:
    """(topic_id, platforms): a map of contents by platform."""
    n = content.filter("topic_id IS NOT NULL").groupBy("topic_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("topic_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "n")))).alias("platforms"))


def dominant_emotions(content: DataFrame, most: int = 3) -> DataFrame:
    """(topic_id, emotions): the most frequent tags joined by commas, ties by tag."""
    tags = content.filter("topic_id IS NOT NULL")
    if dict(content.dtypes)["emotion_tags"] == "string":
        tags = tags.withColumn("emotion_tags", F.from_json("emotion_tags", "array<string>"))
    n = tags.select("topic_id", F.explode("emotion_tags").alias("tag")).groupBy("topic_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy("topic_id").orderBy(F.desc("n"), "tag")
    top = n.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most)
    return top.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ",").alias("emotions"))


def dominant_sentiment(stats: DataFrame) -> DataFrame:
    """``stats`` with ``dominant``: mixed if the top share is under 0.4; ties positive, neutral, negative."""
    total = F.col("pos") + F.col("neu") + F.col("neg")
    top = F.greatest("pos", "neu", "neg")
    name = F.when((F.col("pos") >= F.col("neu")) & (F.col("pos") >= F.col("neg")), "positive").when(F.col("neu") >= F.col("neg"), "neutral").otherwise("negative")
    return stats.withColumn("dominant", F.when((total > 0) & (top / total < 0.4), "mixed").otherwise(name))


def heat_level(stats: DataFrame) -> DataFrame:
    heat = F.col("content_count") * 5 + F.col("interaction") * 0.01
    return stats.withColumn("heat", F.when(heat >= 500, "critical").when(heat >= 100, "high").when(heat >= 20, "medium").otherwise("low"))


def hot_score(df: DataFrame, new: str = "new_count", interaction: str = "interaction") -> DataFrame:
    return df.withColumn("hot_score", F.col(new) * 10 + F.col(interaction) * 0.01)


def update_topic_stats(topics: DataFrame, content: DataFrame) -> DataFrame:
    """Topics with all statistics renewed; a missing mean score is 0."""
    s = heat_level(dominant_sentiment(topic_content_stats(content))).withColumn("mean_score", F.coalesce("mean_score", F.lit(0.0)))
    s = s.join(platform_distribution(content).hint("merge"), "topic_id", "left").join(dominant_emotions(content).hint("merge"), "topic_id", "left")
    return topics.select(*[c for c in topics.columns if c == "topic_id" or c not in s.columns]).join(s, "topic_id", "left")


def daily_stats(content: DataFrame, day: str | None = None) -> DataFrame:
    """(topic_id, day, new_count, mean_score, interaction) by day of assignment."""
    c = with_interaction(content.filter("topic_id IS NOT NULL")).withColumn("day", F.to_date("topic_assigned_at"))
    c = c.filter(F.col("day") == F.lit(day).cast("date")) if day else c
    return c.groupBy("topic_id", "day").agg(F.count(F.lit(1)).alias("new_count"), F.avg("sentiment_score").alias("mean_score"), F.sum("interaction").alias("interaction"))


def evolution_snapshot(topics: DataFrame, content: DataFrame, day: str, evolution: DataFrame | None = None) -> DataFrame:
    """A snapshot row for each live topic of a day, put over an earlier one of the same day.

    Day counts, mean score (0 is null) and interactions are the day's; sentiment counts and platforms
    are of all time."""
    every = dominant_sentiment(topic_content_stats(content)).select("topic_id", F.col("content_count").alias("total_count"), "pos", "neu", "neg", "dominant")
    d = daily_stats(content, day).drop("day")
    rows = non_merged(topics).select("topic_id", "status").join(every, "topic_id", "left").join(d, "topic_id", "left")
    rows = rows.join(platform_distribution(content), "topic_id", "left")
    rows = rows.withColumns({"snapshot_date": F.lit(day).cast("date"), "new_count": F.coalesce("new_count", F.lit(0)), "interaction": F.coalesce("interaction", F.lit(0)), "mean_score": F.nullif(F.col("mean_score"), F.lit(0.0))})
    rows = hot_score(rows)
    return upsert(evolution, rows.select(*evolution.columns), ["topic_id", "snapshot_date"]) if evolution is not None else rows


def evolution_history(evolution: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` snapshots of each topic."""
    last = W.partitionBy("topic_id").orderBy(F.desc("snapshot_date"))
    return evolution.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_r")


def topic_overview(topics: DataFrame) -> DataFrame:
    """Live topics with their duration in calendar days, newest first."""
    return non_merged(topics).withColumn("duration_days", F.datediff("last_at", "first_at")).orderBy(F.desc("last_at"), "topic_id")


def topic_sentiment(topics: DataFrame, content: DataFrame) -> DataFrame:
    """(topic_id, platform): contents, mean score and sentiment counts."""
    c = content.join(non_merged(topics).select("topic_id"), "topic_id")
    return c.groupBy("topic_id", "platform").agg(
        F.count(F.lit(1)).alias("content_count"),
        F.avg("sentiment_score").alias("mean_score"),
        *[F.count_if(F.col("sentiment") == v).alias(f"{v}_count") for v in ("positive", "neutral", "negative")],
    )


def topic_comments(topics: DataFrame, content: DataFrame, comment: DataFrame) -> DataFrame:
    """Comments of the contents of each topic."""
    c = content.select("topic_id", "platform", "content_id").join(topics.select("topic_id"), "topic_id")
    return comment.join(c, ["platform", "content_id"])


def topic_status_counts(t: DataFrame) -> DataFrame:
    """(status, n, place) in the fixed order of statuses."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return t.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).orderBy("place")


def topic_totals(t: DataFrame) -> DataFrame:
    return non_merged(t).agg(F.count(F.lit(1)).alias("topics"), F.sum("content_count").alias("contents"), F.avg("content_count").alias("mean_size"), F.max("content_count").alias("max_size"))


def _of_topic(content: DataFrame, n: int) -> DataFrame:
    best = W.partitionBy("topic_id").orderBy(F.desc("topic_similarity"), "id")
    return content.filter("topic_id IS NOT NULL").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n)


def wordcloud(content: DataFrame, processed: DataFrame, topics: DataFrame, limit: int = 200, top: int = 100) -> DataFrame:
    """(topic_id, word, weight, rank): keywords counted over a topic's ``limit`` nearest contents, and its
    own keywords at five times their weight."""
    words = _of_topic(content, limit).select("topic_id", "id").join(processed.select(F.col("unified_id").alias("id"), "keywords"), "id")
    counts = words.select("topic_id", F.explode("keywords").alias("word")).withColumn("weight", F.lit(1.0))
    own = topics.select("topic_id", F.explode("keywords").alias("k")).select("topic_id", F.col("k.word").alias("word"), (F.col("k.weight") * 5).alias("weight"))
    sums = counts.unionByName(own).groupBy("topic_id", "word").agg(F.round(F.sum("weight"), 4).alias("weight"))
    best = W.partitionBy("topic_id").orderBy(F.desc("weight"), "word")
    return sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def representatives(content: DataFrame, n: int) -> DataFrame:
    """The ``n`` contents nearest to each topic, with their place r."""
    return _of_topic(content, n)


def topic_prompts(reps: DataFrame, chars: int = 200) -> DataFrame:
    """(topic_id, prompt): numbered lines of platform, sentiment and title, each with the head of its body."""
    line = F.concat(F.col("r").cast("string"), F.lit(". ["), F.col("platform"), F.lit("] "), F.when(F.col("sentiment").isNotNull(), F.concat(F.lit("[情感:"), F.col("sentiment"), F.lit("] "))).otherwise(""), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    rows = reps.select("topic_id", "r", line.alias("line"))
    return rows.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


def unnamed_topics(t: DataFrame) -> DataFrame:
    return t.filter(F.col("name").startswith("话题-") | F.col("name").contains("/"))


def parse_topic_reply(df: DataFrame, col: str) -> DataFrame:
    """``df`` with name, summary and keywords (word, weight) of a naming reply, null without a name.
    Names are cut to 200, weights held to 0 to 1; a plain text keyword weighs 1."""
    v = F.try_parse_json(F.regexp_extract(F.col(col), r"\{(?:[^{}]|\{[^{}]*\})*\}", 0))
    get = lambda p, k: F.try_variant_get(F.col("_v"), p, k)
    held = lambda w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(w, F.lit(1.0))))
    words = F.transform(get("$.keywords", "array<variant>"), lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.word", "string"), F.try_variant_get(x, "$", "string")).alias("word"), held(F.try_variant_get(x, "$.weight", "double")).alias("weight")))
    out = df.withColumn("_v", v).withColumns({"name": F.substring(F.nullif(get("$.name", "string"), F.lit("")), 1, 200), "summary": get("$.summary", "string"), "keywords": words})
    return out.drop("_v")


def mean_centroids(df: DataFrame, key: Column | str = "topic_id", vector: str = "vector") -> DataFrame:
    return mean_vectors(df, key, vector)
