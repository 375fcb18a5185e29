"""Nested payloads and edge lists as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contact_edges(fans: DataFrame, followings: DataFrame) -> DataFrame:
    """(up_id, fan_id) once each, from fans (creator_id, fan_id) and followings (creator_id, up_id)."""
    a = fans.select(F.col("creator_id").alias("up_id"), "fan_id")
    b = followings.select("up_id", F.col("creator_id").alias("fan_id"))
    return a.unionByName(b).dropDuplicates(["up_id", "fan_id"])


def cap_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """At most ``n`` rows a key, in order: a feature of crawling, which takes so many comments a post."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def cap_per_day_then_total(df: DataFrame, per_day: int, total: int, keyword: str = "keyword", day: str = "day", order: str = "id") -> DataFrame:
    """At most ``per_day`` rows a keyword and day, then at most ``total`` a keyword by day."""
    d = cap_per_key(df, [keyword, day], [order], per_day)
    return cap_per_key(d, [keyword], [day, order], total)


def flatten_bili_video(df: DataFrame) -> DataFrame:
    """A video's payload (View: {...}) as a row: counts as text, title and description cut to 500."""
    v = "View"
    text = lambda c, default="": F.coalesce(F.col(f"{v}.{c}").cast("string"), F.lit(default))
    return df.select(
        text("aid").alias("video_id"),
        F.lit("video").alias("video_type"),
        F.substring(text("title"), 1, 500).alias("title"),
        F.substring(text("desc"), 1, 500).alias("desc"),
        F.col(f"{v}.pubdate").cast("long").alias("create_time"),
        text("owner.mid").alias("user_id"),
        text("owner.name").alias("nickname"),
        text("owner.face").alias("avatar"),
        text("stat.like").alias("liked_count"),
        text("stat.dislike").alias("disliked_count"),
        text("stat.view").alias("video_play_count"),
        text("stat.favorite").alias("video_favorite_count"),
        text("stat.share").alias("video_share_count"),
        text("stat.coin").alias("video_coin_count"),
        text("stat.danmaku").alias("video_danmaku"),
        text("stat.reply").alias("video_comment"),
        F.concat(F.lit("https://www.bilibili.com/video/av"), text("aid")).alias("video_url"),
        text("pic").alias("video_cover_url"),
    )


def weibo_cards(df: DataFrame, col: str = "cards", kind: int = 9) -> DataFrame:
    """One row a post card, in order: cards of the kind at the top and inside card groups."""
    rows = df.select("*", F.posexplode(col).alias("_i", "_c"))
    inner = F.transform(F.coalesce(F.col("_c.card_group"), F.array()), lambda g: F.struct(g["card_type"].alias("card_type"), g["mblog"].alias("mblog")))
    every = F.concat(F.array(F.struct(F.col("_c.card_type").alias("card_type"), F.col("_c.mblog").alias("mblog"))), inner)
    flat = rows.select(*[c for c in df.columns if c != col], "_i", F.posexplode(F.filter(every, lambda x: x["card_type"] == kind)).alias("_j", "card"))
    return flat.withColumn("place", F.struct("_i", "_j")).drop("_i", "_j")
