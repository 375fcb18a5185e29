"""Seven platforms' tables in one content table and one comment table.

An adapter is a table of target columns: a source column's name, or a constant, or an expression.
Targets that are not named take the source column of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import safe_int
from opinara.functions.times import flex_timestamp

PLATFORMS = ("xhs", "dy", "wb", "bili", "ks", "tieba", "zhihu")
TEXTS = ("content_id", "content_type", "user_id", "nickname", "avatar", "ip_location", "gender", "title", "content", "content_url", "media_type", "cover_url", "video_url", "video_download_url", "image_list", "music_url", "tag_list")
COUNTS = ("liked_count", "comment_count", "share_count", "collect_count", "view_count", "coin_count", "danmaku_count")
COMMENT_TEXTS = ("comment_id", "content_id", "parent_comment_id", "user_id", "nickname", "avatar", "ip_location", "gender", "content", "pictures")
COMMENT_COUNTS = ("liked_count", "reply_count")
STAMPS = ("add_ts", "last_modify_ts")


def _const(value: str):
    return ("=", value)



NONE = _const("")
_NO_MEDIA = dict.fromkeys(("cover_url", "video_url", "video_download_url", "image_list", "music_url", "tag_list"), NONE)

# Where each platform keeps the unified columns.  A column absent here has the same name there.
CONTENT = {
    "xhs": {"content_id": "note_id", "content_type": "type", "content": "desc", "content_url": "note_url", "media_type": ("?", "type", "video"), "cover_url": NONE, "video_download_url": NONE, "music_url": NONE, "collect_count": "collected_count", "view_count": NONE, "coin_count": NONE, "danmaku_count": NONE, "gender": NONE, "time": "time"},
    "dy": {"content_id": "aweme_id", "content_type": "aweme_type", "content": "desc", "content_url": "aweme_url", "media_type": ("!", "aweme_type", "image"), "video_url": "aweme_url", "image_list": "note_download_url", "music_url": "music_download_url", "tag_list": NONE, "collect_count": "collected_count", "view_count": NONE, "coin_count": NONE, "danmaku_count": NONE, "gender": NONE, "time": "create_time"},
    "wb": {"content_id": "note_id", "content_type": _const("note"), "title": NONE, "content_url": "note_url", "media_type": _const("text"), "comment_count": "comments_count", "share_count": "shared_count", "collect_count": NONE, "view_count": NONE, "coin_count": NONE, "danmaku_count": NONE, "time": "create_time"} | _NO_MEDIA,
    "bili": _NO_MEDIA | {"content_id": "video_id", "content_type": _const("video"), "ip_location": NONE, "content": "desc", "content_url": "video_url", "media_type": _const("video"), "cover_url": "video_cover_url", "video_url": "video_url", "comment_count": "video_comment", "share_count": "video_share_count", "collect_count": "video_favorite_count", "view_count": "video_play_count", "coin_count": "video_coin_count", "danmaku_count": "video_danmaku", "gender": NONE, "time": "create_time"},
    "ks": _NO_MEDIA | {"content_id": "video_id", "content_type": _const("video"), "ip_location": NONE, "content": "desc", "content_url": "video_url", "media_type": _const("video"), "cover_url": "video_cover_url", "video_url": "video_url", "video_download_url": "video_play_url", "comment_count": NONE, "share_count": NONE, "collect_count": NONE, "view_count": "viewd_count", "coin_count": NONE, "danmaku_count": NONE, "gender": NONE, "time": "create_time"},
    "tieba": _NO_MEDIA | {"content_id": "note_id", "content_type": _const("note"), "user_id": NONE, "nickname": "user_nickname", "avatar": "user_avatar", "content": "desc", "content_url": "note_url", "media_type": _const("text"), "liked_count": NONE, "comment_count": "total_replay_num", "share_count": NONE, "collect_count": NONE, "view_count": NONE, "coin_count": NONE, "danmaku_count": NONE, "gender": NONE, "time": "publish_time"},
    "zhihu": _NO_MEDIA | {"nickname": "user_nickname", "avatar": "user_avatar", "ip_location": NONE, "content": "content_text", "media_type": _const("text"), "liked_count": "voteup_count", "share_count": NONE, "collect_count": NONE, "view_count": NONE, "coin_count": NONE, "danmaku_count": NONE, "gender": NONE, "time": "created_time"},
}
_COMMENT = {"reply_count": "sub_comment_count", "liked_count": "like_count", "gender": NONE, "time": "create_time"}
COMMENT = {
    "xhs": _COMMENT | {"content_id": "note_id"},
    "dy": _COMMENT | {"content_id": "aweme_id"},
    "wb": _COMMENT | {"content_id": "note_id", "gender": "gender", "pictures": NONE, "liked_count": "comment_like_count"},
    "bili": _COMMENT | {"content_id": "video_id", "ip_location": NONE, "gender": "sex", "pictures": NONE},
    "ks": _COMMENT | {"content_id": "video_id", "parent_comment_id": NONE, "ip_location": NONE, "pictures": NONE, "liked_count": NONE},
    "tieba": _COMMENT | {"content_id": "note_id", "user_id": NONE, "nickname": "user_nickname", "avatar": "user_avatar", "pictures": NONE, "liked_count": NONE, "time": "publish_time"},
    "zhihu": _COMMENT | {"nickname": "user_nickname", "avatar": "user_avatar", "pictures": NONE, "time": "publish_time"},
}
CONTENT_TABLES = {"xhs": "xhs_note", "dy": "douyin_aweme", "wb": "weibo_note", "bili": "bilibili_video", "ks": "kuaishou_video", "tieba": "tieba_note", "zhihu": "zhihu_content"}
COMMENT_TABLES = {"xhs": "xhs_note_comment", "dy": "douyin_aweme_comment", "wb": "weibo_note_comment", "bili": "bilibili_video_comment", "ks": "kuaishou_video_comment", "tieba": "tieba_comment", "zhihu": "zhihu_comment"}


def _source(df: DataFrame, rule) -> Column:
    """A rule's column as text; columns that the raw table lacks are null."""
    if isinstance(rule, str):
        return F.col(f"`{rule}`") if rule in df.columns else F.lit(None).cast("string")
    kind, *rest = rule
    if kind == "=":
        return F.lit(rest[0])
    column, value = rest
    has = _source(df, column).eqNullSafe(F.lit(value))
    return F.when(has, value).otherwise("image" if kind == "?" else "video")


def _adapt(df: DataFrame, platform: str, rules: dict, texts, counts, dates: bool, parse_numeric_strings: bool) -> DataFrame:
    at = rules["time"]
    numeric = dict(df.dtypes).get(at, "string") != "string"
    time = flex_timestamp(_source(df, at), numeric, dates or parse_numeric_strings, parse_numeric_strings)
    return df.select(
        F.lit(platform).alias("platform"),
        *[F.coalesce(_source(df, rules.get(c, c)).cast("string"), F.lit("")).alias(c) for c in texts],
        *[safe_int(_source(df, rules.get(c, c))).alias(c) for c in (*counts, *STAMPS)],
        *([F.coalesce(_source(df, "source_keyword").cast("string"), F.lit("")).alias("source_keyword")] if "title" in texts else []),
        time.alias("original_created_at"),
    )


def adapt_content(df: DataFrame, platform: str, parse_numeric_strings: bool = False) -> DataFrame:
    """A platform's raw content table as unified content.  Texts: null is empty; counts: what is no
    whole number is 0.  A text time of digits alone is null unless ``parse_numeric_strings``."""
    return _adapt(df, platform, CONTENT[platform], TEXTS, COUNTS, True, parse_numeric_strings)


def adapt_comment(df: DataFrame, platform: str, parse_numeric_strings: bool = False) -> DataFrame:
    """A platform's raw comment table as unified comments; a text time is digits alone, or null
    (dates too are read with ``parse_numeric_strings``)."""
    return _adapt(df, platform, COMMENT[platform], COMMENT_TEXTS, COMMENT_COUNTS, False, parse_numeric_strings)


def unify(tables: dict[str, DataFrame], kind: str = "content") -> DataFrame:
    """All platforms' raw tables in one."""
    adapt = adapt_content if kind == "content" else adapt_comment
    return reduce(DataFrame.unionByName, [adapt(df, p) for p, df in tables.items()])


def incremental_since(raw: DataFrame, target: DataFrame, since_ts: int | None = None, everything: bool = False, ts_col: str = "add_ts") -> DataFrame:
    """Raw rows (with platform) above ``since_ts``, or above their platform's highest in ``target``."""
    if everything:
        return raw
    if since_ts is not None:
        return raw.filter(F.col(ts_col) > since_ts)
    top = target.groupBy("platform").agg(F.max(ts_col).alias("_top"))
    return raw.join(F.broadcast(top), "platform", "left").filter(F.col(ts_col) > F.coalesce("_top", F.lit(0))).drop("_top")  # one row a platform


def sync_stats(content: DataFrame, comment: DataFrame) -> DataFrame:
    """(kind, platform, n)."""
    kinds = content.select(F.lit("content").alias("kind"), "platform").unionAll(comment.select(F.lit("comment").alias("kind"), "platform"))
    return kinds.groupBy("kind", "platform").agg(F.count(F.lit(1)).alias("n"))
