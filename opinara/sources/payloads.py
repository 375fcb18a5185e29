"""Raw platform payloads (JSON texts, one a row) as flat tables.

Every function takes a table with the payload in the column ``payload`` and keeps the columns named
in ``keep``.  Payloads are parsed once, as variants; a path that a payload lacks is null, or the
field's default.  Rows whose payload is no JSON give rows of nulls and defaults, or none where an id
is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import or_else
from opinara.functions.times import rfc2822_china, rfc2822_epoch_naive
from opinara.sources.pages import html_to_text

_V = "_payload"


def parsed(df: DataFrame, payload: str = "payload") -> DataFrame:
    return df.withColumn(_V, F.try_parse_json(payload))


def get(path: str, kind: str = "string", default: object = None) -> Column:
    """The value at ``path``, or ``default`` where the payload lacks it."""
    found = F.try_variant_get(F.col(_V), f"$.{path}", kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def either(*paths: str) -> Column:
    """The first text among ``paths`` that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(get(p), F.lit("")) for p in paths])


def _urls(path: str) -> Column:
    return F.coalesce(get(path, "array<string>"), F.array().cast("array<string>"))


def _joined(items: Column) -> Column:
    return F.coalesce(F.array_join(items, ","), F.lit(""))


def _flat(df: DataFrame, keep: tuple[str, ...], payload: str, **fields: Column) -> DataFrame:
    return parsed(df, payload).select(*keep, *[c.alias(name) for name, c in fields.items()])


# ---- Bilibili


def flatten_bili_creator(df: DataFrame, keep: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    card = "Card.card"
    return _flat(
        df, keep, payload,
        user_id=get(f"{card}.mid"), nickname=get(f"{card}.name"), sex=get(f"{card}.sex"), sign=get(f"{card}.sign"), avatar=get(f"{card}.face"),
        total_fans=get(f"{card}.fans", "long"), total_liked=get("Card.like_num", "long"),
        user_rank=get(f"{card}.level_info.current_level", "int"), is_official=get(f"{card}.official_verify.type", "int"),
    )


def flatten_bili_comment(df: DataFrame, keep: tuple[str, ...] = ("video_id",), payload: str = "payload") -> DataFrame:
    return _flat(
        df, keep, payload,
        comment_id=get("rpid"), parent_comment_id=get("parent", default="0"), create_time=get("ctime", "long"), content=get("content.message"),
        user_id=get("member.mid"), nickname=get("member.uname"), sex=get("member.sex"), sign=get("member.sign"), avatar=get("member.avatar"),
        sub_comment_count=get("rcount", default="0"), like_count=get("like", "long", 0),
    )


def flatten_bili_dynamic(df: DataFrame, keep: tuple[str, ...] = ("user_id", "user_name"), payload: str = "payload") -> DataFrame:
    """The type is the last part of its name; a dynamic without a description has an empty text."""
    stat = "modules.module_stat"
    return _flat(
        df, keep, payload,
        dynamic_id=get("id_str"), text=get("modules.module_dynamic.desc.text", default=""), type=F.element_at(F.split(get("type"), "_"), -1),
        pub_ts=get("modules.module_author.pub_ts", "long"),
        total_comments=get(f"{stat}.comment.count", "long"), total_forwards=get(f"{stat}.forward.count", "long"), total_liked=get(f"{stat}.like.count", "long"),
    )


# ---- XHS


def xhs_video_urls() -> Column:
    """Urls of a video note: by the origin key in either spelling, else the h264 streams; other notes have none."""
    key = either("video.consumer.origin_video_key", "video.consumer.originVideoKey")
    streams = F.transform(get("video.media.stream.h264", "array<struct<master_url:string>>"), lambda v: v["master_url"])
    own = F.when(key.isNotNull(), F.array(F.concat(F.lit("http://sns-video-bd.xhscdn.com/"), key))).otherwise(streams)
    return F.when(get("type") == "video", F.coalesce(own, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def flatten_xhs_note(df: DataFrame, keep: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """The title falls back to the description's first 255 characters, an image's url to that without
    default, and of the tags only topics count."""
    images = F.transform(get("image_list", "array<struct<url:string,url_default:string>>"), lambda i: or_else(i["url_default"], i["url"]))
    tags = F.filter(get("tag_list", "array<struct<name:string,type:string>>"), lambda t: t["type"] == "topic")
    url = F.concat(F.lit("https://www.xiaohongshu.com/explore/"), get("note_id"), F.lit("?xsec_token="), get("xsec_token", default=""), F.lit("&xsec_source=pc_search"))
    return _flat(
        df, keep, payload,
        note_id=get("note_id"), type=get("type"), title=or_else(get("title"), F.substring(get("desc"), 1, 255)), desc=get("desc", default=""),
        video_url=_joined(xhs_video_urls()), time=get("time", "long"), last_update_time=get("last_update_time", "long", 0),
        user_id=get("user.user_id"), nickname=get("user.nickname"), avatar=get("user.avatar"),
        **{c: get(f"interact_info.{c}") for c in ("liked_count", "collected_count", "comment_count", "share_count")},
        ip_location=get("ip_location", default=""), image_list=_joined(images),
        tag_list=_joined(F.transform(tags, lambda t: F.coalesce(t["name"], F.lit("")))), note_url=url, xsec_token=get("xsec_token"),
    )


def flatten_xhs_comment(df: DataFrame, keep: tuple[str, ...] = ("note_id",), payload: str = "payload") -> DataFrame:
    pictures = F.transform(get("pictures", "array<struct<url_default:string>>"), lambda p: F.coalesce(p["url_default"], F.lit("")))
    return _flat(
        df, keep, payload,
        comment_id=get("id"), create_time=get("create_time", "long"), ip_location=get("ip_location"), content=get("content"),
        user_id=get("user_info.user_id"), nickname=get("user_info.nickname"), avatar=get("user_info.image"),
        sub_comment_count=get("sub_comment_count", default="0"), pictures=_joined(pictures),
        parent_comment_id=get("target_comment.id", default="0"), like_count=get("like_count", default="0"),
    )


def flatten_xhs_creator(df: DataFrame, keep: tuple[str, ...] = ("user_id",), payload: str = "payload") -> DataFrame:
    """The list of interactions as columns, the gender's code as a name, tags as a JSON object by type."""
    listed = get("interactions", "array<struct<type:string,count:string>>")
    count = lambda kind: F.coalesce(F.try_element_at(F.filter(listed, lambda i: i["type"] == kind), F.lit(1))["count"], F.lit("0"))
    gender = get("basicInfo.gender", "int")
    tags = F.filter(get("tags", "array<struct<tagType:string,name:string>>"), lambda t: t["tagType"].isNotNull())
    last = F.transform(F.array_distinct(F.transform(tags, lambda t: t["tagType"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(tags, lambda t: t["tagType"] == k), -1)["name"].alias("v")))
    return _flat(
        df, keep, payload,
        nickname=get("basicInfo.nickname"), gender=F.when(gender == 1, "Female").when(gender == 0, "Male"), avatar=get("basicInfo.images"),
        desc=get("basicInfo.desc"), ip_location=get("basicInfo.ipLocation"),
        follows=count("follows"), fans=count("fans"), interaction=count("interaction"),
        tag_list=F.coalesce(F.to_json(F.map_from_entries(last)), F.lit("{}")),
    )


# ---- Douyin


def flatten_douyin_video(df: DataFrame, keep: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """Of an image's urls the last, without watermark; the second of the cover's; of the download urls the
    last, if there are two or more; h264 before 256 before plain."""
    images = F.transform(get("images", "array<struct<url_list:array<string>>>"), lambda i: F.try_element_at(i["url_list"], F.lit(-1)))
    cover = F.when(get("video.raw_cover", "variant").isNotNull() & (get("video.raw_cover", "string") != "{}"), _urls("video.raw_cover.url_list")).otherwise(_urls("video.origin_cover.url_list"))
    filled = [F.when(F.size(_urls(f"video.{a}.url_list")) > 0, _urls(f"video.{a}.url_list")) for a in ("play_addr_h264", "play_addr_256", "play_addr")]
    play = F.coalesce(*filled, F.array().cast("array<string>"))
    return _flat(
        df, keep, payload,
        aweme_id=get("aweme_id"), aweme_type=get("aweme_type"), title=get("desc", default=""), desc=get("desc", default=""), create_time=get("create_time", "long"),
        user_id=get("author.uid"), sec_uid=get("author.sec_uid"), short_user_id=get("author.short_id"), user_unique_id=get("author.unique_id"),
        user_signature=get("author.signature"), nickname=get("author.nickname"), avatar=F.coalesce(F.try_element_at(_urls("author.avatar_thumb.url_list"), F.lit(1)), F.lit("")),
        liked_count=get("statistics.digg_count"), collected_count=get("statistics.collect_count"), comment_count=get("statistics.comment_count"), share_count=get("statistics.share_count"),
        ip_location=get("ip_label", default=""), aweme_url=F.concat(F.lit("https://www.douyin.com/video/"), get("aweme_id")),
        cover_url=F.coalesce(F.try_element_at(cover, F.lit(2)), F.lit("")),
        video_download_url=F.when(F.size(play) >= 2, F.try_element_at(play, F.lit(-1))).otherwise(F.lit("")),
        music_download_url=get("music.play_url.uri", default=""),
        note_download_url=_joined(F.array_compact(F.coalesce(images, F.array().cast("array<string>")))),
    )


def flatten_douyin_comment(df: DataFrame, keep: tuple[str, ...] = (), payload: str = "payload", aweme: str = "aweme_id") -> DataFrame:
    """Comments whose own video is not the row's (column ``aweme``) go; the first size of avatar that there
    is, and the second url of each image."""
    images = F.transform(get("image_list", "array<struct<origin_url:struct<url_list:array<string>>>>"), lambda i: F.try_element_at(i["origin_url"]["url_list"], F.lit(2)))
    avatars = [F.when(F.size(_urls(f"user.{a}.url_list")) > 0, _urls(f"user.{a}.url_list")[0]) for a in ("avatar_medium", "avatar_300x300", "avatar_168x168", "avatar_thumb")]
    own = parsed(df, payload).filter(get("aweme_id") == F.col(aweme).cast("string"))
    return own.select(
        *keep,
        *[c.alias(n) for n, c in {
            "comment_id": get("cid"), "create_time": get("create_time", "long"), "ip_location": get("ip_label", default=""), "aweme_id": get("aweme_id"), "content": get("text"),
            "user_id": get("user.uid"), "sec_uid": get("user.sec_uid"), "short_user_id": get("user.short_id"), "user_unique_id": get("user.unique_id"),
            "user_signature": get("user.signature"), "nickname": get("user.nickname"), "avatar": F.coalesce(*avatars, F.lit("")),
            "sub_comment_count": get("reply_comment_total", default="0"), "like_count": get("digg_count", "long", 0),
            "parent_comment_id": get("reply_id", default="0"), "pictures": _joined(F.array_compact(F.coalesce(images, F.array().cast("array<string>")))),
        }.items()],
    )


def flatten_douyin_creator(df: DataFrame, keep: tuple[str, ...] = ("user_id",), payload: str = "payload") -> DataFrame:
    gender = get("user.gender", "int")
    avatar = F.concat(F.lit("https://p3-pc.douyinpic.com/img/"), get("user.avatar_300x300.uri"), F.lit("~c5_300x300.jpeg?from=2956013662"))
    return _flat(
        df, keep, payload,
        nickname=get("user.nickname"), gender=F.when(gender == 1, "Male").when(gender == 2, "Female").otherwise("Unknown"), avatar=avatar,
        desc=get("user.signature"), ip_location=get("user.ip_location"), follows=get("user.following_count", "long", 0), fans=get("user.max_follower_count", "long", 0),
        interaction=get("user.total_favorited", "long", 0), videos_count=get("user.aweme_count", "long", 0),
    )


# ---- Kuaishou


def flatten_ks_video(df: DataFrame, keep: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """Rows without an id go; title and description are the caption's first 500 characters."""
    caption = F.substring(get("photo.caption", default=""), 1, 500)
    out = _flat(
        df, keep, payload,
        video_id=F.nullif(get("photo.id"), F.lit("")), video_type=get("type"), title=caption, desc=caption, create_time=get("photo.timestamp", "long"),
        user_id=get("author.id"), nickname=get("author.name"), avatar=get("author.headerUrl", default=""),
        liked_count=get("photo.realLikeCount"), viewd_count=get("photo.viewCount"), video_url=F.concat(F.lit("https://www.kuaishou.com/short-video/"), get("photo.id")),
        video_cover_url=get("photo.coverUrl", default=""), video_play_url=get("photo.photoUrl", default=""),
    )
    return out.filter("video_id IS NOT NULL")


def flatten_ks_comment(df: DataFrame, keep: tuple[str, ...] = ("video_id",), payload: str = "payload") -> DataFrame:
    """Both spellings of a field: the first that is filled (0 and empty are not)."""
    filled = lambda *paths: F.coalesce(*[F.nullif(F.nullif(get(p), F.lit("")), F.lit("0")) for p in paths])
    return _flat(
        df, keep, payload,
        comment_id=filled("comment_id", "commentId"), create_time=get("timestamp", "long"), content=get("content"),
        user_id=filled("author_id", "authorId"), nickname=filled("author_name", "authorName"), avatar=get("headurl"),
        sub_comment_count=F.coalesce(filled("commentCount"), get("subCommentCount", default="0")),
    )


def flatten_ks_creator(df: DataFrame, keep: tuple[str, ...] = ("user_id",), payload: str = "payload") -> DataFrame:
    return _flat(
        df, keep, payload,
        nickname=get("profile.user_name"), gender=F.when(get("profile.gender") == "F", "Female").otherwise("Male"), avatar=get("profile.headurl"),
        desc=get("profile.user_text"), ip_location=F.lit(""), follows=get("ownerCount.follow", "long"), fans=get("ownerCount.fan", "long"), interaction=get("ownerCount.photo_public", "long"),
    )


# ---- Weibo


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "<.*?>", "")


def _weibo_user(at: str) -> dict[str, Column]:
    return {
        "user_id": get(f"{at}.id"), "nickname": get(f"{at}.screen_name", default=""), "gender": get(f"{at}.gender", default=""),
        "profile_url": get(f"{at}.profile_url", default=""), "avatar": get(f"{at}.profile_image_url", default=""),
    }


def flatten_weibo_note(df: DataFrame, keep: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """Text without tags; the time as epoch seconds that ignore its offset and as text in China's zone."""
    at = get("mblog.created_at")
    return _flat(
        df, keep, payload,
        note_id=get("mblog.id"), content=_bare(get("mblog.text")), create_time=rfc2822_epoch_naive(at), create_date_time=rfc2822_china(at),
        liked_count=get("mblog.attitudes_count", default="0"), comments_count=get("mblog.comments_count", default="0"), shared_count=get("mblog.reposts_count", default="0"),
        note_url=F.concat(F.lit("https://m.weibo.cn/detail/"), get("mblog.id")), ip_location=F.replace(get("mblog.region_name", default=""), F.lit("发布于 "), F.lit("")),
        **_weibo_user("mblog.user"),
    )


def flatten_weibo_comment(df: DataFrame, keep: tuple[str, ...] = ("note_id",), payload: str = "payload") -> DataFrame:
    at = get("created_at")
    return _flat(
        df, keep, payload,
        comment_id=get("id"), create_time=rfc2822_epoch_naive(at), create_date_time=rfc2822_china(at), content=_bare(get("text")),
        sub_comment_count=get("total_number", default="0"), comment_like_count=get("like_count", default="0"),
        ip_location=F.replace(get("source", default=""), F.lit("来自"), F.lit("")), parent_comment_id=get("rootid", default=""), **_weibo_user("user"),
    )


def flatten_weibo_creator(df: DataFrame, keep: tuple[str, ...] = ("user_id",), payload: str = "payload") -> DataFrame:
    return _flat(
        df, keep, payload,
        nickname=get("screen_name"), gender=F.when(get("gender") == "f", "Female").otherwise("Male"), avatar=get("avatar_hd"), desc=get("description"),
        ip_location=F.replace(get("source", default=""), F.lit("来自"), F.lit("")), follows=get("follow_count", default=""), fans=get("followers_count", default=""), tag_list=F.lit(""),
    )


# ---- Zhihu


def _zhihu_author(at: str) -> dict[str, Column]:
    """An author without an id is looked for under ``member``."""
    own = F.coalesce(get(f"{at}.id"), F.lit("")) != ""
    pick = lambda c: F.when(own, get(f"{at}.{c}")).otherwise(get(f"{at}.member.{c}"))
    return {
        "user_id": pick("id"), "user_link": F.concat(F.lit("https://www.zhihu.com/people/"), pick("url_token")),
        "user_nickname": pick("name"), "user_avatar": pick("avatar_url"), "user_url_token": pick("url_token"),
    }


def flatten_zhihu_content(df: DataFrame, keep: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """Rows of a search result (payload: the result with its ``object``): answers, articles and videos;
    other kinds go."""
    o = "object"
    kind = get(f"{o}.type")
    text = lambda path: html_to_text(get(f"{o}.{path}", default=""))
    video = get(f"{o}.video", "variant").isNotNull()
    by_kind = lambda answer, article, zvideo: F.when(kind == "answer", answer).when(kind == "article", article).otherwise(zvideo)
    number = lambda path: F.nullif(get(f"{o}.{path}", "long"), F.lit(0).cast("long"))
    rows = parsed(df, payload).filter(get("type").isin("search_result", "zvideo") & kind.isin("answer", "article", "zvideo"))
    url = by_kind(
        F.concat(F.lit("https://www.zhihu.com/question/"), get(f"{o}.question.id"), F.lit("/answer/"), get(f"{o}.id")),
        F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), get(f"{o}.id")),
        F.when(video, F.concat(F.lit("https://www.zhihu.com/zvideo/"), get(f"{o}.id"))).otherwise(get(f"{o}.video_url")),
    )
    zero = F.lit(0).cast("long")
    fields = {
        "content_id": get(f"{o}.id"), "content_type": kind, "content_text": by_kind(text("content"), text("content"), F.lit("")),
        "question_id": F.when(kind == "answer", get(f"{o}.question.id")), "content_url": url, "title": text("title"),
        "desc": by_kind(html_to_text(or_else(get(f"{o}.description"), get(f"{o}.excerpt"))), text("excerpt"), text("description")),
        "created_time": by_kind(get(f"{o}.created_time", "long"), F.coalesce(number("created_time"), number("created"), zero), F.when(video, get(f"{o}.published_at", "long")).otherwise(get(f"{o}.created_at", "long"))),
        "updated_time": by_kind(get(f"{o}.updated_time", "long"), F.coalesce(number("updated_time"), number("updated"), zero), F.when(video, get(f"{o}.updated_at", "long"))),
        "voteup_count": get(f"{o}.voteup_count", "long", 0), "comment_count": get(f"{o}.comment_count", "long", 0), **_zhihu_author(f"{o}.author"),
    }
    return rows.select(*keep, *[c.alias(n) for n, c in fields.items()])


def flatten_zhihu_comment(df: DataFrame, keep: tuple[str, ...] = ("content_id", "content_type"), payload: str = "payload") -> DataFrame:
    """Rows of the type ``comment``; the place is the first tag of the type ``ip_info``."""
    tags = F.filter(get("comment_tag", "array<struct<type:string,text:string>>"), lambda t: t["type"] == "ip_info")
    fields = {
        "comment_id": get("id"), "parent_comment_id": get("reply_comment_id"), "content": html_to_text(get("content", default="")),
        "publish_time": get("created_time", "long"), "ip_location": F.coalesce(F.try_element_at(tags, F.lit(1))["text"], F.lit("")),
        "sub_comment_count": get("child_comment_count", "long", 0), "like_count": get("like_count", "long", 0), "dislike_count": get("dislike_count", "long", 0), **_zhihu_author("author"),
    }
    return parsed(df, payload).filter(get("type") == "comment").select(*keep, *[c.alias(n) for n, c in fields.items()])
