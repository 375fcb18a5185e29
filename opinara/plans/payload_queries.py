"""Registered queries of raw payloads and pages: payloads are built from the driver's tables by Spark,
flattened, and compared with SQL that works on the tables directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.plans.fixtures import Tables
from opinara.sources import pages
from opinara.sources import payloads as P

L = F.lit


def obj(**fields: object) -> Column:
    """A struct of columns and constants."""
    return F.struct(*[(c if isinstance(c, Column) else L(c)).alias(n) for n, c in fields.items()])


def _docs(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.col("doc_id").cast("string").alias("s"), "text", (F.col("doc_id") % 3).alias("k"))


def _payload(df: DataFrame, o: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.to_json(o).alias("payload"))


def _hashed(df: DataFrame, *cols: str) -> DataFrame:
    """Long texts as their md5."""
    return df.withColumns({c: F.md5(c) for c in cols})


def flat_bili_creator(t: Tables) -> DataFrame:
    d = _docs(t)
    card = obj(mid=F.col("doc_id"), name=F.concat(L("n"), "s"), sex="x", sign=F.col("text"), face="f", fans=F.col("doc_id") * 2, level_info=obj(current_level=F.col("k")), official_verify=obj(type=-1))
    return _hashed(P.flatten_bili_creator(_payload(d, obj(Card=obj(card=card, like_num=F.col("doc_id") + 1)))), "sign")


def flat_bili_comment(t: Tables) -> DataFrame:
    d = _docs(t)
    o = obj(rpid=F.col("doc_id"), parent=F.when(F.col("k") > 0, F.col("doc_id") - 1), ctime=F.col("doc_id") + 1_700_000_000, content=obj(message=F.col("text")), member=obj(mid=F.col("s"), uname="u", sex="s", sign="", avatar="a"), rcount=F.when(F.col("k") == 1, F.col("k")), like=F.when(F.col("k") > 1, F.col("doc_id")))
    return _hashed(P.flatten_bili_comment(_payload(d, o, "doc_id"), ("doc_id",)), "content")


def flat_bili_dynamic(t: Tables) -> DataFrame:
    d = _docs(t)
    stat = obj(comment=obj(count=F.col("k")), forward=obj(count=F.col("doc_id")), like=obj(count=F.col("doc_id") * 3))
    o = obj(id_str=F.col("s"), type=F.element_at(F.array(L("DYNAMIC_TYPE_DRAW"), L("DYNAMIC_TYPE_AV"), L("WORD")), (F.col("k") + 1).cast("int")), modules=obj(module_dynamic=F.when(F.col("k") > 0, obj(desc=obj(text=F.col("text")))), module_author=obj(pub_ts=F.col("doc_id") + 1), module_stat=stat))
    return _hashed(P.flatten_bili_dynamic(_payload(d, o), ()), "text")


def flat_xhs_note(t: Tables) -> DataFrame:
    d = _docs(t)
    video = obj(consumer=obj(origin_video_key=F.when(F.col("k") == 0, F.col("s")).otherwise(""), originVideoKey=F.when(F.col("k") == 1, F.concat(L("o"), "s")).otherwise("")), media=obj(stream=obj(h264=F.array(obj(master_url=F.concat(L("m"), "s")), obj(master_url="n")))))
    o = obj(
        note_id=F.col("s"), type=F.when(F.col("doc_id") % 2 == 0, "video").otherwise("normal"), title=F.when(F.col("k") == 0, "").otherwise("title"), desc=F.col("text"), video=video, time=F.col("doc_id"),
        user=obj(user_id="u", nickname="n", avatar="a"), interact_info=obj(liked_count="1.2万", collected_count=F.col("s"), comment_count="3", share_count="4"),
        image_list=F.array(obj(url="a", url_default=F.when(F.col("k") == 1, "b").otherwise("")), obj(url="c", url_default="d")), tag_list=F.array(obj(name="x", type="topic"), obj(name="y", type="brand"), obj(name="z", type="topic")), xsec_token="tok",
    )
    return _hashed(P.flatten_xhs_note(_payload(d, o)), "desc", "title")


def flat_xhs_comment(t: Tables) -> DataFrame:
    d = _docs(t)
    o = obj(id=F.col("s"), create_time=F.col("doc_id"), ip_location="here", content=F.col("text"), user_info=obj(user_id="u", nickname="n", image="i"), sub_comment_count=F.when(F.col("k") == 0, "7"), pictures=F.array(obj(url_default="p"), obj(url_default="q")), target_comment=F.when(F.col("k") == 1, obj(id=F.concat(L("t"), "s"))), like_count=F.col("k"))
    return _hashed(P.flatten_xhs_comment(_payload(d, o, "doc_id"), ("doc_id",)), "content")


def flat_xhs_creator(t: Tables) -> DataFrame:
    d = _docs(t)
    listed = F.array(obj(type="follows", count=F.col("s")), obj(type="fans", count="5"))
    o = obj(basicInfo=obj(nickname="n", gender=F.col("k"), images="i", desc=F.col("text"), ipLocation="here"), interactions=listed, tags=F.array(obj(tagType="a", name="1"), obj(tagType="b", name=F.col("s"))))
    return _hashed(P.flatten_xhs_creator(_payload(d, o, "doc_id"), ("doc_id",)), "desc")


def _url_list(*urls: object) -> Column:
    return obj(url_list=F.array(*[u if isinstance(u, Column) else L(u) for u in urls]))


def flat_douyin_video(t: Tables) -> DataFrame:
    d = _docs(t)
    none = obj(url_list=F.array().cast("array<string>"))
    video = obj(raw_cover=F.when(F.col("k") == 0, _url_list("r1", "r2")), origin_cover=_url_list("o1", F.concat(L("o"), "s")), play_addr_h264=F.when(F.col("k") == 1, _url_list("h1", "h2")).otherwise(none), play_addr_256=F.when(F.col("k") == 2, _url_list("l1")).otherwise(none), play_addr=_url_list("p1", "p2", "p3"))
    o = obj(
        aweme_id=F.col("s"), aweme_type=F.col("k"), desc=F.col("text"), create_time=F.col("doc_id"), author=obj(uid="u", sec_uid="s", short_id="h", unique_id="q", signature="g", nickname="n", avatar_thumb=_url_list("a1", "a2")),
        statistics=obj(digg_count=F.col("doc_id"), collect_count=2, comment_count=3, share_count=4), ip_label="here", video=video, music=obj(play_url=obj(uri="mu")), images=F.array(_url_list("i1", "i2"), none, _url_list("i3")),
    )
    return _hashed(P.flatten_douyin_video(_payload(d, o)), "desc", "title")


def flat_douyin_comment(t: Tables) -> DataFrame:
    d = _docs(t).withColumn("aweme_id", F.col("doc_id") % 7)
    o = obj(cid=F.col("s"), aweme_id=F.when(F.col("k") == 2, L(-1).cast("long")).otherwise(F.col("aweme_id")), create_time=F.col("doc_id"), text=F.col("text"), user=obj(uid="u", sec_uid="s", short_id="h", unique_id="q", signature="g", nickname="n", avatar_300x300=F.when(F.col("k") == 0, _url_list("m")), avatar_thumb=_url_list("t")), reply_comment_total=F.col("k"), digg_count=F.when(F.col("k") == 1, F.col("doc_id")), reply_id=F.when(F.col("k") == 1, "9"), image_list=F.array(obj(origin_url=_url_list("x1", "x2")), obj(origin_url=_url_list("y1"))))
    return _hashed(P.flatten_douyin_comment(_payload(d, o, "aweme_id")), "content")


def flat_douyin_creator(t: Tables) -> DataFrame:
    d = _docs(t)
    user = obj(nickname="n", gender=F.col("k"), avatar_300x300=obj(uri=F.col("s")), signature=F.col("text"), ip_location="here", following_count=1, max_follower_count=F.col("doc_id"), total_favorited=3)
    return _hashed(P.flatten_douyin_creator(_payload(d, obj(user=user), "doc_id"), ("doc_id",)), "desc")


def flat_ks_video(t: Tables) -> DataFrame:
    d = _docs(t)
    o = obj(type=1, photo=obj(id=F.when(F.col("k") < 2, F.col("s")), caption=F.col("text"), timestamp=F.col("doc_id"), realLikeCount=F.col("doc_id"), viewCount="1.5万", coverUrl="c", photoUrl="p"), author=obj(id="u", name="n", headerUrl="h"))
    return _hashed(P.flatten_ks_video(_payload(d, o)), "title", "desc")


def flat_ks_comment(t: Tables) -> DataFrame:
    d = _docs(t)
    o = obj(comment_id=F.when(F.col("k") == 0, F.col("doc_id")), commentId=F.concat(L("c"), "s"), timestamp=F.col("doc_id"), content=F.col("text"), author_id=F.when(F.col("k") == 1, 0).otherwise(5), authorId="old", author_name="", authorName="an", headurl="h", commentCount=F.when(F.col("k") == 0, 4), subCommentCount=6)
    return _hashed(P.flatten_ks_comment(_payload(d, o, "doc_id"), ("doc_id",)), "content")


def flat_ks_creator(t: Tables) -> DataFrame:
    d = _docs(t)
    o = obj(ownerCount=obj(follow=F.col("k"), fan=F.col("doc_id"), photo_public=2), profile=obj(user_name="n", gender=F.when(F.col("k") == 0, "F").otherwise("M"), headurl="h", user_text=F.col("text")))
    return _hashed(P.flatten_ks_creator(_payload(d, o, "doc_id"), ("doc_id",)), "desc")


def _weibo_user() -> Column:
    return obj(id=F.col("doc_id"), screen_name="n", gender=F.when(F.col("k") == 0, "f").otherwise("m"), profile_url="p", profile_image_url="i")


_AT = "Mon Jan 02 15:04:05 +0800 2023"


def flat_weibo_note(t: Tables) -> DataFrame:
    d = _docs(t)
    o = obj(mblog=obj(id=F.col("s"), text=F.concat(L("<b>x</b> "), F.translate("text", "<>", "")), created_at=_AT, attitudes_count=F.col("doc_id"), comments_count=F.when(F.col("k") == 0, 3), region_name="发布于 北京", user=_weibo_user()))
    return _hashed(P.flatten_weibo_note(_payload(d, o)), "content")


def flat_weibo_comment(t: Tables) -> DataFrame:
    d = _docs(t)
    o = obj(id=F.col("s"), created_at=_AT, text=F.concat(L("<i>"), F.translate("text", "<>", "")), total_number=F.col("k"), source="来自上海", rootid=F.when(F.col("k") == 1, "7"), user=_weibo_user())
    return _hashed(P.flatten_weibo_comment(_payload(d, o, "doc_id"), ("doc_id",)), "content")


def flat_weibo_creator(t: Tables) -> DataFrame:
    d = _docs(t)
    o = obj(screen_name="n", gender=F.when(F.col("k") == 0, "f").otherwise("m"), avatar_hd="a", description=F.col("text"), source="来自广东", follow_count=F.col("k"), followers_count=F.when(F.col("k") == 1, "2万"))
    return _hashed(P.flatten_weibo_creator(_payload(d, o, "doc_id"), ("doc_id",)), "desc")


def _zhihu_author() -> Column:
    return F.when(F.col("k") == 0, F.to_json(obj(id="i", url_token="t", name="n", avatar_url="a"))).otherwise(F.to_json(obj(id="", member=obj(id="mi", url_token="mt", name="mn", avatar_url="ma"))))


def flat_zhihu_content(t: Tables) -> DataFrame:
    d = _docs(t).withColumn("plain", F.translate("text", "<>&", ""))
    kind = F.element_at(F.array(L("answer"), L("article"), L("zvideo"), L("topic")), (F.col("doc_id") % 4 + 1).cast("int"))
    o = obj(type=F.when(F.col("doc_id") % 5 == 0, "ad").otherwise("search_result"), object=obj(id=F.col("s"), type=kind, content=F.concat(L("<p>"), "plain", L("</p>")), title="<em>t</em>", description=F.when(F.col("k") == 0, "").otherwise("d"), excerpt="e", question=obj(id=F.col("k")), video_url="v", created_time=F.when(F.col("k") == 1, F.col("doc_id")), created=9, created_at=8, voteup_count=F.col("doc_id")))
    # the object's own text ends at its last brace: the author is put in before it
    rows = d.select("doc_id", F.regexp_replace(F.to_json(o), r"\}\}$", "").alias("head"), _zhihu_author().alias("who")).select("doc_id", F.concat("head", L(',"author":'), "who", L("}}")).alias("payload"))
    return _hashed(P.flatten_zhihu_content(rows), "content_text")


def flat_zhihu_comment(t: Tables) -> DataFrame:
    d = _docs(t).withColumn("plain", F.translate("text", "<>&", ""))
    o = obj(id=F.col("s"), type=F.when(F.col("k") == 2, "ad").otherwise("comment"), reply_comment_id=F.when(F.col("k") == 1, "8"), content=F.concat(L("<p>"), "plain"), created_time=F.col("doc_id"), comment_tag=F.array(obj(type="hot", text="h"), obj(type="ip_info", text="here")), child_comment_count=F.col("k"), like_count=F.when(F.col("k") == 0, 3), author=obj(id="i", url_token="t", name="n", avatar_url="a"))
    return _hashed(P.flatten_zhihu_comment(_payload(d, o, "doc_id"), ("doc_id",)), "content")


D = "(SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, text, doc_id % 3 AS k FROM documents)"
# all flattened values are texts but times and counts of whole numbers
_WU = "s AS user_id, 'n' AS nickname, CASE WHEN k = 0 THEN 'f' ELSE 'm' END AS gender, 'p' AS profile_url, 'i' AS avatar"
_WT = "CAST(1672671845 AS BIGINT) AS create_time, '2023-01-02 15:04:05' AS create_date_time"
_NOTE = "regexp_replace(regexp_replace({}, '(?is)<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g')"
QUERIES = {
    "flat_bili_creator": (flat_bili_creator, f"SELECT s AS user_id, 'n' || s AS nickname, 'x' AS sex, md5(text) AS sign, 'f' AS avatar, doc_id * 2 AS total_fans, doc_id + 1 AS total_liked, CAST(k AS INTEGER) AS user_rank, CAST(-1 AS INTEGER) AS is_official FROM {D}"),
    "flat_bili_comment": (flat_bili_comment, f"SELECT doc_id, s AS comment_id, CASE WHEN k > 0 THEN CAST(doc_id - 1 AS VARCHAR) ELSE '0' END AS parent_comment_id, doc_id + 1700000000 AS create_time, md5(text) AS content, s AS user_id, 'u' AS nickname, 's' AS sex, '' AS sign, 'a' AS avatar, CASE WHEN k = 1 THEN '1' ELSE '0' END AS sub_comment_count, CASE WHEN k > 1 THEN doc_id ELSE 0 END AS like_count FROM {D}"),
    "flat_bili_dynamic": (flat_bili_dynamic, f"SELECT s AS dynamic_id, md5(CASE WHEN k > 0 THEN coalesce(text, '') ELSE '' END) AS text, CASE k WHEN 0 THEN 'DRAW' WHEN 1 THEN 'AV' ELSE 'WORD' END AS type, doc_id + 1 AS pub_ts, k AS total_comments, doc_id AS total_forwards, doc_id * 3 AS total_liked FROM {D}"),
    "flat_xhs_note": (flat_xhs_note, f"SELECT s AS note_id, CASE WHEN doc_id % 2 = 0 THEN 'video' ELSE 'normal' END AS type, md5(CASE WHEN k = 0 THEN coalesce(substr(text, 1, 255), '') ELSE 'title' END) AS title, md5(coalesce(text, '')) AS desc, CASE WHEN doc_id % 2 = 1 THEN '' WHEN k = 0 THEN 'http://sns-video-bd.xhscdn.com/' || s WHEN k = 1 THEN 'http://sns-video-bd.xhscdn.com/o' || s ELSE 'm' || s || ',n' END AS video_url, doc_id AS time, CAST(0 AS BIGINT) AS last_update_time, 'u' AS user_id, 'n' AS nickname, 'a' AS avatar, '1.2万' AS liked_count, s AS collected_count, '3' AS comment_count, '4' AS share_count, '' AS ip_location, CASE WHEN k = 1 THEN 'b,d' ELSE 'a,d' END AS image_list, 'x,z' AS tag_list, 'https://www.xiaohongshu.com/explore/' || s || '?xsec_token=tok&xsec_source=pc_search' AS note_url, 'tok' AS xsec_token FROM {D}"),
    "flat_xhs_comment": (flat_xhs_comment, f"SELECT doc_id, s AS comment_id, doc_id AS create_time, 'here' AS ip_location, md5(text) AS content, 'u' AS user_id, 'n' AS nickname, 'i' AS avatar, CASE WHEN k = 0 THEN '7' ELSE '0' END AS sub_comment_count, 'p,q' AS pictures, CASE WHEN k = 1 THEN 't' || s ELSE '0' END AS parent_comment_id, CAST(k AS VARCHAR) AS like_count FROM {D}"),
    "flat_xhs_creator": (flat_xhs_creator, f"""SELECT doc_id, 'n' AS nickname, CASE k WHEN 1 THEN 'Female' WHEN 0 THEN 'Male' END AS gender, 'i' AS avatar, md5(text) AS desc, 'here' AS ip_location, s AS follows, '5' AS fans, '0' AS interaction, '{{"a":"1","b":"' || s || '"}}' AS tag_list FROM {D}"""),
    "flat_douyin_video": (flat_douyin_video, f"SELECT s AS aweme_id, CAST(k AS VARCHAR) AS aweme_type, md5(coalesce(text, '')) AS title, md5(coalesce(text, '')) AS desc, doc_id AS create_time, 'u' AS user_id, 's' AS sec_uid, 'h' AS short_user_id, 'q' AS user_unique_id, 'g' AS user_signature, 'n' AS nickname, 'a1' AS avatar, s AS liked_count, '2' AS collected_count, '3' AS comment_count, '4' AS share_count, 'here' AS ip_location, 'https://www.douyin.com/video/' || s AS aweme_url, CASE WHEN k = 0 THEN 'r2' ELSE 'o' || s END AS cover_url, CASE k WHEN 1 THEN 'h2' WHEN 2 THEN '' ELSE 'p3' END AS video_download_url, 'mu' AS music_download_url, 'i2,i3' AS note_download_url FROM {D}"),
    "flat_douyin_comment": (flat_douyin_comment, f"SELECT s AS comment_id, doc_id AS create_time, '' AS ip_location, CAST(doc_id % 7 AS VARCHAR) AS aweme_id, md5(text) AS content, 'u' AS user_id, 's' AS sec_uid, 'h' AS short_user_id, 'q' AS user_unique_id, 'g' AS user_signature, 'n' AS nickname, CASE WHEN k = 0 THEN 'm' ELSE 't' END AS avatar, CAST(k AS VARCHAR) AS sub_comment_count, CASE WHEN k = 1 THEN doc_id ELSE 0 END AS like_count, CASE WHEN k = 1 THEN '9' ELSE '0' END AS parent_comment_id, 'x2' AS pictures FROM {D} WHERE k <> 2"),
    "flat_douyin_creator": (flat_douyin_creator, f"SELECT doc_id, 'n' AS nickname, CASE k WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END AS gender, 'https://p3-pc.douyinpic.com/img/' || s || '~c5_300x300.jpeg?from=2956013662' AS avatar, md5(text) AS desc, 'here' AS ip_location, CAST(1 AS BIGINT) AS follows, doc_id AS fans, CAST(3 AS BIGINT) AS interaction, CAST(0 AS BIGINT) AS videos_count FROM {D}"),
    "flat_ks_video": (flat_ks_video, f"SELECT s AS video_id, '1' AS video_type, md5(substr(coalesce(text, ''), 1, 500)) AS title, md5(substr(coalesce(text, ''), 1, 500)) AS desc, doc_id AS create_time, 'u' AS user_id, 'n' AS nickname, 'h' AS avatar, s AS liked_count, '1.5万' AS viewd_count, 'https://www.kuaishou.com/short-video/' || s AS video_url, 'c' AS video_cover_url, 'p' AS video_play_url FROM {D} WHERE k < 2"),
    "flat_ks_comment": (flat_ks_comment, f"SELECT doc_id, CASE WHEN k = 0 AND doc_id <> 0 THEN s ELSE 'c' || s END AS comment_id, doc_id AS create_time, md5(text) AS content, CASE WHEN k = 1 THEN 'old' ELSE '5' END AS user_id, 'an' AS nickname, 'h' AS avatar, CASE WHEN k = 0 THEN '4' ELSE '6' END AS sub_comment_count FROM {D}"),
    "flat_ks_creator": (flat_ks_creator, f"SELECT doc_id, 'n' AS nickname, CASE WHEN k = 0 THEN 'Female' ELSE 'Male' END AS gender, 'h' AS avatar, md5(text) AS desc, '' AS ip_location, k AS follows, doc_id AS fans, CAST(2 AS BIGINT) AS interaction FROM {D}"),
    "flat_weibo_note": (flat_weibo_note, f"SELECT s AS note_id, md5('x ' || translate(text, '<>', '')) AS content, {_WT}, s AS liked_count, CASE WHEN k = 0 THEN '3' ELSE '0' END AS comments_count, '0' AS shared_count, 'https://m.weibo.cn/detail/' || s AS note_url, '北京' AS ip_location, {_WU} FROM {D}"),
    "flat_weibo_comment": (flat_weibo_comment, f"SELECT doc_id, s AS comment_id, {_WT}, md5(translate(text, '<>', '')) AS content, CAST(k AS VARCHAR) AS sub_comment_count, '0' AS comment_like_count, '上海' AS ip_location, CASE WHEN k = 1 THEN '7' ELSE '' END AS parent_comment_id, {_WU} FROM {D}"),
    "flat_weibo_creator": (flat_weibo_creator, f"SELECT doc_id, 'n' AS nickname, CASE WHEN k = 0 THEN 'Female' ELSE 'Male' END AS gender, 'a' AS avatar, md5(text) AS desc, '广东' AS ip_location, CAST(k AS VARCHAR) AS follows, CASE WHEN k = 1 THEN '2万' ELSE '' END AS fans, '' AS tag_list FROM {D}"),
    "flat_zhihu_content": (flat_zhihu_content, f"""SELECT s AS content_id, CASE q WHEN 0 THEN 'answer' WHEN 1 THEN 'article' ELSE 'zvideo' END AS content_type, md5(CASE WHEN q < 2 THEN {_NOTE.format("coalesce(translate(text, '<>&', ''), '')")} ELSE '' END) AS content_text, CASE WHEN q = 0 THEN CAST(k AS VARCHAR) END AS question_id,
  CASE q WHEN 0 THEN 'https://www.zhihu.com/question/' || k || '/answer/' || s WHEN 1 THEN 'https://zhuanlan.zhihu.com/p/' || s ELSE 'v' END AS content_url, 't' AS title, CASE q WHEN 0 THEN CASE WHEN k = 0 THEN 'e' ELSE 'd' END WHEN 1 THEN 'e' ELSE CASE WHEN k = 0 THEN '' ELSE 'd' END END AS desc,
  CASE q WHEN 0 THEN CASE WHEN k = 1 THEN doc_id END WHEN 1 THEN CASE WHEN k = 1 AND doc_id <> 0 THEN doc_id ELSE 9 END ELSE 8 END AS created_time, CASE WHEN q = 1 THEN CAST(0 AS BIGINT) END AS updated_time, doc_id AS voteup_count, CAST(0 AS BIGINT) AS comment_count,
  CASE WHEN k = 0 THEN 'i' ELSE 'mi' END AS user_id, 'https://www.zhihu.com/people/' || CASE WHEN k = 0 THEN 't' ELSE 'mt' END AS user_link, CASE WHEN k = 0 THEN 'n' ELSE 'mn' END AS user_nickname, CASE WHEN k = 0 THEN 'a' ELSE 'ma' END AS user_avatar, CASE WHEN k = 0 THEN 't' ELSE 'mt' END AS user_url_token
  FROM (SELECT *, doc_id % 4 AS q FROM {D}) WHERE q < 3 AND doc_id % 5 <> 0"""),
    "flat_zhihu_comment": (flat_zhihu_comment, f"SELECT doc_id, s AS comment_id, CASE WHEN k = 1 THEN '8' END AS parent_comment_id, md5({_NOTE.format("coalesce(translate(text, '<>&', ''), '')")}) AS content, doc_id AS publish_time, 'here' AS ip_location, k AS sub_comment_count, CASE WHEN k = 0 THEN CAST(3 AS BIGINT) ELSE 0 END AS like_count, CAST(0 AS BIGINT) AS dislike_count, 'i' AS user_id, 'https://www.zhihu.com/people/t' AS user_link, 'n' AS user_nickname, 'a' AS user_avatar, 't' AS user_url_token FROM {D} WHERE k <> 2"),
}


# ---- forum pages, rebuilt from the table of pages


def _forum(t: Tables) -> DataFrame:
    """A forum page by row: a post with two comments, one of them with two answers; and its author's profile."""
    p = t.raw("pages").select("page_id", F.col("page_id").cast("string").alias("s"))
    link = F.concat(L('<a id="lzonly_cntn" href="/p/'), "s", L('?see_lz=1">x</a><title>t'), "s", L('【f】_Baidu Tieba</title><meta name="description" content="d">'))
    head = F.concat(link, L('<a class="card_title_fname" href="/f?kw=f"> f </a><div id="thread_theme_5"><li class="l_reply_num"><span class="red">12</span><span class="red">3</span></li></div>'))

    def comment(n: int) -> Column:
        field = F.concat(L("<div class='l_post l_post_bright j_l_post clearfix  ' data-field='{&quot;content&quot;:{&quot;post_id&quot;:9"), "s", L(f"{n},&quot;forum_id&quot;:7,&quot;comment_num&quot;:{n},&quot;content&quot;:&quot;&lt;b&gt;c{n}&lt;/b&gt;&quot;}}}}'>"))
        who = L(f'<a class="p_author_face " href="/home?u={n}"><img src="i{n}"></a><a class="p_author_name j_user_card">u{n}</a>')
        tail = L(f'<div class="post-tail-wrap"><span>IP属地:广东</span><span class="tail-info">2024-01-0{n} 10:00</span></div></div>')
        return F.concat(field, who, tail)

    return p.withColumn("html", F.concat(head, L('<div class="p_postlist">'), comment(1), comment(2), L("</div>")))


def forum_detail(t: Tables) -> DataFrame:
    return pages.tieba_detail(_forum(t))


def forum_comments(t: Tables) -> DataFrame:
    return pages.tieba_comments(_forum(t)).drop("page_id")


def _answers(t: Tables) -> DataFrame:
    p = t.raw("pages").select("page_id", F.col("page_id").cast("string").alias("s"))
    one = lambda n, css: F.concat(L(f"<li class=\"lzl_single_post j_lzl_s_p {css}\" data-field='{{&quot;spid&quot;:9"), "s", L(f"{n},&quot;showname&quot;:&quot;w{n}&quot;}}'><a class=\"j_user_card lzl_p_p\" href=\"/h{n}\"><img src=\"j{n}\"></a><span class=\"lzl_content_main\"> a<i>b</i>{n} </span><span class=\"lzl_time\">2024-1-{n}</span></li>"))
    return p.select("page_id", F.concat(L("9"), "s", L("1")).alias("comment_id"), F.concat(one(1, "first_no_border"), one(2, "")).alias("html"))


def forum_answers(t: Tables) -> DataFrame:
    parents = pages.tieba_comments(_forum(t))
    return pages.tieba_sub_comments(_answers(t), parents).drop("page_id")


def forum_profile(t: Tables) -> DataFrame:
    p = t.raw("pages").select("page_id", F.col("page_id").cast("string").alias("s"), (F.col("page_id") % 3).alias("k"))
    html = F.concat(
        L('<p class="space"><a href="/home/main?un=%E5%B0%8F&amp;id='), "s", L('">x</a></p><div class="userinfo_left_head"><a><img src="av"></a></div><span class="userinfo_username "> n </span><div class="userinfo_userdata"><span class="userinfo_sex '),
        F.when(F.col("k") == 0, "sex_male").when(F.col("k") == 1, "sex_female").otherwise(""), L('"></span><span>吧龄:1.9年</span><span>IP属地:北京</span></div>'),
        F.when(F.col("k") < 2, F.concat(L('<span class="concern_num">(<a href="x">5</a>)</span><span class="concern_num">(<a>'), "s", L("</a>)</span>"))).otherwise(""),
    )
    return pages.tieba_profile(p.select("page_id", html.alias("html")))


_N = "(SELECT page_id, CAST(page_id AS VARCHAR) AS s, unnest([1, 2]) AS n FROM pages)"
_PARENT = "'https://tieba.baidu.com/p/' || s AS note_url, '7' AS tieba_id, 'f' AS tieba_name, 'https://tieba.baidu.com/f?kw=f' AS tieba_link"
QUERIES |= {
    "forum_detail": (forum_detail, "SELECT page_id, s AS note_id, 't' || s AS title, 'd' AS desc, 'https://tieba.baidu.com/p/' || s AS note_url, 'https://tieba.baidu.com/home?u=1' AS user_link, 'u1' AS user_nickname, 'i1' AS user_avatar, 'f' AS tieba_name, 'https://tieba.baidu.com/f?kw=f' AS tieba_link, '广东' AS ip_location, '2024-01-01 10:00' AS publish_time, CAST(12 AS INTEGER) AS total_replay_num, CAST(3 AS INTEGER) AS total_replay_page FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS s FROM pages)"),
    "forum_comments": (forum_comments, f"SELECT '9' || s || n AS comment_id, CAST(n AS INTEGER) AS sub_comment_count, 'c' || n AS content, s AS note_id, 'https://tieba.baidu.com/home?u=' || n AS user_link, 'u' || n AS user_nickname, 'i' || n AS user_avatar, '广东' AS ip_location, '2024-01-0' || n || ' 10:00' AS publish_time, {_PARENT} FROM {_N}"),
    "forum_answers": (forum_answers, f"SELECT '9' || s || n AS comment_id, 'ab' || n AS content, '/h' || n AS user_link, 'w' || n AS user_nickname, 'j' || n AS user_avatar, '2024-1-' || n AS publish_time, '9' || s || '1' AS parent_comment_id, s AS note_id, {_PARENT} FROM {_N}"),
    "forum_profile": (forum_profile, "SELECT page_id, CAST(page_id AS VARCHAR) AS user_id, '小' AS user_name, 'n' AS nickname, 'av' AS avatar, CASE page_id % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS gender, '北京' AS ip_location, CAST(CASE WHEN page_id % 3 < 2 THEN 5 ELSE 0 END AS BIGINT) AS follows, CASE WHEN page_id % 3 < 2 THEN page_id ELSE 0 END AS fans, '1.9年' AS registration_duration FROM pages"),
}
