"""Jobs over raw web pages (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html_to_text(c: Column) -> Column:
    """Text without scripts, styles and tags, trimmed."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]+>", ""), r"^\s+|\s+$", "")


def pages_to_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


def url_params(pages: DataFrame) -> DataFrame:
    """(page_id, params): the query's parameters, decoded; those without a value are left out, of repeated
    ones the first counts."""
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    pairs = F.filter(F.transform(F.split(query, "&"), lambda p: F.split(p, "=", 2)), lambda p: (F.size(p) == 2) & (p[1] != ""))
    names = F.array_distinct(F.transform(pairs, lambda p: p[0]))
    first = F.transform(names, lambda n: F.struct(F.try_url_decode(n).alias("k"), F.try_url_decode(F.element_at(F.filter(pairs, lambda p: p[0] == n), 1)[1]).alias("v")))
    return pages.select("page_id", F.map_from_entries(first).alias("params"))


# Where an id stands in a platform's urls.
CONTENT_ID = {
    "xhs": r"xiaohongshu\.com/(?:explore|discovery/item)/([0-9a-f]+)",
    "bili": r"bilibili\.com/video/(BV[0-9A-Za-z]+|av[0-9]+)",
    "dy": r"douyin\.com/(?:video|note)/([0-9]+)|[?&]modal_id=([0-9]+)",
    "ks": r"kuaishou\.com/short-video/([0-9A-Za-z]+)",
    "zhihu": r"zhihu\.com/question/[0-9]+/answer/([0-9]+)|zhuanlan\.zhihu\.com/p/([0-9]+)|zhihu\.com/zvideo/([0-9]+)",
}
CREATOR_ID = {
    "xhs": r"xiaohongshu\.com/user/profile/([0-9a-f]+)",
    "bili": r"space\.bilibili\.com/([0-9]+)",
    "dy": r"douyin\.com/user/([0-9A-Za-z_-]+)",
    "ks": r"kuaishou\.com/profile/([0-9A-Za-z_-]+)",
    "zhihu": r"zhihu\.com/people/([0-9A-Za-z_-]+)",
}


def _found(c: Column, pattern: str) -> Column:
    groups = pattern.count("(") - pattern.count("(?:")
    return F.coalesce(*[F.nullif(F.regexp_extract(c, pattern, i), F.lit("")) for i in range(1, groups + 1)])


def url_entities(df: DataFrame, col: str = "url") -> DataFrame:
    """``df`` with platform, content_id, creator_id, content_type and reason (null where an id was found)."""
    c = F.col(col)
    content = {p: _found(c, r) for p, r in CONTENT_ID.items()}
    creator = {p: _found(c, r) for p, r in CREATOR_ID.items()}
    bare = F.when(c.rlike("^BV[0-9A-Za-z]{10}$"), F.struct(F.lit("bili").alias("p"), c.alias("i"))).when(c.rlike("^[0-9a-f]{24}$"), F.struct(F.lit("xhs").alias("p"), c.alias("i"))).when(c.rlike("^[0-9]{19}$"), F.struct(F.lit("dy").alias("p"), c.alias("i")))
    platform = F.coalesce(*[F.when(F.coalesce(content[p], creator[p]).isNotNull(), p) for p in CONTENT_ID], bare["p"])
    kind = F.when(c.contains("zhuanlan.zhihu.com/p/"), "article").when(c.rlike("zhihu.com/question/[0-9]+/answer/"), "answer").when(c.contains("zhihu.com/zvideo/"), "video")
    out = df.withColumns({"platform": platform, "content_id": F.coalesce(*content.values(), bare["i"]), "creator_id": F.coalesce(*creator.values()), "content_type": kind})
    return out.withColumn("reason", F.when(F.col("platform").isNull(), "no id in the address"))


def page_state(pages: DataFrame, schema: str, pattern: str = r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*</script>") -> DataFrame:
    """(page_id, state): embedded page state as typed columns; ``undefined`` becomes an empty text."""
    raw = F.regexp_replace(F.regexp_extract("html", pattern, 1), r":\s*undefined", ':""')
    return pages.select("page_id", F.from_json(F.nullif(raw, F.lit("")), schema).alias("state"))


def tieba_search_posts(pages: DataFrame) -> DataFrame:
    """One row a post of a forum search page: id, title, description, forum, author, date."""
    block = F.explode(F.regexp_extract_all("html", F.lit(r'(?s)(<div class="s_post">.*?<font class="p_green p_date">[^<]*</font>)'), F.lit(1)))
    p = pages.select("page_id", block.alias("b"))
    get = lambda r: html_to_text(F.regexp_extract("b", r, 1))
    return p.select(
        "page_id",
        get(r'data-tid="(\d+)"').alias("note_id"),
        get(r'(?s)class="p_title">(.*?)</span>').alias("title"),
        get(r'(?s)class="p_content">(.*?)</div>').alias("desc"),
        get(r'(?s)class="p_forum"[^>]*>(.*?)</a>').alias("tieba_name"),
        get(r'(?s)</a>.*?<a href="/home/main[^>]*>(.*?)</a>').alias("user_nickname"),
        get(r'class="p_green p_date">([^<]*)<').alias("publish_time"),
    )


def tieba_list_posts(pages: DataFrame) -> DataFrame:
    """One row a post of a forum's list page, from the JSON of its block; rows without valid JSON go."""
    block = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<li class=\"[^\"]*j_thread_list[^\"]*\"[^>]*data-field='([^']*)'"), F.lit(1)))
    field = F.replace(F.replace("b", F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    p = pages.select("page_id", block.alias("b")).select("page_id", F.from_json(field, "id long, author_name string, author_nickname string, reply_num int").alias("f"))
    return p.filter("f.id IS NOT NULL").select("page_id", F.col("f.id").cast("string").alias("note_id"), F.coalesce("f.author_nickname", "f.author_name").alias("user_nickname"), F.col("f.reply_num").alias("total_replay_num"))


_TIEBA = "https://tieba.baidu.com"


def _first(c: Column, pattern: str) -> Column:
    """The first group where the pattern is found, trimmed; empty elsewhere and for null."""
    return F.coalesce(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))


def _unescaped(c: Column) -> Column:
    for name, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def _place_and_time(c: Column) -> dict[str, Column]:
    return {"ip_location": _first(c, r"IP属地:([^\s<]+)</span>"), "publish_time": _first(c, r'<span class="tail-info">(\d{4}-\d{2}-\d{2} \d{2}:\d{2})</span>')}


def _author(c: Column) -> dict[str, Column]:
    return {
        "user_link": F.concat(F.lit(_TIEBA), _first(c, r'class="p_author_face " href="([^"]*)"')),
        "user_nickname": _first(c, r'class="p_author_name j_user_card">([^<]*)<'),
        "user_avatar": _first(c, r'(?s)class="p_author_face "[^>]*>\s*<img[^>]*src="([^"]*)"'),
    }


def tieba_detail(pages: DataFrame) -> DataFrame:
    """One row a post's page: the post as its first floor and its heads tell it; absent parts are empty, counts null."""
    h = F.col("html")
    first = F.regexp_extract(h, r"(?s)(<div class=\"p_postlist\">.*)", 1)
    note, forum = _first(h, r'id="lzonly_cntn" href="(?:[^"?]*/)?([^"?/]*)'), _first(h, r"(?s)class=\"card_title_fname\"[^>]*>([^<]*)<")
    counts = F.regexp_extract_all(F.regexp_extract(h, r'(?s)<li class="l_reply_num">(.*?)</li>', 1), F.lit(r'class="red">\s*(\d+)'), F.lit(1))
    fields = {
        "note_id": note, "title": F.replace(_first(h, r"(?s)<title>(.*?)</title>"), F.concat(F.lit("【"), forum, F.lit("】_Baidu Tieba")), F.lit("")),
        "desc": _first(h, r'<meta name="description" content="([^"]*)"'), "note_url": F.concat(F.lit(f"{_TIEBA}/p/"), note), **_author(first),
        "tieba_name": forum, "tieba_link": F.concat(F.lit(_TIEBA), _first(h, r'class="card_title_fname" href="([^"]*)"')), **_place_and_time(h),
        "total_replay_num": F.try_element_at(counts, F.lit(1)).cast("int"), "total_replay_page": F.try_element_at(counts, F.lit(2)).cast("int"),
    }
    return pages.select("page_id", *[c.alias(n) for n, c in fields.items()])


def tieba_comments(pages: DataFrame) -> DataFrame:
    """One row a first-level comment of a post's page; blocks without valid JSON go."""
    note, forum = _first(F.col("html"), r'id="lzonly_cntn" href="(?:[^"?]*/)?([^"?/]*)'), _first(F.col("html"), r"(?s)class=\"card_title_fname\"[^>]*>([^<]*)<")
    block = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)(<div class='l_post l_post_bright j_l_post clearfix  '.*?(?=<div class='l_post |$))"), F.lit(1)))
    p = pages.select("page_id", note.alias("note_id"), forum.alias("tieba_name"), block.alias("b"))
    field = F.from_json(_unescaped(F.regexp_extract("b", "data-field='([^']*)'", 1)), "content struct<post_id:string,forum_id:string,comment_num:int,content:string>")
    p = p.withColumn("f", field).filter("f.content IS NOT NULL")
    fields = {
        "comment_id": F.col("f.content.post_id"), "sub_comment_count": F.col("f.content.comment_num"), "content": html_to_text(F.col("f.content.content")), "note_id": F.col("note_id"),
        "note_url": F.concat(F.lit(f"{_TIEBA}/p/"), "note_id"), **_author(F.col("b")), "tieba_id": F.coalesce("f.content.forum_id", F.lit("")), "tieba_name": F.col("tieba_name"),
        "tieba_link": F.concat(F.lit(f"{_TIEBA}/f?kw="), "tieba_name"), **_place_and_time(F.col("b")),
    }
    return p.select("page_id", *[c.alias(n) for n, c in fields.items()])


def tieba_sub_comments(pages: DataFrame, parents: DataFrame) -> DataFrame:
    """One row an answer on a page of answers (page_id, comment_id of the parent, html); post and forum are the parent's."""
    block = F.explode(F.regexp_extract_all("html", F.lit(r'(?s)(<li class="lzl_single_post j_lzl_s_p (?:first_no_border)?".*?</li>)'), F.lit(1)))
    p = pages.select("page_id", F.col("comment_id").alias("parent_comment_id"), block.alias("b"))
    field = F.from_json(_unescaped(F.regexp_extract("b", "data-field='([^']*)'", 1)), "spid string, showname string")
    p = p.withColumn("f", field).filter("f.spid IS NOT NULL")
    fields = {
        "comment_id": F.col("f.spid"), "content": html_to_text(F.regexp_extract("b", r'(?s)class="lzl_content_main">(.*?)</span>', 1)), "user_link": _first(F.col("b"), r'class="j_user_card lzl_p_p" href="([^"]*)"'),
        "user_nickname": F.col("f.showname"), "user_avatar": _first(F.col("b"), r'(?s)class="j_user_card lzl_p_p"[^>]*>\s*<img[^>]*src="([^"]*)"'), "publish_time": _first(F.col("b"), r'class="lzl_time">([^<]*)<'),
    }
    own = parents.select(F.col("comment_id").alias("parent_comment_id"), "note_id", "note_url", "tieba_id", "tieba_name", "tieba_link")
    return p.select("page_id", "parent_comment_id", *[c.alias(n) for n, c in fields.items()]).join(own.hint("merge"), "parent_comment_id")


def tieba_profile(pages: DataFrame) -> DataFrame:
    """One row a profile page: ids of the link's parameters, gender, place, follows, fans and age of the account."""
    h = F.col("html")
    link = F.replace(_first(h, r'(?s)<p class="space">\s*<a href="([^"]*)"'), F.lit("&amp;"), F.lit("&"))
    user = F.regexp_extract(h, r'(?s)(<div class="userinfo_userdata">.*?</div>)', 1)
    numbers = F.regexp_extract_all("html", F.lit(r'<span class="concern_num">\(<a[^>]*>(\d+)</a>\)</span>'), F.lit(1))
    both = lambda i: F.when(F.size(numbers) == 2, numbers[i].try_cast("long")).otherwise(F.lit(0).cast("long"))
    fields = {
        "user_id": F.coalesce(F.try_url_decode(_first(link, r"[?&]id=([^&]*)")), F.lit("")), "user_name": F.coalesce(F.try_url_decode(_first(link, r"[?&]un=([^&]*)")), F.lit("")),
        "nickname": _first(h, r'class="userinfo_username ">([^<]*)<'), "avatar": _first(h, r'(?s)class="userinfo_left_head">.*?<img[^>]*src="([^"]*)"'),
        "gender": F.when(F.contains(user, F.lit("sex_male")), "Male").when(F.contains(user, F.lit("sex_female")), "Female").otherwise("Unknown"),
        "ip_location": _first(user, r"IP属地:([^\s<]+)</span>"), "follows": both(0), "fans": both(1), "registration_duration": _first(user, r"<span>吧龄:([^\s<]+)</span>"),
    }
    return pages.select("page_id", *[c.alias(n) for n, c in fields.items()])
