"""Cleaning of social-media text with native column expressions.

Word characters and white space are written out, as Spark's regular expressions know ASCII only.
Every function takes a column and returns one; null stays null except in the two chains, which
give an empty text as the first step of a pipeline should.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NOT_URL = rf"[^{SPACE}<>\"{{}}|\\^`\[\]]"
# The ranges of emoji.
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{1F900}-\x{1F9FF}"
    r"\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{1F000}-\x{1F02F}\x{1F0A0}-\x{1F0FF}]+"
)

# Internet slang and its plain form, in this order.
SLANG = {
    "yyds": "永远的神", "YYDS": "永远的神", "绝绝子": "太绝了", "无语子": "无语", "笑死": "很好笑", "笑死了": "很好笑", "笑哭": "很好笑",
    "裂开": "崩溃", "破防": "情绪崩溃", "破大防": "情绪崩溃", "爆哭": "大哭", "暴风哭泣": "大哭", "DNA动了": "被触动", "上头": "沉迷", "下头": "失望",
    "栓Q": "谢谢", "蚌埠住了": "绷不住了", "泰裤辣": "太酷了", "特种兵式": "高效快速", "牛": "厉害", "牛逼": "厉害", "nb": "厉害", "NB": "厉害",
    "牛批": "厉害", "6": "厉害", "66": "厉害", "666": "厉害", "6666": "厉害", "tql": "太强了", "TQL": "太强了", "太强了": "很强",
    "绝了": "太好了", "芜湖": "好棒", "awsl": "可爱死了", "AWSL": "可爱死了", "太可了": "太可爱了", "真香": "真好", "神仙": "很好", "神": "很好",
    "顶": "支持", "顶顶": "支持", "火钳刘明": "火前留名", "蹲": "等待", "吐了": "讨厌", "yue了": "想吐", "无语": "无话可说", "离谱": "不可思议",
    "离大谱": "非常离谱", "服了": "无奈", "醉了": "无语", "佛了": "无语", "怎么说呢": "不好评价", "就这": "很差", "就这？": "很差", "就这?": "很差",
    "辣眼睛": "很难看", "辣鸡": "垃圾", "渣渣": "垃圾", "拉胯": "很差", "拉跨": "很差", "摆烂": "放弃", "摆了": "放弃", "老六": "阴险的人",
    "挂": "作弊", "脱粉": "不再喜欢", "避雷": "不推荐", "hhhh": "哈哈哈哈", "hhh": "哈哈哈", "hh": "哈哈", "233": "哈哈哈",
    "2333": "哈哈哈", "23333": "哈哈哈", "xswl": "笑死我了", "XSWL": "笑死我了", "emmm": "嗯", "emm": "嗯", "em": "嗯",
    "额": "嗯", "昂": "嗯", "咋": "怎么", "咋了": "怎么了", "咋整": "怎么办", "咋滴": "怎么", "啥": "什么", "啥玩意": "什么东西",
    "搞毛": "干什么", "咋肥四": "怎么回事", "xdm": "兄弟们", "XDM": "兄弟们", "jms": "姐妹们", "JMS": "姐妹们", "gg": "哥哥",
    "GG": "哥哥", "jj": "姐姐", "JJ": "姐姐", "mm": "妹妹", "MM": "妹妹", "dd": "弟弟", "DD": "弟弟", "gf": "女朋友",
    "GF": "女朋友", "bf": "男朋友", "BF": "男朋友", "py": "朋友", "PY": "朋友", "zqsg": "真情实感", "ZQSG": "真情实感",
    "dbq": "对不起", "DBQ": "对不起", "nsdd": "你说得对", "NSDD": "你说得对", "xjj": "小姐姐", "XJJ": "小姐姐", "xgg": "小哥哥",
    "XGG": "小哥哥", "bdjw": "不懂就问", "BDJW": "不懂就问", "yygq": "阴阳怪气", "YYGQ": "阴阳怪气", "ssfd": "瑟瑟发抖",
    "SSFD": "瑟瑟发抖", "cpdd": "处对象", "CPDD": "处对象", "安利": "推荐", "种草": "推荐", "拔草": "买了", "入坑": "开始喜欢",
    "脱坑": "不再喜欢", "pick": "选择支持", "打call": "支持", "应援": "支持", "爬墙": "转移喜好", "糊了": "不火了", "糊": "不火",
    "出圈": "变得流行", "塌房": "偶像出问题", "锤": "揭露黑料", "洗白": "辩解", "控评": "控制评论",
}


def slang_pairs(extra: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(slang, plain), longest slang first; equal lengths keep their order of definition."""
    return sorted((SLANG | (extra or {})).items(), key=lambda p: -len(p[0]))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _where(c: Column, test: Callable[[Column], Column], f: Callable[[Column], Column]) -> Column:
    """``f`` of the texts that pass a cheap test; it leaves the others as they are."""
    return once(c, lambda x: F.when(test(x), f(x)).otherwise(x))


def _has(*parts: str) -> Callable[[Column], Column]:
    return lambda x: F.greatest(*[F.contains(x, F.lit(p)) for p in parts], F.lit(False))


def strip_html(c: Column) -> Column:
    return _where(c, _has("<"), lambda x: F.regexp_replace(x, "<[^>]+>", ""))


def strip_urls(c: Column) -> Column:
    return _where(c, _has("http", "www."), lambda x: F.regexp_replace(x, rf"https?://{NOT_URL}+|www\.{NOT_URL}+", ""))


def strip_emails(c: Column) -> Column:
    # a run of name characters is tried once, from where it or the search begins
    name = rf"[{WORD}.+\-]"
    return _where(c, _has("@"), lambda x: F.regexp_replace(x, rf"(?:\G|(?<!{name})){name}++@[{WORD}\-]++\.[{WORD}.\-]++", ""))


def strip_mentions(c: Column) -> Column:
    return _where(c, _has("@"), lambda x: F.regexp_replace(x, rf"@[{WORD}]+", ""))


def hashtags(c: Column, keep: bool = True) -> Column:
    """Hashtags without their marks and topic suffix, or removed."""
    pattern = rf"#([^#{SPACE}]+)#?"
    plain = _where(c, _has("#"), lambda x: F.regexp_replace(x, pattern, "$1" if keep else ""))
    return F.replace(plain, F.lit("[话题]"), F.lit("")) if keep else plain


def strip_emojis(c: Column) -> Column:
    """Emoji, and the bracketed ones that some platforms write as text."""
    # the two ranges hold all of them
    plain = _where(c, lambda x: F.rlike(x, F.lit(r"[\x{2600}-\x{26FF}\x{1F000}-\x{1FAFF}]")), lambda x: F.regexp_replace(x, EMOJI, ""))
    return _where(plain, _has("R]"), lambda x: F.regexp_replace(x, r"\[[^\]]{1,10}R\]", ""))


def to_simplified(c: Column, table: dict[str, str]) -> Column:
    """Characters replaced one by one by the caller's table."""
    return F.translate(c, "".join(table), "".join(table.values())) if table else c


def _any_of(keys: list[str]) -> str:
    """A pattern for the longest of ``keys`` at a place; first characters are told apart by halves of their range."""
    firsts = sorted({k[0] for k in keys})
    if len(firsts) <= 3:
        rests = ("|".join(re.escape(k[1:]) for k in sorted(keys, key=lambda k: -len(k)) if k[0] == c) for c in firsts)
        return "|".join(f"{re.escape(c)}(?:{r})" for c, r in zip(firsts, rests, strict=True))
    sides = firsts[: len(firsts) // 2], firsts[len(firsts) // 2 :]
    return "|".join(f"(?=[{re.escape(side[0])}-{re.escape(side[-1])}])(?:{_any_of([k for k in keys if k[0] in side])})" for side in sides)


def _slang_reach(pairs: list[tuple[str, str]]) -> dict[str, list[int]]:
    """For each key, the pairs that may find something in a text because the key stands in it, by their place.

    These are the keys inside it, and the later ones that a replacement may give rise to: they have a
    character of what it puts in, or any, where it puts in nothing.
    """
    after = [[j for j in range(i + 1, len(pairs)) if not v or set(v) & set(pairs[j][0])] for i, (_, v) in enumerate(pairs)]
    reach: list[set[int]] = []
    for i in reversed(range(len(pairs))):
        reach.insert(0, {i}.union(*[reach[j - i - 1] for j in after[i]]))
    return {k: sorted(set().union(*[reach[i] for i, (o, _) in enumerate(pairs) if o in k])) for k, _ in pairs}


def normalize_slang(c: Column, extra: dict[str, str] | None = None) -> Column:
    """Slang replaced longest first, each replacement seen by the later ones.

    One look at a text finds the keys in it; only the pairs that these keys can lead to are replaced."""
    pairs = [(k, v) for k, v in slang_pairs(extra) if k]
    reach = F.create_map(*[x for k, at in _slang_reach(pairs).items() for x in (F.lit(k), F.array(*[F.lit(i) for i in at]))])
    keys, values = (F.array(*[F.lit(x) for x in column]) for column in zip(*pairs, strict=True))
    found = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_any_of([k for k, _ in pairs])}))"), F.lit(1)))
    places = lambda text: F.array_sort(F.array_distinct(F.flatten(F.transform(found(text), lambda k: F.element_at(reach, k)))))
    return once(c, lambda text: F.aggregate(places(text), text, lambda t, i: F.replace(t, F.element_at(keys, i + 1), F.element_at(values, i + 1))))


def squeeze_repeats(c: Column, n: int = 3) -> Column:
    """A character that stands more than ``n`` times in a row stands ``n`` times."""
    return F.regexp_replace(c, rf"([^\n])\1{{{n},}}", "$1" * n)


def strip_space(c: Column) -> Column:
    ends = lambda x: F.rlike(F.substring(x, 1, 1), F.lit(f"[{SPACE}]")) | F.rlike(F.substring(x, -1, 1), F.lit(f"[{SPACE}]"))
    return _where(c, ends, lambda x: F.regexp_replace(x, rf"^[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++$", ""))


def collapse_space(c: Column) -> Column:
    # a single blank is left where it is; the wide ranges only tell other characters apart sooner
    return F.regexp_replace(c, rf"[\x00-\x20\x{{80}}-\x{{3000}}&&[{SPACE}]]{{2,}}|[\x00-\x1F\x{{80}}-\x{{3000}}&&[{SPACE}]]", " ")


def strip_punct(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^{WORD}{SPACE}]+", "")


#: The steps of :func:`clean` in order.  Each can be switched off.
STEPS = ("html", "urls", "emails", "mentions", "hashtags", "emojis", "simplify", "slang", "repeats", "space")


def clean(c: Column, skip: tuple[str, ...] = (), simplified: dict[str, str] | None = None, slang: dict[str, str] | None = None, keep_hashtags: bool = True) -> Column:
    """The whole chain; a null text gives an empty one."""
    steps = {
        "html": strip_html,
        "urls": strip_urls,
        "emails": strip_emails,
        "mentions": strip_mentions,
        "hashtags": lambda x: hashtags(x, keep_hashtags),
        "emojis": strip_emojis,
        "simplify": lambda x: to_simplified(x, simplified or {}),
        "slang": lambda x: normalize_slang(x, slang),
        "repeats": squeeze_repeats,
        "space": collapse_space,
    }
    c = F.coalesce(c, F.lit(""))
    for name in STEPS:
        if name not in skip:
            c = steps[name](c)
    return strip_space(c)


def clean_for_segmentation(c: Column, simplified: dict[str, str] | None = None) -> Column:
    return clean(c, skip=("emails", "mentions", "hashtags", "emojis", "slang", "repeats"), simplified=simplified)


def first_int(c: Column) -> Column:
    """The first run of digits of a display count, 0 if none."""
    return F.coalesce(F.regexp_extract(c, "[0-9]+", 0).try_cast("long"), F.lit(0).cast("long"))


def safe_int(c: Column) -> Column:
    """A whole number, 0 for null and for text that is none."""
    return F.coalesce(F.regexp_extract(c.cast("string"), r"^\s*([+-]?[0-9]+)\s*$", 1).try_cast("long"), F.lit(0).cast("long"))


def or_else(*cs: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
