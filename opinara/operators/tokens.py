"""Tokens, stop words, keywords and the processing tables built from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from opinara.functions.text import SPACE, clean, clean_for_segmentation
from opinara.operators.segment import WordTrie, cut_lists, with_column
from opinara.scratch import BROADCAST_ROWS, tidy, written
from opinara.skew import heavy_keys, salted_join

HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
TOKEN = rf"[\p{{L}}\p{{N}}_&&[^{HAN}]]+|[{HAN}]+"
#: Dictionary words that are broadcast to the tasks at most.
DICTIONARY_WORDS = 2_000_000
#: Rows that are cut by a dictionary at a time.
CUT_ROWS = 500
#: Distinct words of rows that are weighed at a time, and the length to which a word's idf goes to all tasks.
WEIGHED, KNOWN_LENGTH = 1 << 20, 100
# The stop words that every list starts with, without punctuation, which is no token; longer lists come as a table or a file.
STOPWORDS = (
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要",
    "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "那", "他", "她", "它", "们", "这个", "那个", "什么", "怎么",
    "为什么", "哪", "哪里", "哪个", "谁", "多少", "几", "怎样", "如何", "吗", "呢", "吧", "啊", "呀", "哦", "嗯", "噢", "哈",
    "呵", "嘿", "哎", "唉", "哇", "咦", "喂", "嗨", "哼", "嘻", "呃", "而", "但", "但是", "然而", "可是", "虽然", "虽",
    "因为", "所以", "因此", "于是", "如果", "假如", "要是", "只要", "除非", "不管", "无论", "既然", "即使", "尽管", "并且", "而且",
    "或者", "还是", "不但", "不仅", "只是", "就是", "这样", "那样", "这么", "那么", "怎么样", "如此", "比较", "更", "最", "太",
    "非常", "特别", "十分", "相当", "极", "挺", "蛮", "颇", "稍", "略", "还", "又", "再", "已经", "曾经", "正在", "将要",
    "刚刚", "刚", "马上", "立刻", "从", "向", "往", "朝", "对", "给", "把", "被", "让", "叫", "使", "令", "为", "为了",
    "关于", "对于", "至于", "按照", "根据", "通过", "经过", "随着", "由于", "除了", "除", "可以", "能", "能够", "应该", "必须",
    "需要", "可能", "或许", "大概", "也许", "一定", "肯定", "当然", "确实", "其实", "实际上", "事实上", "本来", "原来", "反正", "只",
    "仅", "仅仅", "光", "单", "才", "便", "竟", "竟然", "居然", "果然", "终于", "总算", "到底", "究竟", "几乎", "差不多", "大约",
    "左右", "上下", "前后", "之", "之前", "之后", "之间", "之中", "以", "以前", "以后", "以来", "以内", "以外", "以上", "以下",
    "及", "及其", "以及", "并", "且", "与", "同", "哈哈", "哈哈哈", "呵呵", "嘿嘿", "嘻嘻", "233", "666", "啦", "咯", "喽",
    "嘛", "么", "哒", "呐", "捏", "撒",
)


def latin_tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order; Han runs whole."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def tokenize(df: DataFrame, col: str, dictionary: DataFrame | None = None, mode: str = "exact", to: str = "tokens") -> DataFrame:
    """``df`` with an array of tokens.

    Without a dictionary (word) all is native.  With one, Han runs are cut by the longest match in
    it, single characters where nothing matches; ``mode="search"`` adds the shorter dictionary words
    inside longer ones.  The dictionary goes to the tasks once, as a trie; one of more than
    ``DICTIONARY_WORDS`` words is an error.
    """
    out = df.withColumn(to, latin_tokens(F.col(col)))
    if dictionary is None:
        return out
    # a null word is none; the bound is checked before anything is kept
    words = dictionary.select("word").filter("length(word) > 1").distinct().limit(DICTIONARY_WORDS + 1).toArrow().column(0).to_pylist()
    if len(words) > DICTIONARY_WORDS:
        raise ValueError("the dictionary is too large to send to every task")
    shared = df.sparkSession.sparkContext.broadcast(WordTrie.of(words))

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            # few rows at a time, as lists of words take many times their text's memory
            for b in (whole.slice(i, CUT_ROWS) for i in range(0, whole.num_rows, CUT_ROWS)):
                lists = b.column(b.schema.get_field_index(to)).to_pylist()
                yield with_column(b, to, list(cut_lists(shared.value, lists, lambda t: "㐀" <= t[:1] <= "鿿", mode == "search")))

    return out.mapInArrow(run, out.schema)


def drop_stopwords(c: Column, words: list[str] | None = None) -> Column:
    """Tokens that are neither stop words nor blank."""
    stop = list(STOPWORDS if words is None else words)
    # many literals are one hash set
    return F.filter(c, lambda x: ~x.isin(stop) & F.rlike(x, F.lit(f"[^{SPACE}]")))


def drop_stopword_rows(tokens: DataFrame, words: DataFrame, col: str = "word") -> DataFrame:
    """One token a row: those in a table of stop words of any size go."""
    return tokens.join(words.select(F.col("word").alias(col)).distinct().hint("merge"), col, "left_anti")


def _slices(b: pa.RecordBatch, lists: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``most`` entries of its lists, or of one row."""
    ends, at = np.cumsum(np.asarray(pc.list_value_length(b.column(lists)))), 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, to - at)
        at = to


def word_counts(lists: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """Each list's distinct words and their numbers, in any order; nulls are no words."""
    coded = lists.flatten().dictionary_encode()
    code, words = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64), max(len(coded.dictionary), 1)
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    found, n = np.unique((row * words + code)[code >= 0], return_counts=True)
    ends = np.append(0, np.cumsum(np.bincount(found // words, minlength=len(lists)))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(found % words))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))


def best_words(row: np.ndarray, tf: np.ndarray, at: np.ndarray, idf: np.ndarray, k: int) -> np.ndarray:
    """Places of the words that may be among the ``k`` best of their row by tf * idf to six digits, then by word.

    Word i is number at[i] of the known words, which are in order; -1 is none of them, and the last idf is the most
    that such a word may have (NaN: it goes).  Known words are left out where k of their row are before them for
    certain, others where k known ones are.
    """
    most = tf * idf[at]
    known = np.flatnonzero(at >= 0)
    known = known[np.lexsort((at[known], -most[known], row[known]))]
    r, w, i = row[known], most[known], np.arange(len(known))
    n = np.bincount(row) if len(row) else np.zeros(0, int)
    here = np.bincount(r, minlength=len(n))
    kth, full = np.full(len(n), -np.inf), here >= k
    kth[full] = w[(np.cumsum(here) - here)[full] + k - 1]
    # two weights more than a unit of the sixth digit apart keep their order when they are rounded
    least = kth - 2e-6
    first = np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]))[: len(known)]
    equal = i - np.maximum.accumulate(np.where(first, i, 0))
    other = np.flatnonzero(at < 0)
    return np.concatenate([known[(w >= least[r]) & (equal < k)], other[most[other] >= least[row[other]]]])


@tidy
def keywords_tfidf(df: DataFrame, k: int, idf: DataFrame | None = None, id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """(id, word, weight, rank): the k words of highest tf * idf of each row.

    idf is log(rows / rows with the word), from this table or from a supplied one (word, idf).  Ties
    go to the lesser word.  A row is a document; a null id, and a null or empty array, give nothing.

    Words are counted inside their row.  The idf of the words that stand in most rows (``BROADCAST_ROWS`` of them at
    most) goes to all tasks, so a row weighs these where it lies and only its best leave it; of the other
    words those leave it that may still be among the k best, and meet their idf in a join.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(id_col).isNotNull()).select(id_col, F.monotonically_increasing_id().alias("_row"), F.size(tokens).alias("_size"), F.col(tokens).alias("_tokens"))
    schema = StructType().add(id_col, df.schema[id_col].dataType).add("_row", "long")

    def count(batches: Iterator[pa.RecordBatch]):
        for b in (part for whole in batches for part in _slices(whole, "_tokens", WEIGHED)):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *word_counts(b.column("_tokens"))], [id_col, "_row", "_size", "_words", "_n"])

    counted = StructType([*schema.fields]).add("_size", "integer").add("_words", ArrayType(StringType())).add("_n", ArrayType(IntegerType()))
    tf = written(rows.filter("_size > 0").mapInArrow(count, counted), "tfidf-counts")
    counts = tf.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_rows"))
    if idf is None:
        idf = counts.select("word", "_rows", F.log(F.lit(float(df.count())) / F.col("_rows")).alias("idf"), F.lit(True).alias("_plain"))
    else:
        given = written(idf.select("word", F.col("idf").cast("double")), "tfidf-given").filter("word IS NOT NULL")
        given = given.withColumn("_rows", F.lit(1).cast("long")) if given.count() <= BROADCAST_ROWS else given.hint("merge").join(counts, "word")
        # a word with two rows has two weights
        plain = (F.count(F.lit(1)).over(W.partitionBy("word")) == 1) & (F.abs("idf") < float("inf"))
        idf = given.select("word", "_rows", "idf", F.coalesce(plain, F.lit(False)).alias("_plain"))
    idf = written(idf.withColumn("_class", F.when(F.col("_plain") & (F.length("word") <= KNOWN_LENGTH), F.floor(F.log2("_rows") * 8)).otherwise(-1)), "tfidf-idf")
    # classes of about equal numbers of rows, a few hundred at any size, as long as they fit
    least, n = 0, 0
    for c, more in idf.groupBy("_class").count().orderBy(F.desc("_class")).collect():
        n += more
        if n > BROADCAST_ROWS:
            least = c + 1
            break
    known = idf.filter(F.col("_class") >= least).select("word", "idf").toArrow().sort_by("word")
    others = idf.filter(F.col("_class") < least).select("word", "idf")
    number, top = others.agg(F.count(F.lit(1)), F.max("idf")).first()
    top = np.nan if not number else np.inf if top is None or np.isnan(top) else top
    shared = spark.sparkContext.broadcast((known.column("word").combine_chunks(), np.append(known.column("idf").to_numpy(), top)))

    def weigh(batches: Iterator[pa.RecordBatch]):
        names, weights = shared.value
        for b in (part for whole in batches for part in _slices(whole, "_words", WEIGHED)):
            words = b.column("_words").flatten()
            row = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column("_words"))))
            share = np.asarray(b.column("_n").flatten()) / np.asarray(b.column("_size"))[row]
            at = np.asarray(pc.fill_null(pc.index_in(words, value_set=names.cast(words.type)), -1))
            best = best_words(row, share, at, weights, k)
            of, at = pa.array(row[best]), at[best]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(of), b.column("_row").take(of), words.take(pa.array(best)), pa.array(share[best]), pa.array(weights[at], mask=at < 0)],
                [id_col, "_row", "word", "_tf", "idf"],
            )

    both = tf.mapInArrow(weigh, StructType([*schema.fields]).add("word", "string").add("_tf", "double").add("idf", "double"))
    if number:
        both = written(both, "tfidf-best")
        rest = both.filter("idf IS NULL").drop("idf")
        both = both.filter("idf IS NOT NULL").unionByName(salted_join(rest, others, ["word"], heavy_keys(rest, ["word"]), by=F.col("_row")))
    scored = both.select(id_col, "_row", "word", F.round(F.col("_tf") * F.col("idf"), 6).alias("weight"))
    best = W.partitionBy("_row").orderBy(F.desc("weight"), "word")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("_row")


def text_ranks(words: list[str], window: int, iters: int, damping: float) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words with a neighbour, their ranks) over the graph of words that stand within ``window``."""
    names, at = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)
    n = len(names)
    pairs = [(at[:-d], at[d:]) for d in range(1, min(window, len(at)))]
    a, b = (np.concatenate(x) if pairs else np.zeros(0, int) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    a, b = a[a != b], b[a != b]
    # each edge once, with the number of its places, and both ways
    edge, weight = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    to, of = np.divmod(edge, max(n, 1))
    share = weight / np.bincount(of, weight, minlength=n)[of]
    rank = np.ones(n)
    for _ in range(iters):
        rank = 1 - damping + damping * np.bincount(to, share * rank[of], minlength=n)
    linked = np.unique(to)
    return names[linked], rank[linked]


def keywords_textrank(df: DataFrame, k: int, window: int = 5, iters: int = 10, damping: float = 0.85, id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """(id, word, weight, rank): the ``k`` best words by rank over the graph of words that stand within ``window``.

    A row is a document; its graph is iterated where the row lies, so nothing is shuffled.  Equal weights (to six
    places) go by word.  A null or empty array, and words without another beside them, give nothing.
    """
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, word string, weight double, rank int"

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            out: list[tuple] = []
            for key, words in zip(b[id_col], b[tokens], strict=True):
                if words is None or len(words) < 2:
                    continue
                names, weights = text_ranks([w for w in words if w is not None], window, iters, damping)
                best = sorted(zip((-np.round(weights, 6)).tolist(), names.tolist(), weights.tolist(), strict=True))[:k]
                out += [(key, w, x, i) for i, (_, w, x) in enumerate(best, 1)]
            yield pd.DataFrame(out, columns=[id_col, "word", "weight", "rank"])

    return df.select(id_col, tokens).mapInPandas(run, schema)


def keywords(df: DataFrame, method: str, k: int, **more) -> DataFrame:
    """Keywords by ``tfidf`` or ``textrank``."""
    return {"tfidf": keywords_tfidf, "textrank": keywords_textrank}[method](df, k, **more)


def word_freq(df: DataFrame, cols: tuple[str, ...] = ("content", "comment_text", "text"), stopwords: DataFrame | None = None, top: int | None = 20) -> DataFrame:
    """(word, n) over the first filled of ``cols``; the ``top`` most frequent."""
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols if c in df.columns])
    words = df.select(text.alias("text")).filter("text IS NOT NULL").select(F.explode(latin_tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if stopwords is not None:
        counts = drop_stopword_rows(counts, stopwords)
    return counts.orderBy(F.desc("n"), "word").limit(top) if top else counts


def _processed(df: DataFrame, body: str, k: int, title: str | None, dictionary: DataFrame | None) -> DataFrame:
    cols = {"clean_content": body} | ({"clean_title": title} if title else {})
    out = df
    for to, c in cols.items():
        out = out.withColumn(to, clean(F.col(c))).withColumn(f"_seg_{to}", clean_for_segmentation(F.col(c)))
        out = tokenize(out, f"_seg_{to}", dictionary, to=f"{to.removeprefix('clean_')}_tokens")
        out = out.withColumn(f"{to.removeprefix('clean_')}_tokens", drop_stopwords(F.col(f"{to.removeprefix('clean_')}_tokens"))).drop(f"_seg_{to}")
    # counts and status come before the join, which then does not carry the raw text for them
    out = out.withColumns({"char_count": F.length("clean_content"), "word_count": F.size("content_tokens"), "status": F.when(F.col(body).isNull(), "error").otherwise("completed")})
    every = F.concat(F.col("title_tokens"), F.col("content_tokens")) if title else F.col("content_tokens")
    words = keywords_tfidf(out.select("id", every.alias("tokens")), k)
    lists = words.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    joined = out.join(lists.hint("merge"), "id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    last = ["char_count", "word_count", "status"]
    return joined.select(*[c for c in joined.columns if c not in last], *last)


def process_contents(df: DataFrame, k: int = 10, dictionary: DataFrame | None = None) -> DataFrame:
    """Contents (id, title, content, ...) with clean texts, tokens, keywords, counts and a status: a
    null body is an error row and keeps its place."""
    return _processed(df, "content", k, "title", dictionary)


def process_comments(df: DataFrame, k: int = 5, dictionary: DataFrame | None = None) -> DataFrame:
    return _processed(df, "content", k, None, dictionary)


def unprocessed(unified: DataFrame, processed: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that are not in ``processed`` (unified_id), by id."""
    left = unified.join(processed.select(F.col("unified_id").alias("id")), "id", "left_anti").orderBy("id")
    return left.limit(limit) if limit else left


def process_stats(unified: DataFrame, processed: DataFrame) -> DataFrame:
    """total, processed, unprocessed, completed, error."""
    both = unified.select("id").join(processed.select(F.col("unified_id").alias("id"), "status"), "id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("status").alias("processed"),
        F.count_if(F.col("status").isNull()).alias("unprocessed"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "error").alias("error"),
    )
