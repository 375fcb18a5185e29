"""Rules of the library on hand-written cases, and registered queries against their SQL."""

import os
import random
from datetime import datetime

import duckdb
import numpy as np
import pytest
from opinara.functions import text as T
from opinara.functions import times
from opinara.operators import adapters, graph, hot, segment, sentiment, tokens, topics, upsert
from opinara.plans.queries import QUERIES, SQL
from opinara.sources import flatten, io, pages
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.range(1).select(f(F.lit(value)).alias("x")).first().x


def test_cleaning(spark):
    assert one(spark, "<b>好</b> https://a.cn/x @小明 你", T.clean) == "好 你"
    assert one(spark, "#好物分享[话题]# 推荐", T.clean) == "好物分享 推荐"
    assert one(spark, "真好[笑哭R]啊\U0001f600", T.strip_emojis) == "真好啊"
    assert one(spark, "yyds", T.normalize_slang) == "永远的很好"
    assert one(spark, "无语子", T.normalize_slang) == "无话可说"
    assert one(spark, "好好好好好", T.squeeze_repeats) == "好好好"
    assert one(spark, "a　 b", T.collapse_space) == "a b"
    assert one(spark, None, T.clean) == ""
    assert [one(spark, x, T.safe_int) for x in ("12", "1.2万", None, "3.0", " -7 ")] == [12, 0, 0, 0, -7]
    assert one(spark, "赞 123", T.first_int) == 123 and one(spark, "赞", T.first_int) == 0


def test_times(spark):
    at = datetime(2023, 11, 14, 22, 13, 20)
    assert one(spark, 1700000000, times.epoch_time) == at and one(spark, 1700000000000, times.epoch_time) == at
    f = lambda c: times.flex_timestamp(c, False)
    assert one(spark, "2024/01/02", f) == datetime(2024, 1, 2) and one(spark, "2024-08-05 16:45", f) == datetime(2024, 8, 5, 16, 45)
    assert one(spark, "1700000000", f) is None
    s = "Mon Jan 02 15:04:05 +0800 2023"
    assert one(spark, s, times.rfc2822_china) == "2023-01-02 15:04:05" and one(spark, s, times.rfc2822_time) == datetime(2023, 1, 2, 7, 4, 5)
    assert one(spark, s, times.rfc2822_epoch_naive) == 1672671845 and one(spark, "bad", times.str_to_epoch) == 0


def test_tokens(spark):
    d = spark.createDataFrame([(1, "我喜欢手机abc12"), (2, None)], "id long, text string")
    words = spark.createDataFrame([("喜欢",), ("手机",), ("手机壳",)], "word string")
    cut = {r.id: r.tokens for r in tokens.tokenize(d, "text", words).collect()}
    assert cut == {1: ["我", "喜欢", "手机", "abc12"], 2: []}
    assert one(spark, None, lambda c: tokens.drop_stopwords(F.array(F.lit("我"), F.lit("喜欢"), F.lit("的"), F.lit("手机"), F.lit("　")))) == ["喜欢", "手机"]


def _plain_cut(run: str, words: set[str], inner: bool) -> list[str]:
    out, i = [], 0
    while i < len(run):
        n = max([m for m in range(2, len(run) - i + 1) if run[i : i + m] in words], default=1)
        if inner:
            out += [run[j : j + m] for m in range(2, n) for j in range(i, i + n - m + 1) if run[j : j + m] in words]
        out.append(run[i : i + n])
        i += n
    return out


@pytest.mark.parametrize("inner", [False, True])
def test_dictionary_cuts_are_the_longest_matches(inner, monkeypatch):
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choices("一丁七\U00020000", k=n))
    words = [draw(rng.randint(2, 7)) for _ in range(150)]
    runs = ["", "一", draw(3000), *[draw(rng.randint(0, 40)) for _ in range(200)]]
    trie = segment.WordTrie.of(list(set(words)))
    assert segment.cut_runs(trie, runs, inner) == [_plain_cut(r, set(words), inner) for r in runs]
    # no word runs over the end of a run, and slices change nothing
    lists = [None, [], ["ab", *runs[2:6]], *[[r] for r in runs]]
    want = [x if x is None else [y for r in x for y in (_plain_cut(r, set(words), inner) if r != "ab" else ["ab"])] for x in lists]
    for size in (1, 1 << 20):
        monkeypatch.setattr(segment, "SLICE", size)
        assert list(segment.cut_lists(trie, lists, lambda t: t != "ab", inner)) == want
    assert segment.cut_runs(segment.WordTrie.of([]), ["一丁", ""], inner) == [["一", "丁"], []]


def test_two_million_words_fit_in_a_small_trie():
    at = np.arange(2_000_000)
    words = ["".join(map(chr, w)) for w in (0x4E00 + np.stack([at // 1600, at // 40 % 40, at % 40], 1)).tolist()]
    trie = segment.WordTrie.of(words)
    assert trie.edges.nbytes + trie.ends.nbytes < 20_000_000
    assert segment.cut_runs(trie, [words[7] + "丁" + words[-1] + words[-1][:2]], False) == [[words[7], *_plain_cut("丁" + words[-1] + words[-1][:2], set(words), False)]]


def test_dictionary_keeps_columns_and_its_bound(spark, monkeypatch):
    d = spark.createDataFrame([(1, "手机壳", None, [1.5]), (None, None, 7, None), (3, "", 8, [])], "id long, text string, n long, v array<double>")
    words = spark.createDataFrame([("手机",), ("手机壳",), ("机壳",), (None,), ("手机",)], "word string")
    got = [tuple(r) for r in tokens.tokenize(d, "text", words, "search").collect()]
    assert got == [(1, "手机壳", None, [1.5], ["手机", "机壳", "手机壳"]), (None, None, 7, None, []), (3, "", 8, [], [])]
    assert tokens.tokenize(d.limit(0), "text", words).collect() == []
    assert tokens.tokenize(d, "text", words.limit(0)).first().tokens == ["手", "机", "壳"]
    monkeypatch.setattr(tokens, "DICTIONARY_WORDS", 2)
    with pytest.raises(ValueError):
        tokens.tokenize(d, "text", words)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_tfidf_by_row(spark, monkeypatch, limit):
    """Equal ids are documents of their own, nulls and empty arrays give nothing, both joins agree."""
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", limit)
    d = spark.createDataFrame([(1, ["b", "a", "b", None]), (1, ["a", "c"]), (2, []), (3, None), (None, ["z"])], "id long, tokens array<string>")
    got = sorted((r.id, r["rank"], r.word, r.weight) for r in tokens.keywords_tfidf(d, 2).collect())
    a, b = np.log(5 / 2), np.log(5)
    assert got == [(1, 1, "b", round(2 / 4 * b, 6)), (1, 1, "c", round(b / 2, 6)), (1, 2, "a", round(a / 4, 6)), (1, 2, "a", round(a / 2, 6))]
    idf = spark.createDataFrame([("a", 9.0), ("x", 1.0)], "word string, idf double")
    assert sorted((r.id, r.word, r.weight) for r in tokens.keywords_tfidf(d, 2, idf).collect()) == [(1, "a", 2.25), (1, "a", 4.5)]


def _plain_tfidf(d, k, idf=None):
    """Every word of every row is joined and ranked."""
    w = d.filter("id IS NOT NULL").select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("word")).filter("word IS NOT NULL")
    f = w.groupBy("id", "size", "word").agg(F.count(F.lit(1)).alias("n"))
    idf = f.groupBy("word").agg(F.log(F.lit(float(d.count())) / F.count(F.lit(1))).alias("idf")) if idf is None else idf
    x = f.join(idf, "word").select("id", "word", F.round(F.col("n") / F.col("size") * F.col("idf"), 6).alias("weight"))
    return x.withColumn("rank", F.expr("row_number() OVER (PARTITION BY id ORDER BY weight DESC, word)")).filter(F.col("rank") <= k)


def _skewed_rows(n: int) -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(i, [f"w{x}" for x in (rng.pareto(0.7, int(rng.integers(1, 120))) * 4).astype(int) if x < 3000]) for i in range(n)]
    return [*rows, (n, None), (n + 1, []), (n + 2, [None, "w1", "x" * 300, "x" * 300]), (n + 3, ["x" * 300]), (None, ["w1"])]


def _rows_of(df):
    return sorted(tuple(map(str, (r.id, r["rank"], r.word, r.weight))) for r in df.collect())


def test_tfidf_rows_weigh_their_words(spark, monkeypatch):
    """With more words than are broadcast, a row still sends few of its words; the result is that of all of them."""
    sent, write = {}, tokens.written
    monkeypatch.setattr(tokens, "written", lambda df, name: sent.setdefault(name, write(df, name)))
    d = spark.createDataFrame(_skewed_rows(300), "id long, tokens array<string>").repartition(3).cache()
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", 200)
    monkeypatch.setattr(tokens, "WEIGHED", 500)
    got = tokens.keywords_tfidf(d, 4)
    pairs = d.filter("id IS NOT NULL").select(F.explode(F.array_distinct("tokens"))).count()
    assert got.count() <= sent["tfidf-best"].count() < pairs / 2
    assert sent["tfidf-idf"].count() > 200
    assert _rows_of(got) == _rows_of(_plain_tfidf(d, 4))


@pytest.mark.parametrize("limit", [0, 40, 300, 100_000])
@pytest.mark.parametrize("given", [False, True])
def test_tfidf_is_that_of_all_words(spark, monkeypatch, limit, given):
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", limit)
    d = spark.createDataFrame(_skewed_rows(80), "id long, tokens array<string>").cache()
    odd = [("w1", float("nan")), ("w2", float("inf")), ("w3", None), ("w4", -5.0), ("w5", 1.0), ("w5", 2.0), (None, 9.0), ("none", 1.0), ("w7", 0.0)]
    idf = spark.createDataFrame([*odd, *((f"w{i}", 50 / i) for i in range(8, 250))], "word string, idf double") if given else None
    assert _rows_of(tokens.keywords_tfidf(d, 7, idf)) == _rows_of(_plain_tfidf(d, 7, idf))


def test_sentiment_rules(spark):
    tags = lambda t, s: spark.range(1).select(sentiment.emotion_tags(F.lit(t), F.lit(s)).alias("x")).first().x
    assert tags("谢谢, 太好了", None) == ["喜悦", "感激"] and tags("abc", "negative") == ["失望"]
    replies = ['x {"sentiment":"great","sentiment_score":3,"emotion_tags":["喜悦","x"]}', "no json", '{"sentiment":"positive","sentiment_score":true,"emotion_tags":"爱"}']
    rows = sentiment.parse_sentiment_reply(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i long, r string"), "r").orderBy("i").collect()
    assert [(r.sentiment, r.sentiment_score, r.emotion_tags) for r in rows] == [("neutral", 1.0, ["喜悦"]), ("neutral", 0.0, ["平静"]), ("positive", 1.0, ["爱"])]


def test_adapters(spark):
    note = spark.createDataFrame([("n1", "normal", "1.2万", "50", 1700000000)], "note_id string, type string, liked_count string, collected_count string, time long")
    r = adapters.adapt_content(note, "xhs").first()
    assert (r.content_id, r.media_type, r.liked_count, r.collect_count, r.view_count, r.title) == ("n1", "image", 0, 50, 0, "")
    assert r.original_created_at == datetime(2023, 11, 14, 22, 13, 20)
    c = adapters.adapt_comment(spark.createDataFrame([("c", 15, "5", "2024-01-01")], "comment_id string, like_count int, sub_comment_count string, publish_time string"), "zhihu").first()
    assert (c.liked_count, c.reply_count, c.original_created_at) == (15, 5, None)


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", 10, 1), (2, "b", 20, 1)], "id long, title string, add_ts long, last_modify_ts long")
    s = spark.createDataFrame([(2, "B"), (3, "c"), (4, "")], "id long, title string")
    got = {r.id: tuple(r)[1:] for r in upsert.upsert_raw(t, s, ["id"], 99, require="title").collect()}
    assert got == {1: ("a", 10, 1), 2: ("B", 20, 99), 3: ("c", 99, 99)}


def test_topic_rules(spark):
    s = spark.createDataFrame([(1, 4, 0, 4, 3, 3), (2, 20, 0, 34, 33, 33), (3, 100, 0, 0, 0, 0), (4, 3, 100, 1, 2, 2)], "topic_id long, content_count long, interaction long, pos long, neu long, neg long")
    got = {r.topic_id: (r.heat, r.dominant) for r in topics.heat_level(topics.dominant_sentiment(s)).collect()}
    assert got == {1: ("medium", "positive"), 2: ("high", "mixed"), 3: ("critical", "positive"), 4: ("low", "neutral")}
    t = spark.createDataFrame([(1, "emerging"), (2, "active"), (3, "declining"), (4, "emerging"), (5, "active")], "topic_id long, status string")
    now = datetime(2024, 3, 31)
    st = spark.createDataFrame([(1, 10, datetime(2024, 1, 31)), (2, 5, datetime(2024, 3, 24)), (3, 5, datetime(2024, 3, 1)), (4, 2, datetime(2024, 3, 23)), (5, 1, None)], "topic_id long, content_count long, last_at timestamp")
    assert {r.topic_id: r.status for r in topics.update_lifecycle(t, st, now).collect()} == {1: "active", 2: "declining", 3: "ended", 4: "declining", 5: "active"}


def test_greedy_merge_equals_the_sequential_loop(spark):
    rng = random.Random(1)
    n = {i: rng.randrange(1, 9) for i in range(14)}
    pairs = [(a, b, round(rng.uniform(0.85, 1.0), 2)) for a in n for b in n if a < b and rng.random() < 0.25]
    gone, want = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if s >= 0.9 and a not in gone and b not in gone:
            source, target = (b, a) if n[a] >= n[b] else (a, b)
            gone.add(source)
            want.add((source, target))
    t = spark.createDataFrame(list(n.items()), "topic_id long, content_count long")
    m = topics.merge_topics(t, spark.createDataFrame(pairs, "topic_a long, topic_b long, similarity double"))
    assert {(r.source, r.target) for r in m.collect()} == want


def test_graph_rules(spark):
    x = [(1, 1, '[{"head":" Mi ","head_type":"品牌","relation":"r","tail":"y","tail_type":""}]'), (1, 2, '{"triples":[{"head":"mi","head_type":"品牌","relation":"r","tail":"Y"}]}'), (1, 3, "bad")]
    e = graph.extraction_status(graph.triples_to_graph(spark.createDataFrame(x, "topic_id long, unified_id long, reply string"), "reply"))
    r = graph.merge_entities(e).collect()
    assert [(i.name, i.mentions) for i in r] == [("Mi", 2)]
    assert [(i.head, i.tail, i.sources, i.confidence) for i in graph.merge_relations(e).collect()] == [("Mi", "y", 2, 0.9)]


def test_replies_and_cards(spark):
    d = spark.createDataFrame([('```json\n{"is_match": true, "confidence": 0.8}\n```',), ("none",)], "r string")
    assert [(r.is_match, r.confidence) for r in hot.parse_match_reply(d, "r").collect()] == [(True, 0.8), (False, 0.0)]
    k = hot.keyword_rows(spark.createDataFrame([(1, '{"keywords":["a","b"],"count":4}')], "news_id long, r string"), "r").collect()
    assert [(r.keyword, r.is_primary, r.confidence) for r in k] == [("a", True, 2.0), ("b", False, 2.0)]
    cards = spark.createDataFrame([(1, [(9, "x", None), (11, None, [(9, "y"), (4, "z")])])], "id long, cards array<struct<card_type:int,mblog:string,card_group:array<struct<card_type:int,mblog:string>>>>")
    assert [r.card.mblog for r in flatten.weibo_cards(cards).orderBy("place").collect()] == ["x", "y"]


def test_pages_and_exports(spark, tmp_path):
    p = spark.createDataFrame([(1, "http://a/?x=1&y=&z=%20b&x=2", "<style>a</style><p>t</p>")], "page_id long, url string, html string")
    assert pages.url_params(p).first().params == {"x": "1", "z": " b"} and pages.pages_to_text(p).first().text == "t"
    sets = {"contents": spark.createDataFrame([(1, None, [1])], "a int, b string, c array<int>"), "comments": spark.createDataFrame([], "a int")}
    assert io.export_sets(sets, str(tmp_path / "out")) == ["contents"]


@pytest.mark.parametrize("name", ["topic_platform_report", "unify_content", "keywords_tfidf", "process_contents", "dictionary_tokens", "class_metrics", "nearest_topics", "wordcloud", "two_hour_window", "cluster_incremental", "embed"])
def test_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    found = con.execute(SQL[name])
    cols = [c[0] for c in found.description]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, found.fetchall()))


def _near(seed: int, n: int, dim: int = 6) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 2 * np.eye(dim)[rng.integers(0, dim, n)]
    return [(3 * i + 1, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]


def test_batches_of_one_row_are_the_sequential_loop(spark):
    rows, topic, want = _near(14, 6, 3), {}, {}
    for i, v in rows:
        v = np.array(v)
        best = max(topic, key=lambda t: (float(topic[t][1] @ v), -t), default=None)
        if best is not None and float(topic[best][1] @ v) >= 0.6:
            n, c = topic[best]
            c = c * n + v
            topic[best] = n + 1, c / np.linalg.norm(c)
            want[i] = best
        else:
            best = want[i] = len(topic) + 1
            topic[best] = 1, v
    assert 1 < len(topic) < len(rows)
    df = spark.createDataFrame([*rows, (999, None)], "id long, vector array<double>")
    empty = spark.createDataFrame([], "topic_id long, n long, centroid array<double>")
    done, found = topics.cluster_incremental(df, empty, 0.6, batch=1)
    assert {r.id: r.topic_id for r in done.collect()} == want
    assert {r.topic_id: r.n for r in found.collect()} == {t: n for t, (n, _) in topic.items()}
    assert topics.cluster_incremental(df.limit(0), empty)[0].count() == 0
