"""Registered queries of the smaller operators, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as X
from opinara.functions import times
from opinara.operators import graph, hot, sentiment, topics, upsert
from opinara.plans.fixtures import Tables, rounded, with_sql
from opinara.sources import pages

L = F.lit
QUERIES: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _parts(t: Tables) -> DataFrame:
    """Parts as search keywords: part key, size as number of searches, brand as domain."""
    p = t.raw("part")
    return p.select(F.col("p_partkey").cast("long").alias("keyword_id"), F.col("p_name").alias("keyword"), (F.col("p_partkey") % 5).cast("long").alias("domain_id"), F.concat(L("b"), (F.col("p_partkey") % 3).cast("string")).alias("run_batch_id"), ((F.col("p_partkey") % 100) / 100.0).alias("confidence"), (F.col("p_size") % 4).cast("long").alias("search_count"), F.col("p_partkey").alias("created_at"), (F.col("p_partkey") % 11).cast("string").alias("news_id"))


_PARTS = "p AS (SELECT CAST(p_partkey AS BIGINT) AS keyword_id, p_name AS keyword, CAST(p_partkey % 5 AS BIGINT) AS domain_id, 'b' || p_partkey % 3 AS run_batch_id, (p_partkey % 100) / 100.0::DOUBLE AS confidence, CAST(p_size % 4 AS BIGINT) AS search_count, CAST(p_partkey % 11 AS VARCHAR) AS news_id FROM part)"


@query(f"WITH {_PARTS} SELECT keyword_id, keyword FROM p WHERE search_count = 0 AND domain_id = 2 AND run_batch_id = 'b1'")
def never_searched(t: Tables) -> DataFrame:
    return hot.never_crawled(_parts(t), 2, "b1").select("keyword_id", "keyword")


@query(f"WITH {_PARTS} SELECT keyword_id, confidence FROM p WHERE domain_id = 3 ORDER BY confidence DESC, keyword_id DESC LIMIT 25")
def top_keywords(t: Tables) -> DataFrame:
    return hot.list_keywords(_parts(t), 3, n=25).select("keyword_id", "confidence")


@query(f"WITH {_PARTS} SELECT keyword_id FROM p WHERE keyword_id % 7 <> 0")
def drop_keywords(t: Tables) -> DataFrame:
    p = _parts(t)
    return hot.drop_keys(p, p.filter("keyword_id % 7 = 0")).select("keyword_id")


@query(f"WITH {_PARTS} SELECT keyword_id, keyword FROM p WHERE domain_id = 1 AND run_batch_id = 'b2'")
def lookup_keywords(t: Tables) -> DataFrame:
    return hot.lookup(_parts(t), domain_id=1, run_batch_id="b2").select("keyword_id", "keyword")


def _platforms(t: Tables) -> DataFrame:
    return t.raw("region").select(F.col("r_name").alias("platform"), (F.col("r_regionkey") != 1).alias("is_enabled"), F.col("r_regionkey").alias("priority"))


@query("SELECT r_name AS platform, CAST(row_number() OVER (ORDER BY r_regionkey DESC) AS INTEGER) AS place FROM region WHERE r_regionkey <> 1")
def enabled_platforms(t: Tables) -> DataFrame:
    # the order is the feature: the place of each row in it
    return hot.enabled(_platforms(t)).withColumn("one", L(1)).groupBy("one").agg(F.collect_list("platform").alias("x")).select(F.posexplode("x").alias("place", "platform")).select("platform", (F.col("place") + 1).alias("place"))


@query(f"WITH {_PARTS} SELECT keyword_id, keyword, r_name AS platform, 'pending' AS status FROM p, region WHERE domain_id = 4 AND r_regionkey <> 1")
def crawl_plan(t: Tables) -> DataFrame:
    return hot.crawl_plan(_parts(t), _platforms(t), domain=4)


@query(f"""WITH {_PARTS} SELECT DISTINCT s_suppkey AS id FROM supplier JOIN p ON p.news_id = CAST(s_suppkey % 11 AS VARCHAR) WHERE keyword_id IN (SELECT p_partkey FROM part WHERE p_partkey % 50 = 3)""")
def news_of_keywords(t: Tables) -> DataFrame:
    news = t.raw("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 11).cast("string").alias("news_id"))
    p = _parts(t)
    return hot.news_of_keywords(news, p, p.filter("keyword_id % 50 = 3").select("keyword_id")).select("id")


@query("""WITH m AS (SELECT CAST(page_id % 20 AS VARCHAR) AS news_id, page_id AS domain_id, (page_id % 10) / 10.0::DOUBLE AS confidence, page_id % 2 = 0 AS is_match FROM pages)
SELECT news_id, string_agg(domain_id, ',' ORDER BY confidence DESC, domain_id) AS domains FROM m WHERE is_match AND confidence >= 0.4 GROUP BY news_id""")
def matched_domains(t: Tables) -> DataFrame:
    m = t.raw("pages").select((F.col("page_id") % 20).cast("string").alias("news_id"), F.col("page_id").alias("domain_id"), L("d").alias("domain_name"), ((F.col("page_id") % 10) / 10.0).alias("confidence"), (F.col("page_id") % 2 == 0).alias("is_match"))
    return hot.matched_domains(m, 0.4).select("news_id", F.array_join(F.transform("domains", lambda d: d["domain_id"].cast("string")), ",").alias("domains"))


@query(f"""{with_sql("hot")} SELECT page_id FROM hot WHERE platform_code IN ('p1', 'p2') ORDER BY page_id DESC LIMIT 12""")
def recent_hot(t: Tables) -> DataFrame:
    h = hot.normalize_hot(t.hot).withColumn("fetched_at", F.col("page_id"))
    return hot.recent_hot(h, 12, ["p1", "p2"]).select("page_id")


@query("""WITH r AS (SELECT 'r' || o_orderkey % 4 AS run_batch_id, 'hot' AS k FROM orders UNION ALL SELECT 'r' || l_orderkey % 4, 'matched' FROM lineitem WHERE l_linenumber % 2 = 0
UNION ALL SELECT 'r' || p_partkey % 4, 'keywords' FROM part UNION ALL SELECT 'r' || s_suppkey % 4, 'crawls' FROM supplier)
SELECT run_batch_id, count(*) FILTER (k = 'hot') AS hot, count(*) FILTER (k = 'matched') AS matched, count(*) FILTER (k = 'keywords') AS keywords, count(*) FILTER (k = 'crawls') AS crawls FROM r GROUP BY 1""")
def run_summary(t: Tables) -> DataFrame:
    def runs(table: str, key: str) -> DataFrame:
        return t.raw(table).withColumn("run_batch_id", F.concat(L("r"), (F.col(key) % 4).cast("string")))

    analysis = runs("lineitem", "l_orderkey").withColumn("is_match", F.col("l_linenumber") % 2 == 0)
    return hot.run_summary(runs("orders", "o_orderkey"), analysis, runs("part", "p_partkey"), runs("supplier", "s_suppkey"))


@query("SELECT o_orderkey AS log_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 40")
def log_view(t: Tables) -> DataFrame:
    o = t.raw("orders").select(F.col("o_orderkey").alias("log_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    return hot.log_view(o, "F", oldest_first=True, n=40).select("log_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{"is_match":true}' ELSE '' END <> '' AS is_match, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 10) / 10.0 ELSE 0 END::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id ELSE '' END AS reason FROM documents""")
def match_replies(t: Tables) -> DataFrame:
    d = t.raw("documents").select("doc_id")
    body = F.to_json(F.struct(L(True).alias("is_match"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), F.concat(L("r"), F.col("doc_id").cast("string")).alias("reason")))
    return hot.parse_match_reply(d.withColumn("reply", F.when(F.col("doc_id") % 2 == 0, F.concat(L("```json\n"), body, L("\n```"))).otherwise("no")), "reply").drop("reply")


@query("""SELECT doc_id AS news_id, 'k' || doc_id % 9 || n AS keyword, n = 2 AS is_primary, 1.5::DOUBLE AS confidence FROM documents, (SELECT unnest([1, 2]) AS n)""")
def keyword_replies(t: Tables) -> DataFrame:
    d = t.raw("documents")
    word = lambda n: F.concat(L("k"), (F.col("doc_id") % 9).cast("string"), L(str(n)))
    body = F.to_json(F.struct(F.array(word(1), word(2)).alias("keywords"), L(3).alias("count"), word(2).alias("primary")))
    return hot.keyword_rows(d.select(F.col("doc_id").alias("news_id"), body.alias("reply")), "reply")


# ---- sentiment


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' END AS mood, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS label, CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END AS name FROM documents""")
def label_maps(t: Tables) -> DataFrame:
    d = t.raw("documents").select("doc_id", (F.col("doc_id") % 4).cast("int").alias("k"))
    mood = sentiment.emotion_sentiment(F.element_at(F.array(L("喜悦"), L("愤怒"), L("惊讶"), L("x")), F.col("k") + 1))
    return d.select("doc_id", mood.alias("mood"), sentiment.label_id(mood).alias("label"), sentiment.label_name(F.col("k")).alias("name"))


@query("""WITH p AS (SELECT doc_id, (doc_id % 7) / 10.0::DOUBLE AS a, (doc_id % 5) / 10.0::DOUBLE AS b, (doc_id % 3) / 10.0::DOUBLE AS c FROM documents)
SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral' ELSE 'positive' END AS sentiment, round(c - a, 6) AS sentiment_score FROM p""")
def scores_of_probabilities(t: Tables) -> DataFrame:
    p = t.raw("documents").select("doc_id", F.array(*[(F.col("doc_id") % n) / 10.0 for n in (7, 5, 3)]).alias("p"))
    s = sentiment.score_from_probs(F.col("p"))
    return rounded(p.select("doc_id", s["sentiment"].alias("sentiment"), s["sentiment_score"].alias("sentiment_score")), "sentiment_score")


@query(f"""{with_sql("content")} SELECT id, CASE WHEN id % 3 = 0 THEN 'neutral' ELSE sentiment END AS sentiment, CASE WHEN id % 3 = 0 THEN 0.25::DOUBLE ELSE sentiment_score END AS sentiment_score, CASE WHEN id % 3 = 0 THEN '平静' END AS tags FROM content""")
def apply_sentiment(t: Tables) -> DataFrame:
    c = t.content.select("id", "sentiment", "sentiment_score").withColumn("emotion_tags", L(None).cast("array<string>"))
    r = t.raw("documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(-F.col("doc_id") - 1).alias("id"), L("neutral").alias("sentiment"), L(0.25).alias("sentiment_score"), F.array(L("平静")).alias("emotion_tags"))
    return sentiment.apply_sentiment(c, r).select("id", "sentiment", "sentiment_score", F.array_join("emotion_tags", ",").alias("tags"))


# ---- times and counts


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, strftime(ts, '%Y-%m-%d') AS day, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS back, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS first, CAST(epoch(date_trunc('day', ts)) + 86399 AS BIGINT) AS last FROM events""")
def times_and_texts(t: Tables) -> DataFrame:
    e = t.raw("events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    text, day = times.epoch_to_str(F.col("s")), times.epoch_to_date(F.col("s"))
    first, last = times.day_range_bounds(F.to_date(day), F.to_date(day))
    return e.select("event_id", text.alias("text"), day.alias("day"), times.str_to_epoch(text).alias("back"), first.alias("first"), last.alias("last"))


@query("""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS china, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS naive, CAST(epoch(date_trunc('second', ts)) - 28800 AS BIGINT) AS instant FROM events""")
def mail_times(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    text = F.concat(F.date_format(ts, "EEE MMM dd HH:mm:ss"), L(" +0800 "), F.date_format(ts, "yyyy"))
    e = t.raw("events").select("event_id", text.alias("x"))
    return e.select("event_id", times.rfc2822_china(F.col("x")).alias("china"), times.rfc2822_epoch_naive(F.col("x")).alias("naive"), F.unix_seconds(times.rfc2822_time(F.col("x"))).alias("instant"))


@query("""SELECT doc_id, coalesce(TRY_CAST(regexp_extract(text, '[0-9]+') AS BIGINT), 0) AS first_count, CAST(0 AS BIGINT) AS none, doc_id AS kept FROM documents""")
def display_counts(t: Tables) -> DataFrame:
    d = t.raw("documents")
    return d.select("doc_id", X.first_int(F.col("text")).alias("first_count"), X.safe_int(L("1.2万")).alias("none"), X.safe_int(F.concat(L(" +"), F.col("doc_id").cast("string"))).alias("kept"))


@query("SELECT doc_id, md5(translate(text, 'eaé', '艾阿e')) AS simple FROM documents")
def simplified(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(X.to_simplified(F.col("text"), {"e": "艾", "a": "阿", "é": "e"})).alias("simple"))


@query(r"""WITH u AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages), a AS (SELECT page_id, concat(u, CASE WHEN contains(u, '?') THEN '&' ELSE '?' END, 'id=', page_id, '&q=caf%C3%A9+', page_id % 3, '&id=again&none=#top') AS url FROM u),
q AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: contains(x, '=') AND substr(x, strpos(x, '=') + 1) <> '') AS p FROM a),
e AS (SELECT page_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM q),
f AS (SELECT page_id, url_decode(replace(split_part(x, '=', 1), '+', ' ')) AS k, arg_min(url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' ')), i) AS v FROM e GROUP BY ALL)
SELECT page_id, CAST(count(*) AS INTEGER) AS n, string_agg(k || '=' || v, '&' ORDER BY k) AS params FROM f GROUP BY page_id""")
def url_parameters(t: Tables) -> DataFrame:
    # coded letters and spaces, a name that stands twice, one without a value, a fragment
    base = F.substring_index("url", "#", 1)
    more = (L("id="), F.col("page_id").cast("string"), L("&q=caf%C3%A9+"), (F.col("page_id") % 3).cast("string"), L("&id=again&none=#top"))
    p = t.raw("pages").select("page_id", F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), *more).alias("url"))
    named = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], L("="), e["value"]))
    return pages.url_params(p).select("page_id", F.size("params").alias("n"), F.array_join(named, "&").alias("params"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id END AS id, CASE WHEN page_id % 2 = 0 THEN '' END AS note FROM pages""")
def page_states(t: Tables) -> DataFrame:
    html = F.when(F.col("page_id") % 2 == 0, F.concat(L('<script>window.__INITIAL_STATE__={"id":'), F.col("page_id").cast("string"), L(',"note":undefined}</script>'))).otherwise(F.col("html"))
    return pages.page_state(t.raw("pages").select("page_id", html.alias("html")), "id long, note string").select("page_id", "state.id", "state.note")


# ---- upserts


@query("""WITH f AS (SELECT user_id AS up_id, user_id % 13 AS fan_id, max(event_id) AS last_modify_ts FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
s AS (SELECT user_id AS up_id, user_id % 13 AS fan_id, min(event_id) AS last_modify_ts FROM events WHERE event_id % 2 = 0 GROUP BY ALL)
SELECT coalesce(s.up_id, f.up_id) AS up_id, coalesce(s.fan_id, f.fan_id) AS fan_id, coalesce(f.last_modify_ts, s.last_modify_ts) AS last_modify_ts FROM s FULL JOIN f ON s.up_id = f.up_id AND s.fan_id = f.fan_id""")
def upsert_edges(t: Tables) -> DataFrame:
    e = t.raw("events").select("event_id", F.col("user_id").alias("up_id"), (F.col("user_id") % 13).alias("fan_id"))
    old = e.filter("event_id % 2 = 0").groupBy("up_id", "fan_id").agg(F.min("event_id").alias("last_modify_ts"))
    new = e.filter("event_id % 2 = 1").select("up_id", "fan_id", F.col("event_id").alias("last_modify_ts"))
    return upsert.upsert(old, new, ["up_id", "fan_id"], order=[F.col("last_modify_ts")])


@query(f"""{with_sql("content")} SELECT id, title, CASE WHEN id % 4 = 0 THEN liked_count + 1 ELSE liked_count END AS liked_count, CASE WHEN id % 4 = 0 THEN 99 ELSE 1 END::BIGINT AS last_modify_ts FROM content""")
def upsert_counters(t: Tables) -> DataFrame:
    c = t.content.select("id", "title", "liked_count", L(1).cast("long").alias("last_modify_ts"))
    new = c.filter("id % 4 = 0").select("id", L("renamed").alias("title"), (F.col("liked_count") + 1).alias("liked_count"), L(99).cast("long").alias("last_modify_ts"))
    return upsert.upsert(c, new, ["id"], [x for x in upsert.XHS_UPDATE_COLS["content"] if x in c.columns], order=[F.col("last_modify_ts")])


@query(f"""{with_sql("content")} SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE title END AS title, CAST(7 AS BIGINT) AS add_ts, CASE WHEN id % 5 = 0 THEN 99 ELSE 7 END::BIGINT AS last_modify_ts FROM content WHERE id % 2 = 0
UNION ALL SELECT id, 'new', 99, 99 FROM content WHERE id % 2 = 1 AND id % 5 = 0""")
def upsert_raw(t: Tables) -> DataFrame:
    old = t.content.filter("id % 2 = 0").select("id", "title", L(7).cast("long").alias("add_ts"), L(7).cast("long").alias("last_modify_ts"))
    new = t.content.filter("id % 5 = 0").select("id", L("new").alias("title"))
    return upsert.upsert_raw(old, new, ["id"], 99)


# ---- topics and graph


@query(f"""{with_sql("content")}, g AS (SELECT topic_id, CASE WHEN id % 3 = 0 THEN '喜悦' WHEN id % 5 = 0 THEN '愤怒' ELSE '平静' END AS tag, count(*) AS n FROM content WHERE topic_id IS NOT NULL GROUP BY ALL)
SELECT topic_id, string_agg(tag, ',' ORDER BY n DESC, tag) AS emotions FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, tag) AS r FROM g) WHERE r <= 2 GROUP BY topic_id""")
def dominant_emotions(t: Tables) -> DataFrame:
    c = t.content.select("topic_id", F.array(F.when(F.col("id") % 3 == 0, "喜悦").when(F.col("id") % 5 == 0, "愤怒").otherwise("平静")).alias("emotion_tags"))
    return topics.dominant_emotions(c, 2)


@query("""WITH s AS (SELECT DISTINCT user_id % 10 AS topic_id, CAST(ts AS DATE) AS snapshot_date FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY snapshot_date DESC) AS r FROM s) SELECT topic_id, snapshot_date FROM r WHERE r <= 4""")
def evolution_history(t: Tables) -> DataFrame:
    e = t.raw("events").select((F.col("user_id") % 10).alias("topic_id"), F.to_date("ts").alias("snapshot_date")).distinct()
    return topics.evolution_history(e, 4)


@query(f"""{with_sql("topics")} SELECT topic_id FROM topics WHERE status NOT IN ('merged', 'ended')""")
def active_topics(t: Tables) -> DataFrame:
    return topics.active_topics(t.topics).select("topic_id")


@query(f"""{with_sql("content", "processed")} SELECT id FROM content JOIN processed ON unified_id = id WHERE topic_id IS NULL AND status = 'completed' AND clean_content <> ''""")
def unclustered(t: Tables) -> DataFrame:
    return topics.unclustered(t.content, t.processed).select("id")


@query(f"""{with_sql("content")} SELECT id, CASE WHEN id % 2 = 0 THEN 'a/b/c/d/k' || id WHEN title <> '' THEN substr(title, 1, 50) ELSE '话题-未命名' END AS name, 'emerging' AS status FROM content""")
def new_topic_names(t: Tables) -> DataFrame:
    seeds = t.content.select("id", F.col("id").alias("topic_id"), F.when(F.col("id") % 2 == 0, F.array(*map(L, "abcd"), F.concat(L("k"), F.col("id").cast("string")), L("sixth"))).otherwise(F.array().cast("array<string>")).alias("keywords"), "title")
    return topics.new_topics(seeds).select("id", "name", "status")


@query(f"""{with_sql("content")} SELECT id, CASE WHEN id % 2 = 0 THEN id % 6 ELSE topic_id END AS topic_id, CASE WHEN id % 2 = 0 THEN 0.5 ELSE topic_similarity END::DOUBLE AS topic_similarity FROM content""")
def assign_topics(t: Tables) -> DataFrame:
    c = t.content.select("id", "topic_id", "topic_similarity", F.col("topic_assigned_at").cast("timestamp").alias("topic_assigned_at"))
    a = c.filter("id % 2 = 0").select("id", (F.col("id") % 6).alias("topic_id"), L(0.5).alias("similarity"))
    return topics.assign_topics(c, a, datetime(2024, 2, 1)).select("id", "topic_id", "topic_similarity")


@query(f"""{with_sql("topics")} SELECT topic_id AS source, topic_id + 1 AS target, '相似度 0.9500' AS reason, content_count AS source_content_count FROM topics WHERE topic_id % 2 = 0""")
def merge_log(t: Tables) -> DataFrame:
    m = t.topics.filter("topic_id % 2 = 0").select(F.col("topic_id").alias("source"), (F.col("topic_id") + 1).alias("target"), L(0.95).alias("similarity"))
    return topics.merge_log(m, t.topics.withColumn("keywords", L(None).cast("string"))).select("source", "target", "reason", "source_content_count")


@query(f"""{with_sql("content")} SELECT id, md5('[' || platform || '] [' || coalesce(sentiment, '') || '] ' || coalesce(title, '') || chr(10) || substr(coalesce(content, ''), 1, 500)) AS kg_text FROM content""")
def graph_texts(t: Tables) -> DataFrame:
    return graph.kg_text(t.content).select("id", F.md5("kg_text").alias("kg_text"))


@query(f"""{with_sql("content")} SELECT id FROM content WHERE topic_id IS NOT NULL AND id % 3 <> 0""")
def graph_pending(t: Tables) -> DataFrame:
    c = t.content.filter("topic_id IS NOT NULL").select("topic_id", "id")
    done = c.select("topic_id", F.col("id").alias("unified_id"), F.element_at(F.array(L("completed"), L("failed"), L("failed")), (F.col("id") % 3 + 1).cast("int")).alias("status"))
    return graph.kg_pending(c, done).select("id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN n_regionkey < 3 ELSE true END AS valid FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def checked_relations(t: Tables) -> DataFrame:
    c = t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    r = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "in").otherwise("free").alias("relation"), L("x").alias("head_type"), F.concat(L("r"), F.col("n_regionkey").cast("string")).alias("tail_type"))
    rules = t.raw("region").groupBy().agg(F.array(L("x")).alias("head_types"), F.collect_list(F.when(F.col("r_regionkey") < 3, F.concat(L("r"), F.col("r_regionkey").cast("string")))).alias("tail_types")).withColumn("relation", L("in"))
    return graph.check_schema(r, rules).select("id", "valid")


@query("""WITH b AS (SELECT o_custkey % 50 AS topic_id, o_orderkey AS built_at FROM orders) SELECT topic_id, max(built_at) AS built_at FROM b GROUP BY topic_id""")
def latest_builds(t: Tables) -> DataFrame:
    return graph.latest_build(t.raw("orders").select((F.col("o_custkey") % 50).alias("topic_id"), F.col("o_orderkey").alias("built_at")))
