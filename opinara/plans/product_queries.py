"""Registered queries of posts, topics, replies and logs that no other module has, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators import graph, hot, sentiment, topics
from opinara.plans.fixtures import Tables, rounded, with_sql
from opinara.sources import flatten, io, pages

L = F.lit
QUERIES: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""SELECT CAST(doc_id AS VARCHAR) AS video_id, 'video' AS video_type, coalesce(substring(text, 1, 500), '') AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(substring(text, 1, 500), '') END AS "desc", doc_id * 60 AS create_time,
  CAST(doc_id % 97 AS VARCHAR) AS user_id, coalesce(source, '') AS nickname, '' AS avatar, CAST(n_chars AS VARCHAR) AS liked_count, '' AS disliked_count, CAST(doc_id * 3 AS VARCHAR) AS video_play_count, CASE WHEN doc_id % 2 = 0 THEN '7' ELSE '' END AS video_favorite_count,
  '1' AS video_share_count, '2' AS video_coin_count, '3' AS video_danmaku, CAST(doc_id % 5 AS VARCHAR) AS video_comment, concat('https://www.bilibili.com/video/av', doc_id) AS video_url, coalesce(lang, '') AS video_cover_url FROM documents""")
def flat_bili_video(t: Tables) -> DataFrame:
    none = L(None).cast("string")
    owner = F.struct((F.col("doc_id") % 97).alias("mid"), F.col("source").alias("name"), none.alias("face"))
    counts = {"like": F.col("n_chars"), "dislike": none, "view": F.col("doc_id") * 3, "favorite": F.when(F.col("doc_id") % 2 == 0, 7), "share": L(1), "coin": L(2), "danmaku": L(3), "reply": F.col("doc_id") % 5}
    desc = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    view = F.struct(F.col("doc_id").alias("aid"), F.col("text").alias("title"), desc.alias("desc"), (F.col("doc_id") * 60).alias("pubdate"), owner.alias("owner"), F.struct(*[c.alias(k) for k, c in counts.items()]).alias("stat"), F.col("lang").alias("pic"))
    return flatten.flatten_bili_video(t.raw("documents").select(view.alias("View")))


@query("""SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS note_id, p_name AS title, concat('about ', p_type) AS "desc", p_brand AS tieba_name, p_brand AS user_nickname, '2024-01-02 03:04' AS publish_time FROM part
UNION ALL SELECT p_partkey, concat('9', p_partkey), concat('box ', p_size), '', p_brand, p_type, '2023-12-31' FROM part WHERE p_partkey % 2 = 0""")
def forum_search_posts(t: Tables) -> DataFrame:
    def block(tid, title, desc, forum, author, at):
        parts = ['<div class="s_post"><span class="p_title"><a data-tid="', tid, '" href="/p/1">', title, '</a></span><div class="p_content"><em>', desc, '</em> </div><a class="p_forum" href="/f"><font>', forum, '</font></a> <a href="/home/main?un=x"><font>', author, '</font></a><font class="p_green p_date">', at, "</font></div>"]
        return F.concat(*[L(x) if isinstance(x, str) else x.cast("string") for x in parts])

    key = F.col("p_partkey").cast("string")
    one = block(key, F.col("p_name"), F.concat(L("about "), "p_type"), F.col("p_brand"), F.col("p_brand"), "2024-01-02 03:04")
    two = block(F.concat(L("9"), key), F.concat(L("box "), F.col("p_size").cast("string")), "", F.col("p_brand"), F.col("p_type"), "2023-12-31")
    html = F.concat(L("<html><body>"), one, F.when(F.col("p_partkey") % 2 == 0, two).otherwise(L("")), L("</body></html>"))
    return pages.tieba_search_posts(t.raw("part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("""SELECT o_custkey AS page_id, CAST(o_orderkey AS VARCHAR) AS note_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('clerk', o_custkey) ELSE o_orderstatus END AS user_nickname, CAST(o_orderkey % 50 AS INTEGER) AS total_replay_num FROM orders WHERE o_orderkey % 4 <> 1""")
def forum_list_posts(t: Tables) -> DataFrame:
    """Pages of a customer's orders; every fourth block is broken JSON."""
    key = F.col("o_orderkey")
    nick = F.when(key % 3 == 0, L("")).otherwise(F.concat(L("&quot;author_nickname&quot;:&quot;"), "o_orderstatus", L("&quot;,")))
    field = F.when(key % 4 == 1, L("{&quot;id&quot;:")).otherwise(F.concat(L("{&quot;id&quot;:"), key.cast("string"), L(",&quot;author_name&quot;:&quot;"), L("clerk"), F.col("o_custkey").cast("string"), L("&quot;,"), nick, L("&quot;reply_num&quot;:"), (key % 50).cast("string"), L("}")))
    block = F.concat(L("<li class=\" j_thread_list clearfix\" data-tid=\"1\" data-field='"), field, L("'>x</li>"))
    html = t.raw("orders").select("o_custkey", block.alias("b")).groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.collect_list("b"), "\n").alias("html"))
    return pages.tieba_list_posts(html)


@query(f"""{with_sql("content", "topics")}, s AS (SELECT topic_id, count(*) AS content_count, round(coalesce(avg(sentiment_score), 0), 6) AS mean_score, count(*) FILTER (sentiment = 'positive') AS pos, count(*) FILTER (sentiment = 'neutral') AS neu, count(*) FILTER (sentiment = 'negative') AS neg,
  CAST(sum(liked_count + comment_count + share_count) AS BIGINT) AS interaction, max(original_created_at) AS last_at FROM content WHERE topic_id IS NOT NULL GROUP BY topic_id)
SELECT t.topic_id, t.status, s.content_count, mean_score, pos, neu, neg, interaction, last_at, CASE WHEN s.content_count * 5 + interaction * 0.01 >= 500 THEN 'critical' WHEN s.content_count * 5 + interaction * 0.01 >= 100 THEN 'high' WHEN s.content_count * 5 + interaction * 0.01 >= 20 THEN 'medium' WHEN s.topic_id IS NOT NULL THEN 'low' END AS heat
FROM topics t LEFT JOIN s USING (topic_id)""")
def refresh_topics(t: Tables) -> DataFrame:
    content = t.content.withColumn("emotion_tags", L(None).cast("string"))
    return rounded(topics.update_topic_stats(t.topics, content), "mean_score").select("topic_id", "status", "content_count", "mean_score", "pos", "neu", "neg", "interaction", "last_at", "heat")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN substring(repeat(c_name || ' ', 15), 1, 200) END AS name, CASE WHEN c_custkey % 4 <> 3 THEN c_mktsegment END AS summary,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE concat(c_mktsegment, ':', CASE WHEN c_custkey % 2 = 0 THEN '1.0' ELSE '0.25' END, ',plain:1.0') END AS words FROM customer""")
def naming_replies(t: Tables) -> DataFrame:
    """Replies with prose around nested JSON; every fourth has no name, every other fourth no more than one."""
    key = F.col("c_custkey") % 4
    weight = F.when(F.col("c_custkey") % 2 == 0, L("3")).otherwise(L("0.25"))
    name = F.when(key == 0, L("")).otherwise(F.concat(L('"name": "'), F.repeat(F.concat("c_name", L(" ")), L(15)), L('", ')))
    rest = F.when(key == 3, L('"x": 1')).otherwise(F.concat(L('"summary": "'), "c_mktsegment", L('", "keywords": [{"word": "'), "c_mktsegment", L('", "weight": '), weight, L('}, "plain"]')))
    got = topics.parse_topic_reply(t.raw("customer").select("c_custkey", F.concat(L("Sure:\n{"), name, rest, L("} done")).alias("reply")), "reply")
    words = F.transform("keywords", lambda k: F.concat(k["word"], L(":"), k["weight"].cast("string")))
    return got.select("c_custkey", "name", "summary", F.array_join(words, ",").alias("words"))


@query("""SELECT o_orderkey AS log_id, CASE WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS n_items, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 1000 END AS duration_s FROM orders""")
def log_transitions(t: Tables) -> DataFrame:
    at = datetime(2024, 1, 1)
    o = t.raw("orders")
    rows = o.select(F.col("o_orderkey").alias("log_id"), L(None).cast("timestamp").alias("finished_at"), L(None).cast("long").alias("n_items"))
    status = F.when(F.col("o_orderkey") % 3 == 1, "completed").otherwise("failed")
    done = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("log_id"), status.alias("status"), F.timestamp_seconds(F.unix_seconds(L(at).cast("timestamp")) + F.col("o_orderkey") % 1000).alias("finished_at"), F.col("o_custkey").cast("long").alias("n_items"))
    return hot.log_finish(hot.log_start(rows, at), done).select("log_id", "status", "n_items", "duration_s")


_EXT = "x AS (SELECT c_custkey % 7 AS topic_id, c_mktsegment AS head, n_name AS tail FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 < 2 OR c_nationkey < 5)"


@query(f"""WITH {_EXT}, b AS (SELECT DISTINCT head AS name, '组织机构' AS type, topic_id FROM x UNION SELECT tail, '地点', topic_id FROM x)
SELECT 'belongs' AS part, name, type, topic_id FROM b WHERE topic_id <> 1 UNION ALL SELECT DISTINCT 'node', name, type, CAST(NULL AS BIGINT) FROM b WHERE topic_id <> 1
UNION ALL SELECT DISTINCT 'edge', head, tail, topic_id FROM x WHERE topic_id <> 1""")
def drop_topic_graph(t: Tables) -> DataFrame:
    c = t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey")).filter("c_custkey % 7 < 2 OR c_nationkey < 5")  # 25 rows
    reply = F.concat(L('[{"head":"'), "c_mktsegment", L('","head_type":"组织机构","relation":"位于","tail":" '), "n_name", L('","tail_type":"地点"}]'))
    e = graph.extraction_status(graph.triples_to_graph(c.select((F.col("c_custkey") % 7).alias("topic_id"), F.col("c_custkey").alias("unified_id"), reply.alias("reply")), "reply"))
    g = graph.drop_topic_graph(graph.graph_tables(graph.merge_entities(e), graph.merge_relations(e)), 1)
    shape = lambda part, df, a, b, topic: df.select(L(part).alias("part"), F.col(a).alias("name"), F.col(b).alias("type"), topic.cast("long").alias("topic_id"))
    return shape("belongs", g["belongs"], "name", "type", F.col("topic_id")).unionAll(shape("node", g["nodes"], "name", "type", L(None))).unionAll(shape("edge", g["edges"], "head", "tail", F.col("topic_id")))


@query("""SELECT conv_id, turn, concat('请分析以下文本的情感：', chr(10), chr(10), text) AS instruction, concat('{', chr(10), '  "sentiment": "', CASE WHEN turn % 2 = 0 THEN 'positive' ELSE 'neutral' END, '",', chr(10), '  "sentiment_score": ', CASE WHEN turn % 2 = 0 THEN '0.88' ELSE '0.0' END, ',', chr(10), '  "emotion_tags": [', chr(10), '    "平静"', CASE WHEN turn % 2 = 0 THEN ',' || chr(10) || '    "期待"' ELSE '' END, chr(10), '  ]', chr(10), '}') AS output FROM conversations""")
def instruction_records(t: Tables) -> DataFrame:
    even = F.col("turn") % 2 == 0
    rows = t.raw("conversations").withColumns({"sentiment": F.when(even, "positive").otherwise("neutral"), "sentiment_score": F.when(even, 0.876).otherwise(0.0), "emotion_tags": F.when(even, F.array(L("平静"), L("期待"))).otherwise(F.array(L("平静")))})
    return sentiment.instruction_records(rows).select("conv_id", "turn", "instruction", "output")


@query("""WITH e AS (SELECT label AS topic_id, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), a AS (SELECT topic_id, i, sum(CAST(x AS DOUBLE)) AS s, count(*) AS n FROM e WHERE vec_id % 2 = 0 GROUP BY 1, 2), c AS (SELECT topic_id, n, i, s / sqrt(sum(s * s) OVER (PARTITION BY topic_id)) AS x FROM a),
b AS (SELECT topic_id, i, sum(CAST(x AS DOUBLE)) AS s, count(*) AS n FROM e WHERE vec_id % 2 = 1 GROUP BY 1, 2), u AS (SELECT c.topic_id, c.i, c.n + coalesce(b.n, 0) AS n, c.x * c.n + coalesce(b.s, 0) AS s FROM c LEFT JOIN b ON b.topic_id = c.topic_id AND b.i = c.i)
SELECT CAST(topic_id AS BIGINT) AS topic_id, n, CAST(i AS INTEGER) AS i, round(s / sqrt(sum(s * s) OVER (PARTITION BY topic_id)), 6) AS x FROM u""")
def update_centroids(t: Tables) -> DataFrame:
    """Centroids of the even rows, moved by the odd ones."""
    e = t.raw("embeddings").select("vec_id", F.col("label").cast("long").alias("topic_id"), F.col("embedding").cast("array<double>").alias("vector"))
    old = topics.mean_centroids(e.filter("vec_id % 2 = 0")).withColumn("n", F.col("n").cast("long"))
    moved = topics.update_centroids(old, e.filter("vec_id % 2 = 1").select("topic_id", "vector"))
    return moved.select("topic_id", "n", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{n}' AS platform, 'parquet' AS type, CAST(1 AS BIGINT) AS files, count(*) AS records FROM {n}" for n in _TABLES))
def file_inventory(t: Tables) -> DataFrame:
    """The driver's folder, a table's name as platform."""
    return io.source_file_stats(t.spark, t.dir, list(_TABLES)).select("platform", "type", "files", "records")
