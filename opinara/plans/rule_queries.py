"""Registered queries of rules with many cases: addresses, time formats, stop-word tables, snapshots, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import text, times
from opinara.operators import graph, hot, sentiment, tokens, topics
from opinara.plans.fixtures import Tables, with_sql
from opinara.plans.more_queries import _PARTS, _parts
from opinara.sources import pages

L = F.lit
QUERIES: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# ---- addresses

#: Of each kind of address: what stands before and after its key, the key (hash or id), platform, whether it is a creator's, content type.
ADDRESSES = (
    ("https://www.xiaohongshu.com/explore/", "", "h", "xhs", False, None),
    ("https://www.xiaohongshu.com/discovery/item/", "?xsec_token=a", "h", "xhs", False, None),
    ("https://www.xiaohongshu.com/user/profile/", "?from=b", "h", "xhs", True, None),
    ("https://www.bilibili.com/video/av", "/?p=1", "i", "bili", False, None),
    ("https://space.bilibili.com/", "/dynamic", "i", "bili", True, None),
    ("https://www.douyin.com/video/", "", "i", "dy", False, None),
    ("https://www.douyin.com/search/x?modal_id=", "&type=general", "i", "dy", False, None),
    ("https://www.douyin.com/user/", "?from=c", "h", "dy", True, None),
    ("https://www.kuaishou.com/short-video/", "?area=d", "h", "ks", False, None),
    ("https://www.kuaishou.com/profile/", "", "h", "ks", True, None),
    ("https://www.zhihu.com/question/1/answer/", "", "i", "zhihu", False, "answer"),
    ("https://zhuanlan.zhihu.com/p/", "#part", "i", "zhihu", False, "article"),
    ("https://www.zhihu.com/zvideo/", "", "i", "zhihu", False, "video"),
    ("https://www.zhihu.com/people/", "/posts", "h", "zhihu", True, None),
    ("", "", "h", "xhs", False, None),
    ("https://example.org/", "", "i", None, False, None),
)


def _addresses_sql() -> str:
    key = {"h": "h", "i": "CAST(doc_id AS VARCHAR)"}
    shown = {(True, "i"): "'av' || CAST(doc_id AS VARCHAR)"}
    rows = []
    for n, (before, after, k, platform, creator, kind) in enumerate(ADDRESSES):
        found = shown.get((before.endswith("/av"), k), key[k])
        columns = (f"'{platform}'" if platform else "NULL", found if platform and not creator else "NULL", found if creator else "NULL", f"'{kind}'" if kind else "NULL", "NULL" if platform else "'no id in the address'")
        rows.append(f"SELECT doc_id, '{before}' || {key[k]} || '{after}' AS url, {columns[0]} AS platform, {columns[1]} AS content_id, {columns[2]} AS creator_id, {columns[3]} AS content_type, {columns[4]} AS reason FROM d WHERE doc_id % {len(ADDRESSES)} = {n}")
    return "WITH d AS (SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 24) AS h FROM documents) " + " UNION ALL ".join(rows)


@query(_addresses_sql())
def url_shapes(t: Tables) -> DataFrame:
    """Each document under one of the kinds of addresses that carry an id."""
    i = F.col("doc_id").cast("string")
    key = {"h": F.substring(F.md5(i), 1, 24), "i": i}
    kinds = F.array(*[F.concat(L(before), key[k], L(after)) for before, after, k, *_ in ADDRESSES])
    url = F.element_at(kinds, (F.col("doc_id") % len(ADDRESSES) + 1).cast("int"))
    return pages.url_entities(t.raw("documents").select("doc_id", url.alias("url")))


# ---- times

_AT = "date_trunc('second', ts)"


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN NULL ELSE {_AT} END AS at,
  CASE event_id % 6 WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('day', ts) ELSE {_AT} END AS parsed, {_AT} AS of_millis FROM events""")
def text_times(t: Tables) -> DataFrame:
    """Events whose times stand in one of five text formats, or as digits, which are a time only on demand."""
    ts = F.col("ts").cast("timestamp")
    seconds = F.unix_seconds(ts)
    texts = F.array(*[F.date_format(ts, f) for f in times.FORMATS], seconds.cast("string"))
    e = t.raw("events").select("event_id", F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int")).alias("x"), (seconds * 1000).alias("ms"))
    plain = lambda c: c.cast("timestamp_ntz")
    x = F.col("x")
    return e.select("event_id", plain(times.flex_timestamp(x, False)).alias("at"), plain(times.flex_timestamp(x, False, parse_numeric_strings=True)).alias("parsed"), plain(times.epoch_time(F.col("ms"))).alias("of_millis"))


_OFFSETS = (("+0800", 480), ("-0500", -300), ("+0530", 330), ("+0000", 0))


@query(f"""WITH e AS (SELECT event_id, {_AT} AS sec, [{", ".join(str(m) for _, m in _OFFSETS)}][1 + event_id % 4] AS m FROM events)
SELECT event_id, strftime(sec - to_minutes(CAST(m - 480 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS china, CAST(epoch(sec) AS BIGINT) AS naive, CAST(epoch(sec) - m * 60 AS BIGINT) AS instant FROM e""")
def mail_offsets(t: Tables) -> DataFrame:
    """Mail times of four zones: the hour in China, the instant, and the seconds that leave the offset out."""
    ts = F.col("ts").cast("timestamp")
    zone = F.element_at(F.array(*[L(z) for z, _ in _OFFSETS]), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.date_format(ts, "EEE MMM dd HH:mm:ss"), L(" "), zone, L(" "), F.date_format(ts, "yyyy"))
    x = F.col("x")
    return t.raw("events").select("event_id", text.alias("x")).select("event_id", times.rfc2822_china(x).alias("china"), times.rfc2822_epoch_naive(x).alias("naive"), F.unix_seconds(times.rfc2822_time(x)).alias("instant"))


# ---- stop words, keyword counts, look-ups by a table of keys

_WORDS = r"unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS word"


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDS} FROM conversations), s AS (SELECT DISTINCT word FROM (SELECT {_WORDS} FROM benchmark))
SELECT conv_id, turn, word, count(*) AS n FROM w WHERE word NOT IN (SELECT word FROM s) GROUP BY ALL""")
def words_beyond_a_table(t: Tables) -> DataFrame:
    """Words of turns that no benchmark text has: the stop words come as a table."""
    each = F.explode(tokens.latin_tokens(F.col("text"))).alias("word")
    left = tokens.drop_stopword_rows(t.raw("conversations").select("conv_id", "turn", each), t.raw("benchmark").select(each))
    return left.groupBy("conv_id", "turn", "word").agg(F.count(L(1)).alias("n"))


@query(f"WITH {_PARTS} SELECT 'all' AS kind, count(*) AS n FROM p UNION ALL SELECT 'domain 3', count(*) FROM p WHERE domain_id = 3")
def keyword_counts(t: Tables) -> DataFrame:
    p = _parts(t)
    return hot.count_by(p).withColumn("kind", L("all")).unionByName(hot.count_by(p, 3).withColumn("kind", L("domain 3")))


@query(f"WITH {_PARTS} SELECT keyword_id, keyword FROM p WHERE keyword_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND run_batch_id = 'b1'")
def lookup_by_table(t: Tables) -> DataFrame:
    ids = t.raw("lineitem").filter("l_quantity > 49").select(F.col("l_partkey").cast("long").alias("keyword_id"))
    return hot.lookup(_parts(t), keyword_id=ids, run_batch_id="b1").select("keyword_id", "keyword")


# ---- texts: hashtags that go, keywords by a given idf, a seeded sample


@query(f"""WITH d AS (SELECT doc_id, concat('#', replace(split_part(coalesce(text, ''), chr(10), 1), ' ', '# #'), '# ', coalesce(text, '')) AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '#([^#{text.SPACE}]+)#?', '', 'g')) AS bare FROM d""")
def hashtags_removed(t: Tables) -> DataFrame:
    """Texts behind their first line as hashtags, which go with their words."""
    body = F.coalesce("text", L(""))
    tags = F.concat(L("#"), F.replace(F.substring_index(body, "\n", 1), L(" "), L("# #")), L("# "), body)
    return t.raw("documents").select("doc_id", F.md5(text.hashtags(tags, keep=False)).alias("bare"))


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, {_WORDS} FROM conversations), s AS (SELECT id, count(*) AS size FROM w GROUP BY id), f AS (SELECT id, word, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT item_id, {_WORDS} FROM benchmark), d AS (SELECT word, ln((SELECT count(*) FROM benchmark) / count(DISTINCT item_id)::DOUBLE) AS idf FROM b GROUP BY word),
x AS (SELECT id, word, round(n / size::DOUBLE * idf, 6) AS weight FROM f JOIN d USING (word) JOIN s USING (id)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS INTEGER) AS rank FROM x)
SELECT id, word, weight, rank FROM r WHERE rank <= 5""")
def keywords_by_given_idf(t: Tables) -> DataFrame:
    """Keywords of turns, weighed by the benchmark's idf; words that it has not are none."""
    b = t.raw("benchmark")
    each = b.select(F.explode(F.array_distinct(tokens.latin_tokens(F.col("text")))).alias("word"))
    idf = each.groupBy("word").agg(F.log(L(float(b.count())) / F.count(L(1))).alias("idf"))
    turns = t.raw("conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return tokens.keywords(tokens.tokenize(turns, "text").select("id", "tokens"), "tfidf", 5, idf=idf)


@query("""WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) - 1 AS r, least(150, count(*) OVER ()) AS n FROM documents)
SELECT id, CASE WHEN r < floor(n * 7 / 10) THEN 'train' WHEN r < floor(n * 7 / 10) + floor(n * 2 / 10) THEN 'val' ELSE 'test' END AS split FROM r WHERE r < n""")
def split_sample(t: Tables) -> DataFrame:
    """A seeded sample of at most 150 rows, the feature, in three parts."""
    return sentiment.split_dataset(t.raw("documents").select(F.col("doc_id").alias("id")), (7, 2, 1), seed=7, most=150).select("id", "split")


# ---- topics


@query(f"""{with_sql("content")}, g AS (SELECT topic_id, CASE WHEN id % 3 = 0 THEN '喜悦' ELSE '平静' END AS tag, count(*) AS n FROM content WHERE topic_id IS NOT NULL AND id % 4 <> 0 GROUP BY ALL)
SELECT topic_id, string_agg(tag, ',' ORDER BY n DESC, tag) AS emotions FROM g GROUP BY topic_id""")
def dominant_emotions_of_texts(t: Tables) -> DataFrame:
    """Tags as JSON texts, of which a fourth is no JSON and counts nothing."""
    tags = F.when(F.col("id") % 4 == 0, '["喜悦"').when(F.col("id") % 3 == 0, '["喜悦"]').otherwise('["平静"]')
    return topics.dominant_emotions(t.content.select("topic_id", tags.alias("emotion_tags")))


@query(f"""{with_sql("content", "topics")}, d AS (SELECT topic_id, count(*) AS n FROM content WHERE CAST(topic_assigned_at AS DATE) = DATE '2024-01-10' GROUP BY topic_id),
p AS (SELECT topic_id, string_agg(platform || '=' || n, ',' ORDER BY platform) AS platforms FROM (SELECT topic_id, platform, count(*) AS n FROM content WHERE topic_id IS NOT NULL GROUP BY ALL) GROUP BY topic_id),
s AS (SELECT t.topic_id, t.status, coalesce(d.n, 0) AS new_count, platforms FROM topics t LEFT JOIN d USING (topic_id) LEFT JOIN p ON p.topic_id = t.topic_id WHERE t.status <> 'merged')
SELECT topic_id, DATE '2024-01-10' AS snapshot_date, status, new_count, platforms FROM s UNION ALL SELECT topic_id, DATE '2024-01-09', 'stale', new_count, platforms FROM s WHERE topic_id % 2 = 0""")
def evolution_upsert(t: Tables) -> DataFrame:
    """A day's snapshot over an earlier one of the same day; rows of other days stay."""
    old = topics.evolution_snapshot(t.topics, t.content, "2024-01-10").filter("topic_id % 2 = 0").withColumn("status", L("stale"))
    old = old.unionByName(old.withColumn("snapshot_date", L("2024-01-09").cast("date")))
    out = topics.evolution_snapshot(t.topics, t.content, "2024-01-10", old)
    named = F.array_join(F.transform(F.map_entries("platforms"), lambda e: F.concat(e["key"], L("="), e["value"].cast("string"))), ",")
    return out.select("topic_id", "snapshot_date", "status", "new_count", named.alias("platforms"))


# ---- graph

#: Customers in their nations: a third of the segments in small letters, one reply in ten empty, one failed.
EXTRACTIONS = """a AS (SELECT c_custkey % 7 AS topic_id, c_custkey AS unified_id, CASE WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS head, n_name AS tail,
  CASE c_custkey % 10 WHEN 9 THEN 'failed' WHEN 8 THEN 'empty' ELSE 'completed' END AS status, 'k' || c_custkey % 4 AS kind FROM customer JOIN nation ON n_nationkey = c_nationkey),
x AS (SELECT * FROM a WHERE status = 'completed'), m AS (SELECT topic_id, unified_id, head AS spelled, '组织机构' AS type, kind FROM x UNION ALL SELECT topic_id, unified_id, tail, '地点', kind FROM x),
ent AS (SELECT topic_id, arg_min(spelled, unified_id) AS name, type, count(*) AS mentions, 'kind=' || arg_max(kind, unified_id) AS properties FROM m GROUP BY topic_id, lower(spelled), type),
rel AS (SELECT topic_id, arg_min(x.head, unified_id) AS head, '位于' AS relation, arg_min(x.tail, unified_id) AS tail, 0.9::DOUBLE AS confidence, count(*) AS sources FROM x GROUP BY topic_id, lower(x.head), lower(x.tail)),
nodes AS (SELECT name, type, CAST(sum(mentions) AS BIGINT) AS mentions FROM ent GROUP BY ALL),
edges AS (SELECT * FROM rel WHERE (topic_id, head) IN (SELECT (topic_id, name) FROM ent) AND (topic_id, tail) IN (SELECT (topic_id, name) FROM ent))"""


def mixed_extractions(t: Tables) -> DataFrame:
    """Extractions of which some are empty and some failed, with two spellings and a property of each entity."""
    c = t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    last = F.col("c_custkey") % 10
    head = F.when(F.col("c_custkey") % 3 == 1, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    triple = F.concat(L('[{"head":"'), head, L('","head_type":"组织机构","relation":"位于","tail":" '), F.col("n_name"), L('","tail_type":"地点"},{"head":"x","relation":""}]'))
    x = c.select((F.col("c_custkey") % 7).alias("topic_id"), F.col("c_custkey").alias("unified_id"), F.when(last == 8, "[]").when(last != 9, triple).alias("reply"))
    g = graph.triples_to_graph(x, "reply")
    own = F.create_map(L("kind"), F.concat(L("k"), (F.col("unified_id") % 4).cast("string")))
    entities = F.transform("entities", lambda e: e.withField("properties", own))
    answered = F.col("reply").isNotNull()
    return graph.extraction_status(g.withColumns({"entities": F.when(answered, entities), "relations": F.when(answered, F.col("relations"))}))


def _mixed_graph(t: Tables) -> dict[str, DataFrame]:
    e = mixed_extractions(t)
    return graph.graph_tables(graph.merge_entities(e), graph.merge_relations(e))


@query(f"WITH {EXTRACTIONS} SELECT topic_id, name, type, mentions, properties FROM ent")
def merged_spellings(t: Tables) -> DataFrame:
    """Entities of two spellings: the first is kept, and the last value of a property."""
    named = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], L("="), e["value"])), ",")
    return graph.merge_entities(mixed_extractions(t)).withColumn("properties", named)


@query(f"WITH {EXTRACTIONS} SELECT * FROM rel")
def merged_relations(t: Tables) -> DataFrame:
    return graph.merge_relations(mixed_extractions(t))


@query(f"""WITH {EXTRACTIONS} SELECT 'node' AS kind, NULL::BIGINT AS topic_id, name AS a, type AS b, mentions AS n FROM nodes UNION ALL SELECT 'belongs', topic_id, name, type, NULL FROM ent
UNION ALL SELECT 'edge', topic_id, head, tail, sources FROM edges""")
def graph_rows(t: Tables) -> DataFrame:
    """All nodes, the topics that they belong to, and all edges."""
    g = _mixed_graph(t)
    none = L(None).cast("long")
    nodes = g["nodes"].select(L("node").alias("kind"), none.alias("topic_id"), F.col("name").alias("a"), F.col("type").alias("b"), F.col("mentions").alias("n"))
    belongs = g["belongs"].select(L("belongs").alias("kind"), "topic_id", F.col("name").alias("a"), F.col("type").alias("b"), none.alias("n"))
    edges = g["edges"].select(L("edge").alias("kind"), "topic_id", F.col("head").alias("a"), F.col("tail").alias("b"), F.col("sources").alias("n"))
    return nodes.unionByName(belongs).unionByName(edges)


@query(f"""WITH {EXTRACTIONS}, own AS (SELECT n.*, row_number() OVER (PARTITION BY type ORDER BY mentions DESC, name) AS r, row_number() OVER (ORDER BY mentions DESC, name, type) AS q FROM nodes n WHERE (name, type) IN (SELECT (name, type) FROM ent WHERE topic_id = 3)),
e AS (SELECT *, row_number() OVER (ORDER BY sources DESC, confidence DESC, head, relation, tail) AS q FROM edges WHERE topic_id = 3)
SELECT 'entity type' AS part, type AS a, string_agg(name, ',' ORDER BY r) FILTER (r <= 5) AS b, count(*) AS n FROM own GROUP BY type
UNION ALL SELECT 'relation type', relation, NULL, count(*) FROM e GROUP BY relation
UNION ALL SELECT 'entity', name, type, mentions FROM own WHERE q <= 10
UNION ALL SELECT 'relation', head, tail, sources FROM e WHERE q <= 10""")
def graph_report_parts(t: Tables) -> DataFrame:
    """All four tables of a topic's report."""
    r = graph.topic_graph_report(_mixed_graph(t), 3)

    def part(name: str, of: str, a: str, b: str | None, n: str) -> DataFrame:
        return r[of].select(L(name).alias("part"), F.col(a).alias("a"), (F.col(b) if b else L(None).cast("string")).alias("b"), F.col(n).alias("n"))

    parts = [part("entity type", "entity_types", "type", "examples", "n"), part("relation type", "relation_types", "relation", None, "n"), part("entity", "entities", "name", "type", "mentions"), part("relation", "relations", "head", "tail", "sources")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {EXTRACTIONS} SELECT count(DISTINCT topic_id) AS topics, count(*) AS extractions, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'failed') AS failed,
  2 * count(*) FILTER (status = 'completed') AS entities, count(*) FILTER (status = 'completed') AS relations FROM a""")
def kg_stats_by_status(t: Tables) -> DataFrame:
    return graph.kg_stats(mixed_extractions(t))
