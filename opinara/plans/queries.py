"""The registered queries: each applies an operator to the driver's whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.functions import vectors as V
from opinara.operators import adapters, graph, hot, sentiment, tokens, topics, upsert
from opinara.plans import more_queries, payload_queries, product_queries, rule_queries
from opinara.plans.fixtures import NOW, Tables, rounded, with_sql
from opinara.sources import flatten, pages
from opinara.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
R = lambda c: f"round({c}, 6)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SENT = "count(*) FILTER (sentiment = '{}')"
HEAT = "CASE WHEN {0} >= 500 THEN 'critical' WHEN {0} >= 100 THEN 'high' WHEN {0} >= 20 THEN 'medium' ELSE 'low' END"
DOMINANT = "CASE WHEN pos + neu + neg > 0 AND greatest(pos, neu, neg) / (pos + neu + neg)::DOUBLE < 0.4 THEN 'mixed' WHEN pos >= neu AND pos >= neg THEN 'positive' WHEN neu >= neg THEN 'neutral' ELSE 'negative' END"
STATS = f"""stats AS (SELECT topic_id, count(*) AS content_count, avg(sentiment_score) AS mean_score, {SENT.format('positive')} AS pos, {SENT.format('neutral')} AS neu, {SENT.format('negative')} AS neg,
  CAST(sum(liked_count) AS BIGINT) AS likes, CAST(sum(comment_count) AS BIGINT) AS comments, CAST(sum(share_count) AS BIGINT) AS shares,
  min(original_created_at) AS first_at, max(original_created_at) AS last_at, CAST(sum(liked_count + comment_count + share_count) AS BIGINT) AS interaction
  FROM content WHERE topic_id IS NOT NULL GROUP BY topic_id)"""


@query(f"""{with_sql("content", "topics")},
g AS (SELECT topic_id, platform, count(*) AS content_count, avg(sentiment_score) AS mean_score, {SENT.format('positive')} AS pos, {SENT.format('neutral')} AS neu, {SENT.format('negative')} AS neg,
  CAST(sum(liked_count + comment_count + share_count) AS BIGINT) AS interaction FROM content JOIN (SELECT topic_id FROM topics WHERE status <> 'merged') USING (topic_id) GROUP BY ALL)
SELECT topic_id, platform, content_count, round(mean_score, 6) AS mean_score, pos, neu, neg, {DOMINANT} AS dominant, {HEAT.format('content_count * 5 + interaction * 0.01')} AS heat FROM g""")
def topic_platform_report(t: Tables) -> DataFrame:
    c = topics.with_interaction(t.content)
    s = topics.topic_sentiment(t.topics, c).withColumnsRenamed({"positive_count": "pos", "neutral_count": "neu", "negative_count": "neg"})
    i = c.groupBy("topic_id", "platform").agg(F.sum("interaction").alias("interaction"))
    return rounded(topics.heat_level(topics.dominant_sentiment(s.join(i, ["topic_id", "platform"]))).drop("interaction"), "mean_score")


@query(f"""{with_sql("content", "topics")}, {STATS}
SELECT t.topic_id, t.name, t.status, s.content_count, CAST(date_diff('day', CAST(s.first_at AS DATE), CAST(s.last_at AS DATE)) AS INTEGER) AS duration_days FROM topics t JOIN stats s USING (topic_id) WHERE t.status <> 'merged'""")
def topic_overview(t: Tables) -> DataFrame:
    s = topics.topic_content_stats(t.content).select("topic_id", "content_count", "first_at", "last_at")
    return topics.topic_overview(t.topics.drop("content_count").join(s, "topic_id")).select("topic_id", "name", "status", "content_count", "duration_days")


@query(f"""{with_sql("content", "comment")} SELECT c.topic_id, m.comment_id, m.platform, m.content_id FROM comment m JOIN content c ON c.platform = m.platform AND c.content_id = m.content_id WHERE c.topic_id IS NOT NULL""")
def topic_comments(t: Tables) -> DataFrame:
    return topics.topic_comments(t.topics, t.content, t.comment).select("topic_id", "comment_id", "platform", "content_id")


@query(f"""{with_sql("content")}, {STATS} SELECT topic_id, content_count, round(mean_score, 6) AS mean_score, pos, neu, neg, likes, comments, shares, interaction, first_at, last_at,
  {DOMINANT} AS dominant, {HEAT.format('content_count * 5 + interaction * 0.01')} AS heat, peak_at FROM stats JOIN (SELECT topic_id, arg_min(d, (-n, d)) AS peak_at FROM
  (SELECT topic_id, CAST(original_created_at AS DATE) AS d, count(*) AS n FROM content WHERE topic_id IS NOT NULL GROUP BY ALL) GROUP BY topic_id) USING (topic_id)""")
def topic_stats(t: Tables) -> DataFrame:
    return rounded(topics.heat_level(topics.dominant_sentiment(topics.topic_content_stats(t.content))), "mean_score")


@query(f"""{with_sql("content")} SELECT topic_id, string_agg(platform || '=' || n, ',' ORDER BY platform) AS platforms FROM (SELECT topic_id, platform, count(*) AS n FROM content WHERE topic_id IS NOT NULL GROUP BY ALL) GROUP BY topic_id""")
def platform_distribution(t: Tables) -> DataFrame:
    d = topics.platform_distribution(t.content)
    return d.select("topic_id", F.array_join(F.transform(F.map_entries("platforms"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("platforms"))


@query(f"""{with_sql("content")} SELECT platform, sentiment, count(*) AS n, round(avg(sentiment_score), 6) AS mean_score FROM content WHERE sentiment IS NOT NULL GROUP BY ALL""")
def sentiment_stats(t: Tables) -> DataFrame:
    return rounded(sentiment.sentiment_stats(t.content), "mean_score")


@query(f"""{with_sql("content", "processed")} SELECT count(*) AS total, count(sentiment) AS analyzed, count(*) - count(sentiment) AS unanalyzed FROM content JOIN processed ON unified_id = id WHERE status = 'completed' AND clean_content <> ''""")
def sentiment_progress(t: Tables) -> DataFrame:
    return sentiment.sentiment_progress(t.content, t.processed)


@query(f"""{with_sql("content", "processed")} SELECT id, content_id FROM content JOIN processed ON unified_id = id WHERE status = 'completed' AND clean_content <> '' AND sentiment IS NULL""")
def unanalyzed(t: Tables) -> DataFrame:
    return sentiment.unanalyzed(t.processed, t.content).select("id", "content_id")


@query(f"""{with_sql("content")} SELECT id, substr(CASE WHEN content <> '' THEN content ELSE title END, 1, 500) AS scoring FROM content""")
def scoring_text(t: Tables) -> DataFrame:
    return t.content.select("id", sentiment.scoring_text(F.col("content"), F.col("title")).alias("scoring"))


_SP = T.SPACE.replace(r"\t-\r", r"\t-\r")
_STEP_SQL = {
    "html": ("<[^>]+>", ""),
    "urls": (rf"https?://{T.NOT_URL}+|www\.{T.NOT_URL}+", ""),
    "emails": (rf"[{T.WORD}.+\-]+@[{T.WORD}\-]+\.[{T.WORD}.\-]+", ""),
    "mentions": (rf"@[{T.WORD}]+", ""),
    "hashtags": (rf"#([^#{T.SPACE}]+)#?", r"\1"),
    "emojis": (T.EMOJI, ""),
    "space": (rf"[{T.SPACE}]+", " "),
    "punct": (rf"[^{T.WORD}{T.SPACE}]", ""),
}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(c: str, name: str) -> str:
    pattern, to = _STEP_SQL[name]
    return f"regexp_replace({c}, {_lit(pattern)}, {_lit(to)}, 'g')"


@query("SELECT doc_id, " + ", ".join(f"md5({_re('text', n)}) AS {n}" for n in _STEP_SQL) + " FROM documents")
def clean_steps(t: Tables) -> DataFrame:
    c = F.col("text")
    steps = {"html": T.strip_html, "urls": T.strip_urls, "emails": T.strip_emails, "mentions": T.strip_mentions, "hashtags": T.hashtags, "emojis": T.strip_emojis, "space": T.collapse_space, "punct": T.strip_punct}
    return t.raw("documents").select("doc_id", *[F.md5(f(c)).alias(n) for n, f in steps.items()])


def _slang_sql(c: str) -> str:
    for k, v in T.slang_pairs():
        c = f"replace({c}, {_lit(k)}, {_lit(v)})"
    return c


@query(f"SELECT doc_id, md5({_slang_sql('text')}) AS slang FROM documents")
def normalize_slang(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(T.normalize_slang(F.col("text"))).alias("slang"))


def _clean_sql(c: str = "text", to: str = "md5({}) AS cleaned", source: str = "documents") -> str:
    for n in ("html", "urls", "emails", "mentions", "hashtags", "emojis"):
        c = _re(c, n)
    # repeats: runs by position over the characters, as the engine has no back-references
    return f"""WITH a AS (SELECT doc_id, {_slang_sql(c)} AS s FROM {source}),
u AS (SELECT doc_id, unnest(string_split(s, '')) AS ch, generate_subscripts(string_split(s, ''), 1) AS i FROM a WHERE s <> ''),
g AS (SELECT doc_id, ch, i, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ch, run ORDER BY i) AS n FROM g),
j AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS s FROM k WHERE n <= 3 OR ch = chr(10) GROUP BY doc_id)
SELECT a.doc_id, {to.format(f"""regexp_replace({_re("coalesce(j.s, '')", "space")}, {_lit(rf"^[{T.SPACE}]+|[{T.SPACE}]+$")}, '', 'g')""")} FROM a LEFT JOIN j USING (doc_id)"""


@query(_clean_sql())
def clean_text(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) AS body FROM pages""")
def page_text(t: Tables) -> DataFrame:
    return pages.pages_to_text(t.raw("pages")).select("page_id", F.md5("text").alias("body"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), ''), '') AS host, regexp_extract(url, '\?([^#]*)', 1) <> '' AS has_query FROM pages""")
def page_hosts(t: Tables) -> DataFrame:
    p = t.raw("pages")
    params = pages.url_params(p).withColumn("has_query", F.size("params") > 0)
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")).join(params.select("page_id", "has_query"), "page_id")


@query("""SELECT doc_id, 'https://www.bilibili.com/video/av' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'bili' END AS platform, CASE WHEN doc_id % 2 = 0 THEN 'av' || doc_id END AS content_id FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'https://example.org/' || doc_id, NULL, NULL FROM documents WHERE doc_id % 2 = 1""")
def url_entities(t: Tables) -> DataFrame:
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://www.bilibili.com/video/av"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")))
    return pages.url_entities(t.raw("documents").select("doc_id", url.alias("url"))).select("doc_id", "url", "platform", "content_id")


def raw_tables(t: Tables) -> dict[str, DataFrame]:
    """Content back in each platform's raw layout."""
    c = t.content
    out = {}
    for p in adapters.PLATFORMS:
        rules = adapters.CONTENT[p]
        cols = {rules[x] if x in rules else x: F.col(x).cast("string") for x in ("content_id", "title", "content", "liked_count", "comment_count", "share_count") if isinstance(rules.get(x, x), str)}
        own = c.filter(F.col("platform") == p).select(*[v.alias(k) for k, v in cols.items()], F.col("add_ts"), F.col("add_ts").alias(rules["time"]))
        out[p] = own
    return out


@query(f"""{with_sql("content")} SELECT content_id, platform, CASE WHEN platform = 'wb' THEN '' ELSE title END AS title, md5(content) AS body,
  CASE WHEN platform = 'tieba' THEN 0 ELSE liked_count END AS liked_count, CASE WHEN platform = 'ks' THEN 0 ELSE comment_count END AS comment_count,
  CASE WHEN platform IN ('ks', 'tieba', 'zhihu') THEN 0 ELSE share_count END AS share_count, add_ts, original_created_at,
  CASE platform WHEN 'xhs' THEN 'image' WHEN 'dy' THEN 'video' WHEN 'bili' THEN 'video' WHEN 'ks' THEN 'video' ELSE 'text' END AS media_type FROM content""")
def unify_content(t: Tables) -> DataFrame:
    u = adapters.unify(raw_tables(t))
    return u.select("content_id", "platform", "title", F.md5("content").alias("body"), "liked_count", "comment_count", "share_count", "add_ts", F.col("original_created_at").cast("timestamp_ntz").alias("original_created_at"), "media_type")


@query(f"""{with_sql("comment")} SELECT comment_id, content_id, platform, CASE WHEN platform = 'ks' THEN '' ELSE parent_comment_id END AS parent_comment_id, md5(content) AS body, CAST(0 AS BIGINT) AS liked_count FROM comment""")
def unify_comment(t: Tables) -> DataFrame:
    c = t.comment
    raw = {p: c.filter(F.col("platform") == p).select("comment_id", F.col("content_id").alias(adapters.COMMENT[p].get("content_id", "content_id")), "parent_comment_id", "content") for p in adapters.PLATFORMS}
    return adapters.unify(raw, "comment").select("comment_id", "content_id", "platform", "parent_comment_id", F.md5("content").alias("body"), "liked_count")


@query(f"""{with_sql("content")}, m AS (SELECT platform, max(add_ts) AS top FROM content WHERE id % 2 = 0 AND id % 30 < 15 GROUP BY platform)
SELECT id, c.platform, add_ts FROM content c LEFT JOIN m ON m.platform = c.platform WHERE add_ts > coalesce(top, 0)""")
def incremental_since(t: Tables) -> DataFrame:
    target = t.content.filter("id % 2 = 0 AND id % 30 < 15")
    return adapters.incremental_since(t.content.select("id", "platform", "add_ts"), target).select("id", "platform", "add_ts")


@query(f"""{with_sql("content", "comment")} SELECT 'content' AS kind, platform, count(*) AS n FROM content GROUP BY platform UNION ALL SELECT 'comment', platform, count(*) FROM comment GROUP BY platform""")
def sync_stats(t: Tables) -> DataFrame:
    return adapters.sync_stats(t.content, t.comment)


@query(f"""{with_sql("content")}, s AS (SELECT id + 100 AS id, liked_count + 1 AS liked_count, 'new' AS title FROM content)
SELECT coalesce(c.id, s.id) AS id, coalesce(s.liked_count, c.liked_count) AS liked_count, CASE WHEN c.id IS NOT NULL THEN c.title ELSE s.title END AS title FROM content c FULL JOIN s ON s.id = c.id""")
def upsert_partial(t: Tables) -> DataFrame:
    c = t.content.select("id", "liked_count", "title")
    s = c.select((F.col("id") + 100).alias("id"), (F.col("liked_count") + 1).alias("liked_count"), F.lit("new").alias("title"))
    return upsert.upsert(c, s, ["id"], ["liked_count"])


@query(f"""{with_sql("content")}, s AS (SELECT id % 500 AS id, max(liked_count) AS liked_count FROM content GROUP BY id % 500)
SELECT c.id, coalesce(s.liked_count, c.liked_count) AS liked_count FROM content c LEFT JOIN s ON s.id = c.id UNION ALL SELECT id, liked_count FROM s WHERE id NOT IN (SELECT id FROM content)""")
def upsert_latest(t: Tables) -> DataFrame:
    c = t.content.select("id", "liked_count")
    return upsert.upsert(c, c.select((F.col("id") % 500).alias("id"), "liked_count"), ["id"], order=[F.col("liked_count")])


@query(f"""{with_sql("content")} SELECT platform, count(*) AS n, CAST(sum(liked_count) AS BIGINT) AS likes FROM (SELECT platform, liked_count FROM content WHERE platform NOT IN ('wb', 'ks') UNION ALL SELECT platform, liked_count + 5 FROM content WHERE platform IN ('wb', 'ks')) GROUP BY platform""")
def full_resync(t: Tables) -> DataFrame:
    c = t.content.select("id", "platform", "liked_count")
    return upsert.full_resync(c, c.withColumn("liked_count", F.col("liked_count") + 5), ["wb", "ks"]).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.sum("liked_count").alias("likes"))


@query(f"""{with_sql("content")} SELECT id FROM content WHERE original_created_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY""")
def retention(t: Tables) -> DataFrame:
    return upsert.drop_older_than(t.content, "original_created_at", 10, NOW).select("id")


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n, md5(array_to_string({_TOK}, ' ')) AS words FROM documents")
def token_table(t: Tables) -> DataFrame:
    return tokens.tokenize(t.raw("documents"), "text").select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("words"))


_AZ = "abcdefghijklmnopqrstuvwxyz"
#: A Han character for each letter: texts of the driver's tables as runs without spaces.
_HAN = "".join(chr(0x4E00 + i) for i in range(len(_AZ)))


@query(f"""WITH RECURSIVE w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS x FROM documents),
d AS MATERIALIZED (SELECT translate(x, '{_AZ}', '{_HAN}') AS word FROM w WHERE length(x) > 1 GROUP BY x ORDER BY count(*) DESC, x LIMIT 100000), s AS (SELECT DISTINCT length(word) AS m FROM d),
r AS MATERIALIZED (SELECT conv_id, turn, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', '', 'g'), '{_AZ}', '{_HAN}') AS run FROM conversations),
p AS MATERIALIZED (SELECT conv_id, turn, run, unnest(range(1, length(run) + 1)) AS i FROM r),
h AS MATERIALIZED (SELECT conv_id, turn, i, m, word FROM p JOIN s ON i + m <= length(run) + 1 JOIN d ON word = substr(run, i, m)),
b AS MATERIALIZED (SELECT conv_id, turn, i, coalesce(max(m), 1) AS n, coalesce(arg_max(word, m), any_value(substr(run, i, 1))) AS word FROM p LEFT JOIN h USING (conv_id, turn, i) GROUP BY conv_id, turn, i),
k AS (SELECT * FROM b WHERE i = 1 UNION ALL SELECT b.* FROM k JOIN b ON b.conv_id = k.conv_id AND b.turn = k.turn AND b.i = k.i + k.n),
e AS MATERIALIZED (SELECT * FROM k), g AS (SELECT conv_id, turn, i, n AS m, i AS j, word FROM e UNION ALL SELECT conv_id, turn, e.i, h.m, h.i, h.word FROM e JOIN h USING (conv_id, turn) WHERE h.m < e.n AND h.i >= e.i AND h.i + h.m <= e.i + e.n),
x AS (SELECT conv_id, turn, count(*) AS n, md5(string_agg(word, ' ' ORDER BY i)) AS words FROM e GROUP BY ALL), y AS (SELECT conv_id, turn, count(*) AS n_search, md5(string_agg(word, ' ' ORDER BY i, m, j)) AS search_words FROM g GROUP BY ALL)
SELECT conv_id, turn, coalesce(n, 0) AS n, coalesce(words, md5('')) AS words, coalesce(n_search, 0) AS n_search, coalesce(search_words, md5('')) AS search_words FROM r LEFT JOIN x USING (conv_id, turn) LEFT JOIN y USING (conv_id, turn)""")
def dictionary_tokens(t: Tables) -> DataFrame:
    """Turns without spaces, cut by the 100,000 commonest words of all documents, by longest match and in search mode."""
    han = lambda c: F.translate(c, _AZ, _HAN)
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))).alias("x")
    counts = t.raw("documents").select(word).filter("length(x) > 1").groupBy("x").count()
    words = counts.orderBy(F.desc("count"), "x").limit(100_000).select(han(F.col("x")).alias("word"))
    runs = t.raw("conversations").select("conv_id", "turn", han(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", "")).alias("run"))
    d = tokens.tokenize(tokens.tokenize(runs, "run", words), "run", words, "search", "found")
    each = lambda c: (F.size(c).cast("long"), F.md5(F.array_join(c, " ")))
    (n, a), (m, b) = each("tokens"), each("found")
    return d.select("conv_id", "turn", n.alias("n"), a.alias("words"), m.alias("n_search"), b.alias("search_words"))


@query(f"""WITH w AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents), s AS (SELECT doc_id, count(*) AS size FROM w GROUP BY doc_id),
f AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT word, ln((SELECT count(*) FROM documents) / count(*)::DOUBLE) AS idf FROM f GROUP BY word),
x AS (SELECT f.doc_id, f.word, round(n / size::DOUBLE * idf, 6) AS weight FROM f JOIN d USING (word) JOIN s ON s.doc_id = f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS rank FROM x)
SELECT doc_id, word, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def keywords_tfidf(t: Tables) -> DataFrame:
    d = tokens.tokenize(t.raw("documents"), "text").select("doc_id", "tokens")
    return tokens.keywords(d, "tfidf", 10, id_col="doc_id").select("doc_id", "word", "weight", "rank")


def _textrank_sql(iters: int) -> str:
    turns = "".join(
        f"""r{i + 1} AS MATERIALIZED (SELECT e.id, e.word, 0.15::DOUBLE + 0.85::DOUBLE * sum(share * weight) AS weight FROM e JOIN r{i} r ON r.id = e.id AND r.word = e.other GROUP BY e.id, e.word),
""" for i in range(iters))
    return f"""WITH l AS (SELECT conv_id * 1000 + turn AS id, {_TOK} AS words FROM conversations), t AS MATERIALIZED (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM l),
p AS (SELECT a.id, a.word, b.word AS other FROM t a JOIN t b ON a.id = b.id AND a.i - b.i BETWEEN 1 AND 4 WHERE a.word <> b.word), b AS (SELECT * FROM p UNION ALL SELECT id, other, word FROM p),
g AS (SELECT id, word, other, count(*) AS w FROM b GROUP BY ALL), e AS MATERIALIZED (SELECT id, word, other, w / sum(w) OVER (PARTITION BY id, other)::DOUBLE AS share FROM g),
r0 AS (SELECT DISTINCT id, word, 1.0::DOUBLE AS weight FROM e),
{turns}k AS (SELECT id, word, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY id ORDER BY round(weight, 6) DESC, word) AS INTEGER) AS rank FROM r{iters})
SELECT * FROM k WHERE rank <= 5"""


@query(_textrank_sql(5))
def keywords_textrank(t: Tables) -> DataFrame:
    d = tokens.tokenize(t.raw("conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "text").select("id", "tokens")
    return rounded(tokens.keywords(d, "textrank", 5, iters=5), "weight")


@query(f"WITH w AS (SELECT unnest({_TOK}) AS word FROM conversations) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20")
def word_freq(t: Tables) -> DataFrame:
    return tokens.word_freq(t.raw("conversations"))


@query(f"""{with_sql("content", "processed")} SELECT id FROM content WHERE id NOT IN (SELECT unified_id FROM processed)""")
def unprocessed(t: Tables) -> DataFrame:
    return tokens.unprocessed(t.content, t.processed).select("id")


@query(f"""{with_sql("content", "processed")} SELECT count(*) AS total, count(status) AS processed, count(*) - count(status) AS unprocessed, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS error FROM content LEFT JOIN processed ON unified_id = id""")
def process_stats(t: Tables) -> DataFrame:
    return tokens.process_stats(t.content, t.processed)


def _process_sql(source: str, title: str | None, k: int) -> str:
    stop = "[" + ", ".join(_lit(w) for w in tokens.STOPWORDS) + "]"

    def words(c: str) -> str:
        for n in ("html", "urls", "space"):
            c = _re(c, n)
        return rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({stop}, x))"

    body = "coalesce(text, '')"
    return f"""WITH cleaned AS ({_clean_sql(body, "md5({0}) AS clean_content, CAST(length({0}) AS INTEGER) AS char_count", source)}),
w AS MATERIALIZED (SELECT doc_id, text IS NULL AS none, {words(body)} AS words, {words(title) if title else "CAST([] AS VARCHAR[])"} AS titles FROM {source}),
t AS (SELECT doc_id, unnest(list_concat(titles, words)) AS word FROM w), z AS (SELECT doc_id, count(*) AS size FROM t GROUP BY doc_id), f AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL),
d AS (SELECT word, ln((SELECT count(*) FROM w) / count(*)::DOUBLE) AS idf FROM f GROUP BY word), x AS (SELECT f.doc_id, f.word, round(n / size::DOUBLE * idf, 6) AS weight FROM f JOIN d USING (word) JOIN z ON z.doc_id = f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS rank FROM x), k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY rank) AS keywords FROM r WHERE rank <= {k} GROUP BY doc_id)
SELECT doc_id AS id, CASE WHEN none THEN 'error' ELSE 'completed' END AS status, clean_content, char_count, md5(array_to_string(words, ' ')) AS words, CAST(len(words) AS INTEGER) AS word_count, coalesce(keywords, '') AS keywords FROM w JOIN cleaned USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _process_columns(df: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, " ")
    return df.select("id", "status", F.md5("clean_content").alias("clean_content"), "char_count", F.md5(joined("content_tokens")).alias("words"), "word_count", joined("keywords").alias("keywords"))


@query(_process_sql("documents", "split_part(coalesce(text, ''), chr(10), 1)", 10))
def process_contents(t: Tables) -> DataFrame:
    # as in the SQL, the documents alone: the content table's other columns cost joins that carry the texts
    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"))
    return _process_columns(tokens.process_contents(d))


@query(_process_sql("(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)", None, 5))
def process_comments(t: Tables) -> DataFrame:
    c = t.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    return _process_columns(tokens.process_comments(c))


def _tags_sql() -> str:
    hits = ", ".join(f"CASE WHEN {' OR '.join(f'contains(x, {_lit(w)})' for w in words)} THEN '{tag}' END" for tag, words in sentiment.LEXICON.items())
    return f"""{with_sql("content")}, l AS (SELECT id, sentiment, lower(content) AS x FROM content), h AS (SELECT id, sentiment, list_filter([{hits}], lambda v: v IS NOT NULL)[1:3] AS tags FROM l)
SELECT id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') WHEN sentiment = 'positive' THEN '喜悦' WHEN sentiment = 'negative' THEN '失望' ELSE '平静' END AS tags FROM h"""


@query(_tags_sql())
def emotion_tags(t: Tables) -> DataFrame:
    return t.content.select("id", F.array_join(sentiment.emotion_tags(F.col("content"), F.col("sentiment")), ",").alias("tags"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'positive' WHEN doc_id % 3 = 1 THEN 'neutral' ELSE 'neutral' END AS sentiment,
 CASE WHEN doc_id % 3 = 2 THEN 0.0 ELSE least(1.0, (doc_id % 40) / 20.0) END::DOUBLE AS sentiment_score, CASE WHEN doc_id % 3 = 0 THEN '喜悦' ELSE '平静' END AS tags FROM documents""")
def parse_reply(t: Tables) -> DataFrame:
    d = t.raw("documents")
    label = F.when(F.col("doc_id") % 3 == 0, "positive").otherwise("great")
    body = F.concat(F.lit('reply ```{"sentiment":"'), label, F.lit('","sentiment_score":'), ((F.col("doc_id") % 40) / 20.0).cast("string"), F.lit(',"emotion_tags":["'), F.when(F.col("doc_id") % 3 == 0, "喜悦").otherwise("x"), F.lit('"]}```'))
    r = d.select("doc_id", F.when(F.col("doc_id") % 3 == 2, "no json").otherwise(body).alias("reply"))
    return sentiment.parse_sentiment_reply(r, "reply").select("doc_id", "sentiment", "sentiment_score", F.array_join("emotion_tags", ",").alias("tags"))


@query("""WITH u AS (SELECT doc_id, quality, CAST('0x' || substr(md5(doc_id || ':7'), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u FROM labels)
SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'negative' ELSE 'positive' END AS sentiment, round(CASE WHEN quality = 0 THEN -(0.5 + 0.4 * u) ELSE 0.5 + 0.4 * u END, 6) AS sentiment_score FROM u""")
def weak_label(t: Tables) -> DataFrame:
    d = t.raw("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return rounded(sentiment.weak_label(d, 7), "sentiment_score").select("id", "sentiment", "sentiment_score")


@query("""WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT id, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_dataset(t: Tables) -> DataFrame:
    return sentiment.split_dataset(t.raw("documents").select(F.col("doc_id").alias("id"))).select("id", "split")


def _guesses(t: Tables) -> DataFrame:
    return t.content.filter("sentiment IS NOT NULL").select("id", F.col("sentiment").alias("label"), F.when(F.col("id") % 4 == 0, "neutral").otherwise(F.col("sentiment")).alias("prediction"))


_GUESS = f"""{with_sql("content")}, g AS (SELECT sentiment AS truth, CASE WHEN id % 4 = 0 THEN 'neutral' ELSE sentiment END AS guess FROM content WHERE sentiment IS NOT NULL),
l AS (SELECT unnest(['negative', 'neutral', 'positive']) AS x), c AS (SELECT a.x AS truth, b.x AS guess, (SELECT count(*) FROM g WHERE g.truth = a.x AND g.guess = b.x) AS n FROM l a CROSS JOIN l b)"""


@query(f"{_GUESS} SELECT truth, guess, n FROM c")
def confusion(t: Tables) -> DataFrame:
    return sentiment.confusion(_guesses(t), list(sentiment.LABELS))


@query(f"""{_GUESS}, k AS (SELECT x AS class, CAST((SELECT sum(n) FROM c WHERE truth = x) AS BIGINT) AS support, (SELECT sum(n) FROM c WHERE guess = x) AS guessed, (SELECT n FROM c WHERE truth = x AND guess = x) AS tp FROM l),
m AS (SELECT class, support, tp, guessed, coalesce(tp / nullif(guessed, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r FROM k), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f WHERE support > 0 OR guessed > 0
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support)::DOUBLE, 6), round(sum(tp) / sum(support)::DOUBLE, 6), round(sum(tp) / sum(support)::DOUBLE, 6), CAST(sum(support) AS BIGINT) FROM f""")
def class_metrics(t: Tables) -> DataFrame:
    return rounded(sentiment.class_metrics(_guesses(t), list(sentiment.LABELS)), "precision", "recall", "f1")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"""WITH n AS (SELECT vec_id, {_NORM} AS n, embedding AS e FROM embeddings), c AS (SELECT vec_id, n, unnest(e)::DOUBLE AS x, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS i FROM n)
SELECT vec_id, round(n, 6) AS norm, i, CASE WHEN abs(x / greatest(n, 1e-12)) < 5e-7 THEN 0 ELSE round(x / greatest(n, 1e-12), 6) END AS x FROM c""")
def l2_norm(t: Tables) -> DataFrame:
    e = t.raw("embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.posexplode(V.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return e.withColumn("x", F.when(F.abs("x") < 5e-7, 0.0).otherwise(F.round("x", 6)))


_CENTROIDS = """e AS (SELECT CAST(label AS BIGINT) AS topic_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT topic_id, i, avg(x) AS x FROM e GROUP BY ALL), z AS (SELECT topic_id, sqrt(sum(x * x)) AS z FROM m GROUP BY topic_id), cen AS (SELECT topic_id, i, x / z AS x FROM m JOIN z USING (topic_id))"""


def centroids(t: Tables) -> DataFrame:
    return V.mean_vectors(t.raw("embeddings").select(F.col("label").cast("long").alias("topic_id"), "embedding"), "topic_id", "embedding")


@query(f"WITH {_CENTROIDS} SELECT topic_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM cen")
def topic_centroids(t: Tables) -> DataFrame:
    return centroids(t).select("topic_id", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {_CENTROIDS}, v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT vec_id, topic_id, sum(v.x * cen.x) AS s FROM v JOIN cen USING (i) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic_id) AS rank FROM s)
SELECT vec_id, topic_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def nearest_topics(t: Tables) -> DataFrame:
    items = t.raw("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rounded(V.nearest(items, centroids(t), 3, "vec_id"), "similarity")


@query(f"WITH {_CENTROIDS} SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, round(sum(a.x * b.x), 6) AS similarity FROM cen a JOIN cen b ON a.i = b.i AND a.topic_id < b.topic_id GROUP BY ALL HAVING sum(a.x * b.x) >= -2")
def topic_pairs(t: Tables) -> DataFrame:
    return rounded(topics.topic_pairs(centroids(t), -2.0), "similarity")


@query(f"""WITH RECURSIVE {_CENTROIDS}, n AS (SELECT CAST(label AS BIGINT) AS topic_id, count(*) AS n FROM embeddings GROUP BY label),
s AS (SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, sum(a.x * b.x) AS similarity FROM cen a JOIN cen b ON a.i = b.i AND a.topic_id < b.topic_id GROUP BY ALL HAVING sum(a.x * b.x) >= 0.05),
p AS (SELECT row_number() OVER (ORDER BY similarity DESC, topic_a, topic_b) AS r, similarity, CASE WHEN x.n >= y.n THEN topic_b ELSE topic_a END AS source, CASE WHEN x.n >= y.n THEN topic_a ELSE topic_b END AS target
  FROM s JOIN n x ON x.topic_id = topic_a JOIN n y ON y.topic_id = topic_b),
g AS (SELECT 0::BIGINT AS r, CAST([] AS BIGINT[]) AS gone, NULL::BIGINT AS source, NULL::BIGINT AS target, NULL::DOUBLE AS similarity, false AS taken
  UNION ALL SELECT p.r, CASE WHEN list_contains(gone, p.source) OR list_contains(gone, p.target) THEN gone ELSE list_append(gone, p.source) END, p.source, p.target, p.similarity, NOT list_contains(gone, p.source) AND NOT list_contains(gone, p.target) FROM g JOIN p ON p.r = g.r + 1)
SELECT source, target, round(similarity, 6) AS similarity FROM g WHERE taken""")
def merge_topics(t: Tables) -> DataFrame:
    return rounded(topics.merge_topics(t.topics, topics.topic_pairs(centroids(t), 0.0), 0.05), "similarity")


@query(f"""{with_sql("content")} SELECT id, CASE topic_id WHEN 9 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 2 ELSE topic_id END AS topic_id FROM content""")
def reassign_merged(t: Tables) -> DataFrame:
    # 9 into 5 into 1, and 7 into 2
    m = t.topics.filter("topic_id IN (9, 5, 7)").select(F.col("topic_id").alias("source"), F.when(F.col("topic_id") == 9, 5).when(F.col("topic_id") == 5, 1).otherwise(2).cast("long").alias("target"))
    return topics.reassign_merged(t.content.select("id", "topic_id"), m)


LEADERS_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS MATERIALIZED (SELECT a.i, b.i AS j, list_dot_product(a.c, b.c) AS sim FROM v a JOIN v b ON a.i <> b.i),
b AS MATERIALIZED (SELECT v.i, coalesce(list(j) FILTER (j < v.i AND sim >= 0.3), []) AS before FROM v LEFT JOIN s ON s.i = v.i GROUP BY 1),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS found UNION ALL SELECT b.i, CASE WHEN list_has_any(found, before) THEN found ELSE list_append(found, b.i) END FROM w JOIN b ON b.i = w.i + 1),
l AS MATERIALIZED (SELECT unnest(found) AS j, generate_subscripts(found, 1) AS topic_id FROM w WHERE i = (SELECT max(i) FROM v)),
n AS (SELECT s.i, arg_min(topic_id, (-sim, topic_id)) AS topic_id, max(sim) AS similarity FROM s JOIN l USING (j) WHERE s.i NOT IN (SELECT j FROM l) GROUP BY 1)
SELECT id, topic_id, round(similarity, 6) AS similarity FROM v JOIN (SELECT * FROM n UNION ALL SELECT j, topic_id, 1.0 FROM l) x USING (i)"""


@query(LEADERS_SQL)
def cluster_incremental(t: Tables) -> DataFrame:
    items = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    empty = t.spark.createDataFrame([], "topic_id long, n long, centroid array<double>")
    return rounded(topics.cluster_incremental(items, empty, 0.30)[0], "similarity")


@query(f"SELECT doc_id AS id, topic_id FROM documents LEFT JOIN ({LEADERS_SQL}) c ON c.id = doc_id")
def recluster(t: Tables) -> DataFrame:
    content = t.content.select("id", F.lit(7).cast("long").alias("topic_id"), "topic_similarity", "topic_assigned_at")
    items = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return topics.recluster(content, items, 0.30)[0].select("id", "topic_id")


EMBED_SQL = """WITH w AS (SELECT doc_id, md5(unnest(string_split(text, ' '))) AS h FROM documents), c AS (SELECT doc_id, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % 64 AS slot, sum(CASE WHEN substr(h, 9, 1) >= '8' THEN -1 ELSE 1 END) AS n FROM w GROUP BY 1, 2),
z AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM c GROUP BY 1)
SELECT d.doc_id, CAST(s.slot AS INTEGER) AS slot, round(coalesce(n, 0) / greatest(coalesce(size, 0), 1e-12), 6) AS value FROM documents d CROSS JOIN range(64) s(slot) LEFT JOIN c ON c.doc_id = d.doc_id AND c.slot = s.slot LEFT JOIN z ON z.doc_id = d.doc_id"""


@query(EMBED_SQL)
def embed(t: Tables) -> DataFrame:
    words = t.raw("documents").select("doc_id", F.split("text", " ").alias("tokens"))
    return topics.embed(words).select("doc_id", F.posexplode("vector").alias("slot", "value")).withColumn("value", F.round("value", 6))


@query()
def sentiment_classifier(t: Tables) -> DataFrame:
    d = t.raw("documents").join(t.raw("labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    # fitted on two of three rows, predicted on the others
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = sentiment.fit_sentiment(d.filter(~held), features=1 << 14)
    return sentiment.predict_sentiment(model, d.filter(held)).select("doc_id", "label", "prediction")


@query(f"""{with_sql("content", "topics")}, {STATS} SELECT t.topic_id, CASE WHEN s.last_at IS NULL THEN t.status WHEN t.status = 'emerging' AND s.content_count >= 10 THEN 'active'
  WHEN t.status IN ('emerging', 'active') AND epoch(TIMESTAMP '2024-02-20' - s.last_at) >= 7 * 86400 THEN 'declining' WHEN t.status = 'declining' AND epoch(TIMESTAMP '2024-02-20' - s.last_at) >= 30 * 86400 THEN 'ended' ELSE t.status END AS status
  FROM topics t LEFT JOIN stats s USING (topic_id)""")
def lifecycle(t: Tables) -> DataFrame:
    return topics.update_lifecycle(t.topics, topics.topic_content_stats(t.content), datetime(2024, 2, 20)).select("topic_id", "status")


@query(f"""{with_sql("content")} SELECT topic_id, CAST(topic_assigned_at AS DATE) AS day, count(*) AS new_count, round(avg(sentiment_score), 6) AS mean_score, CAST(sum(liked_count + comment_count + share_count) AS BIGINT) AS interaction,
  round(CAST(count(*) * 10 + sum(liked_count + comment_count + share_count) * 0.01 AS DOUBLE), 6) AS hot_score FROM content WHERE topic_id IS NOT NULL GROUP BY ALL""")
def daily_heat(t: Tables) -> DataFrame:
    return rounded(topics.hot_score(topics.daily_stats(t.content)), "mean_score", "hot_score")


@query(f"""{with_sql("content", "topics")}, {STATS}, d AS (SELECT topic_id, count(*) AS new_count, avg(sentiment_score) AS mean_score, sum(liked_count + comment_count + share_count) AS interaction FROM content WHERE CAST(topic_assigned_at AS DATE) = DATE '2024-01-10' GROUP BY topic_id)
SELECT t.topic_id, t.status, s.pos, s.neu, s.neg, coalesce(d.new_count, 0) AS new_count, CAST(coalesce(d.interaction, 0) AS BIGINT) AS interaction, round(nullif(d.mean_score, 0), 6) AS mean_score FROM topics t LEFT JOIN stats s USING (topic_id) LEFT JOIN d ON d.topic_id = t.topic_id WHERE t.status <> 'merged'""")
def evolution(t: Tables) -> DataFrame:
    return rounded(topics.evolution_snapshot(t.topics, t.content, "2024-01-10"), "mean_score").select("topic_id", "status", "pos", "neu", "neg", "new_count", "interaction", "mean_score")


@query(f"""{with_sql("content")}, r AS (SELECT topic_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY topic_similarity DESC, id) AS r FROM content WHERE topic_id IS NOT NULL) SELECT topic_id, id, CAST(r AS INTEGER) AS r FROM r WHERE r <= 10""")
def representatives(t: Tables) -> DataFrame:
    return topics.representatives(t.content, 10).select("topic_id", "id", "r")


@query(f"""{with_sql("content")}, r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY topic_similarity DESC, id) AS r FROM content WHERE topic_id IS NOT NULL)
SELECT topic_id, md5(string_agg(r || '. [' || platform || '] ' || CASE WHEN sentiment IS NOT NULL THEN '[情感:' || sentiment || '] ' ELSE '' END || title || chr(10) || substr(content, 1, 200), chr(10) ORDER BY r)) AS prompt FROM r WHERE r <= 10 GROUP BY topic_id""")
def topic_prompts(t: Tables) -> DataFrame:
    return topics.topic_prompts(topics.representatives(t.content, 10)).select("topic_id", F.md5("prompt").alias("prompt"))


@query(f"""{with_sql("content")}, r AS (SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY topic_similarity DESC, id) AS r, list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) AS words FROM content WHERE topic_id IS NOT NULL),
w AS (SELECT topic_id, unnest(words) AS word, 1.0::DOUBLE AS weight FROM r WHERE r <= 200 UNION ALL SELECT CAST(label AS BIGINT), 'the', 5 * 0.9::DOUBLE FROM (SELECT DISTINCT label FROM embeddings)),
s AS (SELECT topic_id, word, round(sum(weight), 4) AS weight FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, word) AS rank FROM s)
SELECT topic_id, word, weight, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 100""")
def wordcloud(t: Tables) -> DataFrame:
    p = t.content.select(F.col("id").alias("unified_id"), F.array_distinct(tokens.latin_tokens(F.col("title"))).alias("keywords"))
    own = t.topics.withColumn("keywords", F.array(F.struct(F.lit("the").alias("word"), F.lit(0.9).alias("weight"))))
    return topics.wordcloud(t.content, p, own)


@query(f"""{with_sql("topics")} SELECT status, count(*) AS n FROM topics GROUP BY status""")
def topic_status_counts(t: Tables) -> DataFrame:
    return topics.topic_status_counts(t.topics).select("status", "n")


@query(f"""{with_sql("topics")} SELECT count(*) AS topics, CAST(sum(content_count) AS BIGINT) AS contents, round(avg(content_count), 6) AS mean_size, max(content_count) AS max_size FROM topics WHERE status <> 'merged'""")
def topic_totals(t: Tables) -> DataFrame:
    return rounded(topics.topic_totals(t.topics), "mean_size")


@query(f"""{with_sql("topics")} SELECT topic_id, name FROM topics WHERE starts_with(name, '话题-') OR contains(name, '/')""")
def unnamed_topics(t: Tables) -> DataFrame:
    return topics.unnamed_topics(t.topics).select("topic_id", "name")


@query(f"""{with_sql("hot")}, r AS (SELECT *, row_number() OVER (PARTITION BY platform_code ORDER BY rank) AS r FROM hot) SELECT page_id, md5(platform_code || ':' || title || ':' || url) AS news_id, CASE WHEN description = '' THEN title ELSE description END AS description FROM r WHERE r <= 20""")
def hot_items(t: Tables) -> DataFrame:
    return hot.normalize_hot(t.hot, 20).select("page_id", "news_id", "description")


def _news(t: Tables) -> DataFrame:
    return hot.normalize_hot(t.hot).withColumn("fetched_at", F.col("page_id"))


def _analysis(t: Tables) -> DataFrame:
    return _news(t).filter("page_id % 3 = 0").select("news_id", (F.col("page_id") % 5).alias("domain_id"), (F.col("page_id") % 2 == 0).alias("is_match"), ((F.col("page_id") % 10) / 10.0).alias("confidence"))


_NEWS = f"""{with_sql("hot")}, news AS (SELECT *, md5(platform_code || ':' || title || ':' || url) AS news_id FROM hot), ana AS (SELECT news_id, page_id % 5 AS domain_id, page_id % 2 = 0 AS is_match, (page_id % 10) / 10.0::DOUBLE AS confidence FROM news WHERE page_id % 3 = 0)"""


@query(f"{_NEWS} SELECT page_id FROM news WHERE news_id NOT IN (SELECT news_id FROM ana WHERE domain_id = 1)")
def unanalyzed_hot(t: Tables) -> DataFrame:
    return hot.unanalyzed_hot(_news(t), _analysis(t), 1).select("page_id")


@query(f"{_NEWS} SELECT page_id, confidence FROM news JOIN ana USING (news_id) WHERE domain_id = 2 AND is_match")
def matched_news(t: Tables) -> DataFrame:
    return hot.matched_news(_news(t), _analysis(t), 2).select("page_id", "confidence")


def _domains(t: Tables) -> DataFrame:
    words = ["the,and", "la,les,des", "der,und", "el,los", "a,of,in"]
    return t.topics.filter("topic_id < 5").select(F.col("topic_id").alias("domain_id"), F.concat(F.lit("d"), F.col("topic_id").cast("string")).alias("domain_name"), F.element_at(F.array(*map(F.lit, words)), (F.col("topic_id") + 1).cast("int")).alias("domain_keywords"))


@query(f"""{with_sql("hot")}, d AS (SELECT * FROM (VALUES (0, ['the', 'and']), (1, ['la', 'les', 'des']), (2, ['der', 'und']), (3, ['el', 'los']), (4, ['a', 'of', 'in'])) v(domain_id, words) WHERE domain_id IN (SELECT label FROM embeddings)),
x AS (SELECT page_id, CAST(domain_id AS BIGINT) AS domain_id, CAST(len(list_filter(words, lambda w: contains(lower(title), w))) AS INTEGER) AS hits, len(words) AS n FROM hot CROSS JOIN d)
SELECT page_id, domain_id, hits, round(hits / n::DOUBLE, 6) AS confidence, CASE WHEN hits / n::DOUBLE >= 0.7 THEN 'high' WHEN hits / n::DOUBLE >= 0.4 THEN 'medium' WHEN hits > 0 THEN 'low' ELSE 'none' END AS level FROM x""")
def domain_match(t: Tables) -> DataFrame:
    m = hot.domain_match(hot.news_domain_pairs(t.hot, _domains(t)))
    return rounded(m, "confidence").select("page_id", "domain_id", "hits", "confidence", "level")


@query("""WITH k AS (SELECT doc_id AS keyword_id, 'k' || doc_id % 97 AS keyword, (doc_id % 10) / 10.0::DOUBLE AS confidence FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY confidence DESC, keyword_id) AS r FROM k) SELECT keyword_id, keyword, confidence FROM r WHERE r = 1""")
def dedupe_keywords(t: Tables) -> DataFrame:
    return hot.dedupe_keywords(t.raw("documents").select(F.col("doc_id").alias("keyword_id"), F.concat(F.lit("k"), (F.col("doc_id") % 97).cast("string")).alias("keyword"), ((F.col("doc_id") % 10) / 10.0).alias("confidence")))


@query("""SELECT p.p_partkey AS keyword_id, p.p_size + coalesce(u.n, 0) AS search_count, greatest(u.d, CASE WHEN p_partkey % 3 = 0 THEN DATE '1997-01-01' END) AS last_used_at
FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY l_partkey) u ON u.l_partkey = p.p_partkey""")
def bump_usage(t: Tables) -> DataFrame:
    k = t.raw("part").select(F.col("p_partkey").alias("keyword_id"), F.col("p_size").cast("long").alias("search_count"), F.when(F.col("p_partkey") % 3 == 0, F.lit("1997-01-01").cast("date")).alias("last_used_at"))
    u = t.raw("lineitem").select(F.col("l_partkey").alias("keyword_id"), F.to_date("l_shipdate").alias("used_at"))
    return hot.bump_usage(k, u)


@query("""WITH e AS (SELECT user_id, user_id % 13 AS other, event_type FROM events) SELECT DISTINCT up_id, fan_id FROM (SELECT user_id AS up_id, other AS fan_id FROM e WHERE event_type = 'view' UNION ALL SELECT other, user_id FROM e WHERE event_type = 'click')""")
def contact_edges(t: Tables) -> DataFrame:
    e = t.raw("events").withColumn("other", F.col("user_id") % 13)
    fans = e.filter("event_type = 'view'").select(F.col("user_id").alias("creator_id"), F.col("other").alias("fan_id"))
    return flatten.contact_edges(fans, e.filter("event_type = 'click'").select(F.col("user_id").alias("creator_id"), F.col("other").alias("up_id")))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r <= 5")
def cap_per_key(t: Tables) -> DataFrame:
    return flatten.cap_per_key(t.raw("events"), ["user_id", "event_type"], ["event_id"], 5).select("event_id")


@query("""WITH a AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS r FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day, event_id) AS q FROM a WHERE r <= 10) SELECT event_id FROM b WHERE q <= 100""")
def quota(t: Tables) -> DataFrame:
    e = t.raw("events").withColumn("day", F.to_date("ts"))
    return flatten.cap_per_day_then_total(e, 10, 100, "event_type", "day", "event_id").select("event_id")


def extractions(t: Tables) -> DataFrame:
    """Customers in their nations as typed entities and one relation each."""
    c = t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    x = c.select(
        (F.col("c_custkey") % 7).alias("topic_id"),
        F.col("c_custkey").alias("unified_id"),
        F.concat(F.lit('[{"head":"'), F.col("c_mktsegment"), F.lit('","head_type":"组织机构","relation":"位于","tail":" '), F.col("n_name"), F.lit('","tail_type":"地点"},{"head":"x","relation":""}]')).alias("reply"),
    )
    return graph.extraction_status(graph.triples_to_graph(x, "reply"))


_EXT = "WITH x AS (SELECT c_custkey % 7 AS topic_id, c_custkey AS unified_id, c_mktsegment AS head, n_name AS tail FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(f"""{_EXT} SELECT topic_id, name, type, count(*) AS mentions FROM (SELECT topic_id, head AS name, '组织机构' AS type FROM x UNION ALL SELECT topic_id, tail, '地点' FROM x) GROUP BY ALL""")
def merge_entities(t: Tables) -> DataFrame:
    return graph.merge_entities(extractions(t)).drop("properties")


@query(f"{_EXT} SELECT topic_id, head, '位于' AS relation, tail, 0.9::DOUBLE AS confidence, count(*) AS sources FROM x GROUP BY ALL")
def merge_relations(t: Tables) -> DataFrame:
    return graph.merge_relations(extractions(t))


@query(f"""{_EXT}, e AS (SELECT DISTINCT topic_id, head, tail FROM x) SELECT (SELECT count(DISTINCT (name, type)) FROM (SELECT head AS name, 1 AS type FROM x UNION ALL SELECT tail, 2 FROM x)) AS nodes, (SELECT count(*) FROM e) AS edges""")
def graph_counts(t: Tables) -> DataFrame:
    e = extractions(t)
    g = graph.graph_tables(graph.merge_entities(e), graph.merge_relations(e))
    return g["nodes"].agg(F.count(F.lit(1)).alias("nodes")).crossJoin(g["edges"].agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query(f"""{_EXT} SELECT name, mentions FROM (SELECT name, type, count(*) AS mentions FROM (SELECT topic_id, head AS name, 1 AS type FROM x UNION ALL SELECT topic_id, tail, 2 FROM x) GROUP BY ALL) WHERE (name, type) IN (SELECT (head, 1) FROM x WHERE topic_id = 3 UNION ALL SELECT (tail, 2) FROM x WHERE topic_id = 3) ORDER BY mentions DESC, name LIMIT 10""")
def graph_report(t: Tables) -> DataFrame:
    e = extractions(t)
    g = graph.graph_tables(graph.merge_entities(e), graph.merge_relations(e))
    return graph.topic_graph_report(g, 3)["entities"].select("name", "mentions")


@query(f"{_EXT} SELECT count(DISTINCT topic_id) AS topics, count(*) AS extractions, count(*) AS completed, CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS failed, 2 * count(*) AS entities, count(*) AS relations FROM x")
def kg_stats(t: Tables) -> DataFrame:
    return graph.kg_stats(extractions(t))


@query(f"""{with_sql("content", "processed")}, r AS (SELECT id, topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY topic_similarity DESC, id) AS r FROM content JOIN processed ON unified_id = id WHERE topic_id IS NOT NULL AND status = 'completed' AND clean_content <> '') SELECT id, topic_id FROM r WHERE r <= 20""")
def kg_candidates(t: Tables) -> DataFrame:
    return graph.kg_candidates(t.content, t.processed, 20).select("id", "topic_id")


@query("SELECT date_trunc('day', ts) AS start, user_id % 10 AS topic_id, count(*) AS n FROM events GROUP BY ALL")
def daily_window(t: Tables) -> DataFrame:
    e = t.raw("events").withColumn("topic_id", F.col("user_id") % 10).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.stream_daily_heat(e, "1 day", "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def two_hour_window(t: Tables) -> DataFrame:
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.stream_hot_counts(e, "2 hours", "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


for registered in (payload_queries.QUERIES, more_queries.QUERIES, product_queries.QUERIES, rule_queries.QUERIES):
    QUERIES |= {name: (lambda f: lambda spark, sf_dir: f(Tables(spark, sf_dir)))(f) for name, (f, _) in registered.items()}
    SQL |= {name: sql for name, (_, sql) in registered.items()}
