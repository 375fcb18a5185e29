"""Hot lists, domain matching, search keywords and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.functions.text import or_else
from opinara.operators.upsert import upsert
from opinara.skew import every_pair


def _listed(df: DataFrame, order: list, n: int | None) -> DataFrame:
    out = df.orderBy(*order)
    return out.limit(n) if n else out


def normalize_hot(df: DataFrame, n: int | None = None) -> DataFrame:
    """Items with news_id = md5(platform:title:url), a description that falls back to the title, and of
    each platform the first ``n`` by rank."""
    out = df.withColumns({"news_id": F.md5(F.concat_ws(":", "platform_code", "title", "url")), "description": or_else(F.col("description"), F.col("title"))})
    if n:
        first = W.partitionBy("platform_code").orderBy("rank", "news_id")
        out = out.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_r")
    return out


def recent_hot(df: DataFrame, n: int | None, platforms: list[str] | None = None) -> DataFrame:
    df = df.filter(F.col("platform_code").isin(platforms)) if platforms else df
    return _listed(df, [F.desc("fetched_at"), "news_id"], n)


def unanalyzed_hot(news: DataFrame, analysis: DataFrame, domain: int | None = None) -> DataFrame:
    """Items without an analysis, or without one for a domain."""
    a = analysis if domain is None else analysis.filter(F.col("domain_id") == domain)
    return news.join(a.select("news_id"), "news_id", "left_anti")


def news_domain_pairs(news: DataFrame, domains: DataFrame) -> DataFrame:
    """Every item with every enabled domain."""
    return every_pair(news, domains.select("domain_id", "domain_name", "domain_keywords"))


def domain_match(pairs: DataFrame, text: str = "title") -> DataFrame:
    """``pairs`` with hits, confidence (hits by keywords), is_match and level."""
    words = F.filter(F.transform(F.split("domain_keywords", ","), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.size(F.filter(words, lambda w: F.contains(body, w)))
    conf = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.size(words)), F.lit(0.0))
    out = pairs.withColumn("hits", hits).withColumn("confidence", conf).withColumn("is_match", F.col("hits") > 0)
    return out.withColumn("level", F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").when(F.col("is_match"), "low").otherwise("none"))


def parse_match_reply(df: DataFrame, col: str) -> DataFrame:
    """``df`` with is_match, confidence and reason of a reply, with or without a code fence; no JSON: no match."""
    inner = F.regexp_extract(F.col(col), r"(?s)```(?:json)?\s*(.*?)```", 1)
    v = F.coalesce(F.try_parse_json(F.col(col)), F.try_parse_json(F.nullif(inner, F.lit(""))))
    get = lambda p, k: F.try_variant_get(F.col("_v"), p, k)
    out = df.withColumn("_v", v).withColumns({"is_match": F.coalesce(get("$.is_match", "boolean"), F.lit(False)), "confidence": F.coalesce(get("$.confidence", "double"), F.lit(0.0)), "reason": F.coalesce(get("$.reason", "string"), F.lit(""))})
    return out.drop("_v")


def matched_domains(df: DataFrame, min_conf: float) -> DataFrame:
    """(news_id, domains): matches from ``min_conf`` on, best first."""
    m = df.filter(F.col("is_match") & (F.col("confidence") >= min_conf))
    return m.groupBy("news_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "domain_id", "domain_name", "confidence"))).alias("domains"))


def matched_news(news: DataFrame, analysis: DataFrame, domain: int, n: int | None = None) -> DataFrame:
    a = analysis.filter((F.col("domain_id") == domain) & F.col("is_match")).select("news_id", "confidence")
    return _listed(news.join(a, "news_id"), [F.desc("confidence"), F.desc("fetched_at"), "news_id"], n)


def news_of_keywords(news: DataFrame, keywords: DataFrame, ids: DataFrame) -> DataFrame:
    """Items that produced the keywords whose ids (keyword_id) are given."""
    k = keywords.join(ids, "keyword_id", "left_semi").select("news_id")
    return news.join(k, "news_id", "left_semi")


def keyword_rows(df: DataFrame, col: str, key: str = "news_id") -> DataFrame:
    """(key, keyword, is_primary, confidence) of replies {keywords: [...], count, primary}: confidence
    is the declared count by the list's length, and can exceed 1."""
    r = F.from_json(F.regexp_extract(F.col(col), r"(?s)\{.*\}", 0), "keywords array<string>, count double, primary string")
    x = df.select(key, r.alias("r")).select(key, F.posexplode("r.keywords").alias("i", "keyword"), "r")
    conf = F.coalesce(F.try_divide(F.col("r.count"), F.size("r.keywords")), F.lit(1.0))
    return x.filter("trim(keyword) != ''").select(key, F.trim("keyword").alias("keyword"), F.coalesce(F.col("keyword") == F.col("r.primary"), F.col("i") == 0).alias("is_primary"), conf.alias("confidence"))


def dedupe_keywords(df: DataFrame, order: str = "keyword_id") -> DataFrame:
    """One row a keyword: the highest confidence, the first on a tie."""
    best = W.partitionBy("keyword").orderBy(F.desc("confidence"), order)
    return df.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def list_keywords(df: DataFrame, domain: int | None = None, batch: str | None = None, n: int | None = None) -> DataFrame:
    df = df if domain is None else df.filter(F.col("domain_id") == domain)
    df = df if batch is None else df.filter(F.col("run_batch_id") == batch)
    return _listed(df, [F.desc("confidence"), F.desc("created_at"), "keyword_id"], n)


def never_crawled(df: DataFrame, domain: int | None = None, batch: str | None = None, n: int | None = None) -> DataFrame:
    return list_keywords(df.filter("search_count = 0"), domain, batch, n)


def bump_usage(keywords: DataFrame, uses: DataFrame) -> DataFrame:
    """search_count and last_used_at renewed from uses (keyword_id, used_at)."""
    u = uses.groupBy("keyword_id").agg(F.count(F.lit(1)).alias("_n"), F.max("used_at").alias("_at"))
    out = keywords.join(u, "keyword_id", "left")
    return out.withColumns({"search_count": F.col("search_count") + F.coalesce("_n", F.lit(0)), "last_used_at": F.greatest("last_used_at", "_at")}).select(*keywords.columns)


def log_view(df: DataFrame, status: str | None = None, keyword_id: int | None = None, oldest_first: bool = False, n: int | None = None) -> DataFrame:
    df = df if status is None else df.filter(F.col("status") == status)
    df = df if keyword_id is None else df.filter(F.col("keyword_id") == keyword_id)
    return _listed(df, ["started_at" if oldest_first else F.desc("started_at"), "log_id"], n)


def run_summary(news: DataFrame, analysis: DataFrame, keywords: DataFrame, crawls: DataFrame) -> DataFrame:
    """(run_batch_id, hot, matched, keywords, crawls)."""
    parts = [news.select("run_batch_id", F.lit("hot").alias("k")), analysis.filter("is_match").select("run_batch_id", F.lit("matched").alias("k")), keywords.select("run_batch_id", F.lit("keywords").alias("k")), crawls.select("run_batch_id", F.lit("crawls").alias("k"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("run_batch_id").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("hot", "matched", "keywords", "crawls")])


def enabled(df: DataFrame) -> DataFrame:
    return df.filter("is_enabled").orderBy(F.desc("priority"), df.columns[0])


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows with the given values; a DataFrame value is a table of keys."""
    for k, v in keys.items():
        df = df.join(v, k, "left_semi") if isinstance(v, DataFrame) else df.filter(F.col(k) == v)
    return df


def drop_keys(df: DataFrame, ids: DataFrame, key: str = "keyword_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def count_by(df: DataFrame, domain: int | None = None) -> DataFrame:
    df = df if domain is None else df.filter(F.col("domain_id") == domain)
    return df.agg(F.count(F.lit(1)).alias("n"))


def crawl_plan(keywords: DataFrame, platforms: DataFrame, ids: DataFrame | None = None, domain: int | None = None, n: int | None = None) -> DataFrame:
    """(keyword_id, keyword, platform, status): chosen keywords on every enabled platform."""
    k = keywords.join(ids, "keyword_id", "left_semi") if ids is not None else list_keywords(keywords, domain, n=n) if domain is not None else never_crawled(keywords, n=n)
    return every_pair(k.select("keyword_id", "keyword"), enabled(platforms).select("platform")).withColumn("status", F.lit("pending"))


def log_start(rows: DataFrame, at) -> DataFrame:
    return rows.withColumns({"status": F.lit("running"), "started_at": F.lit(at)})


def log_finish(log: DataFrame, results: DataFrame) -> DataFrame:
    """Results (log_id, status, finished_at, n_items) written to the log, with the duration in seconds."""
    out = upsert(log, results, ["log_id"], [c for c in results.columns if c != "log_id"])
    return out.withColumn("duration_s", F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")))
