"""The driver's tables as the product's tables, by arithmetic on ids, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.adapters import PLATFORMS

NOW = datetime(2024, 1, 31)
#: Tables with texts, whose rows are dear to work on.
TEXTS = ("documents", "pages", "conversations")
_P = ", ".join(f"'{p}'" for p in PLATFORMS)

#: Every product table as one statement that both engines run; {div} is whole division.
TABLES = {
    "content": f"""SELECT d.doc_id AS id, CAST(d.doc_id AS STRING) AS content_id, {{list}}({_P}){{at}} AS platform,
  split_part(d.text, chr(10), 1) AS title, d.text AS content,
  (d.doc_id * 37) % 1000 AS liked_count, (d.doc_id * 13) % 200 AS comment_count, (d.doc_id * 7) % 50 AS share_count,
  {{t0}} + make_interval_days(d.doc_id % 30) + make_interval_hours(d.doc_id % 24) AS original_created_at,
  {{t0}} + make_interval_days(d.doc_id % 30 + 1) + make_interval_hours(d.doc_id % 24) AS topic_assigned_at,
  1704067200000 + (d.doc_id % 30) * 86400000 + (d.doc_id % 24) * 3600000 AS add_ts,
  CAST(e.label AS BIGINT) AS topic_id, ((d.doc_id * 31) % 1000) / CAST(1000 AS DOUBLE) AS topic_similarity,
  CASE WHEN l.quality = 0 THEN 'negative' WHEN l.toxic = 1 THEN 'neutral' WHEN l.quality = 1 THEN 'positive' END AS sentiment,
  CASE WHEN l.quality = 0 THEN CAST(-0.7 AS DOUBLE) WHEN l.toxic = 1 THEN CAST(0.0 AS DOUBLE) WHEN l.quality = 1 THEN CAST(0.8 AS DOUBLE) END AS sentiment_score
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "comment": f"""SELECT conv_id * 1000 + turn AS id, CAST(conv_id * 1000 + turn AS STRING) AS comment_id, CAST(conv_id AS STRING) AS content_id,
  {{list}}({_P}){{atc}} AS platform, CASE WHEN turn > 0 THEN CAST(conv_id * 1000 AS STRING) ELSE '' END AS parent_comment_id, role AS nickname, text AS content
  FROM conversations""",
    "processed": "SELECT doc_id AS unified_id, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'completed' END AS status, text AS clean_content FROM documents WHERE doc_id % 5 <> 4",
    "topics": """SELECT topic_id, CASE topic_id % 4 WHEN 0 THEN 'emerging' WHEN 1 THEN 'active' WHEN 2 THEN 'declining' ELSE 'merged' END AS status,
  CASE WHEN topic_id % 3 = 0 THEN concat('话题-', CAST(topic_id AS STRING)) ELSE concat('topic ', CAST(topic_id AS STRING)) END AS name, n AS content_count
  FROM (SELECT CAST(label AS BIGINT) AS topic_id, count(*) AS n FROM embeddings GROUP BY label) t""",
    "hot": """SELECT page_id, concat('p', CAST(page_id % 10 AS STRING)) AS platform_code, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, url,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE 'described' END AS description, page_id AS rank FROM pages""",
}
_SPARK = {"list": "array", "at": "[CAST(d.doc_id % 7 AS INT)]", "atc": "[CAST(conv_id % 7 AS INT)]", "t0": "TIMESTAMP_NTZ'2024-01-01 00:00:00'"}
_DUCK = {"list": "list_value", "at": "[1 + CAST(d.doc_id % 7 AS INT)]", "atc": "[1 + CAST(conv_id % 7 AS INT)]", "t0": "TIMESTAMP '2024-01-01 00:00:00'"}


def _statement(name: str, duck: bool) -> str:
    s = TABLES[name]
    for k, v in (_DUCK if duck else _SPARK).items():
        s = s.replace("{" + k + "}", v)
    for unit in ("days", "hours"):
        s = s.replace(f"make_interval_{unit}(", f"to_{unit}(" if duck else f"make_dt_interval{'' if unit == 'days' else '_h'}(")
    if not duck:
        import re

        s = re.sub(r"make_dt_interval_h\(([^)]*)\)", r"make_dt_interval(0, CAST(\1 AS INT))", s)
        s = re.sub(r"make_dt_interval\((d\.doc_id[^)]*)\)", r"make_dt_interval(CAST(\1 AS INT))", s)
    else:
        import re

        s = re.sub(r"to_(days|hours)\(([^)]*)\)", r"to_\1(CAST(\2 AS INT))", s).replace("AS STRING", "AS VARCHAR")
    return s


def with_sql(*names: str) -> str:
    """``WITH`` and the named tables, for the oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({_statement(n, True)})" for n in names)


class Tables:
    """The product tables over a folder of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        # a table of one row group is one scan task: only then its rows are dealt to all cores
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        s = _statement(name, False)
        used = {t: self.raw(t) for t in ("documents", "embeddings", "labels", "conversations", "pages") if t in s}
        for t in used:
            s = s.replace(f" {t} ", f" {{{t}}} ").replace(f" {t}\n", f" {{{t}}}\n")
            s = s[: -len(t)] + f"{{{t}}}" if s.endswith(f" {t}") else s
        return self.spark.sql(s, **used)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})
