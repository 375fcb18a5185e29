"""Keyed upserts, resync and retention on plain tables.

Parquet has no merge, so an upsert is one full outer join of target and de-duplicated source; write
the result to a new version and switch, never over the table that is being read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns that a repeated delivery from this platform renews, by kind.
XHS_UPDATE_COLS = {
    "content": ["comment_count", "share_count", "liked_count", "collected_count", "last_modify_ts"],
    "comment": ["like_count", "sub_comment_count", "last_modify_ts"],
    "creator": ["nickname", "avatar", "desc", "ip_location", "follows", "fans", "interaction", "tag_list", "last_modify_ts"],
}


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by ``order``."""
    last = W.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """``target`` with ``source``'s rows inserted, or their ``update_cols`` (default: all but the
    keys) put over those of the row with the same key.  Of source rows with one key the last by
    ``order`` counts, or any if they are alike.  Null keys match each other."""
    columns = target.columns
    update = set(update_cols if update_cols is not None else [c for c in columns if c not in keys])
    source = latest(source, keys, order or [F.col(c) for c in columns if c not in keys][:1] or [F.col(keys[0])])
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in columns], F.lit(True).alias("_old"))
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in columns if c in source.columns], F.lit(True).alias("_new"))
    on = [F.col(f"_t_{k}").eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    both = t.join(s, on, "full_outer")
    out = []
    for c in columns:
        if c not in source.columns:
            out.append(F.col(f"_t_{c}").alias(c))
        elif c in update:
            out.append(F.when(F.col("_new"), F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(f"_t_{c}")).otherwise(F.col(f"_s_{c}")).alias(c))
    return both.select(*out)


def upsert_raw(target: DataFrame, source: DataFrame, keys: list[str], now_ms: int, require: str | None = None, update_cols: list[str] | None = None) -> DataFrame:
    """Raw-store upsert: ``add_ts`` is that of the first insert, ``last_modify_ts`` is now.  With
    ``require``, rows without a text in that column update but do not insert."""
    source = source.withColumn("add_ts", F.lit(now_ms).cast("long")).withColumn("last_modify_ts", F.lit(now_ms).cast("long"))
    if require:
        known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
        source = source.join(known, keys, "left").filter(F.col("_known") | (F.coalesce(F.col(require), F.lit("")) != "")).drop("_known")
    update = update_cols if update_cols is not None else [c for c in target.columns if c not in keys and c != "add_ts"]
    return upsert(target, source.select(*[c for c in target.columns if c in source.columns]), keys, update)


def full_resync(target: DataFrame, adapted: DataFrame, platforms: list[str]) -> DataFrame:
    """The named platforms' rows replaced by ``adapted``."""
    return target.filter(~F.col("platform").isin(platforms)).unionByName(adapted.filter(F.col("platform").isin(platforms)))


def resync_table(adapted: DataFrame, platforms: list[str], path: str) -> None:
    """The same on a table partitioned by platform under ``path``: only the named platforms' partitions are
    replaced, those without new rows become empty, all other files stay as they are.  ``adapted`` does not
    read the table.  A repeated call gives the same table."""
    spark = adapted.sparkSession
    rows = adapted.filter(F.col("platform").isin(platforms))
    fresh = {r[0] for r in rows.select("platform").distinct().collect()}  # at most the named ones
    rows.repartition(len(fresh) or 1, "platform", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("platform").parquet(path)
    for p in set(platforms) - fresh:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/platform={p}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_older_than(df: DataFrame, ts: str, days: int, now: datetime) -> DataFrame:
    """Rows whose time is not more than ``days`` before ``now``; rows without a time go."""
    return df.filter(F.col(ts) >= F.lit(now) - F.make_dt_interval(F.lit(days)))
