"""Joins on keys of which one may have a third of all rows, and on no key at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.scratch import written

#: A key is heavy above this many rows and above one in PARTS of all: at most PARTS keys are.
LEAST, PARTS = 1000, 1000
#: Parts into which the rows of a heavy key are dealt.
SALTS = 64


def heavy_keys(df: DataFrame, keys: list[str], least: int = LEAST, parts: int = PARTS) -> DataFrame | None:
    """The heavy keys of ``df``, written: ``parts`` rows at most, whatever its size; None if there are
    none.  Null keys are left out, as no join finds them."""
    filled = df.dropna(subset=keys)
    total = filled.count()
    if total <= least:
        return None
    counts = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = written(counts.filter(F.col("_n") > max(least, total // parts)).select(*keys), "heavy-keys")
    return found if found.head(1) else None


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame | None, how: str = "inner", by: Column | None = None) -> DataFrame:
    """``left`` joined to ``right`` on equal ``keys``, the heavy ones in SALTS parts.

    Rows of ``left`` with a heavy key are dealt by a hash of ``by`` (default: of the whole row), and
    the right rows of these keys stand once in each part; rows with a null key are dealt too.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if heavy is None and how == "inner":
        return left.hint("merge").join(right, keys)
    own = F.pmod(F.xxhash64(*left.columns) if by is None else by, F.lit(SALTS)).cast("int")
    spread = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    a, b = left.withColumn("_own", own), right
    if heavy is None:
        b = b.withColumn("_salt", F.lit(0))
    else:
        known = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))  # PARTS rows at most
        a = a.join(known, keys, "left")
        spread = F.coalesce("_heavy", spread)
        every = F.sequence(F.lit(0), F.lit(SALTS - 1))
        b = b.join(known, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_heavy"), every).otherwise(F.array(F.lit(0))))).drop("_heavy")
    a = a.withColumn("_salt", F.when(spread, F.col("_own")).otherwise(F.lit(0))).drop("_heavy", "_own")
    return a.hint("merge").join(b, [*keys, "_salt"], how).drop("_salt")


#: Rows of a dimension that are broadcast, and rows of its blocks beyond that.
DIMENSION, BLOCK = 10_000, 1000


def every_pair(rows: DataFrame, dimension: DataFrame, limit: int = DIMENSION, block: int = BLOCK) -> DataFrame:
    """Every row with every row of ``dimension``, for operators whose result these pairs are.

    A dimension of at most ``limit`` rows is broadcast.  A larger one is cut into blocks of about ``block`` rows that
    meet the rows in SALTS parts, so no task holds more than a part of the rows against a block.  The
    columns have different names.
    """
    d = written(dimension, "dimension")
    n = d.count()
    if n <= limit:
        return rows.crossJoin(F.broadcast(d))  # counted
    blocks = -(-n // block)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).withColumn("_block", numbers(blocks))
    right = d.withColumn("_block", F.pmod(F.xxhash64(*d.columns), F.lit(blocks)).cast("int")).withColumn("_salt", numbers(SALTS))
    return left.hint("merge").join(right, ["_block", "_salt"]).drop("_block", "_salt")
