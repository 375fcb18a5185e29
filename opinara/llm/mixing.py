"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each document has a 60-bit hash of its key and text.  Words are summed by source and the hash's top
bits; a cumulative sum finds the bucket in which a source's budget ends, and only that bucket
is opened by the next bits.  After ``LEVELS`` rounds the threshold is exact, and documents are
filtered by comparing their hash with it: no sort of documents, no shuffle of texts.
Thresholds are nested: a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.scratch import BROADCAST_ROWS, small_side, tidy, written

WEIGHTS, SHARE, MAX_REPEAT = (5, 2, 1), 1.5, 2
BITS, LEVELS = 10, 6
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(key: Column, text: Column, seed: str) -> Column:
    """60 bits of md5 over seed, key and the text's md5; a null key counts as the text ``null``, a null text as empty."""
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(of), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> plus ``target`` words.

    Sources in code-point order, null last, get the weights in turn.  ``share`` of all words is
    dealt by weight; no target is above ``max_repeat`` times its source, and the excess goes to
    the others by weight until none is above.  One row a source, so its windows are small: the
    number of sources is a dimension and not the corpus.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    every = W.partitionBy()
    s = (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("w_all", F.sum("w").over(every))
    )
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("at", F.row_number().over(by_ratio))
        .withColumn("lam", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("full", F.col("cap") <= F.col("lam") * F.col("w"))
    )
    lam = F.min_by(F.when(~F.col("full"), F.col("lam")), F.when(~F.col("full"), F.col("at"))).over(every)
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(lam * F.col("w"))).select("source", "source_size", "target")


def thresholds(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: ``fulls`` (times that every document is taken) and the hash ``bound``
    below which documents are taken once more, if any are (``open``); ``edge`` says whether the one
    hash at the bound is taken too, which is so if that comes at least as near to the target."""
    fulls = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = written(
        targets.withColumn("fulls", fulls)
        .withColumn("rest", F.col("target") - F.col("fulls") * F.col("source_size"))
        .withColumn("bound", F.lit(0).cast("long"))
        .withColumn("done", F.lit(0).cast("long"))
        .withColumn("last", F.lit(0).cast("long")),
        "mix-state",
    )
    side = "broadcast" if state.count() <= BROADCAST_ROWS else "merge"
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = measured.select("source", "size", F.shiftright("hash", shift).alias("cell"))
        own = state.select(F.col("source").alias("s"), "bound").hint(side)
        inside = inside.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("cell", BITS) == F.col("bound")))
        sums = inside.groupBy("source", "cell").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(W.partitionBy("source").orderBy("cell"))
        sums = sums.withColumn("before", upto - F.col("n"))
        sums = sums.join(state.select(F.col("source").alias("s"), "rest", "done").hint(side), F.col("source").eqNullSafe(F.col("s")))
        over = F.col("done") + F.col("before") + F.col("n") > F.col("rest")
        edge = sums.filter(over).groupBy(F.col("source").alias("e")).agg(F.min(F.struct("cell", "before", "n")).alias("x"))
        none = (F.shiftleft(F.col("bound"), BITS) + F.lit((1 << BITS) - 1)).cast("long")
        state = written(
            state.join(edge.hint(side), F.col("source").eqNullSafe(F.col("e")), "left").select(
                "source", "source_size", "target", "fulls", "rest",
                F.coalesce("x.cell", none).alias("bound"),
                (F.col("done") + F.coalesce("x.before", F.lit(0))).cast("long").alias("done"),
                F.coalesce("x.n", F.lit(0)).cast("long").alias("last"),
            ),
            "mix-state",
        )
    nearer = F.col("rest") - F.col("done") >= F.col("done") + F.col("last") - F.col("rest")
    return state.select("source", "source_size", "target", "fulls", "bound", nearer.alias("edge"), (F.col("rest") > 0).alias("open"))


def measure(docs: DataFrame, key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """(key, source, size, hash) of every document, written: the narrow table that all rounds read."""
    return written(docs.select(F.col(key), F.col("source"), word_count(F.col("text")).alias("size"), key_hash(F.col(key), F.col("text"), seed).alias("hash")), "mix-measured")


def plan_mix(measured: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT) -> DataFrame:
    """One row a source with its target and thresholds, from :func:`measure`'s table."""
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    return written(thresholds(measured, source_targets(sizes, weights, share, max_repeat)), "mix-plan")


def copies(plan: DataFrame, rows: DataFrame, hashed: Column) -> DataFrame:
    """``rows`` joined to its source's plan row, with ``copies``: how often the mix takes each."""
    p = plan.select(F.col("source").alias("_mix_source"), "source_size", "target", "fulls", "bound", "edge", "open")
    once = F.col("open") & ((hashed < F.col("bound")) | ((hashed == F.col("bound")) & F.col("edge")))
    joined = rows.join(small_side(p), rows["source"].eqNullSafe(F.col("_mix_source")), "left")
    return joined.withColumn("copies", F.coalesce(F.col("fulls") + F.when(once, 1).otherwise(0), F.lit(0)).cast("int"))


@tidy
def mix_sources(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """The mixed corpus: ``docs``' own columns, each row as often as the mix takes it.

    Rows with the same doc_id and text share a hash and are taken together.  A null source is a source
    of its own, null and empty texts have size 0, a source of size 0 has target 0, an empty
    table gives an empty one.  Columns beyond doc_id, text and source are carried, whatever
    their names.
    """
    plan = plan_mix(measure(docs, seed=seed), weights, share, max_repeat)
    own = docs.columns
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_mix_row"), F.col("source"), F.col("doc_id"), F.col("text"))
    taken = copies(plan, renamed, key_hash(F.col("doc_id"), F.col("text"), seed)).filter("copies > 0")
    return taken.select("_mix_row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_mix_row.*")


@tidy
def mix_report(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document, taken or not."""
    measured = measure(docs, seed=seed)
    plan = plan_mix(measured, weights, share, max_repeat)
    out = copies(plan, measured, F.col("hash"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE = """
WITH m AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS w FROM s),
a AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS w_all FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
    (budget - coalesce(sum(cap) OVER b, 0)) / (w_all - coalesce(sum(w) OVER b, 0)) AS lam FROM a
    WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lam, k) AS lam FROM r WHERE NOT cap <= lam * w),
t AS (SELECT source, source_size, CASE WHEN cap <= r.lam * w THEN cap ELSE (SELECT lam FROM l) * w END AS target FROM r),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS fulls FROM t),
c AS (SELECT m.doc_id, m.size, f.source_size, f.target, f.fulls, f.target - f.fulls * f.source_size AS rest,
    sum(size) OVER (PARTITION BY m.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY m.source ORDER BY h RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS own
    FROM m JOIN f ON m.source IS NOT DISTINCT FROM f.source),
d AS (SELECT *, CAST(fulls + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN 1 WHEN upto - own <= rest AND rest - (upto - own) >= upto - rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM c)
SELECT doc_id, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken FROM d
"""
