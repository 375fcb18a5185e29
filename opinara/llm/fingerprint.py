"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up.  On each level, runs of one name become a name; deterministic coin
tossing (lowest bit in which a name differs from the one before, and that bit) shrinks neighbours
to labels below 6, still different; a phrase begins at each local minimum of labels, and is named by
a hash of its names.  A boundary depends on a few neighbours alone, so equal substrings get equal
phrases in their interior, wherever they stand.  The fingerprint is the ``SKETCH`` smallest hashes of
the phrases of levels 2 and 3 (about 10 and 33 characters); the likeness of two fingerprints is the
Jaccard share of common hashes among the smallest of both.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.shingles import mix

LEVELS, SKETCH = (2, 3), 64
#: Characters parsed at a time.
CHUNK = 1 << 19
_G, _H = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.array([8] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def _level(names: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level's phrases, and which of them begin a text."""
    keep = np.r_[True, (names[1:] != names[:-1]) | start[1:]]
    at = np.flatnonzero(keep)
    run = np.diff(np.r_[at, len(names)])
    names, start = names[at], start[at]
    long = np.flatnonzero(run > 1)
    names[long] = mix(names[long] + run[long].astype(np.uint64) * _H)
    x = names[1:] ^ names[:-1]
    low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    label = np.empty(len(names), np.uint8)
    label[0] = 0
    label[1:] = (low << np.uint64(1)) | ((names[1:] >> np.minimum(low, np.uint64(63))) & np.uint64(1))
    first = np.flatnonzero(start)
    # a text's first label must not depend on the text before it
    label[first] = (names[first] & np.uint64(3)).astype(np.uint8)
    for _ in range(3):
        low8 = _LOW[label[1:] ^ label[:-1]]
        keep_first = label[first] & 3
        label[1:] = (low8 << 1) | ((label[1:] >> np.minimum(low8, 7)) & 1)
        label[first] = keep_first
    after = np.empty_like(label)
    after[:-1], after[-1] = label[1:], 255
    after[first[1:] - 1] = 255
    begin = start.copy()
    begin[1:] |= (label[1:] < label[:-1]) & (label[1:] < after[1:])
    cut = np.flatnonzero(begin)
    size = np.diff(np.r_[cut, len(names)])
    place = np.arange(1, len(names) + 1) - np.repeat(cut, size)
    phrases = mix(np.add.reduceat(mix(names + place.astype(np.uint64) * _G), cut) + size.astype(np.uint64))
    return phrases, start[cut]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text the ascending smallest phrase hashes, SKETCH at most; none for an empty text."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i + 1 == len(texts):
            some = [j for j in range(begin, i + 1) if texts[j]]
            for j, s in zip(some, _sketch([texts[j] for j in some]), strict=True):
                out[j] = s
            begin, size = i + 1, 0
    return out


def _sketch(texts: list[str]) -> list[np.ndarray]:
    if not texts:
        return []
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    start = np.zeros(len(names), bool)
    start[np.cumsum(sizes) - sizes] = True
    keys = []
    for level in range(1, max(LEVELS) + 1):
        names, start = _level(names, start)
        if level in LEVELS:
            text = (np.cumsum(start) - 1).astype(np.uint64)
            keys.append((text << np.uint64(32)) | (mix(names ^ np.uint64(level)) >> np.uint64(32)))
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    text, hashes = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
    ends = np.searchsorted(text, np.arange(len(texts)), "right")
    begins = np.r_[0, ends[:-1]]
    return [hashes[a : min(b, a + SKETCH)] for a, b in zip(begins, ends, strict=True)]


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate from two sketches; two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    least = sorted(x | y)[:SKETCH]
    return len(x.intersection(y).intersection(least)) / len(least)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (rounded down) replaced by as many first characters of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``: a hexadecimal text, equal for equal texts, empty for null or empty ones."""
    own = [c for c in docs.columns if c != "fingerprint"]
    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                x = b.slice(start, 512)
                prints = [as_text(s) for s in sketches([t or "" for t in x.column(at).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(prints, pa.string())], [*own, "fingerprint"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, at, mark, doc_id, text), dealt by bucket: ranges of descending doc_id and, within an id that
    has many rows, of a hash of the text; each is followed by a copy of the row after it (ghost), which is
    the first row of all for the last range.

    Null ids stand after all others; rows of equal id are ordered by the hash and the text.  Only ids and
    hashes go through Python, to be looked up in the sorted split points.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"), F.xxhash64(text).alias("mark"), text.alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # split points and one row for each range: bounded by their number
    shares, accuracy = [i / parts for i in range(1, parts)], 10 * parts
    found = rows.agg(F.percentile_approx("at", shares, accuracy)).first()[0] or []
    cuts = np.array(sorted(set(found)), np.int64)
    # an id at several split points has rows for several ranges, cut by the hash
    crowded = [x for x, n in Counter(found).items() if n > 1]
    split: dict[int, np.ndarray] = {}
    if crowded:
        split = {r[0]: np.array(sorted(set(r[1])), np.int64) for r in rows.filter(F.col("at").isin(crowded)).groupBy("at").agg(F.percentile_approx("mark", shares, accuracy)).collect()}
    shared = spark.sparkContext.broadcast((cuts, split))

    @F.pandas_udf("long")
    def bucket_of(at: pd.Series, mark: pd.Series) -> pd.Series:
        # the largest ids come first
        cuts, split = shared.value
        bucket = (len(cuts) - np.searchsorted(cuts, at.to_numpy(), "right")) * (parts + 1)
        for x, own in split.items():
            here = at.to_numpy() == x
            bucket[here] += np.searchsorted(own, mark.to_numpy()[here], "right")
        return pd.Series(bucket)

    # of an id that is split, its rows alone are in the bucket's later parts; the first part may begin with larger ids
    head = F.max_by(F.struct("at", "mark"), F.struct("at", (-1 - F.col("mark")).alias("m")))
    heads = sorted((r[0], (r[1].at, r[1].mark)) for r in rows.groupBy(bucket_of("at", "mark").alias("bucket")).agg(head).collect())
    after: dict[tuple[int, int], list[int]] = {}
    for (b, _), (_, first) in zip(heads, heads[1:] + heads[:1], strict=True):
        after.setdefault(first, []).append(b)
    ghosts = spark.sparkContext.broadcast(after)

    @F.pandas_udf("array<long>")
    def ghosts_of(at: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([ghosts.value.get(x, []) for x in zip(at.tolist(), mark.tolist(), strict=True)], dtype=object)

    own = rows.select(bucket_of("at", "mark").alias("bucket"), F.lit(0).alias("ghost"), *rows.columns)
    # one copy for each range, however many rows are equal to it
    copies = rows.select(F.explode(ghosts_of("at", "mark")).alias("bucket"), "at", "mark", "doc_id", "text")
    copies = copies.groupBy("bucket").agg(F.first("at").alias("at"), F.first("mark").alias("mark"), F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rows = own.unionByName(copies.withColumn("ghost", F.lit(1)))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "ghost", F.desc("at"), "mark", "text")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next, where the next row is that of the next smaller doc_id, after the last the first.

    A null text counts as empty.  Other columns are ignored, an empty table gives an empty one.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    def emit(held: list):
        """Results of all but the last of ``held``."""
        texts = [r[2] for r in held]
        own = sketches(texts)
        edits = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        changed = sketches(edits)
        out = []
        for i, e in enumerate(edits):
            if not held[i][1]:
                sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((held[i][3], len(texts[i]), sha, as_text(own[i]), as_text(changed[i]), likeness(own[i], changed[i]), likeness(own[i], own[i + 1])))
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for b in batches:
            for start in range(0, b.num_rows, 256):
                for bucket, ghost, doc_id, text in zip(*(c.to_pylist() for c in b.slice(start, 256).columns), strict=True):
                    held.append((bucket, ghost, text, doc_id))
                    size += len(text)
                    if ghost or size >= CHUNK:
                        yield emit(held)
                        held = [] if ghost else held[-1:]
                        size = sum(len(h[2]) for h in held)

    return with_next(docs).select("bucket", "ghost", "doc_id", "text").mapInArrow(run, schema)
