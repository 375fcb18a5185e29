"""Line dedup by content-defined chunks of lines, exact to the pair of lines.

Boundaries.  A rolling hash over the hashes of the last WINDOW lines decides whether a chunk ends after a line, so
a boundary depends on nothing before these lines: a passage that is copied anywhere is cut alike, but
for its edges.

Chunks.  Chunks of two lines or more that occur more than once are grouped by hash, and their bytes
compared.  All occurrences but the first (least doc_id, then place) go.

Edges.  Copied lines that share a chunk with lines that are not copied are found by the pairs of neighbouring
lines, again by hash and then by bytes; but only pairs outside the copies are looked at: those
across boundaries, in the first occurrences, and in chunks that occur once.  The first occurrence of a pair is
never inside a copied chunk (that chunk's first occurrence has the pair before it), so the result is the same as
if all pairs were compared: each pair of neighbouring lines that occurs more than once goes but for its
first occurrence, and a passage is the union of its pairs, wherever it stands.

Counts are aggregated before they are shuffled, and where they meet the units again the heavy ones
are salted, so a chunk that a third of all documents have is spread over tasks; texts are shuffled by
document only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.memory import release
from opinara.scratch import tidy, written
from opinara.skew import heavy_keys, salted_join

#: Lines that decide on a boundary; one in BOUNDARY lines ends a chunk.
WINDOW, BOUNDARY = 2, 4
ADDED = ("n_lines", "removed_chunks", "removed_lines")
_MASK = (1 << 64) - 1
#: Kinds of units: a chunk by its number, a pair by its first line.
CHUNK, PAIR = 0, 1
_UNIT = "doc_id long, mark long, kind int, unit int, key long, weight int"


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def boundaries(lines: list[bytes]) -> list[int]:
    """Where chunks begin, and the end: a boundary follows from the WINDOW lines before it alone."""
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    out = [0]
    for i in range(len(lines) - 1):
        rolled = 0
        for h in hashes[max(0, i + 1 - WINDOW) : i + 1]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & _MASK
        if (rolled >> 33) % BOUNDARY == 0:
            out.append(i + 1)
    return [*out, len(lines)]


def _key(lines: list[bytes], a: int, b: int) -> int:
    return xxhash.xxh64_intdigest(b"\n".join(lines[a:b])) - (1 << 63)


def _place():
    """Where a unit stands: the least is the first occurrence."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"), F.col("unit"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): rows of equal id and text are one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def _on(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["_id"]) & (left["mark"] == right["_mark"])


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, kind, unit, key, inside) of all chunks of two lines or more and of all pairs of lines, written.
    ``inside``: the chunk that holds both lines of a pair, -1 if none does."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            rows, kinds, numbers, keys, inside = [], [], [], [], []
            for row, text in enumerate(b.column(2).to_pylist()):
                lines = _lines(text)
                if len(lines) < 2:
                    continue
                ends = boundaries(lines)
                long = [(c, x, y) for c, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y - x > 1]
                chunk = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                pairs = len(lines) - 1
                rows.append(np.full(len(long) + pairs, row))
                kinds.append(np.repeat([CHUNK, PAIR], [len(long), pairs]))
                numbers += [[c for c, _, _ in long], range(pairs)]
                keys += [_key(lines, x, y) for _, x, y in long]
                keys += [_key(lines, i, i + 2) for i in range(pairs)]
                inside += [np.full(len(long), -1), np.where(chunk[:-1] == chunk[1:], chunk[:-1], -1)]
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64())
            flat = lambda parts: pa.array(np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), flat(kinds), flat(numbers), pa.array(keys, pa.int64()), flat(inside)], ["doc_id", "mark", "kind", "unit", "key", "inside"])
        release()

    return written(_keyed(docs).mapInArrow(run, "doc_id long, mark long, kind int, unit int, key long, inside int"), "dedup-units")


def _proposed(found: DataFrame) -> DataFrame:
    """(doc_id, mark, kind, unit, key, weight, keeper) of units whose hash weighs more than one, written."""
    often = found.groupBy("key").agg(F.sum("weight").alias("n"), F.min(_place()).alias("first")).filter("n > 1").select("key", "first")
    both = salted_join(found, often, ["key"], heavy_keys(found, ["key"]), by=F.xxhash64("mark", "unit"))
    return written(both.withColumn("keeper", _place() == F.col("first")).drop("first").distinct(), "dedup-proposed")


def _texts_of(docs: DataFrame, proposed: DataFrame) -> DataFrame:
    """The proposed units with their bytes."""
    lists = proposed.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_list(F.struct("kind", "unit", "key", "weight")).alias("want"))
    keyed = _keyed(docs)
    both = keyed.hint("merge").join(lists, _on(keyed, lists)).select("doc_id", "mark", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(start, 256).to_pylist():
                    lines, ends = _lines(r["text"]), None
                    for w in r["want"]:
                        if w["kind"] == CHUNK:
                            ends = ends or boundaries(lines)
                            x, y = ends[w["unit"]], ends[w["unit"] + 1]
                        else:
                            x, y = w["unit"], w["unit"] + 2
                        out.append({"doc_id": r["doc_id"], "mark": r["mark"], **w, "bytes": b"\n".join(lines[x:y])})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        release()

    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("kind", pa.int32()), ("unit", pa.int32()), ("key", pa.int64()), ("weight", pa.int32()), ("bytes", pa.binary())])
    return both.mapInArrow(run, f"{_UNIT}, bytes binary")


def verified(docs: DataFrame, proposed: DataFrame) -> DataFrame:
    """(doc_id, mark, kind, unit, keeper) of repeated units, after comparing bytes: grouping by the bytes themselves."""
    texts = _texts_of(docs, proposed)
    unequal = written(texts.groupBy("key", "bytes").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("key"), "dedup-unequal")
    columns = ["doc_id", "mark", "kind", "unit", "keeper"]
    if not unequal.head(1):
        return proposed.select(*columns)
    # one hash for different texts: such units are kept or removed by their bytes alone
    heavy = heavy_keys(proposed, ["key"])
    own = written(_texts_of(docs, salted_join(proposed, unequal, ["key"], heavy, "left_semi")), "dedup-texts")
    first = own.groupBy("key", "bytes").agg(F.min(_place()).alias("first"), F.sum("weight").alias("n")).filter("n > 1").drop("n")
    more = salted_join(own, first, ["key", "bytes"], heavy_keys(own, ["key", "bytes"]), by=F.xxhash64("mark", "unit")).withColumn("keeper", _place() == F.col("first"))
    return salted_join(proposed, unequal, ["key"], heavy, "left_anti").select(*columns).unionByName(more.select(*columns))


def _outside_copies(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs that are in no copied chunk; one in a first occurrence weighs two, as its copies are left out."""
    known = chunks.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("unit").alias("_chunk"), "keeper")
    on = _on(pairs, known) & (pairs["inside"] == known["_chunk"])
    both = pairs.hint("merge").join(known, on, "left").filter("keeper IS NULL OR keeper")
    return both.select("doc_id", "mark", "kind", "unit", "key", F.when(F.col("keeper"), 2).otherwise(1).alias("weight"))


@tidy
def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rid of repeated passages of two lines or more, and n_lines, removed_chunks (runs of
    lines that are removed), removed_lines.

    Of each passage the first occurrence (least doc_id, then text hash, then place) stays.  A line that also
    belongs to the first occurrence of another repeated pair stays.  Lines end at a line feed; single
    lines are never removed.  A null text stays null and has no lines, an empty one has one line.  Rows of equal
    doc_id and text are one document.  A text that is removed as a whole becomes empty.  A null doc_id is later
    than any other.  Other columns are kept, those of the added names replaced; an empty table gives
    an empty one.
    """
    every = units(docs)
    chunks = every.filter(F.col("kind") == CHUNK).withColumn("weight", F.lit(1)).drop("inside")
    chunks = written(verified(docs, _proposed(chunks)), "dedup-chunks")
    pairs = _outside_copies(every.filter(F.col("kind") == PAIR), chunks)
    pairs = verified(docs, _proposed(written(pairs, "dedup-pairs")))
    found = pairs.unionByName(chunks.filter(~F.col("keeper")))
    side = lambda kind, keeper: F.collect_set(F.when((F.col("kind") == kind) & (F.col("keeper") == F.lit(keeper)), F.col("unit")))
    lists = found.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(side(CHUNK, False).alias("chunks"), side(PAIR, False).alias("pairs"), side(PAIR, True).alias("stay"))
    lists = lists.filter("size(chunks) + size(pairs) > 0").select("_id", "_mark", F.struct("chunks", "pairs", "stay").alias("lists"))
    own = [c for c in docs.columns if c not in ADDED]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    both = kept.hint("merge").join(lists, _on(kept, lists), "left").select("row", "lists")
    at = own.index("text")
    schema = T.StructType([*both.schema["row"].dataType.fields, *[T.StructField(c, T.LongType()) for c in ADDED]])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                x = b.slice(start, 512)
                columns = x.column(0).flatten()
                texts, counts = [], []
                for text, told in zip(columns[at].to_pylist(), x.column(1).to_pylist(), strict=True):
                    if not told:
                        texts.append(text)
                        counts.append((0 if text is None else text.count("\n") + 1, 0, 0))
                        continue
                    lines = _lines(text)
                    ends = boundaries(lines) if told["chunks"] else []
                    gone = {i for c in told["chunks"] for i in range(ends[c], ends[c + 1])} | {j for i in told["pairs"] for j in (i, i + 1)}
                    gone -= {j for i in told["stay"] for j in (i, i + 1)}
                    texts.append(b"\n".join(line for i, line in enumerate(lines) if i not in gone).decode("utf-8", "surrogatepass"))
                    counts.append((len(lines), sum(i - 1 not in gone for i in gone), len(gone)))
                cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(v, pa.int64()) for v in zip(*counts, strict=True)]], [*own, *ADDED])
        release()

    return both.mapInArrow(run, schema)
