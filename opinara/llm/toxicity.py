"""Toxicity by compression distance.

Two zstandard dictionaries are trained by ``zstandard.train_dictionary``: one on ordinary texts, one
on what the ordinary dictionary leaves of toxic texts, that is on their words that it does not shorten
much.  A text is compressed word by word with both: the bytes that a word needs less with the toxic
dictionary are its distance.  A window is a run of ``WINDOW`` words; its distinct words are counted by
distance, and a logistic calibration of these counts on other labelled texts weighs them.  The score
of a text is that of its most toxic window, by a second calibration on whole texts, so a toxic passage
decides however long the text around it is; 0.7 is the threshold.

Words of a window are compressed one by one, since in one stream the choice of matches elsewhere in
the window moves its length by as many bytes as a telling word does, and behind a fixed frame that
both dictionaries end with, since zstandard does not shorten a few bytes alone.  A letter is written
as a checksum of itself and the ``CONTEXT`` letters before it: a match is then a common run of letters
of some length, and each letter that is not found costs three bytes.

The model is fitted by Spark jobs on a bounded sample (``PER_CLASS`` texts of each class and
``PER_TEXT`` distinct words of each for the dictionaries, by hash); scoring runs over every whole text
in Arrow batches, with no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.memory import release
from opinara.scratch import tidy, written

#: Labelled texts of each class that the model is fitted on at most, and distinct words of one text in the dictionaries.
PER_CLASS, PER_TEXT = 3000, 500
LEVEL, THRESHOLD = 12, 0.7
#: Most bytes of the trained dictionaries; bytes of the segments that training chooses and of the runs that it counts.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, RUN = 8192, 262_144, 48, 8
#: Share of its bytes that the ordinary dictionary must leave of a word on which the toxic one is trained.
LEFT = 0.55
#: Letters that are written together with the one after them.
CONTEXT = 3
#: Words of a window, and words from one window's begin to the next.
WINDOW, STRIDE = 200, 100
#: Distances at which a word goes to the next class.
STEPS = (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 18, 20)
#: Words whose distances a worker keeps at a time.
KEPT = 100_000
FRAME = bytes(range(0x80, 0xA0))
#: Words; longer runs of letters, as of scripts without spaces, are cut.
_WORD = re.compile(r"\w{1,24}")


@dataclass(frozen=True)
class Model:
    #: Contents of the toxic and of the ordinary dictionary.
    contents: tuple[bytes, bytes]
    #: Weights of a window's counts by step, of its words, and the offset.
    weights: tuple[float, ...]
    #: Slope and offset of a text's score, from its most toxic window.
    text: tuple[float, float]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _samples(text: str, key: object) -> list[str]:
    """The distinct words of a text, PER_TEXT at most by hash."""
    own = sorted(set(words_of(text)))
    if len(own) > PER_TEXT:
        own = sorted(sorted(own, key=lambda w: xxhash.xxh64_intdigest(f"{key} {w}".encode("utf-8", "surrogatepass")))[:PER_TEXT])
    return own


def encoded(word: str) -> bytes:
    """Three bytes a letter: a checksum of it and the CONTEXT letters before it."""
    x = f" {word} "
    return b"".join(zlib.crc32(x[max(0, i - CONTEXT) : i + 1].encode("utf-8", "surrogatepass")).to_bytes(4, "little")[:3] for i in range(len(x)))


def train_dictionary(words: list[str], size: int) -> bytes:
    """Content of a dictionary trained on ``words``; the words themselves where they are too few to train on."""
    samples = [encoded(w) for w in words]
    try:
        content = zstandard.train_dictionary(size, samples, k=SEGMENT, d=RUN).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(dict.fromkeys(samples))[-size:]
    return content + FRAME


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of both dictionaries from words of toxic and of ordinary texts."""
    known = train_dictionary(ordinary, ORDINARY_BYTES)
    shorten = _compressor(known)
    none = len(shorten(FRAME))
    x = {w: encoded(w) for w in set(toxic)}
    left = {w for w, e in x.items() if len(shorten(FRAME + e)) - none >= LEFT * len(e)}
    return train_dictionary([w for w in toxic if w in left], TOXIC_BYTES), known


def _compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=256, dict_size=len(d), write_content_size=0, write_dict_id=0, min_match=6, strategy=zstandard.STRATEGY_BTLAZY2)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress


@lru_cache(maxsize=1)
def _compressors(contents: tuple[bytes, bytes]):
    return [_compressor(x) for x in contents], {}


def distance(word: str, contents: tuple[bytes, bytes]) -> int:
    """Bytes that ``word`` needs less with the toxic dictionary."""
    toxic, ordinary = _compressors(contents)[0]
    x = FRAME + encoded(word)
    return len(ordinary(x)) - len(toxic(x))


def windows(text: str | None, contents: tuple[bytes, bytes]) -> np.ndarray:
    """For each window (WINDOW words, from each STRIDE-th word on) its distinct words by step of distance,
    its hundreds of distinct words, and 1.  A shorter text is one window."""
    known = _compressors(contents)[1]
    words = words_of(text)
    rows = []
    for start in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE):
        own = set(words[start : start + WINDOW])
        row = [0] * (len(STEPS) + 1)
        for w in own:
            c = known.get(w)
            if c is None:
                if len(known) >= KEPT:
                    known.clear()
                d = distance(w, contents)
                c = known[w] = sum(d >= s for s in STEPS)
            row[c] += 1
        rows.append([*row[1:], len(own) / 100, 1.0])
    return np.array(rows)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ridge-damped Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 1e-2 * beta
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    slope, offset = model.text
    weights = np.array(model.weights)
    z = np.array([slope * (windows(t, model.contents) @ weights).max() + offset for t in texts])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def _trained(sample: DataFrame) -> tuple[bytes, bytes]:
    """Contents of both dictionaries: words are drawn where the texts are, training is one task's work
    on at most PER_CLASS * PER_TEXT words of each class."""

    def draw(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, toxic, texts = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_samples(t, i) for i, t in zip(ids, texts, strict=True)], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    def train(batches: Iterator[pa.RecordBatch]):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        both = train_dictionaries(*[[w for _, y, words in rows if y == k for w in words] for k in (1, 0)])
        release()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in both], ["toxic", "ordinary"])

    words = sample.select("doc_id", "toxic", "text").mapInArrow(draw, "doc_id long, toxic int, words array<string>")
    return tuple(bytes(x) for x in words.repartition(1).mapInArrow(train, "toxic binary, ordinary binary").first())


def _windows_of(sample: DataFrame, contents: tuple[bytes, bytes]) -> list[tuple[int, np.ndarray]]:
    """(label, windows) of each text of a bounded sample, in order of ids."""
    shared = sample.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = [windows(t, shared.value).astype(np.float32).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "found"])
        _compressors.cache_clear()
        release()

    rows = sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, found binary").collect()
    return [(y, np.frombuffer(x, np.float32).reshape(-1, len(STEPS) + 2).astype(float)) for _, y, x in sorted(tuple(r) for r in rows)]


def calibrate(known: list[tuple[int, np.ndarray]], share: float) -> tuple[tuple[float, ...], tuple[float, float]]:
    """Weights of windows, and slope and offset of texts, from the windows of labelled texts, weighed to
    ``share`` toxic ones."""
    y = np.array([k for k, _ in known], dtype=float)
    if not len(y):
        return (0.0,) * (len(STEPS) + 2), (0.0, -3.0)
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, len(y) - y.sum())) * len(y)
    sizes = np.array([len(w) for _, w in known])
    beta = _logistic(np.concatenate([w for _, w in known]), np.repeat(y, sizes), np.repeat(weight / sizes, sizes))
    worst = np.array([(w @ beta).max() for _, w in known])
    slope, offset = _logistic(np.c_[worst, np.ones(len(y))], y, weight)
    return tuple(map(float, beta)), (float(slope), float(offset)) if slope > 0 else (0.0, -3.0)


@tidy
def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` texts of each class, of rows that are not held out, by hash of the id:
    two of three texts make the dictionaries, the others calibrate, weighed to the true share of toxic rows.

    Rows with a null id, label or text are not used; of rows of one id the least text is.  Without
    labelled texts every score is low.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known, "toxicity-labels")
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(per_class).unionAll(known.filter("toxic = 0").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # 2 * per_class ids at most
    sample = written(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))), "toxicity-sample")
    contents = _trained(sample.filter("part > 0"))
    share = n.get(1, 0) / max(1, sum(n.values()))
    return Model(contents, *calibrate(_windows_of(sample.filter("part = 0"), contents), share))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (score >= threshold).

    Null and empty texts get the score of a text without evidence.  Other columns are kept;
    columns named score or predicted are replaced.  Equal texts get equal scores.  An empty table gives
    an empty one.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                x = b.slice(start, 512)
                s = score_texts(shared.value, x.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*x.schema.names, "score", "predicted"])
        _compressors.cache_clear()
        release()

    return kept.mapInArrow(run, schema)
