"""Language identification of mixed-language texts by words.

Script ranges narrow a word's languages to those that use its first letter's script.  Each
language has log-probabilities of letter n-grams, trained by a Spark job over a bounded sample of
labelled texts; a word's score in a language is their sum.  Viterbi over the words, with a
penalty for a switch, labels spans; the text's language is that of most letters.

Batches of texts go through the Viterbi steps together, longest first, so each step is one array
operation over the texts that still have words; nothing is shuffled but n-gram counts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled texts of each language that the model is fitted on at most, and n-grams of each.
PER_LANGUAGE, PER_MODEL = 2000, 20_000
ORDERS = (1, 2, 3)
SWITCH = 6.0
#: A word's evidence is bounded, so that one odd word can't outweigh its neighbours.
BOUND = 12.0
#: A word's evidence against languages that don't use its script; no neighbours outweigh it.
BARRED = 1000.0
#: Begins the names of scripts among the n-grams; no word has it.
_MARK = "\x00"
#: Words whose scores a worker keeps at a time.
KEPT = 200_000
# Unicode script blocks, as (first, last) code points.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x531, 0x58F),)),
    ("hebrew", ((0x591, 0x5F4),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
)


def _ranges(wanted, last: int) -> str:
    """The characters of some general categories up to ``last``, as ranges of a regular expression."""
    codes = [c for c in range(last + 1) if wanted(unicodedata.category(chr(c)))]
    cut = [i for i in range(len(codes)) if i == 0 or codes[i] != codes[i - 1] + 1]
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}" for a, b in zip(cut, [*cut[1:], len(codes)], strict=True))


@lru_cache(maxsize=1)
def _every_word() -> re.Pattern:
    """A letter, and letters and combining marks after it: marks are parts of words in many scripts."""
    letters, marks = (_ranges(lambda k, x=x: k[0] == x, sys.maxunicode) for x in "LM")
    return re.compile(f"[{letters}][{letters}{marks}]*")


#: Words of texts without the characters that Python's classes take for letters though they are none, and without marks.
_PLAIN = re.compile(r"[^\W\d_]+")
_ODD = re.compile(f"[{_ranges(lambda k: k[0] == 'M' or k in ('Nl', 'No'), 0xFFFF)}\U00010000-\U0010ffff]")


@lru_cache(maxsize=4096)
def script_of(ch: str) -> str:
    c = ord(ch)
    return next((name for name, ranges in SCRIPTS if any(a <= c <= b for a, b in ranges)), "other")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and the marks among them, lower-cased."""
    text = (text or "").lower()
    return (_every_word() if _ODD.search(text) else _PLAIN).findall(text)


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    grams: dict[str, int]
    table: np.ndarray
    scripts: dict[str, np.ndarray]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows (text, lang, doc_id) of each language, by hash of the id.

    Rows with null text or lang are not used.  n-grams are counted by Spark; the ``PER_MODEL`` most
    frequent of each language make the model.
    """
    known = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]):
        total: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.text, b.lang, strict=True):
                c = total.setdefault(lang, Counter())
                for w, n in Counter(words_of(text)).items():
                    for g in _grams(w):
                        c[g] += n
                    c[f"{_MARK}{script_of(w[0])}"] += n
        for lang, c in total.items():
            if c:  # texts of a language without any letter count nothing
                yield pd.DataFrame({"lang": lang, "gram": list(c), "n": list(c.values())})

    sums = drawn.select("text", "lang").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(W.partitionBy("lang").orderBy(F.col("gram").startswith(_MARK).desc(), F.desc("n"), "gram"))
    top: dict[str, dict[str, int]] = {lang: {} for lang in sorted(sizes)}
    for r in sums.filter("n > 1").withColumn("i", best).filter(F.col("i") <= PER_MODEL + len(SCRIPTS) + 1).collect():  # PER_MODEL rows a language
        top[r.lang][r.gram] = r.n
    langs = tuple(sorted(top))
    scripts: dict[str, np.ndarray] = {}
    for i, lang in enumerate(langs):
        own = {g[1:]: n for g, n in top[lang].items() if g[0] == _MARK}
        for name, n in own.items():
            if n >= 0.01 * sum(own.values()):
                scripts.setdefault(name, np.zeros(len(langs), bool))[i] = True
    total = np.array([max(1, sum(n for g, n in top[x].items() if g[0] != _MARK)) for x in langs], dtype=float)
    unseen = np.log(0.5 / total)
    grams: dict[str, int] = {}
    rows = [np.zeros(len(langs))]
    for i, lang in enumerate(langs):
        for g, n in top[lang].items():
            if g[0] != _MARK:
                if g not in grams:
                    grams[g] = len(rows)
                    rows.append(unseen.copy())
                rows[grams[g]][i] = np.log(n / total[i])
    # an n-gram of no language says nothing
    return Model(langs, grams, np.array(rows), scripts)


class _Scores:
    """Scores of words, kept from batch to batch."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table = model, {}, np.zeros((KEPT, len(model.langs)), np.float32)
        # an n-gram as a number: its code points, 21 bits each; no n-gram is 0
        known = sorted((sum(ord(c) << 21 * i for i, c in enumerate(reversed(g))), r) for g, r in model.grams.items()) or [(0, 0)]
        self.keys, self.at = np.array([k for k, _ in known], np.uint64), np.array([r for _, r in known])

    def of(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``table``; valid until the next call."""
        rows, fresh = self.rows, []
        if len(rows) > KEPT // 2:
            rows.clear()
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            r = rows.get(w)
            if r is None:
                r = rows[w] = len(rows)
                fresh.append(w)
            out[i] = r
        if len(rows) > len(self.table):
            self.table = np.vstack([self.table, np.zeros((len(rows), self.table.shape[1]), np.float32)])
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            first = len(rows) - len(fresh) + a
            self.table[first : first + len(part)] = self._score(part)
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        """Summed log-probabilities of the n-grams of `` word ``, all words at once, and the bounds."""
        m = self.model
        code = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
        s = np.zeros((len(words), len(m.langs)))
        key = code
        for n in ORDERS:
            if n > 1:
                key = (key[:-1] << np.uint64(21)) | code[n - 1 :]
            own = of[: len(key)] == of[n - 1 :]
            at = np.minimum(np.searchsorted(self.keys, key[own]), len(self.keys) - 1)
            found = np.where(self.keys[at] == key[own], self.at[at], 0)
            begin = np.flatnonzero(np.diff(of[: len(key)][own], prepend=-1))
            s += np.add.reduceat(m.table[found], begin, axis=0)
        none = np.ones(len(m.langs), bool)
        may = np.array([m.scripts.get(script_of(w[0]), none) for w in words])
        s = np.where(may, s, -np.inf)
        return np.where(may, np.maximum(s - s.max(1, keepdims=True), -BOUND), -BARRED)


def _viterbi(table: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label of each word of texts that stand one after another, in as many bytes as the languages need."""
    order = np.argsort(-lengths, kind="stable")
    size, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    longest, n_lang = int(size[0]) if len(size) else 0, table.shape[1]
    active = np.searchsorted(-size, -np.arange(longest), "left")
    v = np.zeros((len(size), n_lang), np.float32)
    kind = np.min_scalar_type(max(0, n_lang - 1))
    back = np.zeros((len(rows), n_lang), kind)
    own = np.arange(n_lang, dtype=kind)
    for t in range(longest):
        a = active[t]
        at = begin[:a] + t
        s = table[rows[at]]
        if t:
            best = v[:a].argmax(1)
            jump = v[np.arange(a), best][:, None] - np.float32(SWITCH)
            stay = v[:a] >= jump
            back[at] = np.where(stay, own, best[:, None].astype(kind))
            s = s + np.where(stay, v[:a], jump)
            if t % 256 == 0:
                s -= s.max(1, keepdims=True)
        v[:a] = s
    label = np.zeros(len(rows), kind)
    now = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        label[at] = now[: active[t]]
        now[: active[t]] = back[at, now[: active[t]]]
    return label


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of letters in its spans (0 to 1).

    Null texts, and texts without a letter, get ``und`` and 0.  With ``spans``, a column of (first
    word, number of words, language) spans is added.  Other columns are kept, those of the same
    names replaced.  Equal shares go to the language that comes first.  Without a trained language
    all rows are ``und``.
    """
    added = ["lang_pred", "score", *["spans"] * spans]
    own = [c for c in docs.columns if c not in added]
    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index("text")
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("spans", span)] * spans])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        scores = _Scores(m)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                x = batch.slice(start, 1024)
                texts = [words_of(t) if m.langs else [] for t in x.column(at).to_pylist()]
                lengths = np.array([len(t) for t in texts])
                flat = [w for t in texts for w in t]
                rows = scores.of(flat)
                label = _viterbi(scores.table, rows, lengths) if m.langs else np.zeros(0, np.uint8)
                doc = np.repeat(np.arange(len(texts)), lengths)
                letters = np.zeros((len(texts), max(1, len(m.langs))))
                np.add.at(letters, (doc, label), [len(w) for w in flat])
                best, total = letters.argmax(1), letters.sum(1)
                names = [m.langs[b] if n else "und" for b, n in zip(best, total, strict=True)]
                share = letters.max(1) / np.maximum(total, 1)
                more = []
                if spans:
                    ends = np.cumsum(lengths)
                    more = [pa.array([_runs(label[e - n : e], m.langs) for e, n in zip(ends, lengths, strict=True)], arrow_span)]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(names, pa.string()), pa.array(share), *more], [*x.schema.names, *added])

    return kept.mapInArrow(run, schema)


def _runs(label: np.ndarray, langs: tuple[str, ...]) -> list[dict]:
    cut = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, np.int64)
    return [{"first": int(a), "words": int(b - a), "lang": langs[label[a]]} for a, b in zip(cut, np.r_[cut[1:], len(label)], strict=False)]
