"""SentencePiece encoding by sampled segmentations, and lossless decoding.

A text's pieces form a lattice of all vocabulary pieces that occur in it.  Forward filtering sums
the weight of all segmentations up to each character; backward sampling draws a piece from the
end on, in proportion.  Draws are hashes of the row key, the place and the step: the same row gives
the same segmentation anywhere.  No piece has a space but at its beginning, so the lattice falls
into units (a run of spaces and the characters up to the next) that are built once for all equal
units of a batch; draws differ by occurrence.

A piece of rank r in the model weighs (1 / (r + RANK)) ** alpha: the model's own order, nothing is
trained.  Characters without a piece of their own are written as their UTF-8 bytes; so is the
character that the model writes spaces with, which makes decoding exact for every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from opinara.llm.memory import release
from opinara.llm.shingles import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANK, ALPHA, SEED = 50.0, 1.0, 7
#: Characters that a worker segments at a time; units above LONG characters go one by one.
CHUNK, LONG = 250_000, 200
#: Forward sums beyond this, or below one over it, are rescaled.
FAR = 1e100
_SPACE, _ODD = 0x2581, 0x10FFFF + 1
_DENSE = 512
_GOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Vocabulary:
    """The model's pieces as plain data, which goes to the executors in place of a file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes0 = sp.piece_to_id("<0x00>")
        self.pieces = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.ranks = [-sp.get_score(i) for i in range(sp.get_piece_size())]
        spaced = [p for p in self.pieces if p and "▁" in p.lstrip("▁")]
        if spaced or not sp.is_byte(self.bytes0):
            raise ValueError("the model needs byte pieces, and spaces at the beginning of pieces only")


class _Trie:
    def __init__(self, vocabulary: Vocabulary, alpha: float):
        next_, piece, n = {}, [-1], 1
        chars = {_SPACE: 1}
        for i, p in enumerate(vocabulary.pieces):
            if not p:
                continue
            node = 0
            for ch in p:
                c = chars.setdefault(ord(ch), len(chars) + 1)
                to = next_.get((node, c))
                if to is None:
                    to = next_[node, c] = n
                    piece.append(-1)
                    n += 1
                node = to
            piece[node] = i
        self.piece = np.array(piece, np.int32)
        self.depth = max(len(p) for p in vocabulary.pieces if p)
        # a table of the first _DENSE character classes, a sorted list for the others
        self.classes = np.zeros(_ODD + 1, np.uint16)
        for ch, c in chars.items():
            self.classes[ch] = c
        self.dense = np.full((n, _DENSE // 4), -1, np.int32)
        sparse = []
        for (node, c), to in next_.items():
            if c < self.dense.shape[1]:
                self.dense[node, c] = to
            else:
                sparse.append(((node << 16) | c, to))
        sparse.sort()
        self.keys = np.array([k for k, _ in sparse] or [-1], np.int64)
        self.to = np.array([t for _, t in sparse] or [-1], np.int32)
        self.weight = np.array([(1.0 / (max(0.0, r) + RANK)) ** alpha if p else 0.0 for r, p in zip(vocabulary.ranks, vocabulary.pieces, strict=True)])
        self.byte_weight = (1.0 / (len(vocabulary.pieces) + RANK)) ** alpha
        self.bytes0 = vocabulary.bytes0
        self.surface = [(p or "").replace("▁", " ").encode() for p in vocabulary.pieces]
        for b in range(256):
            self.surface[self.bytes0 + b] = bytes([b])
        self.size = np.array([len(b) for b in self.surface], np.int32)
        self.begin = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(self.surface), np.uint8)
        self.scale = self.weight[self.weight > 0].mean() ** (-1 / 3)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        c = self.classes[chars].astype(np.int64)
        wide = c >= self.dense.shape[1]
        out = self.dense[nodes, np.where(wide, 0, c)]
        if wide.any():
            k = (nodes[wide].astype(np.int64) << 16) | c[wide]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[wide] = np.where(self.keys[at] == k, self.to[at], -1)
        return out


_tries: dict = {}


def _trie(vocabulary: Vocabulary, alpha: float) -> _Trie:
    key = (len(vocabulary.pieces), hash(tuple(vocabulary.pieces)), alpha)
    if key not in _tries:
        _tries.clear()
        _tries[key] = _Trie(vocabulary, alpha)
    return _tries[key]


@lru_cache(maxsize=4096)
def _utf8(code: int) -> bytes:
    return chr(_SPACE if code == _ODD else code).encode("utf-8", "surrogatepass")


def _symbols(text: str) -> np.ndarray:
    """Code points after a leading space, spaces as the model writes them."""
    c = np.frombuffer(f" {text}".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    c[c == _SPACE] = _ODD
    c[c == 0x20] = _SPACE
    return c


def _lattice(t: _Trie, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position and length - 1 the weight and the piece of the edge that begins there; ends:
    for each position the end of its unit."""
    n = len(chars)
    weight, piece = np.zeros((t.depth, n)), np.full((t.depth, n), -1, np.int32)
    at, nodes = np.arange(n), np.zeros(n, np.int32)
    for length in range(t.depth):
        nodes = t.step(nodes, chars[at + length])
        ok = nodes >= 0
        at, nodes = at[ok], nodes[ok]
        p = t.piece[nodes]
        has = p >= 0
        piece[length, at[has]] = p[has]
        weight[length, at[has]] = t.weight[p[has]] * t.scale ** (length + 1)
        ok = at + length + 1 < ends[at]
        at, nodes = at[ok], nodes[ok]
        if not len(at):
            break
    weight, piece = weight[: length + 1], piece[: length + 1]
    alone = np.flatnonzero(piece[0] < 0)
    c = chars[alone]
    size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    size[c == _ODD] = 3
    piece[0, alone] = np.where(c < 0x80, t.bytes0 + c, -2 - c)
    weight[0, alone] = t.byte_weight**size * t.scale
    return weight, piece


def _forward(weight: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulated probabilities of the length of the last piece, for each node (a position and the end
    of each unit has one), and the node of each unit's begin."""
    depth, n = weight.shape
    first = begin + np.arange(len(begin))
    nodes = n + len(begin)
    # edges by the node they end at, longest first: column j has length depth - j
    into = np.zeros((nodes, depth))
    unit = np.repeat(np.arange(len(begin)), size)
    for length in range(1, depth + 1):
        some = np.flatnonzero(weight[length - 1])
        into[some + unit[some] + length, depth - length] = weight[length - 1, some]
    total = np.zeros(nodes + depth)
    total[first + depth] = 1.0
    before = np.lib.stride_tricks.sliding_window_view(total, depth)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    count = np.searchsorted(-size[order], -np.arange(longest + 1), "right")
    start = first[order]
    for i in range(1, longest + 1):
        node = start[: count[i]] + i
        share = into[node]
        share *= before[node]
        sums = share.sum(1)
        share /= sums[:, None]
        into[node] = share
        total[node + depth] = sums
        far = (sums < 1 / FAR) | (sums > FAR)
        if far.any():
            # only ratios count: the sums that later nodes of the unit read are divided by the last one
            at = node[far][:, None] + depth - np.arange(min(i + 1, depth))
            total[at] /= sums[far][:, None]
    cum = into[:, ::-1].astype(np.float32)
    np.cumsum(cum, axis=1, out=cum)
    # rounding must not lead beyond the longest piece there is
    cum[cum >= 1 - 5e-7] = 2.0
    return cum, first


def _draw(key: np.ndarray, step: int) -> np.ndarray:
    return ((mix(key + np.uint64((step * int(_STEP)) & (2**64 - 1))) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def _long_unit(t: _Trie, chars: np.ndarray, key: np.uint64) -> list[int]:
    """One unit of any length: the same sums in logarithms."""
    n = len(chars)
    weight, piece = _lattice(t, chars, np.full(n, n))
    log = [0.0] + [-math.inf] * n
    for i in range(1, n + 1):
        terms = [log[i - k] + math.log(w) for k in range(1, min(i, len(weight)) + 1) if (w := weight[k - 1, i - k]) > 0]
        m = max(terms)
        log[i] = m + math.log(sum(math.exp(x - m) for x in terms))
    out, i, step = [], n, 0
    while i:
        u, s = float(_draw(np.array([key]), step)[0]), 0.0
        for k in range(1, min(i, len(weight)) + 1):
            if (w := weight[k - 1, i - k]) > 0:
                last = k
                s += math.exp(log[i - k] + math.log(w) - log[i])
                if u < s:
                    break
        out.append(int(piece[last - 1, i - last]))
        i -= last
        step += 1
    return out[::-1]


def _segment(t: _Trie, texts: list[str], keys: list[int]) -> list[np.ndarray]:
    """Piece ids of each text."""
    parts = [_symbols(x) for x in texts]
    sizes = np.array([len(p) for p in parts])
    chars = np.concatenate(parts)
    del parts
    # units begin at a text's begin, at a run of spaces, and before and after a line feed
    cut = np.zeros(len(chars), bool)
    cut[np.cumsum(sizes) - sizes] = True
    cut[1:] |= (chars[1:] == _SPACE) & (chars[:-1] != _SPACE)
    feed = chars == 10
    cut |= feed
    cut[1:] |= feed[:-1]
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], len(chars)]
    size = end - begin
    text_of = np.searchsorted(np.cumsum(sizes), begin, "right")
    ordinal = np.arange(len(begin)) - np.searchsorted(text_of, text_of)
    key = mix(np.array(keys, np.uint64)[text_of] + ordinal.astype(np.uint64) * _GOLD)
    # equal units by a hash of their characters
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), _STEP | np.uint64(1))], dtype=np.uint64)
    h = np.add.reduceat(mix(chars.astype(np.uint64)) * power[np.arange(len(chars)) - np.repeat(begin, size)], begin)
    _, sample, unit = np.unique(mix(h) + size.astype(np.uint64), return_index=True, return_inverse=True)
    short = size[sample] <= LONG
    number = np.cumsum(short) - 1
    own = sample[short]
    ubegin = np.cumsum(size[own]) - size[own]
    src = np.repeat(begin[own] - ubegin, size[own]) + np.arange(size[own].sum())
    uchars = chars[src]
    weight, piece = _lattice(t, uchars, np.repeat(ubegin + size[own], size[own]))
    cum, first = _forward(weight, ubegin, size[own])

    occ = np.flatnonzero(short[unit])
    u = number[unit[occ]]
    left, node = size[own][u].copy(), first[u] + size[own][u]
    shift = first[u] - ubegin[u]
    steps, counts = [], np.zeros(len(begin), np.int64)
    k = key[occ]
    for step in range(LONG + 1):
        if not len(occ):
            break
        length = (cum[node] <= _draw(k, step)[:, None]).sum(1) + 1
        node = node - length
        steps.append((occ, piece[length - 1, node - shift]))
        counts[occ] += 1
        left = left - length
        go = left > 0
        occ, node, shift, left, k = occ[go], node[go], shift[go], left[go], k[go]
    long = {int(i): _long_unit(t, chars[begin[i] : end[i]], key[i]) for i in np.flatnonzero(~short[unit])}
    for i, ids in long.items():
        counts[i] = len(ids)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), np.int64)
    for step, (o, p) in enumerate(steps):
        out[ends[o] - 1 - step] = p
    for i, ids in long.items():
        out[ends[i] - counts[i] : ends[i]] = ids
    upto = ends[np.searchsorted(text_of, np.arange(len(texts)), "right") - 1]
    if (out < 0).any():
        # characters that are written as bytes
        n = np.ones(len(out), np.int64)
        odd = np.flatnonzero(out < 0)
        raw = [_utf8(int(-2 - c)) for c in out[odd]]
        n[odd] = [len(b) for b in raw]
        new_ends = np.cumsum(n)
        wide = np.repeat(out, n)
        for i, b in zip(odd, raw, strict=True):
            wide[new_ends[i] - len(b) : new_ends[i]] = np.frombuffer(b, np.uint8) + t.bytes0
        out, upto = wide, new_ends[upto - 1]
    return np.split(out.astype(np.int32), upto[:-1])


def _row_key(key, seed: int) -> int:
    return xxhash.xxh64_intdigest(repr(key), seed)


def segment_texts(vocabulary: Vocabulary, texts: list[str | None], keys: list, alpha: float = ALPHA, seed: int = SEED) -> list[np.ndarray | None]:
    """Sampled piece ids of each text; None for a null text, no pieces for an empty one."""
    t = _trie(vocabulary, alpha)
    out: list[np.ndarray | None] = [None if x is None else np.zeros(0, np.int32) for x in texts]
    held, n = [], 0

    def close():
        if held:
            for i, ids in zip(held, _segment(t, [texts[i] for i in held], [_row_key(keys[i], seed) for i in held]), strict=True):
                out[i] = ids
        held.clear()

    for i, x in enumerate(texts):
        if x:
            if held and n + len(x) > CHUNK:
                close()
                n = 0
            held.append(i)
            n += len(x) + 1
    close()
    return out


def decode_all(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of piece ids that stand one after another, each up to one of ``ends``."""
    t = _trie(vocabulary, ALPHA)
    size = t.size[ids]
    upto = np.cumsum(size, dtype=np.int64)
    # where each byte stands in the table of surfaces
    at = np.repeat(t.begin[ids] - (upto - size), size)
    raw = t.raw[at + np.arange(len(at))].tobytes()
    cut = np.r_[0, upto][ends].tolist()
    return [raw[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip([0, *cut[:-1]], cut, strict=True)]


def decode_ids(vocabulary: Vocabulary, ids: list[int] | None) -> str | None:
    return None if ids is None else decode_all(vocabulary, np.array(ids, np.int64), np.array([len(ids)]))[0]


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, at: int, by: int, alpha: float, seed: int, to: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 256):
            x = b.slice(start, 256)
            ids = segment_texts(vocabulary, x.column(at).to_pylist(), x.column(by).to_pylist(), alpha, seed)
            ends = np.cumsum([0 if i is None else len(i) for i in ids])
            flat = np.concatenate([np.zeros(0, np.int32), *[i for i in ids if i is not None]])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat), mask=pa.array([i is None for i in ids]))
            yield pa.RecordBatch.from_arrays([*x.columns, lists], [*x.schema.names, to])
        release()


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, at: int, to: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 256):
            x = b.slice(start, 256)
            lists = x.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([n or 0 for n in lists.value_lengths().to_pylist()])
            texts = [y if ok else None for y, ok in zip(decode_all(vocabulary, flat, ends), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(texts, pa.string())], [*x.schema.names, to])
    release()


def encode(docs: DataFrame, vocabulary: Vocabulary, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id", column: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with an array of sampled piece ids for each whole text.

    A null text gives null, an empty one no pieces; rows with equal key and text get equal ids, a
    null key is a key.  Other columns are kept, one named ``to`` is replaced.
    """
    own = [c for c in docs.columns if c != to]
    kept = docs.select(*[docs[f"`{c}`"] for c in own])
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    at, by = own.index(column), own.index(key)
    return kept.mapInArrow(lambda batches: _encoded(batches, shared.value, at, by, alpha, seed, to), schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids in ``column`` were made from; null ids give null."""
    own = [c for c in rows.columns if c != to]
    kept = rows.select(*[rows[f"`{c}`"] for c in own])
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.StringType())])
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    at = own.index(column)
    return kept.mapInArrow(lambda batches: _decoded(batches, shared.value, at, to), schema)


def encode_and_verify(docs: DataFrame, vocabulary: Vocabulary, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id", column: str = "text", to: str = "ids", proof: str = "lossless") -> DataFrame:
    """:func:`encode` without the text but with a column ``proof``: whether the ids decode to it (null: to null).

    Both steps of a batch are one worker's, so a task needs one Python process and no decoded text leaves it.
    """
    own = [c for c in docs.columns if c not in (to, proof)]
    kept = docs.select(*[docs[f"`{c}`"] for c in own])
    others = [c for c in own if c != column]
    schema = T.StructType([*kept.drop(column).schema.fields, T.StructField(to, T.ArrayType(T.IntegerType())), T.StructField(proof, T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    at, by, ids = own.index(column), own.index(key), len(own)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in _decoded(_encoded(batches, shared.value, at, by, alpha, seed, to), shared.value, ids, proof):
            same = [x == y for x, y in zip(b.column(at).to_pylist(), b.column(ids + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(own.index(c)) for c in others], b.column(ids), pa.array(same, pa.bool_())], [*others, to, proof])

    return kept.mapInArrow(run, schema)
