"""Best-fit packing of token sequences by bin completion.

Documents are tokenized where they lie and cut into pieces of at most ``capacity`` tokens.  Packing
needs the pieces' lengths alone, and of these only how many pieces have each length: a table of at
most ``capacity`` rows, whatever the input.  On it a search of whole fillings runs, each used as
often as the pieces last:

* best fit, longest pieces first, gives the first incumbent;
* branch and bound completes one sequence at a time around the longest piece that is left.  It
  enumerates the undominated fillings of the rest (none in which pieces could be changed for one
  that is longer, or several for one of their length), least waste first;
* a branch goes when its waste shows that it cannot beat the incumbent, the search ends when the
  incumbent meets a lower bound, and best fit completes each node to a new incumbent.

The result is a list of fillings with the number of their uses.  Pieces of one length are alike, so
the n-th piece of a length, counted by tasks and prefix sums over tasks, finds its place in it by a
binary search.  No piece leaves Spark, and no length is gathered in one task.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.memory import release
from opinara.scratch import small_side, tidy, written

CAPACITY, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Nodes of the search, fillings that a node branches on, and steps of their enumeration.  They bound the
#: search for fewer sequences, not what is packed.
NODES, FILLINGS, STEPS = 60, 8, 4000
#: Words of which a worker keeps the ids, and bytes of text that it tokenizes at a time.
KEPT, CHUNK = 300_000, 8_000_000
#: Letters below this code point, marks that may follow them, and how many.
PLAIN, MARKS, MOST_MARKS = 0x250, ".,!?;:", 3
#: Pieces of one length are numbered in this many bits.
_RANK_BITS = 48

Filling = tuple[tuple[int, int], ...]


# ---- tokens


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_coders: dict[str, WordCoder] = {}


class WordCoder:
    """Ids of texts, as the tokenizer gives them, by way of their distinct words.

    The tokenizer drops white space and its pieces never span it, so a text's ids are those of its
    words in a row.  It also splits plain letters from a mark after them, so such a word's ids are those of
    its letters and of its marks.  Letters, normalised one by one by the tokenizer's own normaliser, go straight
    to its merges; all other words go through it whole.  Ids of words are kept from batch to batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        spelled, normal = ByteLevel(add_prefix_space=False, use_regex=False), self.tokenizer.normalizer.normalize_str
        alone = [c for c in map(chr, range(PLAIN)) if c.isalpha() and normal(c).isalpha()]
        #: What a letter becomes before the merges.
        self.table = {ord(c): "".join(x for x, _ in spelled.pre_tokenize_str(normal(c))) for c in alone}
        self.plain = f"^[{''.join(alone)}]+$"

    @classmethod
    def of(cls, path: str) -> WordCoder:
        """The worker's own, built once."""
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def _ids(self, words: pa.Array, plain: np.ndarray) -> pa.Array:
        """Ids of distinct words, as bytes."""
        known, model, table, others = self.known, self.tokenizer.model, self.table, []
        if len(known) > KEPT:
            known.clear()
            known[""] = b""
        every = words.to_pylist()
        for w, p in zip(every, plain.tolist(), strict=True):
            if w not in known:
                if p:
                    pieces = model.tokenize(w.translate(table))
                    known[w] = struct.pack(f"<{len(pieces)}I", *[x.id for x in pieces])
                else:
                    others.append(w)
        for a in range(0, len(others), 20_000):
            some = others[a : a + 20_000]
            coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            known.update((w, struct.pack(f"<{len(e)}I", *e.ids)) for w, e in zip(some, coded, strict=True))
        return pa.array([known[w] for w in every], pa.large_binary())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all ids in a row, and where each text's end; a null text has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.dictionary_encode(split.flatten())
        words = coded.dictionary
        heads = pc.utf8_rtrim(words, characters=MARKS)
        marks = pc.subtract(pc.utf8_length(words), pc.utf8_length(heads))
        plain = pc.and_(pc.match_substring_regex(heads, self.plain), pc.less_equal(marks, MOST_MARKS))
        heads = pc.if_else(plain, heads, words)
        tails = pa.nulls(len(words), pa.string()).fill_null("")
        for n in range(1, MOST_MARKS + 1):
            tails = pc.if_else(pc.and_(plain, pc.equal(marks, n)), pc.utf8_slice_codeunits(words, start=-n, stop=None), tails)
        parts = []
        for some in (heads, tails):
            d = pc.dictionary_encode(some)
            alone = np.asarray(pc.match_substring_regex(d.dictionary, self.plain))
            parts.append(self._ids(d.dictionary, alone).take(d.indices))
        taken = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")
        before = np.r_[0, np.cumsum(np.asarray(pc.binary_length(taken), np.int64)) // 4]
        return ids[: before[-1]], before[np.cumsum(np.asarray(pc.list_value_length(split)))]


def pieces_of(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids, part, nth) of all documents; ``ids`` are little-endian
    unsigned 32-bit numbers, ``nth`` numbers the pieces of one length in partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]):
        coder, part, seen = WordCoder.of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0)))
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                rows, texts = b.column(0).slice(at, upto - at), b.column(1).slice(at, upto - at)
                ids, ends = coder.encode(texts)
                counts = np.diff(np.r_[0, ends]) + 1
                full = np.insert(ids, ends, np.uint32(end)).astype("<u4")
                pieces = -(-counts // capacity)
                own = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[own] - start)
                offsets = np.r_[0, np.cumsum(length)]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(full).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
                cols = [rows.take(pa.array(own)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(full)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*cols, body, pa.array(np.full(len(own), part, np.int32)), pa.array(nth)], names)
                at = upto
        release()

    source = docs.select(F.col(key), F.col(text).cast("string"))
    names = [key, "piece", "start", "length", "ids_crc32", "ids", "part", "nth"]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.IntegerType(), T.LongType()]
    return source.mapInArrow(run, T.StructType([source.schema[0], *[T.StructField(n, t) for n, t in zip(names[1:], kinds, strict=True)]]))


# ---- the search, on numbers of pieces by length


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by the sum of lengths, and by pieces that no two of share a sequence."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    number, total = np.zeros(capacity + 2, object), np.zeros(capacity + 2, object)
    for n, c in counts.items():
        number[n], total[n] = c, n * c
    number, total = np.cumsum(number[::-1])[::-1], np.cumsum(total[::-1])[::-1]  # pieces of at least this length
    half = capacity // 2 + 1
    for least in {0, *(n for n in counts if 2 * n <= capacity)}:
        alone, pairs = number[capacity - least + 1], number[half] - number[capacity - least + 1]
        room = pairs * capacity - (total[half] - total[capacity - least + 1])
        small = total[least] - total[half] if least else total[0] - total[half]
        best = max(best, alone + pairs + max(0, -(-(small - room) // capacity)))
    return int(best)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Longest pieces first, each in the fullest sequence that takes it: (times, filling).  Sequences that are
    filled alike move together."""
    open_: dict[int, list[tuple[int, Filling]]] = {}
    mask = 0  # bit r: some sequence has room for r tokens
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = mask >> length
            room, times, filling = capacity, left, ()
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                times, filling = open_[room].pop()
                if not open_[room]:
                    mask &= ~(1 << room)
            use = min(room // length, left)
            n = min(times, left // use)
            if filling and times > n:
                open_.setdefault(room, []).append((times - n, filling))
                mask |= 1 << room
            room -= use * length
            open_.setdefault(room, []).append((n, (*filling, (length, use))))
            mask |= 1 << room
            left -= n * use
    return [x for some in open_.values() for x in some]


def dominated(filling: Filling, counts: dict[int, int], there: int, slack: int) -> bool:
    """Whether some of the pieces could give way to one left out that is longer and fits, or several to one
    of their length.  ``filling`` is without the longest piece; bit n of ``there``: counts has pieces of length n."""
    rest = there
    one, more = 0, 0  # sums of one piece, of several
    for n, c in filling:
        if c == counts[n]:
            rest &= ~(1 << n)
        for _ in range(c):
            more |= (one | more) << n
            one |= 1 << n
    if more & rest:
        return True
    longer, width = (1 | one | more) << 1, 1  # sums + 1 .. sums + slack
    if not slack:
        return False
    while width < slack:
        step = min(width, slack - width)
        longer |= longer << step
        width += step
    return bool(longer & rest)


def fillings(counts: dict[int, int], room: int, spare: int, most: int = FILLINGS, steps: int = STEPS) -> list[tuple[int, Filling]]:
    """(waste, filling) of ``room`` by pieces of ``counts``: undominated, of at most ``spare`` waste, the least
    first.  Depth first with long pieces first; the search looks at ``steps`` fillings and keeps ``most``."""
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    found: list[tuple[int, Filling]] = []
    # sum of all pieces from here on: a rest that they cannot fill up to ``spare`` is no filling
    after = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        after[i] = after[i + 1] + lengths[i] * counts[lengths[i]]
    there, negative = sum(1 << n for n, c in counts.items() if c), [-n for n in lengths]
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack and steps > 0 and len(found) < most:
        at, left, filling = stack.pop()
        steps -= 1
        at = max(at, bisect_left(negative, -left))
        if left - after[at] > spare:
            continue
        if at == len(lengths):
            if not dominated(filling, counts, there, left):
                found.append((left, filling))
            continue
        n = lengths[at]
        stack += [(at + 1, left - n * use, (*filling, (n, use)) if use else filling) for use in range(min(counts[n], left // n) + 1)]
    return sorted(found, key=lambda x: x[0])


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, Filling]]:
    """(times, filling) in as few sequences as are found for ``counts`` pieces of each length.

    Optimal if a lower bound is met or the search ends before ``nodes``.
    """
    counts = {n: c for n, c in counts.items() if c}
    total, least = sum(n * c for n, c in counts.items()), least_sequences(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(t for t, _ in best)

    def branches(counts: dict[int, int], waste: int):
        """(times, filling) around the longest piece, as often as the pieces last, then once."""
        n = max(counts)
        rest = dict(counts)
        rest[n] -= 1
        for w, filling in fillings(rest, capacity - n, (fewest - 1) * capacity - total - waste):
            need = Counter(dict(filling))
            need[n] += 1
            whole = tuple(sorted(need.items(), reverse=True))
            times = min(counts[x] // u for x, u in whole)
            for t in {times: None, 1: None}:
                yield t, whole, w * t

    # one frame for each open node: what is left, its waste, the fillings taken up to it, its branches
    stack = [(counts, 0, (), branches(counts, 0))] if fewest > least else []
    while stack and nodes > 0 and fewest > least:
        left, waste, taken, more = stack[-1]
        step = next(more, None)
        if step is None:
            stack.pop()
            continue
        t, filling, w = step
        if waste + w > (fewest - 1) * capacity - total:  # cannot beat the incumbent
            continue
        nodes -= 1
        after = dict(left)
        for n, u in filling:
            after[n] -= u * t
            if not after[n]:
                del after[n]
        path = (taken, (t, filling))
        tail, head = best_fit(after, capacity), []
        at = path
        while at:
            at, x = at
            head.append(x)
        if (n := sum(t for t, _ in head) + sum(t for t, _ in tail)) < fewest:
            fewest, best = n, head + tail
        if after:
            stack.append((after, waste + w, path, branches(after, waste + w)))
    return best


def places(plan: list[tuple[int, Filling]]) -> np.ndarray:
    """Rows (key, sequence, use, offset, length) by key: pieces of a length from a number on (both in the
    key) go ``use`` at a time to sequences from ``sequence`` on, at ``offset``."""
    taken, rows, sequence = Counter(), [], 0
    for times, filling in plan:
        offset = 0
        for n, use in filling:
            rows.append(((n << _RANK_BITS) + taken[n], sequence, use, offset))
            taken[n] += use * times
            offset += n * use
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


@tidy
def pack_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, nodes: int = NODES) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids, sequence_id, offset): one row a piece.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone.  Only longer documents than
    ``capacity`` are cut.  Pieces fill their sequence without gaps from 0 on.  Rows that repeat an
    id, or have none, are packed each on its own.  Other columns are ignored; an empty table gives an
    empty one.  Which of several pieces of one length goes where follows the order of the input.
    """
    pieces = written(pieces_of(docs, path or vocabulary_path(), key, text, capacity, end), "packing-pieces")
    counts = written(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "packing-counts")
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    # the plan has at most capacity / length rows more for each length than there are lengths
    shared = docs.sparkSession.sparkContext.broadcast(places(complete(by_length, capacity, nodes)))
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(small_side(written(before, "packing-before")), ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]):
        plan = shared.value
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank"))
            at = plan[np.searchsorted(plan[:, 0], (length << _RANK_BITS) + rank, "right") - 1] if len(rank) else plan[:0]
            n = (length << _RANK_BITS) + rank - at[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at[:, 1] + n // at[:, 2]), pa.array(at[:, 3] + n % at[:, 2] * length)], [*own, "sequence_id", "offset"])

    own = [key, "piece", "start", "length", "ids_crc32", "ids"]
    found = ranked.select(*[F.col(f"`{c}`") for c in own], (F.col("nth") + F.col("before")).alias("rank"))
    return found.mapInArrow(place, T.StructType([*found.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
