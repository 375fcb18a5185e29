"""Dictionary words in text: a trie of code points as plain arrays, walked from all places of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Code points that are walked at a time.
SLICE = 1 << 17
#: Bits of a code point in an edge.
_BITS = 21


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@dataclass(frozen=True)
class WordTrie:
    """Edges as sorted numbers (node, code point); edge k leads to node k + 1, the root is node 0.

    Nodes are numbered level by level, so the edges of all levels together are in order and a step is
    one binary search.
    """

    edges: np.ndarray
    #: Whether a word ends at a node.
    ends: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> WordTrie:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat, starts = codes("".join(words)), np.cumsum(sizes) - sizes
        node, open_, levels, nodes = np.zeros(len(words), np.int64), np.arange(len(words)), [np.zeros(0, np.int64)], 1
        depth = 0
        while len(open_ := open_[sizes[open_] > depth]):
            own, at = np.unique(node[open_] << _BITS | flat[starts[open_] + depth], return_inverse=True)
            node[open_] = nodes + at
            levels.append(own)
            nodes, depth = nodes + len(own), depth + 1
        ends = np.zeros(nodes, bool)
        ends[node[sizes > 0]] = True
        return cls(np.concatenate(levels), ends)

    def matches(self, flat: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places where a word of it begins), shortest first; ``left`` code points may be used from each place."""
        at, node, depth = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0
        while len(at) and len(self.edges):
            edge = node << _BITS | flat[at + depth]
            found = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            hit = self.edges[found] == edge
            at, node, depth = at[hit], found[hit] + 1, depth + 1
            if self.ends[node].any():
                yield depth, at[self.ends[node]]
            more = left[at] > depth
            at, node = at[more], node[more]


def cut_runs(trie: WordTrie, runs: list[str], inner: bool) -> list[list[str]]:
    """Each run cut by the longest word at each place, single characters where there is none.

    ``inner`` puts the shorter words inside a longer one before it, by length, then place.
    """
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = codes("".join(runs))
    longest = np.ones(len(flat), np.int64)
    hits = []
    for size, at in trie.matches(flat, np.repeat(ends, sizes) - np.arange(len(flat))):
        if size > 1:
            longest[at] = size
            hits.append((at, np.full(len(at), size)))
    steps = longest.tolist()
    if inner:
        place, length = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((length, place))
        # words at place p are lengths[first[p] : first[p + 1]]
        first, lengths = np.searchsorted(place[order], np.arange(len(flat) + 1)).tolist(), length[order].tolist()
    out = []
    for run, end in zip(runs, ends.tolist(), strict=True):
        begin, i, words = end - len(run), 0, []
        while i < len(run):
            n = steps[begin + i]
            if inner and n > 2:
                own = ((m, j) for j in range(i, i + n - 1) for m in lengths[first[begin + j] : first[begin + j + 1]] if m < n and j + m <= i + n)
                words += [run[j : j + m] for m, j in sorted(own)]
            words.append(run[i : i + n])
            i += n
        out.append(words)
    return out


def cut_lists(trie: WordTrie, lists: list[list[str] | None], is_run, inner: bool) -> Iterator[list[str] | None]:
    """Each list of tokens with those that ``is_run`` cut, SLICE code points (or one list) at a time."""

    def cut(some: list[list[str] | None]) -> Iterator[list[str] | None]:
        parts = iter(cut_runs(trie, [t for tokens in some for t in tokens or () if is_run(t)], inner))
        for tokens in some:
            yield tokens if tokens is None else [x for t in tokens for x in (next(parts) if is_run(t) else (t,))]

    waiting: list[list[str] | None] = []
    size = 0
    for tokens in lists:
        waiting.append(tokens)
        size += sum(len(t) for t in tokens or () if is_run(t))
        if size >= SLICE:
            yield from cut(waiting)
            waiting, size = [], 0
    yield from cut(waiting)


def with_column(b: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    """The batch with a column replaced."""
    at = b.schema.get_field_index(name)
    return pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.string())) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)
