"""Word shingles of many texts at once, as 48-bit hashes in NumPy arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A text's set is its distinct shingles of
``k`` words, or its whole word sequence as one shingle if it has fewer; no words, empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at a time; a longer text is one chunk of its own.
CHUNK = 1 << 20
GRAM_BITS = 48

_rng = np.random.default_rng(20240131)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_AT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * CHUNK:
            _powers[name] = have
    return have[:n]


def word_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that stand one after another in ``data``, each followed by a
    line feed at ``ends``; and the number of the text of each word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[0::2], edge[1::2]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * _power("p", _P, len(raw)), out=total[1:])
    h = (total[end] - total[begin]) * _power("inv", _P_INV, len(raw) + 1)[begin]
    return mix(h + (end - begin).astype(np.uint64)), np.searchsorted(ends, begin)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= CHUNK or i - begin >= 60_000:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: list[bytes | None], k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of texts: index of its first text, set sizes, and all sets one after another,
    each ascending."""
    for a, b in chunks(texts):
        part = [t or b"" for t in texts[a:b]]
        ends = np.cumsum([len(t) + 1 for t in part]) - 1
        words, of = word_hashes(b"\n".join(part) + b"\n", ends)
        n = np.bincount(of, minlength=b - a)
        keys = []
        if len(words) >= k:
            first = len(words) - k + 1
            g = np.zeros(first, dtype=np.uint64)
            for j in range(k):
                g += words[j : first + j] * _WORD_AT[j]
            whole = of[:first] == of[k - 1 :]
            keys.append((of[:first][whole].astype(np.uint64) << np.uint64(GRAM_BITS)) | (mix(g[whole]) >> np.uint64(16)))
        for d in np.flatnonzero((n > 0) & (n < k)):
            w = words[np.searchsorted(of, d) :][: n[d]]
            g = (w * _WORD_AT[k : k + len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
            keys.append(np.array([(int(d) << GRAM_BITS) | int(mix(np.array([g], dtype=np.uint64))[0] >> np.uint64(16))], dtype=np.uint64))
        sets = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        sets.sort()
        if len(sets):
            sets = sets[np.r_[True, sets[1:] != sets[:-1]]]
        sizes = np.bincount((sets >> np.uint64(GRAM_BITS)).astype(np.int64), minlength=b - a)
        yield a, sizes, sets & np.uint64((1 << GRAM_BITS) - 1)


def signatures(sizes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """64 bits for each set: equal sets, equal signatures.  Empty sets have 0."""
    total = np.zeros(len(sets) + 1, dtype=np.uint64)
    np.cumsum(mix(sets + np.uint64(0x51ED270B)) * np.uint64(0xD6E8FEB86659FD93), out=total[1:])
    ends = np.cumsum(sizes)
    sums = total[ends] - total[ends - sizes]
    return np.where(sizes > 0, mix(sums + sizes.astype(np.uint64)), np.uint64(0))
