"""Format-preserving pseudonyms for personal numbers and dates.

Candidates are found by pattern and validated (check digits, calendar, octets, areas).  A value is
then a whole number below the size of its format, and a keyed Feistel network permutes that range:
the pseudonym has the same format and is valid again, equal values get equal pseudonyms in every
document, different values different ones, and the key's owner can invert it.  Where the range is no
product of two halves the network is walked until it is back inside.

Runs of digits that fail their check are no personal numbers and stay as they are; but a candidate
that fails is searched for valid values inside it: from its begin to each border of its groups (an
IBAN first by its country's length), then from the next group on.  Where candidates overlap, the
permutation is walked until the same ones are valid as before, so that the inverse finds the same
values; such a value's pseudonym can differ from that of its equals elsewhere.

The work is one pass over Arrow batches with nothing shuffled or shared but the key.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
#: Dates from FIRST to LAST are permuted among themselves.
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
# The patterns of the candidates.
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))"
    r"|(?P<date>(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>\+1[ -]?(?:\([0-9]{3}\)|[0-9]{3})[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ -]?[0-9]{2,4}){2,4}(?![0-9]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
)
_HINT = re.compile(r"[0-9@]")
#: Characters behind a value that its candidates reach at most, and values before it whose candidates reach it, with room.
AHEAD, BEFORE = 400, 4
_GROUP = re.compile(r"[A-Za-z0-9]+")
# Digits of the groups of printed cards, and lengths of IBANs by country.
CARDS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
IBANS = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}


def _round(key: bytes, tweak: str, i: int, x: int) -> int:
    size = (x.bit_length() + 7) // 8 or 1
    h = hashlib.blake2b(f"{tweak}:{i}:".encode() + x.to_bytes(size, "big"), key=key, digest_size=32)
    return int.from_bytes(h.digest(), "big")


def permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(n)."""
    if n < 2:
        return x
    b = math.isqrt(n - 1) + 1
    a = -(-n // b)
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _round(key, tweak, i, left)) % b
            else:
                left = (left + sign * _round(key, tweak, i, right)) % a
        x = left * b + right
        if x < n:
            return x


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for valid card numbers."""
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10


def _fill(layout: str, symbols: str) -> str:
    """``layout`` with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def _symbols(s: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters permuted among letters, digits among digits, all together, case kept."""
    n, x = 1, 0
    sizes = [10 if c.isdigit() else 26 for c in s]
    for c, k in zip(s, sizes, strict=True):
        x = x * k + (int(c) if k == 10 else ord(c.lower()) - 97)
        n *= k
    x = permute(x, n, key, f"{tweak}:{''.join('9' if k == 10 else 'a' for k in sizes)}", back)
    out = []
    for c, k in zip(reversed(s), reversed(sizes), strict=True):
        x, d = divmod(x, k)
        out.append(str(d) if k == 10 else (chr(97 + d).upper() if c.isupper() else chr(97 + d)))
    return "".join(reversed(out))


def _date_of(s: str) -> tuple[date, str] | None:
    try:
        d = date(int(s[:4]), int(s[5:7]), int(s[8:])) if s[4] == "-" else date(int(s[6:]), int(s[3:5]), int(s[:2]))
    except ValueError:
        return None
    if s[4] != "-" and s[2] != s[5] or not FIRST <= d <= LAST:
        return None
    return d, s[4] if s[4] == "-" else s[2]


def _iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


@lru_cache(maxsize=65_536)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> tuple[str, str] | None:
    """(kind, pseudonym), or None if the candidate is not valid."""
    plain = "".join(c for c in value if c.isalnum())
    if kind == "email":
        local, _, domain = value.partition("@")
        own = "".join(c for c in local if c.isalnum())
        return kind, f"{_fill(local, _symbols(own, key, f'email:{domain.lower()}', back))}@{domain}"
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip", back)
        return kind, ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        found = _date_of(value)
        if not found:
            return None
        d = FIRST + timedelta(permute((found[0] - FIRST).days, (LAST - FIRST).days + 1, key, "date", back))
        return kind, d.isoformat() if found[1] == "-" else d.strftime(f"%d{found[1]}%m{found[1]}%Y")
    if kind == "ssn":
        area, group, serial = int(plain[:3]), int(plain[3:5]), int(plain[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "ssn", back)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return kind, f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        head = re.match(r"\+[0-9]{1,3}(?=[ (-])|\+[0-9]", value)[0]
        rest = "".join(c for c in value[len(head) :] if c.isdigit())
        if not 7 <= len(rest) <= 14:
            return None
        return kind, head + _fill(value[len(head) :], _symbols(rest, key, f"phone:{head}", back))
    if kind == "iban":
        if _iban_number(plain) % 97 != 1:
            return None
        body = _symbols(plain[4:], key, f"iban:{plain[:2]}", back)
        check = 98 - _iban_number(f"{plain[:2]}00{body}") % 97
        return kind, _fill(value, f"{plain[:2]}{check:02d}{body}")
    if luhn(plain):
        return None
    body = _symbols(plain[:-1], key, "card", back)
    return kind, _fill(value, body + str((10 - luhn(body + "0")) % 10))


def _trials(kind: str, value: str) -> list[int]:
    """Ends of the values to try in a candidate, from its begin, in order; they depend on its format alone."""
    if kind not in ("card", "iban"):
        return [len(value)]
    ends = [g.end() for g in _GROUP.finditer(value)]
    sizes = [g.end() - g.start() for g in _GROUP.finditer(value)]
    total = {end: sum(sizes[: i + 1]) for i, end in enumerate(ends)}
    longest = ends[::-1]
    if kind == "iban":
        return sorted((e for e in longest if total[e] >= 12), key=lambda e: total[e] != IBANS.get(value[:2]))
    whole = [e for e in longest if 13 <= total[e] <= 19]
    return sorted(whole, key=lambda e: tuple(sizes[: ends.index(e) + 1]) not in CARDS)


def _values(text: str, pos: int, key: bytes, back: bool) -> Iterator[tuple[str, int, int, int, bool]]:
    """(kind, begin, end, begin of the first candidate since the value before, whether candidates
    overlap it) of each valid value from ``pos`` on."""
    reach, first = pos, -1
    while m := PATTERN.search(text, pos):
        first = m.start() if first < 0 else first
        trials = _trials(m.lastgroup, m[0])
        end = next((e for e in trials if pseudonym(m.lastgroup, m[0][:e], key, back)), 0)
        near = m.start() < reach or end != trials[0] or end != len(m[0])
        reach = max(reach, m.end())
        if end:
            pos = m.start() + end
            yield m.lastgroup, m.start(), pos, first, near
            first = -1
        else:
            after = _GROUP.match(text, m.start())
            group = _GROUP.search(text, after.end() if after else m.start() + 1, m.end())
            pos = group.start() if group else m.end()


def pseudonymize_text(text: str, key: bytes, counts: dict[str, int], back: bool = False) -> str:
    """``text`` with every validated value replaced; ``counts`` is added to by kind."""
    found = list(_values(text, 0, key, back))
    if not found:
        return text
    ends = [0, *[v[2] for v in found]]
    gaps = [text[e : v[1]] for e, v in zip(ends, found, strict=False)] + [text[ends[-1] :]]
    values = [text[v[1] : v[2]] for v in found]

    def same(i: int) -> bool:
        """Whether the candidates that can touch value i give the same values up to it."""
        lo = max(0, i - BEFORE)
        cut = found[lo][3] - ends[lo]
        lead = ((values[lo - 1] if lo else "") + gaps[lo][:cut])[-2:]
        parts, want, at = [lead, gaps[lo][cut:]], [], len(lead) + len(gaps[lo]) - cut
        for j in range(lo, i + 1):
            want.append((found[j][0], at, at + len(values[j])))
            parts += [values[j], gaps[j + 1][:AHEAD] if j == i else gaps[j + 1]]
            at += len(values[j]) + len(gaps[j + 1])
        j, room = i + 1, AHEAD - len(gaps[i + 1])
        while j < len(values) and room > 0:
            parts += [values[j], gaps[j + 1][:AHEAD]]
            room -= len(values[j]) + len(gaps[j + 1])
            j += 1
        got = _values("".join(parts), len(lead), key, back)
        return all(next(got, ("",) * 3)[:3] == w for w in want)

    # the last value first, and the inverse the other way, so that both see the same neighbours
    for i in range(len(found)) if back else reversed(range(len(found))):
        kind, _, _, _, near = found[i]
        counts[kind] = counts.get(kind, 0) + 1
        values[i] = pseudonym(kind, values[i], key, back)[1]
        while near and not same(i):
            values[i] = pseudonym(kind, values[i], key, back)[1]
    return gaps[0] + "".join(v + g for v, g in zip(values, gaps[1:], strict=True))


def pseudonymize(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, ``n_found`` and a map ``found`` of counts by kind.

    ``back`` inverts with the same key.  Null texts stay null; whole texts are read whatever their
    length; other columns are kept, those of the added names replaced.  An e-mail's domain, a phone's
    country code and an IBAN's country stay, all else of a value is permuted.
    """
    own = [c for c in docs.columns if c not in ("n_found", "found")]
    kept = docs.select(*[docs[f"`{c}`"] for c in own])
    at = own.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_found", T.LongType()), T.StructField("found", T.MapType(T.StringType(), T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts, totals, maps = [], [], []
            for text in b.column(at).to_pylist():
                counts: dict[str, int] = {}
                if text and _HINT.search(text):
                    text = pseudonymize_text(text, key, counts, back)
                texts.append(text)
                totals.append(sum(counts.values()))
                maps.append(sorted(counts.items()))
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(totals, pa.int64()), pa.array(maps, pa.map_(pa.string(), pa.int64()))], [*own, "n_found", "found"])

    return kept.mapInArrow(run, schema)
