"""Each operator against brute force on small tables with nulls, ties, repeats and clashing columns."""

import collections
import fractions
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from opinara.llm import chat, components, fingerprint, langid, linedup, mixing, ngram_join, pieces, pii, shingles, topk, toxicity
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 1, None) for i, t, s in rows], DOCS)


WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(900, None, None), (901, "", "a"), (902, "  \n\t ", "a"), (903, "One", "b"), (904, "ONE x", "b"), (903, "One", "b"), (905, "\U0001f600 é ▁ </turn> ### \\", "b")]


# ---- mixing


def brute_mix(rows):
    size = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    by = collections.defaultdict(list)
    for i, t, s in rows:
        h = int(hashlib.md5(f"mix:{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        by[s].append((h, size(t), i))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(x[1] for x in by[s]) for s in order}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(order)
    while open_:
        lam = left / sum(w[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= lam * w[s]}
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        if not full:
            target |= {s: lam * w[s] for s in open_}
            break
        open_ -= full
    return total, target


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "c", "d", None, "é"])) for i in range(300)] + ODD
    total, target = brute_mix(rows)
    out = mixing.mix_report(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    taken = collections.Counter()
    source = {i: s for i, _, s in rows}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in total)
    mixed = mixing.mix_sources(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix_report(docs(spark, [])).count() == 0


def test_no_document_is_taken_more_often_than_allowed(spark):
    rng = random.Random(17)
    # the source that comes first weighs most and is far too small for its share: its target is its cap
    rows = [(i, text(rng, 5), "a") for i in range(20)] + [(100 + i, "", "a") for i in range(200)] + [(1000 + i, text(rng, 50), "b") for i in range(60)]
    rows += [(None, text(rng, 9), "c") for _ in range(300)] + [(7, text(rng, 9), "c") for _ in range(300)]
    out = mixing.mix_report(docs(spark, rows)).collect()
    assert max(r.copies for r in out) == mixing.MAX_REPEAT
    by = collections.defaultdict(list)
    for r in out:
        by[r.target].append(r.taken)
    assert all(abs(sum(t) - target) <= 50 for target, t in by.items())
    again = mixing.mix_report(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


# ---- chat


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, rng.choice([None, "", text(rng, rng.randrange(1, 400)), "a\\</turn>### x: \\e \\h\\"])))
    rows += [(None, None, None, None), (5, 3, "user", "tie"), (-1, 0, "a: b", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, start int")
    win = chat.chat_windows(df)
    w = win.collect()
    for r in w:
        assert r.formatted.count("</turn>\n") == r.context_turns + r.own_turns
    got = {r.conv_id: r for r in chat.read_back(win).collect()}
    by = collections.defaultdict(list)
    for c, t, role, x in rows:
        by[c].append((t is not None, t or 0, role or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        lost = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert chat.read_back(chat.chat_windows(df.limit(0))).count() == 0


@pytest.mark.parametrize("system", [0, 20, 300, 500, 600])
def test_windows_stay_within_their_budget(spark, system):
    rng = random.Random(system)
    rows = [(c, t, "system" if t == 0 and system else rng.choice(["user", "assistant"]), text(rng, system if t == 0 and system else rng.choice([1, 5, 40, 100, 130]))) for c in range(8) for t in range(rng.randrange(2, 60))]
    size = {(c, t): len(x.split()) + chat.TURN_TOKENS for c, t, _, x in rows}
    w = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in w:
        alone = r.own_turns == 1 and r.tokens == size[r.conv_id, r.start] + (size[r.conv_id, 0] if system and r.start else 0)
        assert r.tokens <= chat.BUDGET or alone, r
        if system:
            assert r.formatted.startswith("### system")
    assert sum(r.own_turns for r in w) == len(rows)
    if system <= 20:
        assert sum(r.context_turns for r in w) > len(w) / 2


# ---- n-gram join


def brute_components(rows, k=5):
    def sets(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset({tuple(w)}) if w else frozenset())

    s = [(i, sets(t)) for i, t, _ in rows]
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(s)), 2):
        x, y = s[a][1], s[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for j, (i, x) in enumerate(s):
        if x:
            least[find(j)] = min(i, least.get(find(j), i))
    return sorted((i, len(x), least[find(j)] if x else i) for j, (i, x) in enumerate(s))


def near_rows(rng):
    rows, n = [], 0
    for _ in range(25):
        base = text(rng, rng.randrange(3, 120)).split()
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((n, " ".join(w), None))
            n += 1
    return rows + ODD


@pytest.mark.parametrize("least", [ngram_join.HOT_LEAST, 3])
def test_ngram_join(spark, monkeypatch, least):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", least)
    rows = near_rows(random.Random(3))
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(docs(spark, rows)).collect())
    assert got == brute_components(rows)


def test_crowded_shingles_and_large_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWDED", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = [*near_rows(random.Random(33)), (2**53 + 1, "a b c d e f g h i", None), (2**53 + 3, "a b c d e f g h i", None), (2**53 + 5, "x y", None), (None, "x y", None), (None, None, None)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs(spark, rows)).collect()), key=key)
    want = [(i, n, c) for i, n, c in brute_components([(i if i is not None else -1, t, s) for i, t, s in rows])]
    want = [(None if i == -1 else i, n, c) for i, n, c in want]
    want = [(i, n, (2**53 + 5 if n else None) if c == -1 else c) for i, n, c in want]
    assert got == sorted(want, key=key)


def test_scratch_tables_go(spark, monkeypatch, tmp_path):
    from opinara import scratch

    monkeypatch.setattr(scratch, "scratch_root", lambda spark: f"file://{tmp_path}")
    out = ngram_join.near_duplicates(docs(spark, near_rows(random.Random(3))))
    left = {p.name.split("-")[1] for p in tmp_path.iterdir()}
    assert left <= {"roots", "keys"} and out.count() > 0


def test_ngram_join_empty(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.near_duplicates(docs(spark, [(1, None, None)])).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    rng = random.Random(4)
    links = [(rng.randrange(30), rng.randrange(30)) for _ in range(14)] + [(i, i + 1) for i in range(100, 106)]
    got = {r.node: r.comp for r in components.contract(spark.createDataFrame(links, "a long, b long"), one_task).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert all(got.get(x, x) == find(x) for x in parent)


def test_shingle_sets_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(5)
    texts = [text(rng, rng.randrange(0, 30)).encode() for _ in range(60)] + [None, b"", b"A b", b"a B"]
    whole = [s for _, n, s in shingles.shingle_sets(texts)]
    monkeypatch.setattr(shingles, "CHUNK", 200)
    assert np.array_equal(np.concatenate(whole), np.concatenate([s for _, _, s in shingles.shingle_sets(texts)]))


# ---- line dedup


def brute_dedup(rows):
    """Every pair of neighbouring lines that occurs before goes; lines of a first, repeated pair stay."""
    mark = lambda t: xxhash.xxh64_intdigest((t or "").encode(), seed=42)
    mark = {t: m - (1 << 64) if (m := mark(t)) >= 1 << 63 else m for _, t, _ in rows}
    every = sorted({(i is None, i or 0, mark[t], t or "") for i, t, _ in rows})
    first, often = {}, set()
    for none, i, m, t in every:
        lines = t.split("\n")
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if first.setdefault(pair, (none, i, m, k)) != (none, i, m, k):
                often.add(pair)
    out = {}
    for none, i, m, t in every:
        lines, gone, stay = t.split("\n"), set(), set()
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if pair in often:
                (stay if first[pair] == (none, i, m, k) else gone).update((k, k + 1))
        gone -= stay
        out[None if none else i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    return out


def test_line_dedup(spark):
    """Copied passages at all offsets, overlapping passages, few different lines, clashing columns, repeated rows."""
    rng = random.Random(6)
    some = [[text(rng, 6) for _ in range(n)] for n in (2, 3, 5, 8, 13, 40)]
    few = [f"line {i}" for i in range(6)]
    rows = []
    for i in range(150):
        own = [text(rng, 5) for _ in range(rng.randrange(0, 10))]
        for _ in range(rng.randrange(3)):
            p, at = rng.choice(some), rng.randrange(len(own) + 1)
            a = rng.randrange(len(p))
            own[at:at] = p if rng.random() < 0.5 else p[a : a + rng.randrange(1, 9)]
        rows.append((i, "\n".join(own), None))
    rows += [(200 + i, "\n".join(rng.choice(few) for _ in range(rng.randrange(1, 30))), None) for i in range(40)]
    rows += [*ODD, (60, rows[0][1], None), (7, rows[7][1], None), (7, rows[9][1], None), (None, rows[3][1], None), (300, "same\n" * 500, None), (301, ("x" * 300 + "\n") * 300 + rows[5][1], None)]
    table = docs(spark, rows).withColumns({c: F.lit(9) for c in ("_drop", "_stay", "mark", "row", "lists", "unit", "key", "keeper", "removed_lines", "_id")})
    out = linedup.dedup_passages(table)
    assert set(out.columns) == set(table.columns) | set(linedup.ADDED)
    want = brute_dedup(rows)
    got = sorted(repr((r.doc_id, r.text, r.removed_lines)) for r in out.collect())
    assert got == sorted(repr((i, None if t is None else want[i, t or ""][0], want[i, t or ""][1])) for i, t, _ in rows)
    assert linedup.dedup_passages(docs(spark, [])).count() == 0


def test_copies_go_by_chunks():
    """Boundaries follow content alone, and most lines of a longer passage lie in whole chunks of it."""
    rng = random.Random(9)
    p = [text(rng, 6).encode() for _ in range(200)]
    cuts = []
    for before in range(8):
        lines = [text(rng, 4).encode() for _ in range(before)]
        ends = linedup.boundaries([*lines, *p])
        assert ends[0] == 0 and ends[-1] == before + len(p)
        cuts.append({e - before for e in ends if e - before >= linedup.WINDOW})
    assert all(c == cuts[0] for c in cuts) and 20 < len(cuts[0]) < 90


def test_planted_passages_go_whole(spark):
    rng = random.Random(14)
    own = [[f"{i} {j} {text(rng, 6)}" for j in range(rng.randrange(2, 9))] for i in range(120)]
    want = {i: list(x) for i, x in enumerate(own)}
    for k in range(60):
        passage = [f"passage {k} {j} {text(rng, 8)}" for j in range(3 + k % 6)]
        for i in (k, 60 + k):
            at = rng.randrange(len(own[i]) + 1)
            own[i] = own[i][:at] + passage + own[i][at:]
        want[k] = own[k]
    rows = [(i, "\n".join(x), None) for i, x in enumerate(own)]
    got = {r.doc_id: r for r in linedup.dedup_passages(docs(spark, rows + ODD)).collect()}
    assert all(got[i].text == "\n".join(x) for i, x in want.items())
    assert all((got[60 + k].removed_chunks, got[60 + k].removed_lines) == (1, 3 + k % 6) for k in range(60))
    assert [r.text for r in linedup.dedup_passages(docs(spark, [(1, "a\na\na\na", None), (2, "x\na\na\ny", None), (None, "x\na", None)])).orderBy(F.col("doc_id").asc_nulls_last()).collect()] == ["a\na", "x\na\ny", ""]
    assert linedup.dedup_passages(docs(spark, [])).count() == 0


def test_line_dedup_with_one_hash_for_different_texts(spark, monkeypatch):
    """Units of one hash are told apart by their bytes.  Hashes are replaced by a column, as workers import the module."""
    rows = [(1, "a\nb", None), (2, "c\nd", None), (3, "a\nb", None)]
    real = linedup.units
    monkeypatch.setattr(linedup, "units", lambda d: real(d).withColumn("key", F.lit(5).cast("long")))
    got = {r.doc_id: r.text for r in linedup.dedup_passages(docs(spark, rows)).collect()}
    assert got == {1: "a\nb", 2: "c\nd", 3: ""}
    long = [(i, "\n".join(x), None) for i, x in enumerate([list("abcdefgh"), list("xcdefgy"), list("zzabq"), list("abcdefgh")])]
    want = brute_dedup(long)
    assert {r.doc_id: r.text for r in linedup.dedup_passages(docs(spark, long)).collect()} == {i: want[i, t][0] for i, t, _ in long}


# ---- top-k


def test_top_k(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 8)) * rng.choice([0.01, 0.2, 1.0], size=(300, 1))
    v[50:70] = v[50]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(300)] + [(1000, None, 0), (1020, [1.0, None] * 4, 0), (1040, [float("nan")] * 8, 0), (1060, [0.0] * 8, 0), (1080, [1.0], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("id") % 20 == 0, k=7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(64 * np.array(x)).astype(int) for i, x, _ in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    for q in [i for i in good if i % 20 == 0]:
        best = sorted((-int(good[q] @ p), i) for i, p in good.items() if i != q and len(p) == len(good[q]))[:7]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q


def test_top_k_of_wide_and_repeated_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(1, [4e7, 1.0, 2.0]), (20, [1.0, 1.0, 0.0]), (40, [1e308, -1e308, 3.0]), (41, [-1e308, 5e-324, 1e300]), (42, [4e7, 1.0, 2.0]), (42, [4e7, 1.0, 2.0])]
    rows += [(80, [3.3e7, -3.3e7, 1e6]), (81, [3.3e7, 3.3e7, 1e6]), (1040, [float("inf")] * 3), (1, None)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=7).collect()
    good = [(i, [math.floor(fractions.Fraction(x) * 64) for x in v]) for i, v in rows if v is not None and all(math.isfinite(x) for x in v)]
    want = []
    for a, (q, x) in enumerate(good):
        if q % 20 == 0:
            best = sorted((-sum(u * w for u, w in zip(x, y, strict=True)), i) for b, (i, y) in enumerate(good) if b != a)[:7]
            want += [(q, k + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0


# ---- pieces

ODD_TEXTS = ["", None, "a", " ", "   x  ", "▁ a▁b", "日本語 текст \U0001f642\n\n\t x", "x" * 1000, "▁", " lead", "trail ", "\x00\x01", "é" * 300 + " z"]


def test_pieces_are_lossless_and_reproducible(spark):
    v = pieces.Vocabulary()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "null key", "y")], "doc_id long, text string, ids string")
    coded = pieces.encode(df, v)
    rows = pieces.decode(coded, v).collect()
    assert all(r.decoded == r.text for r in rows) and all((r.ids is None) == (r.text is None) for r in rows)
    again = pieces.encode(df.repartition(3), v).collect()
    assert {r.doc_id: r.ids for r in rows} == {r.doc_id: r.ids for r in again}


def test_pieces_are_verified_where_they_are_made(spark):
    v = pieces.Vocabulary()
    rows = [(1, "The quick  brown", "x", None), (1, "The quick  brown", "x", None), (None, "\u2581 caf\u00e9\n", None, [1]), (3, None, "y", [2]), (4, "", "y", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, ids array<int>")
    got = pieces.encode_and_verify(df, v)
    assert got.columns == ["doc_id", "source", "ids", "lossless"]
    want = pieces.decode(pieces.encode(df, v), v).select("doc_id", "source", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and all(r.lossless for r in got.collect())
    assert pieces.encode_and_verify(df.limit(0), v).collect() == []


def test_pieces_are_drawn_in_proportion():
    v = pieces.Vocabulary()
    weight = {p: 1 / (max(0, r) + pieces.RANK) for p, r in zip(v.pieces, v.ranks, strict=True) if p}

    def every(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                for rest, q in every(s[k:]):
                    yield (s[:k], *rest), q * weight[s[:k]]

    p = dict(every("▁thing"))
    n = 4000
    drawn = collections.Counter(tuple(v.pieces[i] for i in x) for x in pieces.segment_texts(v, ["thing"] * n, list(range(n))))
    for s, q in p.items():
        q /= sum(p.values())
        assert abs(drawn[s] / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3
    t = pieces._trie(v, 1.0)
    long = pieces._symbols("thing")
    assert pieces._long_unit(t, long, np.uint64(5))  # the path for very long units covers the same lattice


@pytest.mark.parametrize("chars", ["的一是不了人我在有他", "龘靐齉爩鱻麤龗灪籲鸞", "\U0001f642\U0001f9ff\U0001fab6\U0001f6f8", "日本語の文は空白なしで続く", "ประเทศไทย", "a\U0001fab6的=-\U00020000"])
def test_pieces_of_units_without_spaces(chars):
    v, rng = pieces.Vocabulary(), random.Random(13)
    texts = ["".join(rng.choice(chars) for _ in range(n)) for n in range(20, pieces.LONG + 4)]
    ids = pieces.segment_texts(v, texts, list(range(len(texts))))
    assert [pieces.decode_ids(v, list(x)) for x in ids] == texts


def test_forward_sums_of_long_units_are_those_in_logarithms():
    t = pieces._trie(pieces.Vocabulary(), 1.0)
    for text in ("龘靐" * 90, "\U0001fab6a" * 60, "=" * 150, "thing的" * 30):
        chars = pieces._symbols(text)
        n = len(chars)
        weight, piece = pieces._lattice(t, chars, np.full(n, n))
        cum, first = pieces._forward(weight, np.array([0]), np.array([n]))
        log = np.full(n + 1, -np.inf)
        log[0] = 0
        for i in range(1, n + 1):
            k = np.arange(1, min(i, len(weight)) + 1)
            with np.errstate(divide="ignore"):
                terms = log[i - k] + np.log(weight[k - 1, i - k])
            log[i] = np.logaddexp.reduce(terms)
            want = np.cumsum(np.exp(terms - log[i]))
            assert np.allclose(np.minimum(cum[first[0] + i, : len(k)], 1), want, atol=1e-5)


# ---- language and toxicity


def test_language_of_mixed_texts(spark):
    rng = random.Random(8)
    syll = {"xx": ["ka", "lo", "mi"], "yy": ["str", "eng", "ück"], "zz": ["да", "не", "ро"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syll[lang]) for _ in range(3)) for _ in range(n))
    train = spark.createDataFrame([(i, say(x, 30), x) for i, x in enumerate(["xx", "yy", "zz"] * 20)] + [(99, None, "xx"), (98, "q", None)], "doc_id long, text string, lang string")
    m = langid.fit(train)
    rows = [(1, say("xx", 20)), (2, say("yy", 5)), (3, say("xx", 30) + " " + say("yy", 10)), (4, "123 !"), (5, None), (6, ""), (7, say("zz", 4)), (8, "漢字")]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double"), m, spans=True).collect()}
    assert [out[i].lang_pred for i in range(1, 8)] == ["xx", "yy", "xx", "und", "und", "und", "zz"]
    assert [(s["first"], s["words"], s["lang"]) for s in out[3].spans] == [(0, 30, "xx"), (30, 10, "yy")]
    assert all(0 <= r.score <= 1 for r in out.values())
    empty = langid.fit(train.limit(0))
    assert langid.identify(train.select("doc_id", "text"), empty).filter("lang_pred != 'und'").count() == 0


def test_scripts_narrow_the_languages(spark):
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("kalomi lokami mikalo", "aa"), ("streng engstr", "bb"), ("дане нероца роне", "cc")] * 20)], "doc_id long, text string, lang string")
    m = langid.fit(train)
    assert {s: [m.langs[i] for i in np.flatnonzero(x)] for s, x in m.scripts.items()} == {"latin": ["aa", "bb"], "cyrillic": ["cc"]}
    assert not any(g[0] in "\x00\\" for g in m.grams)
    rows = [(1, "щюж"), (2, "kalomi lokami щюж mikalo kalomi")]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), m, spans=True).collect()}
    assert out[1].lang_pred == "cc"
    assert [(s["first"], s["words"], s["lang"]) for s in out[2].spans] == [(0, 2, "aa"), (2, 1, "cc"), (3, 2, "aa")]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(9)
    table = -rng.random((20, 3)).astype(np.float32) * 12
    rows, lengths = rng.integers(0, 20, 13), np.array([5, 1, 0, 7])
    label = langid._viterbi(table, rows, lengths)
    at = 0
    for n in lengths:
        value = lambda p, at=at, n=n: sum(table[rows[at + i], p[i]] for i in range(n)) - langid.SWITCH * sum(p[i] != p[i - 1] for i in range(1, n))
        if n:
            assert value(label[at : at + n]) >= max(map(value, itertools.product(range(3), repeat=int(n)))) - 1e-4
        at += n


def test_toxicity_held_out(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = text(rng, 60).split() + [f"{a}{b}" for a, b in itertools.islice(itertools.product("qrs", "tuv"), 5)]
        w += [rng.choice(["vilejerk", "grossfool", "meanbrute"]) for _ in range(4)] * bad
        rng.shuffle(w)
        rows.append((i, " ".join(w), None))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5000, 1), (7, None)]
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score_toxicity(docs(spark, rows + ODD), model)
    got = out.withColumn("held", toxicity.held_out(F.col("doc_id"))).filter("doc_id < 600").collect()
    held = [r for r in got if r.held]
    assert len(held) > 150 and sum((r.score >= 0.7) != (r.doc_id % 6 == 0) for r in held) <= 3
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.collect())
    blank = toxicity.fit(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs(spark, ODD), blank).filter("predicted = 1").count() == 0


def test_toxic_passage_in_a_long_text():
    rng = random.Random(16)
    bad_words = ["vilejerk", "grossfool", "meanbrute", "dimwart", "sourhulk", "crasspig", "dullknave", "rudezero"]
    say = lambda n, bad: " ".join(rng.sample(w := text(rng, n).split() + [rng.choice(bad_words) for _ in range(bad)], len(w)))
    toxic, ordinary = [say(60, 8) for _ in range(200)], [say(rng.randrange(20, 1500), i % 50 == 0) for i in range(300)]
    contents = toxicity.train_dictionaries(*[[w for i, t in enumerate(x) if i % 3 for w in sorted(set(t.split()))] for x in (toxic, ordinary)])
    known = [(y, toxicity.windows(t, contents)) for y, x in ((1, toxic), (0, ordinary)) for t in x[0::3]]
    model = toxicity.Model(contents, *toxicity.calibrate(known, 0.1))
    passage = say(60, 8)
    for n in (100, 1000, 8000, 20000):
        around = say(n, 0)
        half = len(around) // 2
        a, b = toxicity.score_texts(model, [f"{around[:half]} {passage} {around[half:]}", around])
        assert a >= 0.7 > b, n


def test_compression_distances_and_windows():
    words = [f"{a}{b}{c}" for a in ("bra", "cle", "dru") for b in ("ta", "so", "mi") for c in ("n", "rt", "sh")]
    contents = toxicity.train_dictionaries(["zzyvaxo"] * 40 + words * 3, words * 40)
    assert toxicity.distance("zzyvaxo", contents) > 8 and max(toxicity.distance(w, contents) for w in words) <= 0
    t = " ".join(words * 20 + ["zzyvaxo", "zzyvaxo"])
    step = sum(toxicity.distance("zzyvaxo", contents) >= x for x in toxicity.STEPS)
    rows = toxicity.windows(t, contents)
    own = t.split()
    want = []
    for at in range(0, len(own) - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE):
        seen = set(own[at : at + toxicity.WINDOW])
        want.append(([0] * (step - 1) + [int("zzyvaxo" in seen)] + [0] * (len(toxicity.STEPS) - step), len(seen) / 100))
    assert [(r[: len(toxicity.STEPS)].tolist(), r[-2]) for r in rows] == want
    assert toxicity.windows(None, contents).tolist() == toxicity.windows("", contents).tolist() == [[0.0] * (len(toxicity.STEPS) + 1) + [1.0]]


@pytest.mark.parametrize("table", ["sf0.01"])
def test_held_out_quality_on_the_drivers_tables(spark, table):
    from opinara.llm import queries

    sf = f"/root/testdata/{table}"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op9_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.03 * len(clean)
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language_id(spark, sf).filter("held_out").join(docs_, "doc_id").filter("lang IS NOT NULL").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 100


# ---- pseudonyms


def test_permutations_and_round_trips(spark):
    for n in (1, 2, 3, 7, 10, 97, 1000):
        assert sorted(pii.permute(x, n, b"k", "t") for x in range(n)) == list(range(n))
        assert all(pii.permute(pii.permute(x, n, b"k", "t"), n, b"k", "t", True) == x for x in range(n))
    t = "a.b+c@x.com 4111 1111 1111 1111 1234567890123456 2024-02-29 29.02.2023 31/12/1999 GB82 WEST 1234 5698 7654 32 +1 (017) 555-7713 123-45-6789 000-12-3456 10.0.0.256 10.0.0.25"
    df = docs(spark, [(1, t, None), (2, "again 4111 1111 1111 1111", None), (3, "none", None), *ODD])
    out = {r.doc_id: r for r in pii.pseudonymize(df, b"k").collect()}
    p = out[1].text
    assert out[1].found == {"email": 1, "card": 1, "date": 2, "iban": 1, "phone": 1, "ssn": 1, "ip": 1}
    for gone in ("a.b+c@", "4111 1111 1111 1111", "2024-02-29", "31/12/1999", "WEST", "555-7713", "123-45-6789", "10.0.0.25 "):
        assert gone not in p + " "
    for kept in ("1234567890123456", "29.02.2023", "10.0.0.256", "000-12-3456", "@x.com"):
        assert kept in p
    card = out[2].text.removeprefix("again ")
    assert card in p and pii.luhn(card.replace(" ", "")) == 0 and out[3].n_found == 0
    back = {r.doc_id: r.text for r in pii.pseudonymize(pii.pseudonymize(df, b"k"), b"k", back=True).collect()}
    assert back[1] == t


def test_values_inside_longer_candidates():
    card, iban = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"
    rng = random.Random(15)
    texts = [f"{card} 05/27", f"{card} 123", f"{card} 05", "12 4111111111111111", "4111111111111111 9999 x", f"order 1234 5678 {card} end", "378282246310005 1234", f"{iban} ABC", "DE89 3704 0044 0532 0130 00 1234 CODE", f"ES91 2100 0418 4502 0005 1332 NEXT WORD {card}", "NO93 8601 1117 947 ABCD"]
    texts += [f"{rng.randrange(10 ** rng.randrange(1, 6))} {card} {rng.randrange(10 ** rng.randrange(1, 6))} 2024-02-29" for _ in range(300)]
    texts += [" ".join(str(rng.randrange(10 ** rng.randrange(1, 8))) for _ in range(40)) for _ in range(100)]
    texts.append(" ".join(str(rng.randrange(1000)) for _ in range(3000)))
    for n, t in enumerate(texts):
        counts = {}
        out = pii.pseudonymize_text(t, b"k", counts)
        if n < 311:
            assert counts, t
        if n < 11:
            for whole in (card, card.replace(" ", ""), "378282246310005", "WEST 1234", "DE89 3704 0044", "2100 0418", "8601 1117"):
                assert whole not in out, (t, out)
        assert len(out) == len(t) and pii.pseudonymize_text(out, b"k", {}, back=True) == t


# ---- fingerprints


def test_fingerprint_pairs(spark):
    rng = random.Random(11)
    rows = [(i * 3, text(rng, rng.randrange(0, 300)), None) for i in range(80)] + [(500, None, None), (501, "", None), (502, "ab", None)]
    rows.append((503, rows[10][1], None))
    got = {r.doc_id: r for r in fingerprint.fingerprint_pairs(docs(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        a, b, c = fingerprint.sketches([t, e, nxt])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.as_text(a), fingerprint.as_text(b))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    assert got[503].fingerprint == got[30].fingerprint
    assert fingerprint.fingerprint_pairs(docs(spark, [])).count() == 0
    assert fingerprint.fingerprint_pairs(docs(spark, [(1, "abcabc", None)])).first().near_next == 1.0


def test_rows_of_one_id_are_spread(spark):
    """Rows without an id are cut by their text's hash; each row has its next one; equal rows count each."""
    rng = random.Random(12)
    rows = [(None, text(rng, 4), None) for _ in range(900)] + [(i, text(rng, 5), None) for i in range(600)] + [(700, "same text", None)] * 300
    table = docs(spark, rows).withColumns({c: F.lit(1) for c in ("bucket", "ghost", "at", "mark", "fingerprint")}).repartition(6)
    placed = fingerprint.with_next(table)
    own = placed.filter("ghost = 0 AND doc_id IS NULL").groupBy("bucket").count().collect()
    assert len(own) >= 5 and max(r[1] for r in own) < 400
    copies = placed.filter("ghost = 1").groupBy("bucket").count().collect()
    assert all(r[1] == 1 for r in copies) and placed.filter("ghost = 0").count() == len(rows)
    mark = {t: m - (1 << 64) if (m := xxhash.xxh64_intdigest(t.encode(), seed=42)) >= 1 << 63 else m for _, t, _ in rows}
    order = sorted(((i is None, -(i or 0), mark[t], t) for i, t, _ in rows))
    want = collections.Counter()
    for k, (none, i, _, t) in enumerate(order):
        e = t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][3][: len(t) // 3]
        want[None if none else -i, hashlib.sha256(e.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in fingerprint.fingerprint_pairs(table).collect()) == want


def test_windows_of_one_conversation_are_spread(spark, monkeypatch):
    """All windows of the longest conversation repeat its system turn; they are joined to it in parts."""
    from opinara import skew

    seen = []
    real = skew.heavy_keys
    monkeypatch.setattr(chat, "heavy_keys", lambda df, keys: seen.append(real(df, keys, least=20, parts=10)) or seen[-1])
    rng = random.Random(13)
    rows = [(None if c == 0 else c, k, "system" if k == 0 else ("user", "assistant")[k % 2], text(rng, 30)) for c, n in ((0, 600), (1, 4), (2, 9)) for k in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    out = chat.chat_windows(turns, budget=200)
    assert seen[0] is not None and seen[0].count() == 1
    head = {c: next(t for i, k, _, t in rows if i == c and k == 0) for c in (None, 1, 2)}
    got = out.collect()
    assert len(got) > 50 and all(f"### system: {head[r.conv_id]} " in r.formatted or f"system: {head[r.conv_id]}" in r.formatted for r in got)
    back = {r.conv_id: r.n_turns for r in chat.read_back(out).collect()}
    assert back == {None: 600, 1: 4, 2: 9}


def test_equal_substrings_share_phrases():
    rng = random.Random(12)
    common = text(rng, 400)
    sets = [set(fingerprint._level(*fingerprint._level(*_names(x + common + y)))[0].tolist()) for x, y in (("", "zz"), ("qqq vw", ""), (text(rng, 50), text(rng, 9)))]
    assert all(len(a & b) >= 0.9 * min(len(a), len(b)) - 60 for a, b in itertools.combinations(sets, 2))
    assert len(sets[0] & sets[1]) > 0.9 * len(sets[0])


def _names(t):
    names = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.zeros(len(names), bool)
    start[0] = True
    return names, start


def test_languages_whose_texts_have_no_letter_in_a_partition(spark):
    rows = [(i, f"le texte numero {i} est en francais", "fr") for i in range(20)] + [(20, "123 456", "fr"), (21, "", "xx"), (22, None, "fr"), (23, "texte", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for spread in (table.repartitionByRange(24, "doc_id"), spark.createDataFrame(spark.sparkContext.parallelize(rows, 24), table.schema), table.coalesce(1)):
        out = {r.doc_id: r.lang_pred for r in langid.identify(spread.select("doc_id", "text"), langid.fit(spread)).collect()}
        assert {out[i] for i in range(20)} == {"fr"} and out[20] == out[21] == out[22] == "und"
    letterless = table.filter("doc_id = 21")
    assert [r.lang_pred for r in langid.identify(table.filter("doc_id = 0").select("doc_id", "text"), langid.fit(letterless)).collect()] == ["xx"]
    assert langid.identify(letterless.select("doc_id", "text"), langid.fit(table.limit(0))).first().lang_pred == "und"
