"""Cleaning: long runs take one look, slang takes only the pairs that a text can reach."""

import random
import time

from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import tokens


def test_long_runs_are_read_once(spark):
    n = 400_000
    rows = [(1, "a" * n + "@"), (2, "x" + " " * n + "y "), (3, "a@b.c+d@e.f g.h@i-j.k@l")]
    d = spark.createDataFrame(rows, "id int, t string").select("id", F.md5(T.strip_emails("t")).alias("m"), F.length(T.strip_space(F.col("t"))).alias("n"), T.strip_emails(F.col("t")).alias("e"))
    began = time.time()
    got = {r.id: r for r in d.collect()}
    assert time.time() - began < 30
    assert got[2].n == n + 2 and got[3].e == " @l" and got[1].n == n + 1


def test_slang_against_a_plain_loop(spark):
    extra = {"哈哈": "", "ab": "c", "c6": "神绝", "": "x", "a.": "$1\\"}
    rng = random.Random(5)
    bits = [*T.SLANG, *T.SLANG.values(), *extra, *"神了笑死绝太无语子abcé6@ \n😀$\\"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for more in (None, extra):
        want = []
        for t in texts:
            for k, v in T.slang_pairs(more):
                t = t.replace(k, v) if k else t
            want.append(t)
        d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
        got = {r.i: r.t for r in d.select("i", T.normalize_slang(F.col("t"), more).alias("t")).collect()}
        assert got.pop(-1) is None and [got[i] for i in range(len(texts))] == want


def test_slang_takes_few_pairs():
    pairs = T.slang_pairs()
    reach = T._slang_reach(pairs)
    assert [pairs[i][0] for i in reach["hhhh"]] == ["hhhh", "hhh", "hh"]
    assert all(len(reach[k]) == 1 for k in ("mm", "dd", "py", "6", "em"))


def test_stop_words_are_a_set(spark):
    d = spark.createDataFrame([(["的", "a", None, " ", "b"],), (None,), ([],)], "w array<string>")
    out = d.select(tokens.drop_stopwords(F.col("w")).alias("w"))
    assert [r.w for r in out.collect()] == [["a", "b"], None, []]
    assert "INSET" in out._jdf.queryExecution().optimizedPlan().toString()


def test_dictionary_rows_go_in_slices(spark):
    n = 2 * tokens.CUT_ROWS + 201
    rows = [(i, None if i % 7 == 0 else "天地" * (i % 5) + "人a") for i in range(n)]
    d = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    got = {r.i: r.tokens for r in tokens.tokenize(d, "t", spark.createDataFrame([("天地",)], "word string")).collect()}
    assert got == {i: [] if i % 7 == 0 else ["天地"] * (i % 5) + ["人", "a"] for i in range(n)} and tokens.CUT_ROWS <= 1000
