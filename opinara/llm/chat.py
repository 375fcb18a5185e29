r"""Chat formatting in budgeted windows (DataFrame functions only).

Turn tokens (words, and ``TURN_TOKENS`` for the marks) are summed along a conversation.  A window's
``budget`` is charged with the conversation's first system turn, which every later window repeats;
of what is left, ``history_tokens`` (a quarter at most) are kept for history, and the rest is room for
own turns.  The running sum, cut into cells of that room less the longest turn that fits in half of it,
gives turn-aligned spans: a window holds the turns that end in one cell, so it stays within the
room; a turn of over half the room has a window of its own.  Up to ``history_turns`` turns before the
window are repeated as far as the budget still goes; repeated turns are never under the loss mask, so
each assistant turn is a target exactly once.  A window exceeds the budget only where the system turn
and one own turn together do.

A turn is written ``### role: text</turn>`` and a line feed.  Inside texts and roles a backslash
is written ``\\``, ``</turn>`` is ``\e``, ``###`` is ``\h``, and in roles a colon is ``\c``: the
control strings then never occur in a text, and reading back gives the same characters.

Positions and sums are taken in two steps, inside ranges of sorted rows and over the ranges, so
one conversation with a third of all turns is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.mixing import word_count
from opinara.scratch import tidy, written
from opinara.skew import heavy_keys, salted_join

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_TOKENS = 512, 2, 128, 4
END = "</turn>"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(END), F.lit("\\e")), F.lit("###"), F.lit("\\h"))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescape(c: Column) -> Column:
    def part(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit("\\e"), F.lit(END)), F.lit("\\h"), F.lit("###"))
        return F.replace(x, F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def placed(turns: DataFrame) -> DataFrame:
    """Turns with their position in the conversation, the tokens before them and the long turns
    before them.  Order: turn (null first), then role and text; equal rows are alike anyway."""
    order = ["turn", "role", "text"]
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", word_count(F.col("text")) + F.lit(TURN_TOKENS))
    return t.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())


@tidy
def chat_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row a window: conv_id, start (position of its first own turn), formatted, context_turns
    (repeated turns at its head), own_turns, tokens, and loss, an array of (at, length) spans of
    ``formatted`` in code points counted from 0.

    Null role and text count as empty, null conv_id is a conversation, other columns are ignored,
    an empty table gives an empty one.  A window of more than ``budget`` tokens holds one own turn and
    the system turn alone.
    """
    t = written(placed(turns), "chat-turns")
    first = F.min(F.when(F.col("role") == "system", F.struct("turn", "text", "tokens")))
    heads = t.groupBy("conv_id", "part").agg(first.alias("f"))
    whole = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own_room = F.greatest(F.lit(1), F.lit(budget) - F.coalesce("sys_tokens", F.lit(0)))
    rooms = heads.withColumn("sys_tokens", F.first("f.tokens", ignorenulls=True).over(whole)).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "sys_tokens", own_room.alias("room"))
    rooms = rooms.withColumn("room", F.col("room") - F.least(F.lit(history_tokens), F.floor(F.col("room") / 4)))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    t = t.join(rooms.hint("merge"), on).drop("c", "p").withColumn("long", (F.col("tokens") > F.floor(F.col("room") / 2)).cast("int"))
    run = W.partitionBy("conv_id", "part").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = t.select(
        "*",
        (F.row_number().over(W.partitionBy("conv_id", "part").orderBy("turn", "role", "text")) - 1).alias("at"),
        (F.sum("tokens").over(run) - F.col("tokens")).alias("pre"),
        (F.sum("long").over(run) - F.col("long")).alias("longs"),
    )
    short = F.coalesce(F.max(F.when(F.col("long") == 0, F.col("tokens"))), F.lit(0)).alias("m")
    parts = t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"), F.sum("long").alias("l"), short)
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    off = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}0") for x in "nsl"], F.max("m").over(whole).alias("m"))
    t = inner.join(off.hint("merge"), on).select(
        "conv_id", "role", "text", "tokens", "long", "sys_tokens", "room", "m",
        (F.col("at") + F.col("n0")).alias("pos"),
        (F.col("pre") + F.col("s0")).alias("pre"),
        (F.col("longs") + F.col("l0")).alias("longs"),
    )
    cell = F.floor((F.col("pre") + F.col("tokens") - 1) / F.greatest(F.lit(1), F.col("room") - F.col("m")))
    t = written(t.withColumn("cell", cell).withColumn("run", F.col("longs") * 2 + F.col("long")).drop("room", "m", "longs"), "chat-placed")

    win = t.groupBy("conv_id", "cell", "run").agg(F.min("pos").alias("start"), F.min("pre").alias("pre_start"), F.sum("tokens").alias("size"), F.first("sys_tokens").alias("sys_tokens"))
    win = win.withColumn("left", F.least(F.lit(history_tokens), F.lit(budget) - F.col("size") - F.coalesce("sys_tokens", F.lit(0))))
    own_key = W.partitionBy("conv_id", "cell", "run")
    own = t.withColumn("start", F.min("pos").over(own_key)).select("conv_id", "start", "pos", "role", "text", "tokens", F.lit(1).alias("own"))

    w = win.select(F.col("conv_id").alias("c"), "start", "pre_start", "left")
    back = w.select("c", "start", "pre_start", "left", F.explode(F.sequence(F.lit(1), F.lit(history_turns))).alias("k")).withColumn("want", F.col("start") - F.col("k")).filter("want >= 0")
    history = back.hint("merge").join(t, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("want")))
    near = F.col("pre_start") - F.col("pre") <= F.col("left")
    history = history.filter(near).select("conv_id", "start", "pos", "role", "text", "tokens", F.lit(0).alias("own"))

    first = t.filter(F.col("role") == "system").groupBy(F.col("conv_id").alias("s")).agg(F.min("pos").alias("sys"))
    system = first.hint("merge").join(t, F.col("conv_id").eqNullSafe(F.col("s")) & (F.col("pos") == F.col("sys"))).select("conv_id", "pos", "pre", "role", "text", "tokens")
    # all windows of a conversation meet its one system turn: windows of a long one are dealt to parts
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    w = w.withColumn("key", named("c"))
    system = salted_join(w, system.withColumn("key", named("conv_id")), ["key"], heavy_keys(w, ["key"]), by=F.xxhash64("start")).filter("pos < start")
    system = system.filter(~(near & (F.col("pos") >= F.col("start") - history_turns))).select("conv_id", "start", "pos", "role", "text", "tokens", F.lit(0).alias("own"))

    head = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": "))
    rows = own.unionByName(history).unionByName(system)
    rows = rows.withColumn("head", F.length(head)).withColumn("body", escape(F.col("text"))).withColumn("seg", F.concat(head, "body", F.lit(f"{END}\n")))
    ahead = W.partitionBy("conv_id", "start").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("seg")).over(ahead), F.lit(0)) + F.col("head")
    target = (F.col("own") == 1) & (F.col("role") == "assistant")
    rows = rows.withColumn("span", F.when(target, F.struct(at.cast("int").alias("at"), F.length("body").alias("length"))))
    out = rows.groupBy("conv_id", "start").agg(
        F.array_sort(F.collect_list(F.struct("pos", "seg", "span"))).alias("x"),
        F.sum("own").alias("own_turns"),
        F.sum(1 - F.col("own")).cast("int").alias("context_turns"),
        F.sum("tokens").alias("tokens"),
    )
    return out.select(
        "conv_id", "start",
        F.array_join(F.col("x.seg"), "").alias("formatted"),
        "context_turns", "own_turns", "tokens",
        F.filter(F.col("x.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: n_turns, turns_sha256 (role, line feed,
    text, line feed of each turn), loss_chars and loss_sha256 (all text under the masks), and
    formatted_chars."""
    segs = F.split("formatted", f"{END}\n")
    own = F.slice(segs, F.col("context_turns") + 1, F.col("own_turns").cast("int"))

    def turn(s: Column) -> Column:
        colon = F.locate(": ", s)
        return F.concat(unescape(s.substr(F.lit(5), colon - 5)), F.lit("\n"), unescape(s.substr(colon + 2, F.length(s))), F.lit("\n"))

    losses = F.transform("loss", lambda m: unescape(F.substring(F.col("formatted"), m["at"] + 1, m["length"])))
    w = windows.select(
        "conv_id",
        "start",
        F.array_join(F.transform(own, lambda s: turn(s)), "").alias("turns"),
        F.array_join(losses, "").alias("lost"),
        (F.size(segs) - 1 - F.col("context_turns")).alias("n"),
        F.length("formatted").alias("chars"),
    )
    g = w.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "turns", "lost"))).alias("x"),
        F.sum("n").cast("long").alias("n_turns"),
        F.sum(F.length("lost")).cast("long").alias("loss_chars"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return g.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.col("x.turns"), ""), 256).alias("turns_sha256"),
        "loss_chars",
        F.sha2(F.array_join(F.col("x.lost"), ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 4 AS tokens FROM c),
y AS (SELECT conv_id, first(tokens ORDER BY turn NULLS FIRST, text) AS sys_tokens FROM t WHERE role = 'system' GROUP BY conv_id),
q AS (SELECT t.*, coalesce(sys_tokens, 0) AS sys_tokens, greatest(1, 512 - coalesce(sys_tokens, 0)) AS rest FROM t LEFT JOIN y ON y.conv_id = t.conv_id),
g AS (SELECT *, rest - least(128, rest // 4) AS room FROM q),
h AS (SELECT *, CASE WHEN tokens > room // 2 THEN 1 ELSE 0 END AS big FROM g),
e AS (SELECT *, greatest(1, room - coalesce(max(tokens) FILTER (big = 0) OVER (PARTITION BY conv_id), 0)) AS step,
  row_number() OVER o - 1 AS pos, sum(tokens) OVER o AS upto,
  length('### ' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '###', '\h'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h') || '</turn>' || chr(10)) AS chars
  FROM h WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, upto - tokens AS pre, floor((upto - 1) / step) AS cell, 2 * sum(big) OVER (PARTITION BY conv_id ORDER BY pos) - big AS run FROM e),
w AS (SELECT conv_id, cell, run, min(pos) AS start, min(pre) AS pre_start, least(128, 512 - sum(tokens) - any_value(sys_tokens)) AS left_over FROM b GROUP BY conv_id, cell, run),
s AS (SELECT conv_id, min(pos) AS sys FROM b WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT w.conv_id, b.chars FROM w JOIN b ON b.conv_id = w.conv_id AND b.pos < w.start LEFT JOIN s ON s.conv_id = w.conv_id
  WHERE (b.pos >= w.start - 2 AND w.pre_start - b.pre <= w.left_over) OR b.pos = s.sys),
f AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM b UNION ALL SELECT conv_id, chars FROM r) GROUP BY conv_id)
SELECT b.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(any_value(f.chars) AS BIGINT) AS formatted_chars
FROM b JOIN f ON f.conv_id = b.conv_id GROUP BY b.conv_id
"""
