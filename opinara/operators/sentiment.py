"""Sentiment and emotion: labels, scores, reply parsing, data sets and metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.functions.text import or_else
from opinara.operators.tokens import latin_tokens
from opinara.operators.upsert import upsert

LABELS = ("negative", "neutral", "positive")
# The 18 emotions and the sentiment of each, in order.
EMOTIONS = {
    "喜悦": "positive", "兴奋": "positive", "满足": "positive", "感激": "positive", "爱": "positive",
    "愤怒": "negative", "厌恶": "negative", "悲伤": "negative", "恐惧": "negative", "失望": "negative",
    "惊讶": "neutral", "困惑": "neutral", "好奇": "neutral", "期待": "positive", "焦虑": "negative",
    "平静": "neutral", "无聊": "neutral", "冷漠": "neutral",
}
# Words that tell an emotion, in the order in which tags are given.
LEXICON = {
    "喜悦": ("开心", "高兴", "快乐", "太好了", "哈哈", "嘻嘻", "棒", "好", "赞"),
    "兴奋": ("激动", "兴奋", "太棒了", "太厉害", "牛", "nb", "awesome"),
    "满足": ("满足", "满意", "舒服", "享受", "幸福"),
    "感激": ("感谢", "谢谢", "多亏", "感恩", "感激"),
    "爱": ("爱", "喜欢", "爱你", "心", "❤", "💕", "😍"),
    "愤怒": ("气死", "生气", "愤怒", "怒", "火大", "可恶", "操", "艹"),
    "厌恶": ("恶心", "讨厌", "烦", "垃圾", "恶", "呸"),
    "悲伤": ("难过", "伤心", "哭", "悲", "痛", "😢", "😭"),
    "恐惧": ("害怕", "恐惧", "吓", "怕", "担心"),
    "失望": ("失望", "遗憾", "可惜", "唉", "差", "烂"),
    "惊讶": ("惊", "震惊", "没想到", "居然", "竟然", "wow"),
    "困惑": ("困惑", "迷惑", "不懂", "什么意思", "为什么"),
    "好奇": ("好奇", "想知道", "是什么", "怎么"),
    "期待": ("期待", "希望", "盼", "等"),
    "焦虑": ("焦虑", "着急", "急", "慌"),
}
DEFAULT_TAG = {"positive": "喜悦", "negative": "失望"}
CALM = "平静"
# The texts of an instruction record.
SYSTEM_PROMPT = """你是一个专业的情感分析助手。请分析用户提供的文本，输出以下信息：
1. sentiment: 情感倾向 (positive/negative/neutral)
2. sentiment_score: 情感分数 (-1.0 到 1.0，负面为负，正面为正)
3. emotion_tags: 情绪标签列表

请以 JSON 格式输出结果。"""
PROMPT = "请分析以下文本的情感：\n\n"


def _map(d: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def unanalyzed(processed: DataFrame, unified: DataFrame, limit: int | None = None) -> DataFrame:
    """Completed rows with a text and no sentiment, by id."""
    p = processed.filter("status = 'completed' AND clean_content != ''").select(F.col("unified_id").alias("id"), "clean_content")
    out = p.join(unified.filter("sentiment IS NULL"), "id").orderBy("id")
    return out.limit(limit) if limit else out


def scoring_text(body: Column, title: Column, chars: int = 500) -> Column:
    """The body, or the title where it is empty, cut to ``chars``."""
    return F.substring(or_else(body, title), 1, chars)


def emotion_tags(c: Column, sentiment: Column, most: int = 3) -> Column:
    """Emotions whose words the text has, in the lexicon's order, at most three; else one by sentiment."""

    def found(text: Column) -> Column:
        hits = [F.when(F.greatest(*[F.contains(text, F.lit(w)) for w in words]), tag) for tag, words in LEXICON.items()]
        return F.slice(F.array_compact(F.array(*hits)), 1, most)

    # the text is lower-cased once
    tags = F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), found)[0]
    default = F.coalesce(F.try_element_at(_map(DEFAULT_TAG), F.coalesce(sentiment, F.lit(""))), F.lit(CALM))
    return F.when(F.size(tags) == 0, F.array(default)).otherwise(tags)


def emotion_sentiment(c: Column) -> Column:
    return F.try_element_at(_map(EMOTIONS), c)


def label_id(c: Column) -> Column:
    return F.try_element_at(_map({x: i for i, x in enumerate(LABELS)}), c)


def label_name(c: Column) -> Column:
    return F.when((c >= 0) & (c < 3), F.element_at(F.array(*map(F.lit, LABELS)), (c + 1).cast("int")))


def score_from_probs(probs: Column) -> dict[str, Column]:
    """sentiment, sentiment_score and probabilities from an array (negative, neutral, positive)."""
    best = F.array_position(probs, F.array_max(probs)) - 1
    return {"sentiment": label_name(best), "sentiment_score": probs[2] - probs[0], "probabilities": F.map_from_arrays(F.array(*map(F.lit, LABELS)), probs)}


def fit_sentiment(df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 18) -> PipelineModel:
    """A corpus classifier on Spark: hashed terms, idf, multinomial logistic regression."""
    stages = [HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial", maxIter=30, regParam=1e-3)]
    return Pipeline(stages=stages).fit(df.withColumn("_tokens", latin_tokens(F.col(text))))


def predict_sentiment(model: PipelineModel, df: DataFrame, text: str = "text") -> DataFrame:
    out = model.transform(df.withColumn("_tokens", latin_tokens(F.col(text))))
    return out.drop("_tokens", "_tf", "_features", "rawPrediction", "probability").withColumn("prediction", F.col("prediction").cast("int"))


def parse_sentiment_reply(df: DataFrame, col: str, string_tag: bool = True) -> DataFrame:
    """``df`` with sentiment, sentiment_score and emotion_tags from a model's reply.

    The first flat JSON object counts.  An unknown label is neutral; a score is held to [-1, 1], true
    and false are 1 and 0, what is no number is 0; tags outside the 18 go, and none left is calm; a
    single tag in place of a list is read if ``string_tag``.  Without valid JSON: neutral, 0, calm.
    """
    v = F.try_parse_json(F.regexp_extract(F.col(col), r"\{[^{}]*\}", 0))

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("_v"), path, kind)

    raw = get("$.sentiment_score", "variant")
    kind = F.schema_of_variant(raw)
    number = F.when(kind == "BOOLEAN", get("$.sentiment_score", "boolean").cast("double")).when(kind == "STRING", F.lit(0.0)).otherwise(get("$.sentiment_score", "double"))
    tags = F.coalesce(get("$.emotion_tags", "array<string>"), F.array(get("$.emotion_tags", "string")) if string_tag else F.array().cast("array<string>"))
    known = F.array(*map(F.lit, EMOTIONS))
    kept = F.filter(tags, lambda t: F.array_contains(known, t))
    label = get("$.sentiment", "string")
    out = df.withColumn("_v", v).withColumns({
        "sentiment": F.when(label.isin(*LABELS), label).otherwise("neutral"),
        "sentiment_score": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0)))),
        "emotion_tags": F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit(CALM))),
    })
    return out.drop("_v")


def apply_sentiment(unified: DataFrame, results: DataFrame) -> DataFrame:
    """Results (id, sentiment, sentiment_score, emotion_tags) written to their rows."""
    known = results.join(unified.select("id"), "id", "left_semi")
    return upsert(unified, known, ["id"], ["sentiment", "sentiment_score", "emotion_tags"])


def sentiment_stats(df: DataFrame) -> DataFrame:
    """(platform, sentiment, n, mean_score) of rows with a label."""
    return df.filter("sentiment IS NOT NULL").groupBy("platform", "sentiment").agg(F.count(F.lit(1)).alias("n"), F.avg("sentiment_score").alias("mean_score"))


def sentiment_progress(unified: DataFrame, processed: DataFrame) -> DataFrame:
    """total (processed, with text), analyzed and unanalyzed."""
    p = processed.filter("status = 'completed' AND clean_content != ''").select(F.col("unified_id").alias("id"))
    both = p.join(unified.select("id", "sentiment"), "id")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count("sentiment").alias("analyzed"), F.count_if(F.col("sentiment").isNull()).alias("unanalyzed"))


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on key and seed alone."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double")
    return h / F.lit(float(16**12))


def weak_label(df: DataFrame, seed: int, label: str = "label", key: str = "id") -> DataFrame:
    """A binary label as sentiment, with a score from 0.5 to 0.9 on its side."""
    size = F.lit(0.5) + F.lit(0.4) * uniform(F.col(key), seed)
    return df.withColumns({"sentiment": F.when(F.col(label) == 0, "negative").otherwise("positive"), "sentiment_score": F.when(F.col(label) == 0, -size).otherwise(size)})


def instruction_records(df: DataFrame, text: str = "text") -> DataFrame:
    """(system, instruction, output): prompt and JSON answer of each labelled row."""
    tags = F.array_join(F.transform("emotion_tags", lambda t: F.concat(F.lit('    "'), t, F.lit('"'))), ",\n")
    answer = F.concat(F.lit('{\n  "sentiment": "'), F.col("sentiment"), F.lit('",\n  "sentiment_score": '), F.round("sentiment_score", 2).cast("string"), F.lit(',\n  "emotion_tags": [\n'), tags, F.lit("\n  ]\n}"))
    return df.withColumns({"system": F.lit(SYSTEM_PROMPT), "instruction": F.concat(F.lit(PROMPT), F.col(text)), "output": answer})


def split_dataset(df: DataFrame, ratios=(8, 1, 1), seed: int = 42, most: int | None = None, key: str = "id") -> DataFrame:
    """``df`` (at most ``most`` rows of it) with ``split``: train, val, test by a seeded shuffle.

    The global rank is counted in ranges of the hash: a histogram of its first bits gives each range
    its offset, so no task sorts the whole table.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(W.partitionBy()))
    inner = W.partitionBy("_b").orderBy("_h", key)
    rows = rows.join(F.broadcast(offsets), "_b")  # 4096 rows at most
    rows = rows.withColumn("_r", F.col("_o") + F.row_number().over(inner) - 1)
    n = F.least(F.col("_n"), F.lit(most)) if most else F.col("_n")
    total = sum(ratios)
    train, val = F.floor(n * ratios[0] / total), F.floor(n * ratios[1] / total)
    split = F.when(F.col("_r") < train, "train").when(F.col("_r") < train + val, "val").otherwise("test")
    return rows.filter(F.col("_r") < n).withColumn("split", split).drop("_h", "_b", "_c", "_o", "_n", "_r")


def confusion(df: DataFrame, labels: list[str], truth: str = "label", guess: str = "prediction") -> DataFrame:
    """(truth, guess, n) for every pair of the fixed labels, zeros kept."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*map(F.lit, labels))
    grid = df.sparkSession.range(1).select(F.explode(names).alias("truth")).withColumn("guess", F.explode(names))
    return grid.join(F.broadcast(counts), ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0).cast("long")).alias("n"))  # labels squared


def class_metrics(df: DataFrame, labels: list[str], truth: str = "label", guess: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support): each label, and the rows accuracy, macro and weighted.
    A division by zero is 0; means over the labels that occur."""
    n = confusion(df, labels, truth, guess)
    by = n.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("tp"))
    by = by.join(n.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("guessed")), "class")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    by = by.withColumns({"precision": ratio(F.col("tp"), F.col("guessed")), "recall": ratio(F.col("tp"), F.col("support"))})
    by = by.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    occurs = (F.col("support") > 0) | (F.col("guessed") > 0)
    means = by.agg(
        *[F.avg(F.when(occurs, F.col(c))).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        ratio(F.sum("tp"), F.sum("support")).alias("acc"),
        F.sum("support").alias("support"),
    )
    cols = ["class", "precision", "recall", "f1", "support"]
    out = by.select(*cols)
    for name, p in (("macro", "m_"), ("weighted", "w_")):
        out = out.unionAll(means.select(F.lit(name).alias("class"), f"{p}precision", f"{p}recall", f"{p}f1", "support"))
    return out.unionAll(means.select(F.lit("accuracy").alias("class"), "acc", "acc", "acc", "support"))


def write_splits(df: DataFrame, root: str) -> None:
    df.write.mode("overwrite").partitionBy("split").json(root)
