"""The corpus pipeline: five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import linedup, mixing, ngram_join, pieces, toxicity
from opinara.scratch import tidy, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _like_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of ``docs``, rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of two lines or more stay where they stand first; a document of which nothing is left goes."""
    out = linedup.dedup_passages(docs.select(*COLUMNS))
    return _like_documents(out.filter("removed_lines = 0 OR removed_lines < n_lines"))


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id (null last), of equal ids that of the
    least text hash, then any one.  Documents without words are in no group and stay."""
    numbered = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-numbered")
    groups = ngram_join.near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "row")
    both = numbered.select("row", "doc_id", F.xxhash64("text").alias("mark")).hint("merge").join(groups, "row")
    stay = both.groupBy("group").agg(F.min_by("row", place).alias("row")).select("row")
    return numbered.hint("merge").join(stay, "row", "left_semi").select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes twice stands twice."""
    return mixing.mix_sources(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, with the proof that they decode to its text."""
    coded = pieces.encode_and_verify(docs.select("doc_id", "source", "text"), pieces.Vocabulary())
    return coded.select("doc_id", "source", "ids", F.size("ids").alias("n_pieces"), "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("pieces", encode_pieces),
]

#: The stages are beyond SQL (compression, chunk hashes, sampling); tests hold each against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
