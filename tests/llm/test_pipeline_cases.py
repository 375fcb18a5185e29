"""The pipeline over odd tables: nulls, empty and long texts, repeated rows, clashing names, nothing at all."""

import corpus_pipeline
import pytest
from opinara.scratch import written
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stages(spark, docs, folder):
    kept, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, kept, folder), "test")
        out[name] = kept
    return out


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """Labels of the driver's table, for its documents."""
    at = tmp_path_factory.mktemp("pipeline")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_odd_rows(spark, sf, folder):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    words = " ".join(f"w{i * 7919 % 65521}" for i in range(60_000))
    odd = [
        (900_001, None, None, None, None),
        (900_002, "", "en", "a", 0),
        (900_003, " \n\t ", "en", "a", 4),
        (900_004, words, "en", "long", len(words)),
        (900_005, "one row that stands twice in the table as it is", None, "b", 47),
        (900_005, "one row that stands twice in the table as it is", None, "b", 47),
        (None, "a document without an id keeps its text and its place", "en", None, 53),
    ]
    own = spark.createDataFrame(odd, SCHEMA)
    clash = {c: F.lit(1) for c in ("row", "group", "mark", "sig", "n", "ids", "_drop", "_stay", "predicted", "score", "comp", "taken", "target", "decoded")}
    out = stages(spark, docs.unionByName(own).withColumns(clash), folder)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == docs.columns, name
    kept = {name: out[name].filter("doc_id >= 900001 OR doc_id IS NULL").select("doc_id", "text").collect() for name in ("toxicity", "line dedup", "near duplicates")}
    # nothing odd is toxic or repeats a passage; of the repeated row one stays
    assert len(kept["toxicity"]) == len(odd) and len(kept["line dedup"]) == len(odd)
    ids = sorted((r.doc_id or 0) for r in kept["near duplicates"])
    assert ids == [0, 900_001, 900_002, 900_003, 900_004, 900_005]
    assert {r.doc_id: r.text for r in kept["near duplicates"]}[900_004] == words
    last = out["pieces"]
    assert last.count() == out["mixing"].count() and last.filter("NOT lossless").count() == 0
    # a null text has null ids, which stand for it
    assert last.filter("ids IS NULL AND lossless").count() == out["mixing"].filter("text IS NULL").count() > 0


def test_nothing(spark, folder):
    out = stages(spark, spark.createDataFrame([], SCHEMA), folder)
    assert all(df.count() == 0 for df in out.values())
