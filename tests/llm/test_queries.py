"""The registered queries on the smallest tables, against their SQL where there is one."""

import duckdb
import pytest
from opinara.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, found.fetchall()))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, kept = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from opinara.scratch import written

        kept = written(stage(spark, kept, sf), "test")
        assert kept.columns == docs.columns, name
        if name != "mixing":
            assert 0.5 * n < kept.count() <= n
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert out.filter("NOT lossless").count() == 0 and out.count() == kept.count()
