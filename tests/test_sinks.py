"""Readers, sinks and pairings on files and small tables."""

import csv
import json

import pytest
from opinara import skew
from opinara.operators import tokens, upsert
from opinara.sources import io
from pyspark.sql import functions as F


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("part-*") if p.is_file()}


def test_a_resync_leaves_other_platforms_alone(spark, tmp_path):
    rows = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(40)], "id long, platform string")
    rows.write.partitionBy("platform").parquet(f"{tmp_path}/t")
    before = files(tmp_path / "t")
    fresh = spark.createDataFrame([(100, "a"), (101, "a"), (102, "c")], "id long, platform string")
    for _ in range(2):
        upsert.resync_table(fresh, ["a", "b"], f"{tmp_path}/t")
        after = files(tmp_path / "t")
        kept = {f: x for f, x in before.items() if f.split("/")[0] in ("platform=c", "platform=d")}
        assert kept == {f: x for f, x in after.items() if not f.startswith("platform=a/")}
        got = {(r.id, r.platform) for r in spark.read.parquet(f"{tmp_path}/t").collect()}
        assert got == {(i, "abcd"[i % 4]) for i in range(40) if i % 4 > 1} | {(100, "a"), (101, "a")}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_appends_survive_a_retry(spark, tmp_path, fmt):
    write = {"csv": io.write_items_csv, "json": io.write_items_json}[fmt]
    rows = spark.createDataFrame([(i, f'a "b",\n{i}', "xhs" if i % 2 else "wb", "search", "2024-01-01") for i in range(10)], "id long, text string, platform string, crawl_type string, dt string")
    write(rows.filter("id < 6"), str(tmp_path), "d1")
    first = files(tmp_path)
    for _ in range(2):  # a delivery and its retry
        write(rows.filter("id >= 6"), str(tmp_path), "d2")
    assert first.items() <= files(tmp_path).items()
    assert {f.split("/part")[0] for f in files(tmp_path)} == {f"platform={p}/crawl_type=search/dt=2024-01-01/delivery={d}" for p in ("xhs", "wb") for d in ("d1", "d2")}
    reader = spark.read.option("header", True).option("multiLine", fmt == "csv").option("escape", '"' if fmt == "csv" else "\\")
    got = {(int(r.id), r.text, r.platform) for r in reader.format(fmt).load(str(tmp_path)).collect()}
    assert len(got) == 10 and {(i, p) for i, _, p in got} == {(i, "xhs" if i % 2 else "wb") for i in range(10)}
    write(rows, f"{tmp_path}/plain")
    write(rows, f"{tmp_path}/plain")
    assert reader.format(fmt).load(f"{tmp_path}/plain").count() == 20


def test_readers(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))
    (tmp_path / "one.json").write_text('{\n "a": 3,\n "b": "y"}')
    got = [{tuple(r) for r in io.read_json_records(spark, f"{tmp_path}/{f}.json", "a int, b string").collect()} for f in ("list", "one")]
    assert got == [{(1, "x"), (2, None)}, {(3, "y")}]
    with (tmp_path / "l.csv").open("w", newline="") as f:
        csv.writer(f).writerows([("review", "label"), ('say "hi",\nthere', 1), ("bad", "x"), ("", 0), ("ok", 0)])
    assert {tuple(r) for r in io.read_labeled_csv(spark, f"{tmp_path}/l.csv", "review").collect()} == {('say "hi",\nthere', 1), ("ok", 0)}
    spark.createDataFrame([("n", 1)], "note_id string, v int").write.parquet(f"{tmp_path}/raw/{io.CONTENT_TABLES['xhs']}")
    assert io.read_raw(spark, f"{tmp_path}/raw", "xhs").collect()[0].note_id == "n"
    with pytest.raises(ValueError):
        io.read_raw(spark, f"{tmp_path}/raw", "nowhere")


def test_export_files(spark, tmp_path):
    sets = {"contents": spark.createDataFrame([(1, None, [1, 2], {"k": "v"}), (2, 'q"', [], {})], "a int, b string, c array<int>, d map<string,string>"), "comments": spark.createDataFrame([], "a int")}
    assert io.export_sets(sets, str(tmp_path / "out")) == ["contents"]
    rows = [r for f in sorted((tmp_path / "out/contents").glob("part-*")) for r in csv.reader(f.open())]
    assert [r for r in rows if r != ["a", "b", "c", "d"]] == [["1", "", "[1,2]", '{"k":"v"}'], ["2", 'q"', "[]", "{}"]]
    assert not (tmp_path / "out/comments").exists()


def test_inventory(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/xhs/a")
    (tmp_path / "wb").mkdir()
    (tmp_path / "wb/x.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "wb/y.jsonl").write_text('{"a":1}\n{"a":2}\n{"a":3}\n')
    (tmp_path / "other.bin").write_bytes(b"12345")
    got = {(r.platform, r.type): (r.files, r.records) for r in io.source_file_stats(spark, str(tmp_path), ["xhs", "wb"]).collect()}
    assert got == {("xhs", "parquet"): (1, 7), ("wb", "csv"): (1, 2), ("wb", "jsonl"): (1, 3), ("unknown", "bin"): (1, None)}


def test_inventory_of_folders_of_parts(spark, tmp_path):
    """Parts named "part" are not of the platform "part", nor is all below a root named like one; a folder of parts is one file."""
    root = f"{tmp_path}/nation part+50%"
    spark.range(7).repartition(3).write.parquet(f"{root}/region.parquet")
    spark.range(4).repartition(2).write.option("header", True).csv(f"{root}/events.csv")
    spark.range(5).repartition(2).write.parquet(f"{root}/plain")
    got = {(r.platform, r.type): (r.files, r.records) for r in io.source_file_stats(spark, root, ["region", "nation", "part", "events"]).collect()}
    assert got == {("region", "parquet"): (1, 7), ("events", "csv"): (1, 4), ("part", "parquet"): (2, 5)}


def test_pairs_beyond_the_broadcast_limit(spark):
    rows, d = spark.range(50).repartition(3), spark.range(37).select(F.col("id").alias("d"))
    for limit in (100, 10):
        out = skew.every_pair(rows, d, limit, block=5)
        assert {tuple(r) for r in out.collect()} == {(i, j) for i in range(50) for j in range(37)} and out.count() == 50 * 37
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
    assert skew.every_pair(rows, d.limit(0)).count() == 0


def test_textrank_against_a_plain_loop(spark):
    def plain(words, window, iters):
        w = {}
        for i, a in enumerate(words):
            for b in words[i + 1 : i + window]:
                if a != b:
                    w[a, b] = w.get((a, b), 0) + 1
                    w[b, a] = w.get((b, a), 0) + 1
        out, rank = {}, {a: 1.0 for a, _ in w}
        for (_, b), n in w.items():
            out[b] = out.get(b, 0) + n
        for _ in range(iters):
            rank = {a: 0.15 + 0.85 * sum(n / out[y] * rank[y] for (x, y), n in w.items() if x == a) for a in rank}
        return sorted(((-round(x, 6), a) for a, x in rank.items()))[:4]

    docs = {1: list("abcabdaeaf"), 2: ["x"], 3: None, 4: [], 5: ["x", "x"], 6: ["b", "a"], 7: list("qwertyuiop") * 300}
    df = spark.createDataFrame(list(docs.items()), "id long, tokens array<string>").repartition(3)
    out = tokens.keywords_textrank(df, 4)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append((-round(r.weight, 6), r.word))
    assert got == {i: plain(t, 5, 10) for i, t in docs.items() if t and len(set(t)) > 1}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "").split("MapInPandas")[0]
