"""Readers and writers of raw platform data, labelled texts and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.operators.adapters import COMMENT_TABLES, CONTENT_TABLES


def read_raw(spark: SparkSession, root: str, platform: str, kind: str = "content", fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A platform's raw content or comment table under ``root``."""
    tables = {"content": CONTENT_TABLES, "comment": COMMENT_TABLES}[kind]
    if platform not in tables:
        raise ValueError(f"unknown platform {platform}")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(f"{root}/{tables[platform]}")


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON file with a list of records, or one."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_labeled_csv(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """(text, label) of a CSV with a header; rows without a text or a whole label go."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(F.col(text_col).alias("text"), F.col("label").try_cast("int").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")


LAYOUT = ["platform", "crawl_type", "item_type", "dt"]


def _append(df: DataFrame, root: str, fmt: str, delivery: str | None) -> None:
    layout = [c for c in LAYOUT if c in df.columns]
    if delivery is None:
        df.write.partitionBy(*layout).options(header=True, escape='"').mode("append").format(fmt).save(root)
    else:
        # a delivery has partitions of its own, which a retry replaces
        rows = df.withColumn("delivery", F.lit(delivery))
        rows.write.partitionBy(*layout, "delivery").options(header=True, escape='"', partitionOverwriteMode="dynamic").mode("overwrite").format(fmt).save(root)


def write_items_csv(df: DataFrame, root: str, delivery: str | None = None) -> None:
    """Append rows as CSV with a header, one folder for each platform, crawl type, item type and day.

    With a name for the ``delivery`` a retry gives the same files' rows and not a second copy.
    """
    _append(df, root, "csv", delivery)


def write_items_json(df: DataFrame, root: str, delivery: str | None = None) -> None:
    """As ``write_items_csv``, as lines of JSON."""
    _append(df, root, "json", delivery)


def export_sets(sets: dict[str, DataFrame], root: str) -> list[str]:
    """Each non-empty set as CSV files in a folder of its own: null is empty, nested values are JSON.
    Returns the names that were written."""
    done = []
    for name, df in sets.items():
        if df.isEmpty():
            continue
        nested = (T.ArrayType, T.MapType, T.StructType)
        cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields]
        df.select(*[F.coalesce(c, F.lit("")).alias(f.name) for c, f in zip(cols, df.schema.fields, strict=True)]).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(f"{root}/{name}")
        done.append(name)
    return done


READERS = {"json": "json", "csv": "csv", "parquet": "parquet", "jsonl": "json"}


def source_files(spark: SparkSession, root: str, platforms: list[str]) -> DataFrame:
    """(path, bytes, file, platform, type) of the files under ``root``; the platform is the first that ``file`` names.

    ``file`` is the path below ``root``.  A folder that is named like a file, as Spark writes one (``x.csv/part-0.csv``),
    is one file: its parts have the folder's name as ``file``.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    below = F.substr("path", F.lit(len(base) + 1))
    folder = F.regexp_extract(below, r"(?i)^(.*?\.([a-z0-9]+))/(?:.*/)?[^/]*\.\2$", 1)
    file = F.coalesce(F.nullif(folder, F.lit("")), below)
    found = F.coalesce(*[F.when(F.contains(F.lower("file"), F.lit(p.lower())), p) for p in platforms], F.lit("unknown"))
    return files.withColumn("file", file).withColumns({"platform": found, "type": F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))})


def file_records(spark: SparkSession, root: str) -> DataFrame:
    """(path, records) of the files under ``root`` that hold records, each format in one scan: rows of Parquet,
    lines of JSON, lines of CSV but for the header's."""
    out = []
    for suffix, fmt in READERS.items():
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").option("header", True)
        try:
            rows = reader.format(fmt).load(root) if fmt == "parquet" else reader.schema("_line string").format(fmt).load(root)
        except AnalysisException as e:  # no file of this kind
            if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            continue
        counts = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("records"))
        # the path comes as a URI, so blanks are encoded; a plus sign is itself
        out.append(counts.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))))
    none = spark.createDataFrame([], "path string, records long")
    return reduce(DataFrame.unionByName, out, none)


def source_file_stats(spark: SparkSession, root: str, platforms: list[str]) -> DataFrame:
    """(platform, type, files, bytes, records) of the files under ``root``, part files as one (:func:`source_files`); records of other types are null."""
    same = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    files = source_files(spark, root, platforms).withColumn("path", same("path"))
    both = files.hint("merge").join(file_records(spark, root).withColumn("path", same("path")), "path", "left")
    records = F.when(F.col("type").isin(list(READERS)), F.coalesce("records", F.lit(0)))
    return both.groupBy("platform", "type").agg(F.count_distinct("file").alias("files"), F.sum("bytes").alias("bytes"), F.sum(records).alias("records"))
