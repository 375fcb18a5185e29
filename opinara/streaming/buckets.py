"""A keyed table of which an upsert rewrites only the buckets that it touches.

A row's bucket is a hash of its key.  Version n of the table is a list of which version last wrote each bucket
(one row a bucket); its own files hold the touched buckets alone.  The list is written last, so a
version is there whole or not at all, and a repeated batch writes the same version again from the same
predecessor.  Versions that no kept list names are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.upsert import upsert

#: Buckets of a table, and versions that stay readable.
BUCKETS, KEEP = 64, 3


class BucketTable:
    """The table under ``root``, with ``keys`` (nulls are values) in ``buckets`` parts."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.root, self.keys, self.buckets, self.keep = spark, root.rstrip("/"), keys, buckets, keep

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, path: str) -> list[str]:
        fs, at = self._files()
        where = at(path)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Versions with a whole list, oldest first."""
        fs, at = self._files()
        return sorted(int(n[1:]) for n in self._names(f"{self.root}/lists") if n[0] == "v" and fs.exists(at(f"{self.root}/lists/{n}/_SUCCESS")))

    def owners(self, version: int) -> dict[int, int]:
        """Which version wrote each bucket: ``buckets`` rows."""
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.root}/lists/v{version}").collect()}

    def _read(self, owners: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.root}/data/v{v}/bucket={b}" for b, v in sorted(owners.items())]
        if not paths:
            return None
        schema = self.spark.read.parquet(f"{self.root}/data/v{max(owners.values())}").drop("bucket").schema
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version (default: the last), None if there is none."""
        known = self.versions()
        return self._read(self.owners(known[-1] if version is None else version)) if known else None

    def upsert(self, rows: DataFrame, version: int, update_cols: list[str] | None = None) -> None:
        """Write ``version`` from the last one before it and ``rows``, one row a key."""
        before = [v for v in self.versions() if v < version]
        owners = self.owners(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # ``buckets`` numbers
        if touched:
            old = self._read({b: v for b, v in owners.items() if b in touched})
            new = rows if old is None else upsert(old, rows, self.keys, update_cols)
            new.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v{version}")
        owners |= dict.fromkeys(touched, version)
        self.spark.createDataFrame(sorted(owners.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lists/v{version}")
        self._prune()

    def _prune(self) -> None:
        fs, at = self._files()
        known = self.versions()
        for v in known[: -self.keep]:
            fs.delete(at(f"{self.root}/lists/v{v}"), True)
        named = {(b, v) for kept in known[-self.keep :] for b, v in self.owners(kept).items()}
        whole = {v for _, v in named}
        for v in [int(n[1:]) for n in self._names(f"{self.root}/data")]:
            if v > known[-1]:
                continue
            if v not in whole:
                fs.delete(at(f"{self.root}/data/v{v}"), True)
                continue
            for name in self._names(f"{self.root}/data/v{v}"):
                if name.startswith("bucket=") and (int(name[7:]), v) not in named:
                    fs.delete(at(f"{self.root}/data/v{v}/{name}"), True)
