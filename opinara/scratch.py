"""Tables that cut a lineage, in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and Spark runs on
one machine (``local`` masters, as in tests) a temporary folder is made, once for each Spark
application; on a cluster an unset folder is an error.

An operator that writes such tables is marked ``@tidy``: when it returns, its tables that the
returned DataFrame does not read are deleted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)

#: A side of a join is broadcast only below this many rows of a few plain columns (about 4 MB).
BROADCAST_ROWS = 100_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _own[app]


def new_table(spark: SparkSession, name: str) -> str:
    """The place of a new table under the shared folder; it counts as the operator's."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (tables := _tables.get()) is not None:
        tables.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and return a DataFrame that reads it.

    The read-back frame has no lineage, so a lost executor costs no recomputation of what
    came before, and its files give the planner true sizes.
    """
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _roots(df: DataFrame) -> list[str]:
    """The folders that ``df`` reads, from its plan; no file is listed."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        if leaves.apply(i).nodeName().startswith("LogicalRelation"):
            relation = leaves.apply(i).relation()
            if hasattr(relation, "location"):
                out += relation.location().rootPaths().mkString("\n").split("\n")
    return out


def tidy(operator: Callable) -> Callable:
    """Delete the operator's tables that its result does not read, also where it fails.

    A result is a DataFrame, a tuple in which some are, or something else that reads no table.
    """

    @wraps(operator)
    def run(*args, **kwargs):
        own: list[str] = []
        token = _tables.set(own)
        spark, needed = SparkSession.active(), []
        try:
            out = operator(*args, **kwargs)
            frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
            read = {f"{r.rstrip('/')}/" for df in frames for r in _roots(df)} if own else set()
            needed = [p for p in own if any(f"/{p.rsplit('/', 1)[-1]}/" in r for r in read)]
            return out
        finally:
            _tables.reset(token)
            for path in own:
                if path not in needed:
                    _delete(spark, path)
            if (outer := _tables.get()) is not None:
                outer += needed

    return run


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a narrow table that is already written: broadcast if its counted rows allow, else merge join."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")
