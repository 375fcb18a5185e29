"""Connected components of a table of links.

Links of at most ``ONE_TASK`` counted rows (a few MB) are joined in one task.  More are contracted:
every node hooks to its least neighbour, chains are shortened by pointer jumping, and links inside a
component are dropped, until none is left.  Both give the least node of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.scratch import written
from opinara.skew import heavy_keys, salted_join

ONE_TASK = 200_000


def _jump(parents: DataFrame) -> DataFrame:
    """(node, comp) with each comp replaced by its own comp until nothing changes."""
    while True:
        up = parents.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
        # a third of all nodes may have one parent
        both = salted_join(parents.select("node", "comp"), up, ["comp"], heavy_keys(parents, ["comp"]), "left")
        parents = written(both.select("node", F.coalesce("higher", "comp").alias("comp"), F.col("higher").isNotNull().alias("moved")), "components")
        if not parents.filter("moved").head(1):
            return parents.select("node", "comp")


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"node": nodes, "comp": [find(x) for x in nodes]}, dtype="int64")

    return links.select("a", "b").repartition(1).mapInPandas(run, "node long, comp long")


def contract(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b: long, written): comp is its component's least node."""
    if links.count() <= one_task:
        return written(_in_one_task(links), "components")
    comps, links = None, links.select("a", "b").filter("a != b")
    while True:
        if comps is not None:
            for end in ("a", "b"):
                to = comps.select(F.col("node").alias(end), F.col("comp").alias("to"))
                links = salted_join(links, to, [end], heavy_keys(links, [end]), "left").withColumn(end, F.coalesce("to", end)).drop("to")
            links = written(links.filter("a != b").distinct(), "components-links")
        hooks = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp"))
        hooks = written(hooks, "components-hooks")
        if not hooks.head(1):
            return comps if comps is not None else hooks
        fresh = _jump(hooks)
        # the least nodes themselves are no hooks
        fresh = written(fresh.unionByName(fresh.select(F.col("comp").alias("node"), "comp")).distinct(), "components")
        if comps is None:
            comps = fresh
        else:
            to = fresh.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            old = salted_join(comps, to, ["comp"], heavy_keys(comps, ["comp"]), "left").select("node", F.coalesce("root", "comp").alias("comp"))
            new = fresh.join(comps.select("node").hint("merge"), "node", "left_anti")
            comps = written(old.unionByName(new), "components")
