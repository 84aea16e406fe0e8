"""Connected components of links, by contraction on tables and a union-find once few links are left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import keep

#: Links that one task may hold for the union-find; beyond it, rounds of contraction.
ONE_TASK = 400_000


def _union_find(links: DataFrame) -> DataFrame:
    kind = dict(links.dtypes)["a"]

    def run(batches):
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        nodes = list(parent)
        if nodes:
            arrow = pa.string() if kind == "string" else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([root(x) for x in nodes], arrow)], names=["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root for every node of ``links`` (a, b; no nulls): nodes that links join share a root.

    A round sends every node to the neighbour (or itself) with the smallest hash and contracts the
    links along; hashes are random, so each round leaves a fraction of the nodes, whatever the graph
    looks like.  ``one_task`` bounds what the closing union-find holds.
    """
    links = keep(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while links.count() > one_task:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        step = keep(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("root")), "step")
        steps.append(step)
        moved = links.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = keep(moved.filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    out = keep(_union_find(links), "roots")
    for step in reversed(steps):
        after = out.select(F.col("node").alias("root"), F.col("root").alias("end"))
        out = keep(step.join(after, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
    return out
