"""Connected components by hooking and pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, materialise


def _lookup(left: DataFrame, key: str, table: DataFrame, value: str, out: str) -> DataFrame:
    """``left`` with ``out`` = the table's value for ``key``, or the key itself.

    Both sides are written tables, so a root that a third of the nodes point to
    makes a skewed sort-merge join, which adaptive execution splits.
    """
    t = table.select(F.col("node").alias("_n"), F.col(value).alias("_v"))
    return left.join(t, left[key] == t["_n"], "left").withColumn(out, F.coalesce("_v", key)).drop("_n", "_v")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) for every node that has an edge.

    ``component`` is the smallest node reachable. Each round hooks a node to its
    smallest smaller neighbour, halves the paths to the roots by pointer jumping
    until they are flat, and contracts the edges to those between roots; a round
    at least halves the number of roots that have edges. Loops and repeated
    edges are harmless, null ends are dropped, no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"`{a}` is not null and `{b}` is not null and hi > lo")
    e = materialise(e.distinct(), "edges")
    label = None
    while True:
        hooks = materialise(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), "hooks")
        while True:
            jumped = _lookup(hooks.withColumnRenamed("up", "old"), "old", hooks, "up", "up")
            jumped = materialise(jumped, "jump")
            moved = jumped.where("up < old").limit(1).count()
            discard(hooks)
            hooks = jumped.drop("old")
            if not moved:
                break
        if label is None:
            roots = e.select(F.col("lo").alias("node")).distinct().join(hooks, "node", "left_anti")
            label = materialise(hooks.select("node", F.col("up").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "label")
        else:
            old = label
            label = materialise(_lookup(old.withColumnRenamed("component", "was"), "was", hooks, "up", "component").drop("was"), "label")
            discard(old)
        left = _lookup(_lookup(e, "hi", hooks, "up", "x"), "lo", hooks, "up", "y").where("x <> y")
        new = materialise(left.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
        discard(e)
        discard(hooks)
        e = new
        if not e.limit(1).count():
            discard(e)
            return label
