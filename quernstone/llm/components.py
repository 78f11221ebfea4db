"""Connected components by hooking each node to its smallest neighbour and contracting the trees that this makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import if_small, stage, unstage

#: Pointers up to this number (and the bytes of ``staging.is_small``) are sent to all tasks, so that looking them up shuffles nothing.
POINTERS = 500_000


def relabel(df: DataFrame, pointers: DataFrame, *columns: str) -> DataFrame:
    """``df`` with each of the columns pointed on by ``pointers`` (u once, v), where it has a pointer."""
    for name in columns:
        to = pointers.select(F.col("u").alias(name), F.col("v").alias("_to"))
        df = df.join(to, name, "left").withColumn(name, F.coalesce("_to", name)).drop("_to")
    return df


def roots(forest: DataFrame) -> DataFrame:
    """u, v (the root above u) for each u of a staged ``forest`` of pointers: u once, v < u. Each round doubles the pointers' reach."""
    now = forest
    while True:
        reach = if_small(now, POINTERS).select(F.col("u").alias("v"), F.col("v").alias("w"))
        jumped = stage(now.select("u", "v").join(reach, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), "roots")
        ended = jumped.where("moved").isEmpty()
        if now is not forest:
            unstage(now)
        now = jumped
        if ended:
            return now


def _ordered(edges: DataFrame) -> DataFrame:
    return stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")


def pointers(edges: DataFrame) -> DataFrame:
    """u, v (the smallest node reachable) for each node of ``edges`` (u, v, long) that is not the smallest itself, once; staged.

    Each round hooks a node to its smallest neighbour, if that is smaller, follows the hooks to their roots and leaves the edges between
    different roots. A node with no smaller neighbour has another hooked to it, or has a smaller neighbour in the next round; so two rounds at
    least halve the nodes that have edges. A round shuffles the edges once, for the smallest neighbours, and nothing else while there are few
    nodes to point on; beyond, lookups are joins. What is kept is no longer than the edges and nodes, written to the shared folder each round.
    """
    now, found = _ordered(edges), None
    while not now.isEmpty():
        hooks = stage(now.groupBy("u").agg(F.min("v").alias("v")), "hooks")
        to = roots(hooks)
        known = if_small(to, POINTERS)
        before, now = now, _ordered(relabel(now, known, "u", "v"))
        unstage(before, hooks)
        if found is None:
            found = to
        else:
            before, found = found, stage(relabel(found.select("u", "v"), known, "v").unionByName(to.select("u", "v")), "found")
            unstage(before, to)
    return now if found is None else found


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of ``edges`` (u, v, long).

    Nothing goes to the driver but whether edges are left. Null ends and loops are left out; no edges give no rows.
    """
    found = pointers(edges)
    ends = found.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
