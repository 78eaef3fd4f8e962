"""Connected components of an edge table, by joins only.

Each round hooks every component to its least neighbour, halves the depth of the resulting trees by pointer jumping
until all are flat, and keeps one edge between each two components that are still apart.  A component with a neighbour
either hooks or is hooked to, so at least half of those that have edges vanish in a round.  Every table is written to
the shared folder, so a lost executor costs a task, not the history; a node with very many neighbours meets them in many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_spread, new_folder, written


def _flatten(parents: DataFrame, folder: str, tag: str) -> DataFrame:
    """(node, parent) with every parent a root; parents are never larger than their node."""
    step = 0
    while True:
        up = parents.where("node <> parent").select(F.col("node").alias("parent"), F.col("parent").alias("_p"))
        parents = written(
            join_spread(parents, up, ["parent"], [F.col("node")]).select("node", F.coalesce("_p", "parent").alias("parent"), F.col("_p").isNotNull().alias("moved")),
            f"{folder}/{tag}-{step}",
        )
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")
        parents, step = parents.select("node", "parent"), step + 1


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the least node that it reaches."""
    folder = new_folder(edges.sparkSession, name)
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{folder}/edges")
    labels, turn = None, 0
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least")).select("node", F.least("node", "_least").alias("parent"))
        roots = _flatten(written(hooked, f"{folder}/hooked-{turn}"), folder, f"flat-{turn}")
        if labels is None:
            labels = roots.withColumnRenamed("parent", "component")
        else:
            onward = roots.select(F.col("node").alias("component"), F.col("parent").alias("_root"))
            labels = join_spread(labels, onward, ["component"], [F.col("node")]).select("node", F.coalesce("_root", "component").alias("component"))
            labels = written(labels, f"{folder}/labels-{turn}")
        of_a, of_b = (roots.select(F.col("node").alias(k), F.col("parent").alias(f"r{k}")) for k in "ab")
        live = join_spread(live, of_a, ["a"], [F.col("b")])
        live = join_spread(written(live, f"{folder}/half-{turn}"), of_b, ["b"], [F.col("a")]).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        live, turn = written(live, f"{folder}/edges-{turn}"), turn + 1
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
