"""Hash trees of snapshots: one hash for any number of rows, equal for equal rows however they are partitioned, and where two differ.

A row goes to a leaf by the first hexadecimal digits of its key's hash; a leaf hashes its rows in order, and every node above
hashes its children, sixteen at most, in order.  There are as many levels as the number of rows needs for leaves of some
FAN rows, so no list grows with the snapshot.  Trees that are to be compared are built with the same number of levels.

Defined results: keys and contents are texts; null is told from the empty one.  Equal rows are one row with a count.  A snapshot
without rows has a root of its own, the hash of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landing import folder, landed

FAN = 16


def levels_for(rows: int) -> int:
    """Levels below the root that keep leaves at some FAN rows."""
    level = 0
    while FAN ** (level + 1) < rows:
        level += 1
    return level


def _text(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.lit("="), value.cast("string")))


def _joined(lines: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)


def tree(rows: DataFrame, key: str, content: str, levels: int | None = None) -> DataFrame:
    """Stored nodes (level, prefix, hash, n) of ``rows``: level 0 is the root, ``prefix`` the digits of a node, n its rows."""
    stage = folder(rows.sparkSession, "hash-tree")
    lines = rows.select(F.sha2(_text(F.col(key)), 256).alias("k"), F.sha2(_text(F.col(content)), 256).alias("c")).groupBy("k", "c").agg(F.count("*").alias("n"))
    lines = landed(lines, f"{stage}/lines")
    levels = levels_for(lines.count()) if levels is None else levels
    line = F.concat_ws(":", "k", "c", "n")
    nodes = landed(lines.groupBy(F.left("k", F.lit(levels)).alias("prefix")).agg(_joined(line).alias("hash"), F.sum("n").alias("n")), f"{stage}/level-{levels}")
    every = nodes.select(F.lit(levels).alias("level"), "prefix", "hash", "n")
    for level in range(levels - 1, -1, -1):
        up = F.left("prefix", F.lit(level)).alias("prefix")
        nodes = landed(nodes.groupBy(up).agg(_joined(F.concat_ws(":", "prefix", "hash")).alias("hash"), F.sum("n").alias("n")), f"{stage}/level-{level}")
        every = every.unionByName(nodes.select(F.lit(level).alias("level"), "prefix", "hash", "n"))
    return every


def root(nodes: DataFrame) -> DataFrame:
    """(snapshot, n) of a tree."""
    found = nodes.where("level = 0").agg(F.max("hash").alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return found.select(F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("snapshot"), "n")


def differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """(level, prefix) of the nodes in which two trees of the same levels differ, from the root down.

    Only children of nodes that differ are compared, so it costs what the difference does.
    """
    depth = lambda nodes: nodes.agg(F.max("level").alias("level")).first().level
    levels = max((d for d in (depth(one), depth(two)) if d is not None), default=-1)
    stage = folder(one.sparkSession, "hash-tree-difference")
    found, above = None, None
    for level in range(levels + 1):
        sides = [nodes.where(F.col("level") == level).select("prefix", F.col("hash").alias(name)) for nodes, name in ((one, "a"), (two, "b"))]
        if above is not None:
            sides = [s.withColumn("__up", F.left("prefix", F.lit(level - 1))).join(above.select(F.col("prefix").alias("__up")), "__up", "left_semi").drop("__up") for s in sides]
        met = sides[0].join(sides[1], "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        above = landed(met.select(F.lit(level).alias("level"), "prefix"), f"{stage}/{level}")
        found = above if found is None else found.unionByName(above)
    return found if found is not None else one.select("level", "prefix").limit(0)


def in_leaves(rows: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """The rows of the differing leaves among ``nodes`` (level, prefix)."""
    levels = nodes.agg(F.max("level").alias("level")).first().level
    if levels is None:
        return rows.limit(0)
    leaf = F.left(F.sha2(_text(F.col(key)), 256), F.lit(levels))
    last = nodes.where(F.col("level") == levels).select(F.col("prefix").alias("__leaf"))
    return rows.withColumn("__leaf", leaf).join(last, "__leaf", "left_semi").drop("__leaf")
