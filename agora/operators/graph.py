"""Graph operators over edge tables (source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import folder, landed


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").union(edges.select("target", "source")).distinct()


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(node, distance) of nodes within ``depth`` hops of ``roots(node)``: one join per hop, no loop over rows."""
    hops = undirected(edges)
    found = roots.select("node", F.lit(0).alias("distance"))
    edge = found
    for d in range(1, depth + 1):
        edge = edge.join(hops, edge["node"] == hops["source"]).select(F.col("target").alias("node"), F.lit(d).alias("distance")).distinct()
        found = found.unionByName(edge)
    return found.groupBy("node").agg(F.min("distance").alias("distance"))


def valid_artifacts(artifacts: DataFrame, children: DataFrame, levels: int) -> DataFrame:
    """(id, valid): current artifacts all of whose children, down ``levels`` levels, are valid too."""
    valid = artifacts.select("id", F.col("current").alias("valid"))
    for _ in range(levels):
        bad = children.join(valid.where(~F.col("valid")).select(F.col("id").alias("child")), "child").select(F.col("id").alias("__bad")).distinct()
        valid = valid.join(bad, F.col("id") == F.col("__bad"), "left").select("id", (F.col("valid") & F.col("__bad").isNull()).alias("valid"))
    return valid


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that ``edges`` (source, target) reach, for every node of an edge.

    Rounds alternate two steps: every node hands its larger neighbours to the least one around it, then its smaller ones.
    Trees become stars in a number of rounds that is logarithmic on chains, and each round has no more edges than the first.  Both steps
    of a round are one pass, in which only a node's links meet.
    """
    stage = folder(edges.sparkSession, "components")
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).where("node IS NOT NULL").distinct()
    links = edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct()
    links, turn = landed(links, f"{stage}/0"), 0
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
    before, around = state(links), Window.partitionBy("u")
    while True:
        turn += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("least", F.least(F.min("v").over(around), "u")).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = large.withColumn("least", F.min("v").over(around)).select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v")).where("u <> v")
        links = landed(small.distinct(), f"{stage}/small-{turn}")
        after = state(links)
        if after == before:
            break
        before = after
    named = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return landed(nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")), f"{stage}/named")
