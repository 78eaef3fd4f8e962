"""Reports put together by the entities they share: greedy groups in the order of ids, and the hierarchy that they make.

The greedy order is a sequence, but what an id takes only depends on ids that links of similarity connect with it.  So connected
components are found first, in rounds logarithmic on chains, and once for all levels of a hierarchy; those of bounded size are each
walked in order by one task, a path of many thousand ids in a single step.  In a larger component, rounds open every group that no smaller free id can touch, after which
it is split into components again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.landing import folder, landed
from .graph import components
from .ordered import ranked

#: Links of components that one task walks.
TASK_LINKS = 400_000


def similarities(anchors: DataFrame, degree: int = 50) -> DataFrame:
    """(id, other, weight), both ways, of ids that share an anchor of 2 to ``degree`` ids: the sum of 1 / frequency, in 10**-12.
    A column ``component`` of ids is kept."""
    held = [c for c in anchors.columns if c == "component"]
    pairs = anchors.select("id", "anchor", *held).distinct()
    kept = pairs.join(_often(pairs, degree), "anchor")
    met = kept.join(kept.select("anchor", F.col("id").alias("other")), "anchor").where("id <> other")
    return met.groupBy("id", "other").agg(F.sum(F.round(10**12 / F.col("df")).cast("bigint")).alias("weight"), *[F.min(c).alias(c) for c in held])


def _often(pairs: DataFrame, degree: int) -> DataFrame:
    return pairs.groupBy("anchor").agg(F.count("*").alias("df")).where(F.col("df").between(2, degree))


def connected(anchors: DataFrame) -> DataFrame:
    """(id, component) of ids that anchors connect in any number of steps: each with the least id of every anchor it has."""
    pairs = anchors.select("id", "anchor")
    least = pairs.groupBy("anchor").agg(F.min("id").alias("target"))
    return components(pairs.join(least, "anchor").select(F.col("id").alias("source"), "target"))


def _walked(most: int):
    def run(links: pd.DataFrame) -> pd.DataFrame:
        """Groups of whole components, in the order of ids."""
        links = links.sort_values(["id", "weight", "other"], ascending=[True, False, True])
        near = {own: part.tolist() for own, part in links.groupby("id", sort=True)["other"]}
        taken, ids, seeds = set(), [], []
        for own, others in near.items():
            if own in taken:
                continue
            group = [own, *[o for o in others if o not in taken and o != own][: most - 1]]
            taken.update(group)
            ids += group
            seeds += [own] * len(group)
        return pd.DataFrame({"id": ids, "seed": seeds})

    return run


def _grouped(anchors: DataFrame, most: int, degree: int, task_links: int, wide: bool) -> DataFrame | None:
    """(id, seed) of ids of ``anchors`` (id, anchor, component) in the groups of ``routed``, but for those that are left without a
    similar free id; None if none are similar.

    Components are walked apart, so any division that no link crosses gives the same groups.  ``wide`` says that components may be
    wider than what links connect: those too large for a task are divided by their links first.
    """
    spark, turn, groups = anchors.sparkSession, 0, []
    stage = folder(spark, "routing")
    keyed = landed(similarities(anchors, degree), f"{stage}/near")
    kind, fits = keyed.schema["id"].dataType.simpleString(), F.col("n") <= task_links
    while True:
        turn += 1
        sizes = landed(keyed.groupBy("component").agg(F.count("*").alias("n")), f"{stage}/sizes-{turn}")
        known = sizes.agg(F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("small"), F.count(F.when(~fits, 1)).alias("large")).first()
        if known.small:
            # Whole components are dealt over tasks of about an eighth of what a task may walk.
            parts = -(-8 * known.small // task_links)
            dealt = keyed.join(sizes.where(fits).select("component"), "component", "left_semi") if known.large else keyed
            dealt = dealt.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts))).repartition(parts, "part")
            walked = dealt.select("part", "id", "other", "weight").groupBy("part").applyInPandas(_walked(most), f"id {kind}, seed {kind}")
            landed(walked, f"{stage}/groups-{turn}-walked")
            groups.append(f"{stage}/groups-{turn}-walked")
        if not known.large:
            break
        open_ = landed(keyed.join(sizes.where(~fits).select("component"), "component", "left_semi").select("id", "other", "weight"), f"{stage}/free-{turn}")
        if turn > 1 or not wide:
            free = open_
            least = free.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("least"))
            beyond = free.join(least.select(F.col("id").alias("other"), F.col("least").alias("far")), "other").groupBy("id").agg(F.min("far").alias("far"))
            first = landed(least.join(beyond, "id").where((F.col("id") == F.col("least")) & (F.col("far") >= F.col("id"))).select("id"), f"{stage}/first-{turn}")
            taken = ranked(free.join(first, "id", "left_semi"), ["id"], [F.col("weight").desc(), F.col("other")]).where(F.col("rank") < most)
            group = landed(taken.select(F.col("other").alias("id"), F.col("id").alias("seed")).union(first.select("id", F.col("id").alias("seed"))), f"{stage}/groups-{turn}")
            groups.append(f"{stage}/groups-{turn}")
            rest = free.join(group.select("id"), "id", "left_anti").join(group.select(F.col("id").alias("other")), "other", "left_anti")
            open_ = landed(rest.select("id", "other", "weight"), f"{stage}/open-{turn}")
            if open_.isEmpty():
                break
        of = components(open_.select(F.col("id").alias("source"), F.col("other").alias("target")))
        keyed = landed(open_.join(of.withColumnRenamed("node", "id"), "id"), f"{stage}/keyed-{turn}")
    return spark.read.schema(f"id {kind}, seed {kind}").parquet(*groups) if groups else None


def routed(anchors: DataFrame, most: int = 3, degree: int = 50, task_links: int = TASK_LINKS) -> DataFrame:
    """(id, seed): reports of ``anchors`` (id, anchor) in groups of up to ``most``, as if ids were taken in order, each opening a group
    and taking the most similar reports that are still free, by id in ties.

    Reports are similar by the sum of 1 / frequency over shared anchors of 2 to ``degree`` reports; one without such an anchor is a
    group of its own.
    """
    every = anchors.select("id").distinct()
    pairs = landed(anchors.select("id", "anchor").distinct(), f"{folder(anchors.sparkSession, 'anchors')}/pairs")
    of = connected(pairs.join(_often(pairs, degree), "anchor"))
    found = _grouped(pairs.join(of.withColumnRenamed("node", "id"), "id"), most, degree, task_links, False)
    if found is None:
        return every.select("id", F.col("id").alias("seed"))
    # Whoever has no free neighbour left opens a group alone.
    alone = every.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("seed"))
    return found.unionByName(alone)


def hierarchy(leaves: DataFrame, most: int = 3, degree: int = 50, levels: int = 8, task_links: int = TASK_LINKS) -> DataFrame:
    """(level, parent, child): reports of ``leaves`` (id, anchor) under parents that cover them, level by level.

    The reports of a level are grouped by the anchors they share; groups of two or more become parents, which inherit all
    anchors of their children and are grouped next.  It ends with one root, when nothing is shared any more, or after
    ``levels``.  A parent's name is its level and a hash of its children in order.  Ids are texts.
    """
    stage = folder(leaves.sparkSession, "hierarchy")
    pairs = landed(leaves.select(F.col("id").cast("string").alias("id"), "anchor").distinct(), f"{stage}/pairs")
    # What leaves' anchors do not connect is not connected above either, so one division serves all levels.
    anchors = landed(pairs.join(connected(pairs).withColumnRenamed("node", "id"), "id"), f"{stage}/0")
    found = anchors.select(F.lit(0).alias("level"), F.col("id").alias("parent"), F.col("id").alias("child")).limit(0)
    for level in range(1, levels + 1):
        grouped = _grouped(anchors, most, degree, task_links, True)
        if grouped is None:
            break
        members = F.array_sort(F.collect_list("id"))
        linked = grouped.groupBy("seed").agg(members.alias("children")).where(F.size("children") > 1)
        parent = F.concat(F.lit(f"parent:{level}:"), F.sha2(F.concat_ws("\n", "children"), 256))
        named = landed(linked.select(F.lit(level).alias("level"), parent.alias("parent"), F.explode("children").alias("child")), f"{stage}/level-{level}")
        if named.isEmpty():
            break
        found = found.unionByName(named)
        anchors = landed(anchors.join(named.select(F.col("child").alias("id"), "parent"), "id").select(F.col("parent").alias("id"), "anchor", "component").distinct(), f"{stage}/{level}")
    return found


def cover_findings(tree: DataFrame) -> DataFrame:
    """(level, child, finding) of what is wrong with a hierarchy (level, parent, child): ``twice`` for a child of several parents of
    a level, ``unknown`` for one that is no parent of the level below, ``alone`` for a parent's only child."""
    twice = tree.groupBy("level", "child").agg(F.count_distinct("parent").alias("n")).where("n > 1").select("level", "child", F.lit("twice").alias("finding"))
    below = tree.select((F.col("level") + 1).alias("level"), F.col("parent").alias("child")).distinct()
    unknown = tree.where("level > 1").join(below, ["level", "child"], "left_anti").select("level", "child", F.lit("unknown").alias("finding")).distinct()
    alone = tree.groupBy("level", "parent").agg(F.count_distinct("child").alias("n"), F.min("child").alias("child")).where("n = 1").select("level", "child", F.lit("alone").alias("finding"))
    return twice.unionByName(unknown).unionByName(alone)
