"""Writes as snapshots: conditional upserts, immutable imports, versions still to be archived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """(key, content, changed_at, observed_at) after ``incoming``; changed_at moves only where the content differs."""
    old = current.select(key, F.col(content).alias("__old"), F.col("at").alias("__was"))
    new = incoming.select(key, F.col(content).alias("__new"), F.col("at").alias("__now"))
    moved = F.col("__now").isNotNull() & (F.col("__was").isNull() | ~F.col("__new").eqNullSafe(F.col("__old")))
    return old.join(new, key, "full").select(
        key, F.when(F.col("__now").isNull(), F.col("__old")).otherwise(F.col("__new")).alias(content), F.when(moved, F.col("__now")).otherwise(F.col("__was")).alias("changed_at"), F.coalesce("__now", "__was").alias("observed_at")
    )


def import_outcomes(stored: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """(key, outcome) of each incoming row: imported, replayed (equal content), or conflict; nothing stored is replaced."""
    old = stored.select(key, F.col(content).alias("__old"), F.lit(True).alias("__stored"))
    outcome = F.when(F.col("__stored").isNull(), "imported").when(F.col("__old").eqNullSafe(F.col(content)), "replayed").otherwise("conflict")
    return incoming.join(old, key, "left").select(key, outcome.alias("outcome"))


def outbox(old: DataFrame, new: DataFrame, key: str, content: str, sent: DataFrame) -> DataFrame:
    """(event_id, key, content) of new or changed rows; events in ``sent(event_id)`` are not sent again."""
    same = old.select(key, content)
    changed = new.select(key, content).join(same, [key, content], "left_anti")
    events = changed.withColumn("event_id", F.md5(F.concat_ws("|", key, content)))
    return events.join(sent, "event_id", "left_anti").select("event_id", key, content)


def inserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``incoming`` whose key ``stored`` lacks, one of each key; a null in a key is a value as others."""
    known = stored.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return incoming.dropDuplicates(keys).join(known, same, "left_anti")


def archived(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, content, version, archived): the versions that a changed row leaves behind, and the new ones, for an append-only archive.

    ``old`` has a version; a row that is new begins with version 1, an unchanged one has no row.
    """
    before = old.select(key, F.col(content).alias("__old"), F.col("version").alias("__version"))
    met = new.select(key, F.col(content).alias("__new")).join(before, key, "left")
    changed = met.where(F.col("__version").isNull() | ~F.col("__new").eqNullSafe(F.col("__old")))
    left = changed.where(F.col("__version").isNotNull()).select(key, F.col("__old").alias(content), F.col("__version").alias("version"), F.lit(True).alias("archived"))
    return left.unionByName(changed.select(key, F.col("__new").alias(content), (F.coalesce("__version", F.lit(0)) + 1).alias("version"), F.lit(False).alias("archived")))


def refetched(children: DataFrame, runs: DataFrame, day: Column, reconcile: Column) -> DataFrame:
    """``children`` (source, changed_at) that a run of ``day`` fetches again, with ``why``.

    ``runs`` has source, started and complete.  On a source's day of reconciliation (``reconcile``, over source and day) all of its
    children are; else those changed since its last complete run began; all if none ever was complete.
    """
    marks = runs.groupBy("source").agg(F.max(F.when(F.col("complete") & (F.col("started") <= day), F.col("started"))).alias("__mark"))
    met = children.join(marks, "source", "left").withColumn("day", day)
    why = F.when(reconcile, "reconciliation").when(F.col("__mark").isNull(), "never complete").when(F.col("changed_at") >= F.col("__mark"), "changed")
    return met.withColumn("why", why).where(F.col("why").isNotNull()).drop("__mark", "day")
