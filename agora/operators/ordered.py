"""Ordered analytics: latest-by-key, decisions by rank, generations, forward fills, merged intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]

#: Rows of a task that sorts and adds up what it reads, where their number is known beforehand.
TASK_ROWS = 500_000


def ranked(df: DataFrame, keys: Keys, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds each row's rank within its key; ``order`` should end in a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest_by(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``.  Spark limits groups before the shuffle."""
    return ranked(df, keys, order, "__rank").where("__rank = 1").drop("__rank")


def decided(df: DataFrame, keys: Keys, order: Sequence[Column], approved: Column) -> DataFrame:
    """Latest row of each key, kept only if approved: ranking comes before filtering, so an old approval never returns."""
    return latest_by(df, keys, order).where(approved)


def changes(df: DataFrame, keys: Keys, order: Sequence[Column], value: str) -> DataFrame:
    """Adds ``changed`` (differs from the row before) and ``generation`` (how many changes so far, from 1): A, B, A are three."""
    along = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(along)
    first = F.row_number().over(along) == 1
    df = df.withColumn("changed", first | ~before.eqNullSafe(F.col(value)))
    return df.withColumn("generation", F.sum(F.col("changed").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def last_before(df: DataFrame, keys: Keys, order: Sequence[Column], flag: Column, at: str, name: str) -> DataFrame:
    """As-of join without a self-join: adds the latest ``at`` among rows up to this one for which ``flag`` holds."""
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(F.when(flag, F.col(at))).over(along))


def merged_intervals(df: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """Unions of touching or overlapping intervals of each key: (keys, start, end, parts)."""
    along = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    df = df.withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts"))
    return out.drop("__island")


def contiguous(df: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """(keys, covered): whether a key's intervals, in order, leave no gap."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start))
    return df.withColumn("__ok", before.isNull() | (before == F.col(start))).groupBy(*keys).agg(F.bool_and("__ok").alias("covered"))


def surviving_claims(df: DataFrame, entity: str, scope: str, revision: str, claim: str, rows: int | None = None) -> DataFrame:
    """Claims none of whose scopes a newer revision of the same entity has touched.  ``df`` has a row per claim and scope; repeated
    rows count once.

    An entity's rows meet in one shuffle and one sort, in which repeated rows stand side by side and the newest first.  With
    ``rows``, how many there are at most, tasks are as many as keep each at about ``TASK_ROWS``, whatever the session's number.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // TASK_ROWS))
    spread = df.select(entity, scope, revision, claim)
    spread = spread.repartition(entity) if rows is None else spread.repartition(parts, entity)
    along = Window.partitionBy(entity, scope).orderBy(F.col(revision).desc(), claim)
    again = (F.row_number().over(along) > 1) & F.lag(claim).over(along).eqNullSafe(F.col(claim)) & F.lag(revision).over(along).eqNullSafe(F.col(revision))
    kept = spread.withColumns({"__own": F.col(revision) == F.first(revision).over(along), "__again": again})
    return kept.where("NOT __again").groupBy(entity, claim).agg(F.bool_and("__own").alias("survives"), F.count("*").alias("scopes"))


def running_cap(df: DataFrame, keys: Keys, order: Sequence[Column], amount: Column, cap: float) -> DataFrame:
    """Adds the running total of ``amount`` and whether it is still within ``cap``."""
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(amount).over(along)).withColumn("admitted", F.col("running") <= cap)
