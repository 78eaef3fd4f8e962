"""Joins beyond plain equality: aliases, disjunctive existence, validity at a time, calendars, snapshots, anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(df: DataFrame, column: str, aliases: DataFrame, alias: str, target: str) -> DataFrame:
    """``column`` replaced by what it is an alias of, before any join on it."""
    pairs = aliases.select(F.col(alias).alias("__alias"), F.col(target).alias("__target"))
    joined = df.join(pairs, F.col(column) == F.col("__alias"), "left")
    return joined.withColumn(column, F.coalesce("__target", column)).drop("__alias", "__target")


def any_exists(df: DataFrame, key: str, *others: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key is found in at least one of ``others``: one semi-join with the union of their keys."""
    keys = None
    for other, column in others:
        own = other.select(F.col(column).alias("__key"))
        keys = own if keys is None else keys.unionByName(own)
    return df.join(keys, F.col(key) == F.col("__key"), "left_semi")


def exists_and_not(df: DataFrame, key: str, other: DataFrame, other_key: str, some: Column, none: Column) -> DataFrame:
    """Rows with a match for ``some`` and without one for ``none``, with one pass over ``other``."""
    flags = other.groupBy(F.col(other_key).alias("__key")).agg(F.bool_or(some).alias("__some"), F.bool_or(none).alias("__none"))
    return df.join(flags.where(F.col("__some") & ~F.coalesce("__none", F.lit(False))), F.col(key) == F.col("__key"), "left_semi")


def valid_at(events: DataFrame, tenures: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Events with the tenures of the same key that hold at the event: start <= at, and at < end or end is open."""
    joined = events.join(tenures, list(keys))
    return joined.where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def tenure_at(events: DataFrame, tenures: DataFrame, keys: Sequence[str], own: Column) -> DataFrame:
    """``events`` (keys, day, ...) with the ``tenures`` (keys, tenure, a, b, seen, ...) that hold on their day: both ends count, an
    open end is the day the tenure was seen, and one without a first day holds on that day alone and only if ``own``."""
    joined = events.join(tenures, list(keys))
    day = F.col("day")
    dated = (day >= F.col("a")) & (day <= F.coalesce("b", "seen"))
    undated = own & (day == F.col("seen")) & (F.col("b").isNull() | (day <= F.col("b")))
    return joined.where(F.when(F.col("a").isNotNull(), dated).otherwise(undated))


def roster_diff(old: DataFrame, new: DataFrame, key: str, name: str, values: Sequence[str]) -> DataFrame:
    """(key, status): new, removed, renamed, changed or unchanged, by one full outer join."""
    a = old.select(key, F.col(name).alias("__on"), F.struct(*values).alias("__ov"), F.lit(True).alias("__o"))
    b = new.select(key, F.col(name).alias("__nn"), F.struct(*values).alias("__nv"), F.lit(True).alias("__n"))
    status = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "removed").when(~F.col("__on").eqNullSafe(F.col("__nn")), "renamed")
    return a.join(b, key, "full_outer").select(key, status.when(~F.col("__ov").eqNullSafe(F.col("__nv")), "changed").otherwise("unchanged").alias("status"))


def scaffold(days: DataFrame, kinds: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every day with every kind, whether found or not; days and kinds are small dimensions."""
    return days.join(kinds).join(found, list(on), "left")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): new, removed, changed or unchanged between two snapshots, by one full outer join."""
    a = old.select(F.col(key), F.col(value).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(F.col(key), F.col(value).alias("__new"), F.lit(True).alias("__in_new"))
    status = F.when(F.col("__in_old").isNull(), "new").when(F.col("__in_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def anchor_similarity(df: DataFrame, item: str, anchor: str, least: int = 2, most: int = 50) -> DataFrame:
    """(left, right, weight): items that share anchors of document frequency ``least`` to ``most``, weight sum of 1 / df.

    The cap bounds the pairs of an anchor; an anchor on more items says nothing about any two of them.  Pairs are not shuffled:
    an item gets the lists of those that follow it on its anchors, sorted by item, and adds up its own pairs.
    """
    pairs = df.select(item, anchor).where(F.col(anchor).isNotNull()).distinct()
    # One item more than ``most`` shows that an anchor is too common; no list is longer.
    first = pairs.withColumn("__n", F.row_number().over(Window.partitionBy(anchor).orderBy(item))).where(F.col("__n") <= most + 1)
    listed = first.groupBy(anchor).agg(F.count("*").alias("__df"), F.array_sort(F.collect_list(item)).alias("__items")).where(F.col("__df").between(least, most))
    met = listed.select(F.posexplode("__items").alias("__at", "left"), "__items", "__df")
    met = met.select("left", F.slice("__items", F.col("__at") + 2, F.size("__items")).alias("right"), "__df").where(F.size("right") > 0)
    kind = df.schema[item].dataType.simpleString()
    return met.repartition("left").sortWithinPartitions("left").mapInArrow(_added_pairs, f"left {kind}, right {kind}, weight double")


def _added_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (left, right) with the sum of 1 / df, from rows (left, right: array, __df) in the order of left."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        # Rows of the last item wait for the next batch.
        lefts = table.column("left")
        last = pc.index(pc.equal(lefts, lefts[-1]), True).as_py()
        if last:
            yield from _pairs(pa.concat_tables([*held, table.slice(0, last)]))
            held = [table.slice(last)]
        elif held and held[-1].column("left")[-1] != lefts[-1]:
            yield from _pairs(pa.concat_tables(held))
            held = [table]
        else:
            held.append(table)
    if held:
        yield from _pairs(pa.concat_tables(held))


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    rows = pc.list_parent_indices(table.column("right"))
    flat = pa.table({"left": table.column("left").take(rows), "right": pc.list_flatten(table.column("right")), "weight": pc.divide(1.0, table.column("__df").cast(pa.float64())).take(rows)})
    summed = flat.group_by(["left", "right"], use_threads=False).aggregate([("weight", "sum")])
    yield from summed.select(["left", "right", "weight_sum"]).rename_columns(["left", "right", "weight"]).to_batches(max_chunksize=20_000)


def violations(df: DataFrame, key: str, other: DataFrame, other_key: str, kind: str) -> DataFrame:
    """(violation, key) of rows that refer to nothing."""
    missing = df.where(F.col(key).isNotNull()).join(other, F.col(key) == other[other_key], "left_anti")
    return missing.select(F.lit(kind).alias("violation"), F.col(key).cast("bigint").alias("key"))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose key it lacks."""
    return table.unionByName(rows.join(table, list(keys), "left_anti"))


def looked_up(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are, all together, a row of ``asked``: one join on all of them in place of a list of alternatives.

    A null is a value as others; repeated rows of ``asked`` do not repeat what they find.
    """
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(asked.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), same, "left_semi")


def voters(votes: DataFrame, identifiers: DataFrame, sessions: DataFrame) -> DataFrame:
    """``votes`` (bill, session, namespace, value, name, vote) with ``person`` and ``how``.

    A voter is known by an identifier of the session's namespace (``identifiers`` namespace, value, person), and one identifier of
    two persons is a ``conflict``; else unknown.  Votes of sessions that are not held (``sessions`` bill, session) have no row.
    """
    bound = identifiers.groupBy("namespace", "value").agg(F.min("person").alias("__person"), F.count_distinct("person").alias("__n"))
    met = votes.join(sessions.select("bill", "session").distinct(), ["bill", "session"], "left_semi").join(bound, ["namespace", "value"], "left")
    how = F.when(F.col("__n") > 1, "conflict").when(F.col("__n") == 1, "identifier").otherwise("unknown")
    return met.select(*votes.columns, F.when(F.col("__n") == 1, F.col("__person")).alias("person"), how.alias("how"))
