"""Mixing sources to target weights: entropy balancing with document rates rounded into copies.

Every source s has a target of T_s words.  Among all rates r_i >= 0 of its documents with sum r_i * size_i = T_s and
r_i <= cap, those nearest to one in relative entropy are r_i = min(cap, exp(lambda_s * size_i / mean_s)).  The dual is
convex in lambda_s; its root is found by Newton steps kept inside a shrinking bracket.  A rate depends on source and
size alone, so the exact histogram (source, size, count) is all that the iterations read: one shuffle, however many
documents there are, with at most as many rows in a source as it has different sizes.

Rounding: along the sizes of a source, copies follow the running sum of rates, so the words taken differ from the
target by about one document.  Copies of one (source, size) group go to its blocks by exact integer shares, and in a
block to documents in the order of a hash of their id, so that no group, however large, meets in one task.

Defined results: a null or empty text has size 0 and counts as taken 0 words; it keeps one copy, as its rate is one.
A null source is a source of its own, last in order.  Repeated rows are separate documents.  With no words at all
every target is 0.  An empty table gives an empty table.  All columns of the input are kept; an added column replaces
one of its own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT_SHARE, new_folder, written

WORD_GAPS = r"[\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda w: w != "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all words; a target
    stops at ``cap`` times its source, and what is over goes to the others by weight until none is above.  The table
    has a row per source, not per document, so its two windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    df = sources.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    df = df.withColumn("__most", F.col("source_size") * F.lit(float(cap))).withColumn("__full_at", F.col("__most") / F.col("__weight"))
    fill = Window.orderBy(F.col("__full_at"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("__most").over(before), F.lit(0.0))) / F.sum("__weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    # The first source, in the order of filling, that the level does not fill gives the level for it and all after it.
    df = df.withColumn("__level", level)
    df = df.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__full_at"), F.struct("__full_at", "__level"))).over(every)["__level"])
    target = F.least(F.col("__most"), F.coalesce(F.col("__weight") * F.col("__level"), F.col("__most")))
    return df.withColumn("target", target).select("source", "source_size", "target")


def _sum(term: Column) -> Column:
    """A sum that comes out alike whatever the order of rows."""
    return F.sum(term.cast("decimal(28,12)")).cast("double")


def rates(histogram: DataFrame, cap: float = 2.0) -> DataFrame:
    """(source, size, n, source_size, target, rate) from the same without rate, a stored table.

    All sources iterate at once.  A step sums over the histogram with partial sums in every task; what goes from step to
    step is a row per source.  Sources that are at their target, or whose bracket is down to one number, leave the
    iteration; after 30 steps every third one halves the bracket, so that it ends whatever the sizes are.
    """
    folder = new_folder(histogram.sparkSession, "mix-newton")
    goals = histogram.groupBy(F.col("source").alias("__s")).agg(F.sum("n").alias("__docs"), F.max("source_size").alias("__words"), F.max("target").alias("__target"))
    unit = F.col("__words") / F.col("__docs")
    full = F.col("__target") >= cap * F.col("__words") * (1 - 1e-12)
    state = goals.select("__s", unit.alias("__unit"), (F.col("__target") / unit).alias("__goal"), F.lit(0.0).alias("__lambda"), F.lit(-700.0).alias("__low"), F.lit(700.0).alias("__high"), ((F.col("__words") == 0) | full).alias("__done"))
    state = written(state, f"{folder}/0")

    def raw() -> Column:
        return F.exp(F.least(F.col("__lambda") * F.col("size") / F.col("__unit"), F.lit(50.0)))

    k = 0
    while not (open_ := state.where("NOT __done")).isEmpty():
        z = F.col("size") / F.col("__unit")
        moved = histogram.join(open_, F.col("source").eqNullSafe(F.col("__s"))).groupBy(*open_.columns)
        moved = moved.agg(
            (_sum(F.col("n") * z * F.least(raw(), F.lit(cap))) - F.col("__goal")).alias("__gap"),
            _sum(F.when(raw() < cap, F.col("n") * z * z * raw()).otherwise(0.0)).alias("__slope"),
        )
        moved = moved.withColumns({"__low": F.when(F.col("__gap") < 0, F.col("__lambda")).otherwise(F.col("__low")), "__high": F.when(F.col("__gap") > 0, F.col("__lambda")).otherwise(F.col("__high"))})
        step = F.col("__lambda") - F.col("__gap") / F.col("__slope")
        safe = F.lit(k < 30 or k % 3 != 2) & (F.col("__slope") > 0) & (step > F.col("__low")) & (step < F.col("__high"))
        near = F.abs("__gap") <= 1e-9 * F.greatest(F.col("__goal"), F.lit(1.0))
        after = F.when(near, F.col("__lambda")).when(safe, step).otherwise((F.col("__low") + F.col("__high")) / 2)
        closed = F.col("__high") - F.col("__low") <= 4e-16 * F.greatest(F.abs("__low"), F.abs("__high"), F.lit(1.0))
        moved = moved.withColumns({"__lambda": after, "__done": near | closed}).select(*open_.columns)
        k += 1
        state = written(moved.union(state.where("__done")), f"{folder}/{k}")
    at_most = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    rate = F.when((F.col("source_size") > 0) & at_most, F.lit(cap)).when(F.col("source_size") > 0, F.least(raw(), F.lit(cap))).otherwise(1.0)
    found = histogram.join(state, F.col("source").eqNullSafe(F.col("__s")))
    return found.withColumn("rate", rate).select("source", "size", "n", "source_size", "target", "rate")


def group_copies(rated: DataFrame, cap: float = 2.0) -> DataFrame:
    """Adds ``group_copies``: how many copies all documents of a (source, size) group get together."""
    along = Window.partitionBy("source").orderBy("size")
    upto = F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    df = rated.withColumn("__upto", F.floor(upto + 0.5))
    copies = F.col("__upto") - F.coalesce(F.lag("__upto").over(along), F.lit(0))
    return df.withColumn("group_copies", F.greatest(F.lit(0), F.least(copies, F.floor(cap * F.col("n")))).cast("long")).drop("__upto")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_rows: int = 2000) -> DataFrame:
    """``docs`` with size, source_size, target (both of its source), copies and taken = copies * size."""
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "rate", "copies", "taken")
    if clash := [c for c in added if c in docs.columns]:
        docs = docs.drop(*clash)
    sized = docs.withColumn("size", size_of(F.col(text)))
    counted = written(sized.groupBy(F.col(source).alias("source"), "size").agg(F.count("*").alias("n")), new_folder(spark, "mix-sizes"))
    goals = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    histogram = counted.join(goals.withColumnRenamed("source", "__source").hint("merge"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    histogram = written(histogram, new_folder(spark, "mix-histogram"))
    plan = written(group_copies(rates(histogram, cap), cap), new_folder(spark, "mix-plan"))

    # Documents are ranked within (source, size).  Groups of more than block_rows documents that hold over one in HOT_SHARE
    # of all, fewer than HOT_SHARE, are cut into blocks of about block_rows, each with its exact share of the group's copies.
    # Documents and shares then meet by one merge on (source, size, block), which the ranking uses too.
    keys = ["__none", "__source", "__size"]
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    whole = plan.select(F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__source"), F.col("size").alias("__size"), F.col("n").alias("__n"), F.col("group_copies").alias("__group_copies"), "source_size", "target", "rate")
    large = (F.col("__n") > block_rows) & (F.col("__n") * HOT_SHARE > total)
    hot = F.broadcast(whole.where(large).select(*keys, F.ceil(F.col("__n") / block_rows).alias("__blocks")))
    text_source = F.col(source).cast("string")
    keyed = sized.withColumns({"__none": F.col(source).isNull(), "__source": F.coalesce(text_source, F.lit("")), "__size": F.col("size")}).join(hot, keys, "left")
    keyed = keyed.withColumn("__block", F.pmod(F.xxhash64(F.col(doc_id)), F.coalesce("__blocks", F.lit(1).cast("bigint"))))
    many = keyed.where(F.col("__blocks").isNotNull()).groupBy(*keys, "__block").agg(F.count("*").alias("__m")).join(whole.hint("merge"), keys)
    along = Window.partitionBy(*keys).orderBy("__block")
    many = many.withColumn("__end", F.sum("__m").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    many = many.withColumn("__upto", F.expr("cast(cast(__end as decimal(38,0)) * __group_copies div __n as bigint)"))
    many = many.withColumn("__share", F.col("__upto") - F.coalesce(F.lag("__upto").over(along), F.lit(0)))
    own = [*keys, "__block", "__m", "__share", "source_size", "target", "rate"]
    single = whole.where(~large).withColumns({"__block": F.lit(0).cast("bigint"), "__m": F.col("__n"), "__share": F.col("__group_copies")})
    joined = keyed.join(many.select(*own).union(single.select(*own)).hint("merge"), [*keys, "__block"])
    n, k = F.col("__m"), F.col("__share")
    place = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(F.xxhash64(F.col(doc_id), F.lit(1)), F.col(doc_id)))
    copies = F.expr("0").cast("long") + F.floor(k / n) + F.when(place <= k % n, 1).otherwise(0)
    out = joined.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*docs.columns, *added)


def copied(mixed: DataFrame) -> DataFrame:
    """A row for every copy that the mix takes, numbered from 0 in ``__copy``."""
    times = F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))
    return mixed.where("copies > 0").withColumn("__copy", F.explode(times))
