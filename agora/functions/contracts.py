"""Contracts of sources: how rows of a source become activities and votes.  Nothing is guessed: only a verified contract projects."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forms import instant

REQUIRED = ("title", "date")


@dataclass(frozen=True)
class Contract:
    """Fields by what they mean (title, date, stage, vote, person, summary, url), stages and votes by value, the namespace of a person's
    id, topics, how many rows a page has and the record key that the last one ended at."""

    source: str
    kind: str
    verified: bool
    fields: Mapping[str, str]
    stages: Mapping[str, str] = field(default_factory=dict)
    votes: Mapping[str, str] = field(default_factory=dict)
    namespace: str | None = None
    topics: tuple[str, ...] = ()
    limit: int = 100_000
    cursor: str | None = None

    def __post_init__(self) -> None:
        if missing := [name for name in REQUIRED if not self.fields.get(name)]:
            raise ValueError(f"a contract of {self.source!r} needs the fields {missing}")
        if "person" in self.fields and not self.namespace:
            raise ValueError(f"a contract of {self.source!r} names people without a namespace")
        if not 1 <= self.limit <= 100_000:
            raise ValueError("a page has 1 to 100000 rows")


def _known(values: Mapping[str, str], value: Column) -> Column:
    """The meaning of a value; ``unknown`` if the contract does not name it, null if there is none."""
    if not values:
        return F.lit(None).cast("string")
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), value), F.lit("unknown")))


def page(rows: DataFrame, key: str, contract: Contract) -> DataFrame:
    """The next ``limit`` rows after the contract's cursor, by ``key``; a limit on a sorted table, so Spark keeps that many per task."""
    after = rows if contract.cursor is None else rows.where(F.col(key) > F.lit(contract.cursor))
    return after.orderBy(key).limit(contract.limit)


def projected(rows: DataFrame, key: str, contract: Contract) -> DataFrame:
    """Activities of ``rows`` (key, fields: map of texts): key, id, kind, title, stage, vote, person, summary, url, published_at, topics.

    ``skipped`` says why a row is none: it has no title, or no date that can be read.  A stage or vote that the contract does not
    name is ``unknown``; a blank field counts as absent.  A person's id is ``namespace:value``.  Repeated rows are kept.
    """
    if not contract.verified:
        raise ValueError("only a verified contract may be projected")
    none = F.lit(None).cast("string")
    get = lambda name: F.nullif(F.trim(F.try_element_at("fields", F.lit(contract.fields[name]))), F.lit("")) if name in contract.fields else none
    at = instant(get("date"))
    stage = F.coalesce(_known(contract.stages, get("stage")), F.lit("unknown"))
    person = F.when(get("person").isNotNull(), F.concat(F.lit(f"{contract.namespace}:"), get("person")))
    skipped = F.when(get("title").isNull(), "no title").when(at.isNull(), "no date")
    return rows.select(
        key, F.sha2(F.concat_ws("|", F.lit(contract.source), F.col(key)), 256).alias("id"), F.lit(contract.kind).alias("kind"), get("title").alias("title"), stage.alias("stage"), _known(contract.votes, get("vote")).alias("vote"),
        person.alias("person"), get("summary").alias("summary"), get("url").alias("url"), at.alias("published_at"), F.array(*map(F.lit, contract.topics)).cast("array<string>").alias("topics"), skipped.alias("skipped"),
    )


def outcome(projection: DataFrame, key: str, contract: Contract) -> DataFrame:
    """(imported, skipped, next_cursor) of a projected page; no cursor follows a page that is not full."""
    n = projection.agg(F.count_if(F.col("skipped").isNull()).alias("imported"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"), F.max(key).alias("__last"))
    full = F.col("imported") + F.col("skipped") >= contract.limit
    return n.select("imported", "skipped", F.when(full, F.col("__last")).alias("next_cursor"))
