"""What follows from facts and is not there yet, what no longer follows, and the requests that repair it.

Rules are Horn clauses over facts (relation, a, b), b null for a fact of one argument.  They are evaluated semi-naively: a round
joins only what the round before has added with all that is known, one join per atom of a body, until nothing is new, so a
small change costs what depends on it.  Retraction goes by supports: a derived fact stays while one of its supports has all its
premises; facts that only support each other in a circle go, as they have no ground.

Defined results: facts, supports and premises are sets, so repeated rows count once; facts with a null relation or first argument
are no facts.  Empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import folder, landed

Atom = tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    """``head`` holds where all atoms of ``body`` do; an atom is a relation and one or two variables, which begin with lower case."""

    name: str
    head: Atom
    body: tuple[Atom, ...]

    def __post_init__(self) -> None:
        atoms = (self.head, *self.body)
        if not self.body or any(not 2 <= len(a) <= 3 or not all(re.fullmatch(r"[a-z]\w*", v) for v in a[1:]) for a in atoms):
            raise ValueError(f"rule {self.name!r}: atoms are a relation and one or two variables")
        known = set(self.body[0][1:])
        for atom in self.body[1:]:
            if not known & set(atom[1:]):
                raise ValueError(f"rule {self.name!r}: {atom[0]} shares no variable with the atoms before it")
            known |= set(atom[1:])
        if not set(self.head[1:]) <= known:
            raise ValueError(f"rule {self.name!r}: the head has a variable that the body has not")


def facts(df: DataFrame) -> DataFrame:
    """Different facts (relation, a, b) as strings."""
    found = df.select(F.col("relation").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return found.where("relation IS NOT NULL AND a IS NOT NULL").distinct()


def _bound(known: DataFrame, atom: Atom) -> DataFrame:
    """The values of an atom's variables; a variable that stands twice has one value."""
    relation, *variables = atom
    df = known.where((F.col("relation") == relation) & (F.col("b").isNull() if len(variables) == 1 else F.col("b").isNotNull()))
    if len(set(variables)) < len(variables):
        df, variables = df.where("a = b"), variables[:1]
    return df.select(*[F.col(c).alias(v) for c, v in zip(("a", "b"), variables)])


def _heads(rule: Rule, parts: Sequence[DataFrame]) -> DataFrame:
    """The heads that follow if atom i of the body is read from parts[i]."""
    met = None
    for part, atom in zip(parts, rule.body):
        own = _bound(part, atom)
        met = own if met is None else met.join(own, sorted(set(met.columns) & set(own.columns)))
    head = [F.col(v) for v in rule.head[1:]]
    return met.select(F.lit(rule.head[0]).alias("relation"), head[0].alias("a"), (head[1] if len(head) > 1 else F.lit(None).cast("string")).alias("b"), F.lit(rule.name).alias("rule"))


def derived(known: DataFrame, added: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(relation, a, b, rule) of the facts that ``added`` brings by ``rules`` beside ``known``, without those of either.

    ``known`` is closed under the rules already; of several rules that bring a fact in the same round the first by name is
    named.  Rounds are as many as the longest chain of new facts.
    """
    stage = folder(known.sparkSession, "rules")
    compared = ["relation", "a", "b"]
    same = lambda one, two: F.expr(" AND ".join(f"{one}.{c} <=> {two}.{c}" for c in compared))
    unknown = lambda df, held: df.alias("x").join(held.alias("y"), same("x", "y"), "left_anti")
    before = landed(facts(known), f"{stage}/known")
    fresh = landed(unknown(facts(added), before), f"{stage}/0")
    rounds = [fresh.withColumn("rule", F.lit(None).cast("string"))]
    now = before
    while not fresh.isEmpty():
        every = now.unionByName(fresh)
        made = None
        for rule in rules:
            for i in range(len(rule.body)):
                # New facts at atom i, old ones before it, all after it: each new combination is found once.
                heads = _heads(rule, [now if j < i else fresh if j == i else every for j in range(len(rule.body))])
                made = heads if made is None else made.unionByName(heads)
        now = landed(every, f"{stage}/known-{len(rounds)}")
        if made is None:
            break
        named = made.groupBy(*compared).agg(F.min("rule").alias("rule"))
        found = landed(unknown(named, now), f"{stage}/{len(rounds)}")
        rounds.append(found)
        fresh = found.select(*compared)
    out = rounds[0].limit(0)
    for found in rounds[1:]:
        out = out.unionByName(found)
    return out


def retracted(supports: DataFrame, gone: DataFrame) -> DataFrame:
    """(fact, lost): derived facts that go with the facts ``gone`` (fact), and how many supports each had.

    ``supports`` has fact, support, premise: a fact holds if all premises of one of its supports do; facts without supports are
    grounds.  All supports are read by premise and by fact once: a fact with a support on grounds that stay is safe, one all of
    whose supports have a premise that is gone is lost, and only what is between goes on.  Of that, what rests on what is lost is
    suspected; then suspects come back that have a support none of whose premises is lost or still suspected, until none does.
    """
    stage = folder(supports.sparkSession, "retracted")
    held = supports.select("fact", "support", "premise").where("fact IS NOT NULL")  # repeated rows do no harm below
    lost = landed(gone.select(F.col("fact").alias("premise")).where("premise IS NOT NULL").distinct(), f"{stage}/gone")
    known = held.select(F.col("fact").alias("premise"), F.lit(False).alias("__gone")).union(lost.select("premise", F.lit(True)))
    marked = held.join(known.groupBy("premise").agg(F.max("__gone").alias("__gone")), "premise", "left")
    # What is gone speaks against a support, what is derived makes it depend, other premises are grounds.
    met = marked.select("fact", "support", F.when(~F.col("__gone"), F.col("premise")).alias("premise"), F.coalesce("__gone", F.lit(False)).alias("bad")).repartition("fact")
    support, fact = Window.partitionBy("fact", "support"), Window.partitionBy("fact")
    met = met.withColumns({"bad": F.max("bad").over(support), "rests": F.max(F.col("premise").isNotNull()).over(support), "first": F.row_number().over(support.orderBy("fact")) == 1})
    counted = {"lost": F.count(F.when(F.col("first"), F.col("support"))).over(fact), "safe": F.max(~F.col("bad") & ~F.col("rests")).over(fact), "touched": F.max("bad").over(fact), "dead": F.min("bad").over(fact)}
    read = met.withColumns(counted).where("NOT safe").withColumn("head", F.row_number().over(fact.orderBy("fact")) == 1).where("head OR NOT bad AND premise IS NOT NULL")
    # One row for each fact, and those of its supports that may hold.
    read = landed(read, f"{stage}/between")
    facts_ = read.where("head").select("fact", "lost", "touched", "dead")
    depend = read.where("NOT bad AND premise IS NOT NULL").select("fact", "support", "premise")
    suspected = landed(facts_.where("touched").select("fact"), f"{stage}/suspected-0")
    fresh, turn = suspected, 0
    while not fresh.isEmpty():
        turn += 1
        up = depend.join(fresh.select(F.col("fact").alias("premise")), "premise", "left_semi").select("fact").distinct()
        fresh = landed(up.join(suspected, "fact", "left_anti"), f"{stage}/fresh-{turn}")
        suspected = landed(suspected.unionByName(fresh), f"{stage}/suspected-{turn}")
    mine = landed(depend.join(suspected, "fact", "left_semi"), f"{stage}/mine")
    open_ = suspected
    back = mine
    while not back.isEmpty():
        turn += 1
        doubtful = mine.join(open_.select(F.col("fact").alias("premise"), F.lit(True).alias("__open")), "premise", "left")
        good = doubtful.groupBy("fact", "support").agg(F.bool_or(F.coalesce("__open", F.lit(False))).alias("bad")).where("NOT bad").select("fact").distinct()
        back = landed(open_.join(good, "fact", "left_semi"), f"{stage}/back-{turn}")
        open_ = landed(open_.join(back, "fact", "left_anti"), f"{stage}/open-{turn}")
    out = facts_.join(open_, "fact", "left_semi").select("fact", "lost")
    return out.join(lost.withColumnRenamed("premise", "fact"), "fact", "left_anti")


def repaired_artifacts(artifacts: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """(artifact, version, kept, removed): a new version of each artifact that has a removed edge, with how many it keeps and the
    ids, in order, of those it loses.  ``artifacts`` has artifact and version, ``edges`` artifact and edge, ``removed`` edge."""
    marked = edges.join(removed.select("edge").distinct().withColumn("__removed", F.lit(True)), "edge", "left")
    by = marked.groupBy("artifact").agg(F.count_if(F.col("__removed").isNull()).alias("kept"), F.array_sort(F.collect_set(F.when(F.col("__removed"), F.col("edge")))).alias("removed"))
    return artifacts.join(by.where(F.size("removed") > 0), "artifact").select("artifact", (F.col("version") + 1).alias("version"), "kept", "removed")


def requests(wanted: DataFrame, existing: DataFrame, jobs: DataFrame, signature: str, capacity: int, active: Sequence[str] = ("planned", "deferred", "submitting", "polling"), order: Sequence[Column] | None = None) -> DataFrame:
    """(key, relation, a, b, dependency, version, place): requests for facts ``wanted`` that are not among ``existing``.

    ``wanted`` has relation, a, b and dependency, the hash of the sources it was derived from; ``jobs`` has key, relation, a, b,
    version and state.  A key is a hash of fact, dependency and model signature, so what was asked for in the same state is not
    asked again, and a fact asked for from older sources is asked with the next version.  ``capacity`` counts jobs in an active
    state too; of equal facts the least dependency is asked.  The queue is filled in ``order``, by default of the fact.
    """
    fact = ["relation", "a", "b"]
    known = facts(existing)
    one = wanted.groupBy(*fact).agg(F.min("dependency").alias("dependency"))
    absent = one.alias("x").join(known.alias("y"), F.expr(" AND ".join(f"x.{c} <=> y.{c}" for c in fact)), "left_anti")
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    keyed = absent.withColumn("key", F.sha2(F.concat_ws("|", F.lit("repair"), F.lit(signature), *[part(c) for c in (*fact, "dependency")]), 256))
    new = keyed.join(jobs.select("key").distinct(), "key", "left_anti")
    older = jobs.groupBy(*[F.col(c).alias(f"__{c}") for c in fact]).agg(F.max("version").alias("__version"))
    dated = new.join(older, F.expr(" AND ".join(f"{c} <=> __{c}" for c in fact)), "left").withColumn("version", F.coalesce("__version", F.lit(0)) + 1)
    room = capacity - jobs.where(F.col("state").isin(*active)).count()
    by = list(order or [F.col(c) for c in fact])
    queued = dated.orderBy(*by, "key").limit(max(0, room))  # no more than the queue takes
    return queued.withColumn("place", F.row_number().over(Window.orderBy(*by, "key"))).select("key", *fact, "dependency", "version", "place")
