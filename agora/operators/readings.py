"""Readings pinned to evidence: a reading is assembled whole, or not at all.

A reading names versions of contexts, evidence and people, and has blocks of text on them.  Every pin must be published as pinned, and
everything that is said must rest on what is pinned.  All readings are held against all published records at once; what
fails is told by reading and rule, and the others come out as one record each.

    pins      contexts (reading, event, version); evidence (reading, id); people (reading, person, evidence: array)
    blocks    (reading, place, text, evidence: array, people: array)
    public    contexts (event, version, bill); cited (event, version, id); actors (event, version, person, evidence: array);
              evidence (id, excerpt); profiles (person, name, kind)

Defined results: a null list is an empty one, a pin given twice breaks the reading, and a reading without contexts is ``no context``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.landing import folder, landed

Tables = Mapping[str, DataFrame]


def _list(c: str):
    return F.coalesce(c, F.array().cast("array<string>"))


def _said(df: DataFrame, rule: str, id_: str) -> DataFrame:
    return df.select("reading", F.lit(rule).alias("rule"), F.col(id_).cast("string").alias("id"))


def _all(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _unavailable(pins: Tables, public: Tables) -> list[DataFrame]:
    """What one pin and the public records alone decide."""
    contexts = _said(pins["contexts"].join(public["contexts"], ["event", "version"], "left_anti"), "context unavailable", "event")
    return [contexts, _said(pins["evidence"].join(public["evidence"], "id", "left_anti"), "evidence unavailable", "id")]


def _broken(readings: DataFrame, pins: Tables, public: Tables) -> list[DataFrame]:
    """What the pins and blocks of a reading decide together."""
    contexts, evidence, people, blocks = pins["contexts"], pins["evidence"], pins["people"], pins["blocks"]
    out = [_said(readings.join(contexts.select("reading").distinct(), "reading", "left_anti"), "no context", "reading")]
    for name, df, keys in (("context", contexts, ["event", "version"]), ("evidence", evidence, ["id"]), ("person", people, ["person"])):
        out.append(_said(df.groupBy("reading", *keys).agg(F.count("*").alias("n")).where("n > 1"), f"{name} pinned twice", keys[0]))
    cited = contexts.join(public["cited"], ["event", "version"]).select("reading", "id").distinct()
    out.append(_said(evidence.join(cited, ["reading", "id"], "left_anti"), "evidence of no pinned context", "id"))

    persons = public["profiles"].where("kind = 'person'").select("person")
    out.append(_said(people.join(persons, "person", "left_anti"), "person unavailable", "person"))
    out.append(_said(people.where(F.size(_list("evidence")) == 0), "person without evidence", "person"))
    # Lists are held against the pins as rows, so that no row carries all pins of its reading.
    rest = lambda df, id_, list_, of, held: df.select("reading", id_, F.explode(_list(list_)).alias(of)).join(held.select("reading", of), ["reading", of], "left_anti")
    out.append(_said(rest(people, "person", "evidence", "id", evidence), "evidence of a person is not pinned", "person"))
    # A person must act in a pinned context, on all evidence that the pin gives.
    acts = contexts.join(public["actors"], ["event", "version"]).select("reading", "person", F.col("evidence").alias("__of"))
    met = people.join(acts, ["reading", "person"], "left").withColumn("good", F.col("__of").isNotNull() & (F.size(F.array_except(_list("evidence"), _list("__of"))) == 0))
    out.append(_said(met.groupBy("reading", "person").agg(F.bool_or("good").alias("good")).where("NOT good"), "person has no such role", "person"))

    out.append(_said(rest(blocks, "place", "evidence", "id", evidence), "evidence of a block is not pinned", "place"))
    out.append(_said(rest(blocks, "place", "people", "person", people), "person of a block is not pinned", "place"))
    named = blocks.select("reading", "place", F.col("evidence").alias("__block"), F.explode(_list("people")).alias("person"))
    apart = named.join(people.select("reading", "person", "evidence"), ["reading", "person"]).where(~F.arrays_overlap(_list("evidence"), _list("__block")))
    out.append(_said(apart, "person and block share no evidence", "place"))
    return out


def findings(readings: DataFrame, pins: Tables, public: Tables) -> DataFrame:
    """(reading, rule, id) of what keeps ``readings`` (reading) from being assembled."""
    found = _all(_unavailable(pins, public) + _broken(readings, pins, public))
    return found.join(readings.select("reading"), "reading", "left_semi").distinct()


def assembled(readings: DataFrame, pins: Tables, public: Tables) -> DataFrame:
    """(reading, contexts, evidence, people, blocks): a record of each reading without findings, its lists in order of their ids.

    Readings with a pin that is not public are out first; only the pins of the others are landed and held against each other.
    """
    stage = folder(readings.sparkSession, "assembled")
    left = lambda df, parts, name: landed(df.join(_all(parts).select("reading").distinct(), "reading", "left_anti"), f"{stage}/{name}")
    rest = left(readings.select("reading").distinct(), _unavailable(pins, public), "public")
    pins = {name: landed(df.join(rest, "reading", "left_semi"), f"{stage}/{name}") for name, df in pins.items()}
    used = landed(pins["contexts"].select("event", "version").distinct(), f"{stage}/used")
    public = dict(public) | {name: public[name].join(used, ["event", "version"], "left_semi") for name in ("cited", "actors")}
    good = left(rest, _broken(rest, pins, public), "good")
    gather = lambda df, name, *c: df.join(good, "reading", "left_semi").groupBy("reading").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    contexts = gather(pins["contexts"], "contexts", "event", "version")
    evidence = gather(pins["evidence"].select("reading", "id").join(public["evidence"], "id"), "evidence", "id", "excerpt")
    people = gather(pins["people"].join(public["profiles"].select("person", "name"), "person"), "people", "person", "name", F.array_sort("evidence").alias("evidence"))
    blocks = gather(pins["blocks"], "blocks", "place", "text", F.array_sort(_list("evidence")).alias("evidence"), F.array_sort(_list("people")).alias("people"))
    out = good
    for part in (contexts, evidence, people, blocks):
        out = out.join(part, "reading", "left")
    return out
