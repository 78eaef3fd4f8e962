"""Batches of records held against the rules of publication: every rule over all batches at once, as joins, none by a loop.

A batch is given as tables that share the column ``batch``:

    entities    id, kind, name
    documents   id, version, extraction, format, body, licence, url, storage, collected_at
    segments    document, version, extraction, id, text
    mentions    document, version, extraction, segment, id, start, end, surface, decision, person
    evidence    id, document, version, extraction, segment, start, end
    relations   id, type, subject, object, decision, reason, evidence (array of ids)
    activities  id, version, bill, people (array of ids)
    contexts    event, version, change, scheduled_at, precision, evidence, relations, documents (arrays of ids)

Findings are (batch, rule, id): which rule a record breaks.  A batch without findings may be stored; one without findings of
``publication`` either may be published.  Null fields break the rule that asks for them; a null list is an empty one.

Every table is grouped and joined by its batch and more, so tables that lie by ``batch`` (``landing.dealt``) are not shuffled
where ``landing.parts_kept`` holds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds, roles and states that records may have, and how many of a kind a batch may hold.
KINDS = ("person", "organization", "bill", "policy")
DECISIONS = ("pending", "approved", "rejected")
PERSON_ROLES = ("lead_sponsor", "co_sponsor", "speaker", "voter", "scheduled_participant")
BILL_ROLES = ("lead_sponsor", "co_sponsor")
ORGANIZATION_ROLES = ("publisher", "implementing_agency", "committee_proposer")
LINEAGE, CONCERNS, RECORDS = "incorporated_into_alternative", "concerns", "records"
FORMATS = ("html", "pdf", "json", "hwp", "hwpx")
BODIES, READABLE = ("available", "partial", "unavailable", "disclaimer_only", "unsupported", "failed"), ("available", "partial")
LICENCES = ("allowed", "restricted", "unknown")
CHANGES = ("new_record", "state_changed", "important_correction", "explanation_only", "extraction_only")
PRECISIONS = ("date", "second", "unknown")
MOST = {"entities": 100, "documents": 100, "evidence": 1000, "relations": 1000, "activities": 100, "contexts": 100}
STORAGE = r"^(?!/)(?!.*\.\.)[A-Za-z0-9_./-]{1,1024}$"

Batch = Mapping[str, DataFrame]


def _found(df: DataFrame, rule: str, id_: str | Column = "id") -> DataFrame:
    key = F.col(id_) if isinstance(id_, str) else id_
    return df.select("batch", F.lit(rule).alias("rule"), key.cast("string").alias("id"))


def _broken(df: DataFrame, rules: Mapping[str, Column], id_: str | Column = "id") -> DataFrame:
    """Findings of several rules over the same rows, told in one pass, so that the joins behind them run once."""
    named = [F.when(broken, F.lit(rule)) for rule, broken in rules.items()]
    key = F.col(id_) if isinstance(id_, str) else id_
    return df.select("batch", F.explode(F.array_compact(F.array(*named))).alias("rule"), key.cast("string").alias("id"))


def _blank(c: str, most: int) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "") | (F.length(c) > most)


def _none_of(c: str, values: tuple[str, ...]) -> Column:
    return F.col(c).isNull() | ~F.col(c).isin(*values)


def _listed(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """(batch, key, ref) of the ids in a list."""
    return df.select("batch", F.col(key).alias("key"), F.explode(F.array_distinct(column)).alias("ref"))


def _absent(refs: DataFrame, held: DataFrame, rule: str, id_: str = "id") -> DataFrame:
    """References to ids that a batch has not."""
    return _found(refs.join(held.select("batch", F.col(id_).alias("ref")), ["batch", "ref"], "left_anti"), rule, "key")


def integrity(b: Batch) -> DataFrame:
    """(batch, rule, id) of everything that keeps a batch from being stored."""
    entities, documents, segments, mentions, evidence = (b[n] for n in ("entities", "documents", "segments", "mentions", "evidence"))
    relations, activities, contexts = (b[n] for n in ("relations", "activities", "contexts"))
    out = []
    keyed = {"entities": ["id"], "documents": ["id", "version", "extraction"], "evidence": ["id"], "relations": ["id"], "activities": ["id", "version"], "contexts": ["event", "version"], "segments": ["document", "version", "extraction", "id"], "mentions": ["document", "version", "extraction", "segment", "id"]}
    for name, keys in keyed.items():
        same = b[name].select("batch", *keys)
        if name in MOST:
            # A batch stays whole in a partition: its size and its identifiers are counted there.
            same = same.withColumn("__all", F.count("*").over(Window.partitionBy("batch")))
        same = same.groupBy("batch", *keys).agg(F.count("*").alias("n"), *([F.max("__all").alias("__all")] if name in MOST else []))
        missing = F.lit(False)
        for k in keys:
            missing = missing | F.col(k).isNull()
        finding = lambda rule, id_: F.struct(F.lit(rule).alias("rule"), id_.cast("string").alias("id"))
        found = [F.when((F.col("n") > 1) | missing, finding(f"identifier in {name}", F.col(keys[-1] if name in ("segments", "mentions") else keys[0])))]
        if name in MOST:
            found.append(F.when(F.col("__all") > MOST[name], finding(f"too many {name}", F.lit(name))))
        out.append(same.select("batch", F.explode(F.array_compact(F.array(*found))).alias("f")).select("batch", "f.rule", "f.id"))

    out.append(_broken(entities, {"entity: kind": _none_of("kind", KINDS), "entity: name": _blank("name", 500)}))

    bad = {
        "document: version": F.col("version").isNull() | ~F.col("version").rlike("^[a-f0-9]{64}$"), "document: format": _none_of("format", FORMATS), "document: body": _none_of("body", BODIES),
        "document: licence": _none_of("licence", LICENCES), "document: collected": F.col("collected_at").isNull(), "document: storage": F.col("storage").isNull() | ~F.col("storage").rlike(STORAGE), "document: address": F.col("url").isNull() | ~F.col("url").rlike(r"^https://[^/\s@]+(/\S*)?$"),
    }
    out.append(_broken(documents, bad))
    version = ["document", "version", "extraction"]
    of = documents.select("batch", F.col("id").alias("document"), "version", "extraction", "body")
    held = segments.select("batch", *version, "id", _blank("text", 100_000).alias("__blank")).join(of, ["batch", *version], "left")
    out.append(_broken(held, {"segment: no document": F.col("body").isNull(), "segment: no body": F.col("body").isNotNull() & ~F.col("body").isin(*READABLE), "segment: text": F.col("__blank")}))

    text = segments.select("batch", *version, F.col("id").alias("segment"), F.col("text").alias("__text"))
    inside = lambda length: (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= length)
    people = entities.where("kind = 'person'").select("batch", F.col("id").alias("person"), F.lit(True).alias("__person"))
    words = F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start"))
    said = mentions.join(text, ["batch", *version, "segment"], "left").select("batch", "id", "decision", "person", (~F.coalesce(inside(F.length("__text")) & (words == F.col("surface")), F.lit(False))).alias("__other"))
    rules = {"mention: surface": F.col("__other"), "decision": _none_of("decision", DECISIONS), "no such person": F.col("person").isNotNull() & F.col("__person").isNull(), "mention: nobody": (F.col("decision") == "approved") & F.col("person").isNull()}
    out.append(_broken(said.join(people, ["batch", "person"], "left"), rules))

    cited = evidence.join(of.select("batch", *version, F.lit(True).alias("__document")), ["batch", *version], "left").join(text.withColumn("__text", F.length("__text")), ["batch", *version, "segment"], "left")
    known, read = F.col("__document").isNotNull(), F.col("__text").isNotNull()
    out.append(_broken(cited, {"evidence: no document": ~known, "evidence: no segment": known & ~read, "evidence: span": read & ~F.coalesce(inside(F.col("__text")), F.lit(False))}))

    # What the ends of a relation are: a kind of entity, an activity, or a document.  Rows that are the same in all of this count once.
    bare = (F.col("decision") == "approved") & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)
    own = relations.select("batch", "id", "type", "subject", "object", _none_of("decision", DECISIONS).alias("__undecided"), _blank("reason", 1000).alias("__reason"), bare.alias("__bare"))
    end = lambda place, c: F.struct(F.lit(place).alias("__place"), F.col(c).alias("end"))
    met = own.select(*own.columns, F.inline(F.array(end(0, "subject"), end(1, "object"))))
    met = met.join(entities.groupBy("batch", F.col("id").alias("end")).agg(F.collect_set("kind").alias("__kinds")), ["batch", "end"], "left")
    for name, table in (("activity", activities), ("document", documents)):
        met = met.join(table.select("batch", F.col("id").alias("end"), F.lit(name).alias(f"__{name}")).distinct(), ["batch", "end"], "left")
    others = F.array_compact(F.array("__activity", "__document"))
    kinds = F.when(F.col("__kinds").isNotNull() | (F.size(others) > 0), F.concat(F.coalesce("__kinds", F.array().cast("array<string>")), others))
    met = met.groupBy(*own.columns).agg(*[F.max(F.when(F.col("__place") == place, kinds)).alias(f"__{c}") for place, c in enumerate(("subject", "object"))])
    is_ = lambda c, *wanted: F.arrays_overlap(F.coalesce(f"__{c}", F.array().cast("array<string>")), F.array(*map(F.lit, wanted)))
    type_, both = F.col("type"), F.col("__subject").isNotNull() & F.col("__object").isNotNull()
    typed = type_.isin(*PERSON_ROLES, *ORGANIZATION_ROLES, LINEAGE, CONCERNS, RECORDS)
    rules = {
        "relation: end": ~both,
        "relation: type": ~F.coalesce(typed, F.lit(False)),
        "no such person": both & type_.isin(*PERSON_ROLES) & ~is_("subject", "person"),
        "role: object": both & type_.isin(*PERSON_ROLES) & ~(is_("object", "activity") | (type_.isin(*BILL_ROLES) & is_("object", "bill"))),
        "role: subject": both & type_.isin(*ORGANIZATION_ROLES) & ~is_("subject", "organization"),
        "role: object of an organization": both & type_.isin(*ORGANIZATION_ROLES) & ~is_("object", "activity", "bill", "policy"),
        "lineage: ends": both & (type_ == LINEAGE) & ~(is_("subject", "bill") & is_("object", "bill") & (F.col("subject") != F.col("object"))),
        "policy: ends": both & (type_ == CONCERNS) & ~(is_("subject", "bill", "activity") & is_("object", "policy")),
        "record: ends": both & (type_ == RECORDS) & ~(is_("subject", "document") & is_("object", "activity")),
        "decision": F.col("__undecided"),
        "relation: reason": F.col("__reason"),
        "relation: no proof": F.col("__bare"),
    }
    out.append(_broken(met, rules))
    again = relations.where(type_ == LINEAGE).groupBy("batch", "subject", "object").agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1")
    out.append(_found(again, "lineage: twice"))
    out.append(_absent(_listed(relations, "evidence"), evidence, "relation: proof unknown"))

    counts = activities.groupBy("batch").agg(F.count("*").alias("a")).join(contexts.groupBy("batch").agg(F.count("*").alias("c")), "batch", "full")
    out.append(_found(counts.where(~F.col("a").eqNullSafe(F.col("c"))), "contexts and activities differ", F.lit("contexts")))
    known = activities.select("batch", F.col("id").alias("event"), "version")
    out.append(_found(contexts.join(known, ["batch", "event", "version"], "left_anti"), "context: no activity", "event"))
    precision, scheduled = F.col("precision"), F.col("scheduled_at")
    rules = {
        "context: change": _none_of("change", CHANGES),
        "context: precision": precision.isNotNull() & ~precision.isin(*PRECISIONS),
        "context: date without precision": scheduled.isNotNull() & precision.isNull(),
        "context: precision without date": scheduled.isNull() & F.coalesce(precision != "unknown", F.lit(False)),
        "context: no proof": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
    }
    out.append(_broken(contexts, rules, "event"))
    for column, table in (("evidence", evidence), ("relations", relations), ("documents", documents)):
        out.append(_absent(_listed(contexts, column, "event"), table, f"context: {column.removesuffix('s')} unknown"))
    return _together(out)


def usable(b: Batch) -> DataFrame:
    """(batch, id): evidence of documents that may be shown and have a body."""
    allowed = b["documents"].where((F.col("licence") == "allowed") & F.col("body").isin(*READABLE)).select("batch", F.col("id").alias("document"), "version", "extraction")
    return b["evidence"].join(allowed, ["batch", "document", "version", "extraction"], "left_semi").select("batch", "id").distinct()


def reviewed(b: Batch, shown: DataFrame | None = None) -> DataFrame:
    """(batch, person, id): usable evidence (``shown``) whose span holds a whole approved mention of a person."""
    spans = b["evidence"].join(usable(b) if shown is None else shown, ["batch", "id"], "left_semi").select("batch", "document", "version", "extraction", "segment", "id", F.col("start").alias("__a"), F.col("end").alias("__b"))
    said = b["mentions"].where("decision = 'approved' AND person IS NOT NULL").select("batch", "document", "version", "extraction", "segment", "person", "start", "end")
    met = said.join(spans, ["batch", "document", "version", "extraction", "segment"])
    return met.where((F.col("__a") <= F.col("start")) & (F.col("end") <= F.col("__b"))).select("batch", "person", "id").distinct()


def publication(b: Batch) -> DataFrame:
    """(batch, rule, id) of what keeps a batch that may be stored from being published."""
    contexts, relations, mentions = b["contexts"], b["relations"], b["mentions"]
    shown = usable(b)
    out = []
    order = Window.partitionBy("batch", "document", "version", "extraction", "segment").orderBy("start", "end")
    approved = mentions.where("decision = 'approved'").withColumn("__reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    out.append(_found(approved.where(F.col("start") < F.col("__reach")), "mention: overlap"))

    acts = b["activities"].select("batch", F.col("id").alias("event"), "version", "bill", "people")
    pinned = contexts.join(acts, ["batch", "event", "version"]).select("batch", "event", "version", "bill", "people", F.explode_outer("relations").alias("__relation"))
    roles = relations.where((F.col("decision") == "approved") & F.col("type").isin(*PERSON_ROLES)).select("batch", F.col("id").alias("__relation"), "subject", "object")
    met = pinned.join(roles, ["batch", "__relation"], "left").withColumn("__actor", F.when((F.col("object") == F.col("event")) | (F.col("object") == F.col("bill")), F.col("subject")))
    actors = met.groupBy("batch", "event", "version").agg(F.array_sort(F.collect_set("__actor")).alias("__actors"), F.first("people").alias("people"))
    listed = F.array_sort(F.array_distinct(F.coalesce("people", F.array().cast("array<string>"))))
    out.append(_found(actors.where(F.col("__actors") != listed), "activity: actors", "event"))
    out.append(_absent(_listed(contexts, "evidence", "event"), shown, "context: proof not public"))
    out.append(_absent(_listed(relations.where("decision = 'approved'"), "evidence"), shown, "relation: proof not public"))
    people = b["entities"].where("kind = 'person'")
    proven = reviewed(b, shown).select("batch", F.col("person").alias("id")).distinct()
    out.append(_found(people.join(proven, ["batch", "id"], "left_anti"), "person: not identified"))
    return _together(out)


def _together(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct()
