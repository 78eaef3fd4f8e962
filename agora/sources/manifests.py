"""Jobs that collect listed documents, and the dimensions that sources are described by.

A job names its documents and where they are.  What was collected is its receipt: the same job with the same list is answered
from it, with another list it is a conflict, so a job can be run again at any time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 50


def collected(manifests: DataFrame, landed: DataFrame, receipts: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(jobs (job, manifest, outcome, found, missing), documents (job, place, document, url, hash)) of ``manifests`` (job, place, document, url).

    ``landed`` has url and body, ``receipts`` job and manifest, the hash of a list.  Outcomes: ``invalid`` for a list of more than
    ``most`` documents, or with one twice, or without an address; ``replayed`` and ``conflict`` for a job that has a receipt;
    ``complete`` or ``partial`` else, which are the only jobs whose documents are told.  Of several bodies of an address the
    least hash counts.
    """
    entry = F.struct("place", "document", "url")
    listed = manifests.groupBy("job").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("manifest"), F.count("*").alias("__n"), F.count_distinct("document").alias("__different"), F.count_if(F.col("url").isNull() | ~F.col("url").startswith("https://") | F.col("document").isNull()).alias("__bad")
    )
    bodies = landed.where("body IS NOT NULL").groupBy("url").agg(F.min(F.sha2("body", 256)).alias("hash"))
    met = manifests.join(bodies, "url", "left")
    counts = met.groupBy("job").agg(F.count("hash").alias("found"), F.count_if(F.col("hash").isNull()).alias("missing"))
    known = receipts.select("job", F.col("manifest").alias("__receipt"))
    invalid = (F.col("__n") > most) | (F.col("__different") < F.col("__n")) | (F.col("__bad") > 0)
    outcome = F.when(invalid, "invalid").when(F.col("__receipt") == F.col("manifest"), "replayed").when(F.col("__receipt").isNotNull(), "conflict").when(F.col("missing") == 0, "complete").otherwise("partial")
    jobs = listed.join(known, "job", "left").join(counts, "job").select("job", "manifest", outcome.alias("outcome"), "found", "missing")
    fresh = jobs.where("outcome IN ('complete', 'partial')").select("job")
    documents = met.where("hash IS NOT NULL").join(fresh, "job", "left_semi").select("job", "place", "document", "url", "hash")
    return jobs, documents


def broken(dimensions: Mapping[str, DataFrame], references: Mapping[tuple[str, str], str], key: str = "id") -> DataFrame:
    """(dimension, rule, id) of what is wrong with static dimensions: a key that is missing or stands twice, and references, (dimension,
    column) to another dimension, to a key that is not there.  A null reference points nowhere and is no fault."""
    out = []
    for name, df in dimensions.items():
        twice = df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
        out.append(twice.select(F.lit(name).alias("dimension"), F.when(F.col("id").isNull(), "no key").otherwise("key twice").alias("rule"), "id"))
    for (name, column), target in references.items():
        held = dimensions[target].select(F.col(key).alias(column)).distinct()
        lost = dimensions[name].where(F.col(column).isNotNull()).join(held, column, "left_anti")
        out.append(lost.select(F.lit(name).alias("dimension"), F.lit(f"no such {target}").alias("rule"), F.col(key).cast("string").alias("id")))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def active(sources: DataFrame, plans: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, issue, plan, values): what is asked of each active source: its plans in order of their ids, none as one plan without values,
    under the issue that it belongs to.  ``plans`` has id, source and values, ``issues`` id and name, ``sources`` id, issue and active."""
    asked = sources.where("active").join(plans.select(F.col("id").alias("plan"), F.col("source").alias("id"), "values"), "id", "left")
    named = issues.select(F.col("id").alias("issue"), F.col("name").alias("__issue"))
    return asked.join(named, "issue", "left").select("id", F.col("__issue").alias("issue"), "plan", "values")
