"""Landed files: CSV, JSON batches, content-addressed texts, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from .landing import folder, landed


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, all columns as text; blanks stay blank, a byte order mark is passed over, quotes are doubled in quotes.

    With ``columns`` the file is not read an extra time for its header.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", columns is not None)
    df = reader.csv(path) if columns is None else reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("\ufeff")) for c in df.columns])


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Batches of records, a JSON object per line; one that does not parse is an error, not a gap."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def newest_per_scope(sources: DataFrame) -> DataFrame:
    """(scope, observed_at, fingerprint, conflict): the newest observation of a scope; two with other fingerprints conflict."""
    top = sources.groupBy("scope").agg(F.max("observed_at").alias("observed_at"))
    same = sources.join(top, ["scope", "observed_at"]).groupBy("scope", "observed_at").agg(F.min("fingerprint").alias("fingerprint"), (F.count_distinct("fingerprint") > 1).alias("conflict"))
    return same.select("scope", "observed_at", F.when(~F.col("conflict"), F.col("fingerprint")).alias("fingerprint"), "conflict")


def put_addressed(rows: DataFrame, path: str) -> DataFrame:
    """Appends ``rows`` (identity, body) under the hash of the body and returns (identity, hash, outcome).

    What is there with the same hash is a replay and is not written again; another hash under a known identity is a new
    version.  Equal rows are written once.
    """
    spark = rows.sparkSession
    hashed = rows.select("identity", "body", F.sha2("body", 256).alias("hash")).dropDuplicates(["identity", "hash"])
    try:
        known = spark.read.schema("identity string, body string, hash string").parquet(path).select("identity", "hash")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], "identity string, hash string")
    seen = known.select("identity").distinct().withColumn("__seen", F.lit(True))
    outcome = hashed.join(known.withColumn("__same", F.lit(True)), ["identity", "hash"], "left").join(seen, "identity", "left")
    outcome = outcome.select("identity", "body", "hash", F.when(F.col("__same"), "replayed").when(F.col("__seen"), "version").otherwise("new").alias("outcome"))
    outcomes = landed(outcome.select("identity", "hash", "outcome"), folder(spark, "addressed"))  # before the write changes what is known
    outcome.where("outcome <> 'replayed'").select("identity", "body", "hash").write.mode("append").parquet(path)
    return outcomes


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """Rows as JSON lines in ``path/json`` and as a Markdown table, each line on its own, in ``path/markdown``."""
    rows.write.mode("overwrite").json(f"{path}/json")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, f"# {title}"), (1, "| " + " | ".join(rows.columns) + " |"), (2, "|" + " --- |" * len(rows.columns))], "place int, value string")
    head.select("value").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    rows.select(line.alias("value")).write.mode("overwrite").text(f"{path}/markdown")


def latest_progress(progress: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, state, done, total) of every registered source by its newest progress file; none means not started."""
    last = ranked(progress, ["source"], [F.col("at").desc(), F.col("done").desc()]).where("rank = 1")
    return registry.join(last, "source", "left").select("source", F.coalesce("state", F.lit("not_started")).alias("state"), "done", "total")
