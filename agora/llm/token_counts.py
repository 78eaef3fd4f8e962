"""Token counts through a cache of digests.

A text is known by the digest of its normalised content, a tokenizer by the digest of its vocabulary file.  Contents
are joined to the stored counts; those without one are encoded, each different content once, and appended to the
cache.  Counts then come from the cache for every document.  The cache is a table of (content, tokenizer, n_tokens);
an append that a second writer repeats adds equal rows, which are read as one.

The contract of ``normalise`` is that it may not change the count.  The default changes nothing but null, which
counts as empty.  Repeated rows and texts share one cache row; an empty table gives an empty table and adds nothing.
All columns of the input are kept; an added column replaces one of its name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .shared import join_spread
from .tokens import encoder

CACHE = "content binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(vocabulary: str, settings: str = "plain") -> str:
    """Names a vocabulary file and how it is used."""
    with open(vocabulary, "rb") as file:
        return hashlib.sha256(file.read() + b"\0" + settings.encode()).hexdigest()


def content_digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) in the cache for one tokenizer."""
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE)
    return found.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def add_missing(docs: DataFrame, cache: str, vocabulary: str, text: str = "text", normalise=lambda c: F.coalesce(c, F.lit(""))) -> None:
    """Encodes the contents of ``docs`` that the cache lacks, each once, and appends their counts."""
    spark, tokenizer = docs.sparkSession, tokenizer_digest(vocabulary)
    content = docs.select(normalise(F.col(text)).alias("__body")).withColumn("content", content_digest(F.col("__body")))
    # One row per content leaves each map task, so a text with many copies is not gathered anywhere.
    different = content.groupBy("content").agg(F.first("__body").alias("__body"))
    misses = different.join(stored(spark, cache, tokenizer), "content", "left_anti")

    def count(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            n = list(encode.counts_of(batch.column("__body")))
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([tokenizer] * len(n)), pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(count, CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, vocabulary: str, text: str = "text", normalise=lambda c: F.coalesce(c, F.lit(""))) -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens of each text."""
    add_missing(docs, cache, vocabulary, text, normalise)
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    keyed = docs.select(*kept, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"), content_digest(normalise(F.col(text))).alias("__content"))
    counts = stored(docs.sparkSession, cache, tokenizer_digest(vocabulary)).withColumnRenamed("content", "__content")
    # A text that many documents have is met by all tasks; rows of one text are told apart by their other short columns.
    by = [F.col(f.name) for f in docs.schema.fields if f.name in kept and f.name != text and isinstance(f.dataType, AtomicType)]
    return join_spread(keyed, counts, ["__content"], by or [F.lit(0)]).select(*kept, "n_bytes", "n_tokens")
