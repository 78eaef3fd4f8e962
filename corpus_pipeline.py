"""A training corpus from raw documents: language ID, quality rules, near-duplicates, source mix, packed sequences.

Each stage works on everything its predecessor kept, written as Parquet to the shared folder and read again.

Defined results: a null or empty text has no letter, so the language stage drops it; a null id or source is a value of its
own.  Repeated rows are documents of their own up to the near-duplicate stage, which keeps one.  An empty table stays empty.
Every column of the input, whatever its name, comes out of every stage but the last as it went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import langid, mixing, packing, quality, simhash
from agora.llm.queries import fold
from agora.llm.shared import new_folder, written
from agora.llm.tokens import public_path


ROW = "__document"
#: Rows that go to a Python worker at once; texts are long, and both sides hold such a batch in memory of their own.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def with_row(docs: DataFrame) -> DataFrame:
    """What the operators read, beside the whole row, so that no measure of theirs replaces a column of the input."""
    return docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that was learned: without a letter, or with less than half of the belief."""
    small_batches(spark)
    model = langid.train(docs.where(~fold()))
    said = langid.identify(with_row(docs), model)
    return said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(f"{ROW}.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the threshold table."""
    return quality.judge(with_row(docs)).where("kept").select(f"{ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of similar ones: five-word shingles, Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target weights."""
    return mixing.copied(mixing.mix(with_row(docs))).select(f"{ROW}.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence of at most 1024 tokens.

    Workers remember fewer words than the operator's default, as they stand beside executors that other stages have filled.
    """
    small_batches(spark)
    return packing.pack(docs, public_path("byte_bpe_50k.json"), end_id=2, capacity=1024, kept_words=100_000)


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("best_fit_packing", pack)]

#: Tokenizers, byte contexts and fingerprints are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
