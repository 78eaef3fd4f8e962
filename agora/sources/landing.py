"""Where loops and file sinks write: the folder in ``spark.checkpoint.dir``, which driver and executors share."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part, about.
PART_ROWS = 250_000


def folder(spark: SparkSession, name: str) -> str:
    """A new folder; only a session with a local master may leave ``spark.checkpoint.dir`` unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "agora-landing")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a table and read again, so that a loop's plan stays short and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """In how many parts a table of the size of ``df`` lies."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / PART_ROWS))


def dealt(df: DataFrame, path: str, key: str, n: int) -> DataFrame:
    """``df``, which lies by a hash of ``key`` in ``n`` parts, written so and read again: what is grouped, ranked or joined by ``key``,
    or by it and more (``parts_kept``), is not shuffled again.  The table has a name only until it is read."""
    spark, name = df.sparkSession, f"landed_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


@contextmanager
def parts_kept(spark: SparkSession) -> Iterator[None]:
    """What is planned inside joins tables that lie by one of the keys of a join as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
