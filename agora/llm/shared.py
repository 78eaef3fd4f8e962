"""The shared folder: where an operator puts tables and files that other tasks and later jobs read.

The folder is the one the session names in ``spark.checkpoint.dir``; driver and executors see it alike.  Only a
session with a local master may leave it unset (tests); then a folder under the machine's temp directory is used.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder as a URI or path, without a trailing slash."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "agora-shared")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of an operator; it is created by whoever writes to it first."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table in ``path``, read again: later jobs neither recompute it nor depend on lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LIBC = ctypes.CDLL(None)

#: A key with more than HOT_ROWS rows and more than one in HOT_SHARE of all is hot; so there are fewer than HOT_SHARE hot keys, ever.
HOT_SHARE, HOT_ROWS = 2048, 1000


def join_spread(rows: DataFrame, found: DataFrame, keys: Sequence[str], by: Sequence[Column], counts: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``found``, a row per key at most, so that no key's rows meet in one task.

    Hot keys, fewer than HOT_SHARE, meet a broadcast of their rows of ``found``; rows of such keys are dealt over all tasks
    of the other join, a merge, by a hash of ``by``, where they match nothing.  Keys compare as null-safe.  Column names
    of ``found`` other than its keys must be new.  ``counts``, a stored table of the keys and ``n``, says how many rows have
    a key; without it the key columns of ``rows`` are read once more.
    """
    values = [c for c in found.columns if c not in keys]
    key = F.struct(*[F.col(k) for k in keys])
    if counts is None:
        counted = written(rows.select(key.alias("__key")).groupBy("__key").agg(F.count("*").alias("__n")), new_folder(rows.sparkSession, "hot-keys"))
    else:
        counted = counts.select(key.alias("__key"), F.col("n").alias("__n"))
    size = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.max("__n"), F.lit(0)).alias("most")).first()
    least = max(HOT_ROWS, size.n // HOT_SHARE)
    own = found.select(key.alias("__of"), *values)
    keyed = rows.withColumn("__key", key)
    if size.most <= least:  # nothing is hot
        return keyed.join(own.hint("merge"), F.col("__key") == F.col("__of"), "left").select(*rows.columns, *values)
    keys_ = F.broadcast(counted.where(F.col("__n") > least).select(F.col("__key").alias("__hot")))
    met = F.broadcast(own.join(keys_, F.col("__of") == F.col("__hot"), "left_semi").select(F.col("__of").alias("__hit"), *[F.col(v).alias(f"__hot_{v}") for v in values]))
    first = keyed.join(keys_, F.col("__key") == F.col("__hot"), "left").join(met, F.col("__hot") == F.col("__hit"), "left")
    first = first.withColumn("__spread", F.when(F.col("__hot").isNotNull(), F.xxhash64(*by).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("bigint")))
    rest = own.withColumn("__none", F.lit(0).cast("bigint"))
    joined = first.join(rest.hint("merge"), (F.col("__key") == F.col("__of")) & (F.col("__spread") == F.col("__none")), "left")
    return joined.select(*rows.columns, *[F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a URI (file, hdfs, s3, gs) or a plain path, and the path in it; usable inside tasks."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def publish(fs: pafs.FileSystem, folder: str, name: str, write) -> str:
    """Calls ``write(stream)`` on a private file, then moves it to ``folder/name``.

    The content of a name is a function of its input, so a retried or a speculative task replaces a file by its
    equal, and a reader never meets half a file.
    """
    fs.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        write(out)
    fs.move(own, f"{folder}/{name}")
    return name


def give_back() -> None:
    """Hands memory that this worker has freed to the system: workers stay alive beside the executor between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def batches_of(rows, schema: pa.Schema, size: int = 2048):
    """Arrow batches of at most ``size`` rows from an iterator of tuples in the order of ``schema``."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(part: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
