"""Token-id files: each document compressed by itself with one shared zstandard dictionary.

A folder holds ``dictionary.zstd``, trained on the serialized id arrays of a bounded sample of documents, shards
``shard-NNNNN.agtk`` in ascending order of id, and a ``manifest`` table.  A shard is

    magic, SHA-256 of the dictionary, one zstandard frame per document, index, index offset, number of documents, magic

and an index entry holds the id, where the frame starts and ends, and how many ids come before the document in the
shard and are in it; so one short document is read by its index entry, without its neighbours.  Frames and the index are
little-endian.  Reading checks the dictionary's hash.

Writing has two steps: tasks encode and compress into a staged table, which is then dealt into ranges of ids and
written; a lost executor repeats its shards only, and a shard appears by a rename.

Defined results: a null text is an empty document, with the end id only.  Null ids come first.  Repeated ids are
documents of their own, in the order of their frames.  An empty table has no shard and an empty manifest.  Columns
other than id and text are left alone.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import file_system, new_folder, publish, written
from .tokens import encoder

MAGIC = b"AGTK\x01\r\n\0"
_ENTRY = np.dtype([("known", "u1"), ("id", "<i8"), ("start", "<u8"), ("end", "<u8"), ("before", "<u8"), ("n", "<u8")])
_TAIL = "<QQ8s"
_TAIL_BYTES = struct.calcsize(_TAIL)
MANIFEST = "shard int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def _dictionary(docs: DataFrame, doc_id: str, text: str, vocabulary: str, sample: int, sample_ids: int, size: int) -> bytes:
    """A dictionary from the first ``sample_ids`` ids of the ``sample`` documents with the least hash of their id."""
    import zstandard

    few = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def heads(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(t)[: 4 * sample_ids] for t in batch.column("_text").to_pylist()], type=pa.binary())], names=["ids"])

    samples = [bytes(r.ids) for r in few.mapInArrow(heads, "ids binary").collect()]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # too few or too short samples: frames then stand without a dictionary
        return b""


def _codec(dictionary: bytes, level: int | None):
    import zstandard

    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if level is None:
        return zstandard.ZstdDecompressor(dict_data=own)
    return zstandard.ZstdCompressor(level=level, dict_data=own)


def _write_shard(folder: str, digest: bytes):
    def run(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:05d}.agtk"
        total = {}

        def body(out):
            out.write(MAGIC + digest)
            at, before, entries, batch = len(MAGIC) + len(digest), 0, [], first
            while batch is not None:
                frames = batch.column("frame").to_pylist()
                ids, ns = batch.column("id").to_pylist(), batch.column("n").to_pylist()
                part = np.zeros(len(frames), dtype=_ENTRY)
                lengths = np.fromiter(map(len, frames), dtype=np.int64, count=len(frames))
                part["known"], part["id"] = [i is not None for i in ids], [i or 0 for i in ids]
                part["end"] = at + np.cumsum(lengths)
                part["start"] = part["end"] - lengths.astype(np.uint64)
                part["n"] = ns
                part["before"] = before + np.cumsum(ns) - np.asarray(ns)
                entries.append(part)
                at, before = at + int(lengths.sum()), before + sum(ns)
                out.write(b"".join(frames))
                batch = next(batches, None)
            index = np.concatenate(entries)
            out.write(index.tobytes())
            out.write(struct.pack(_TAIL, at, len(index), MAGIC))
            total.update(n_docs=len(index), n_tokens=before, n_bytes=at + index.nbytes + _TAIL_BYTES)

        fs, path = file_system(folder)
        publish(fs, path, name, body)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, **total}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", level: int = 3, shard_bytes: int = 64 << 20, sample: int = 512, sample_ids: int = 4096, dictionary_bytes: int = 64 << 10) -> DataFrame:
    """Writes ``docs`` to ``folder`` and returns the manifest, a row per shard."""
    spark = docs.sparkSession
    dictionary = _dictionary(docs, doc_id, text, vocabulary, sample, sample_ids, dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()
    fs, path = file_system(folder)
    publish(fs, path, "dictionary.zstd", lambda out: out.write(dictionary))
    end = struct.pack("<I", end_id)

    def compress(batches):
        encode, codec = encoder(vocabulary), _codec(dictionary, level)
        for batch in batches:
            found = encode.ids_of(batch.column("_text"))
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [i + end for i in islice(found, part.num_rows)]
                frames = [codec.compress(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(frames, pa.binary())], names=["id", "n", "frame"])

    staged = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("_text")).mapInArrow(compress, "id bigint, n bigint, frame binary")
    staged = written(staged, new_folder(spark, "token-frames"))
    size = staged.agg(F.coalesce(F.sum(F.length("frame")), F.lit(0)).alias("n")).first().n
    shards = staged.repartitionByRange(max(1, -(-size // shard_bytes)), F.col("id").asc_nulls_first(), "n", F.xxhash64("frame")).sortWithinPartitions(F.col("id").asc_nulls_first(), "n", F.xxhash64("frame"))
    return written(shards.mapInArrow(_write_shard(folder, digest), MANIFEST), f"{folder}/manifest")


def _index(file) -> np.ndarray:
    size = file.size()
    at, n, magic = struct.unpack(_TAIL, file.read_at(_TAIL_BYTES, size - _TAIL_BYTES))
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    return np.frombuffer(file.read_at(n * _ENTRY.itemsize, at), dtype=_ENTRY)


def _opened(folder: str, name: str, dictionary: bytes):
    fs, path = file_system(folder)
    file = fs.open_input_file(f"{path}/{name}")
    head = file.read_at(len(MAGIC) + 32, 0)
    if head != MAGIC + hashlib.sha256(dictionary).digest():
        raise ValueError(f"{name} was written with another dictionary")
    return file


def _dictionary_in(folder: str) -> bytes:
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/dictionary.zstd") as file:
        return file.read()


DOCUMENTS = "id bigint, start bigint, n_tokens bigint, ids binary"
_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _document(file, codec, entry, base: int, run: bytes | None = None, origin: int = 0) -> dict:
    """A document by its index entry, from a run of frames that begins at ``origin`` or else by a read of its own."""
    start, end = int(entry["start"]), int(entry["end"])
    frame = file.read_at(end - start, start) if run is None else run[start - origin : end - origin]
    return {"id": int(entry["id"]) if entry["known"] else None, "start": base + int(entry["before"]), "n_tokens": int(entry["n"]), "ids": codec.decompress(frame, max_output_size=4 * int(entry["n"]))}


def _runs(index: np.ndarray, ids: int = 2 << 20, documents: int = 2048):
    """(first, last) of runs of neighbours that are read and yielded together: few ids, few documents, or one long one."""
    upto, first = np.cumsum(index["n"].astype(np.int64)), 0
    while first < len(index):
        last = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + ids, side="right"))
        last = min(max(first + 1, last), first + documents)
        yield first, last
        first = last


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in ``folder``; start counts the ids of all documents before it."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over shards, not documents
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches):
        dictionary = _dictionary_in(folder)
        codec = _codec(dictionary, None)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with _opened(folder, name, dictionary) as file:
                    index = _index(file)
                    for first, last in _runs(index):
                        origin = int(index["start"][first])
                        run = file.read_at(int(index["end"][last - 1]) - origin, origin)
                        yield pa.RecordBatch.from_pylist([_document(file, codec, e, base, run, origin) for e in index[first:last]], schema=_ARROW)

    return based.select("file", "base").repartition(max(1, manifest.count())).mapInArrow(read, DOCUMENTS)


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(file, entry, id) of every document: where each stands, without reading any frame."""

    def read(batches):
        dictionary = _dictionary_in(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with _opened(folder, name, dictionary) as file:
                    index = _index(file)
                for start in range(0, len(index), 65536):
                    part = index[start : start + 65536]
                    ids = pa.array([int(i) if k else None for i, k in zip(part["id"], part["known"])], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(start, start + len(part))), ids], names=["file", "entry", "id"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(read, "file string, entry bigint, id bigint")


def fetch_documents(spark: SparkSession, folder: str, wanted: DataFrame, doc_id: str = "id") -> DataFrame:
    """(id, start, n_tokens, ids) of the ids in ``wanted``, reading their frames only; start counts within the shard."""
    found = token_index(spark, folder).join(wanted.select(F.col(doc_id).alias("id")).distinct(), "id")

    def read(batches):
        dictionary = _dictionary_in(folder)
        codec, name, file, index = _codec(dictionary, None), None, None, None
        for batch in batches:
            rows = []
            for own, entry in zip(batch.column("file").to_pylist(), batch.column("entry").to_pylist()):
                if own != name:
                    name, file = own, _opened(folder, own, dictionary)
                    index = _index(file)
                rows.append(_document(file, codec, index[entry], 0))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return found.repartition("file").sortWithinPartitions("file", "entry").select("file", "entry").mapInArrow(read, DOCUMENTS)
