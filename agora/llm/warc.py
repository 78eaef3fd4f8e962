"""WARC archives: writing page records, and reading them back by boundary-chain verification.

An archive is not compressed, so it can be read in byte ranges.  A task looks for the record magic in its range and
emits each candidate with its successor, the offset that the candidate's own Content-Length leads to.  A payload may
hold the magic, even a whole record, so a candidate counts only if the chain of successors from the start of the file
reaches it.  Within a range the task contracts chains to where they leave the range; over ranges, pointer jumping in
Spark doubles the length of every jump in each round, so a file of n ranges takes about log2(n) rounds.  Records are
then parsed along the chain from where it enters each range.

Of records with equal payloads of at least ``least_bytes``, the one with the largest page_id is a response; the others
are revisit records, which hold the headers and refer to it.

Defined results: a null html is an empty payload.  A null page_id is smaller than any; a group of only such ids is
written as responses.  Repeated rows with the largest page_id are responses each.  A null url leaves its header out.
An empty table has no archive and no record.  Columns other than page_id, url and html are left alone.
A file whose chain does not end at its last byte makes reading fail, by name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, join_spread, new_folder, written

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC_BYTES = 10
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]{0,64}([0-9]{1,18})[ \t]{0,64}(?=\r\n)", re.I)
_BLANK = re.compile(rb"\r\n(?=\r\n)")
HEAD_BYTES = 1 << 16  # how much is read beyond a range at first; a longer header is read on to its end
_LINE = 256  # a line of a length is no longer
PREFIX = "urn:agora:page:"
MANIFEST = "file string, n_records bigint, n_bytes bigint"
RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, payload binary, refers_to bigint"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"".join((b"WARC/1.1\r\n", lines.encode("utf-8", "replace"), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"))


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = f"<{PREFIX}{'' if page_id is None else page_id}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{PREFIX}{refers_to}>")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _record(headers, http + (payload if refers_to is None else b""))


def _pressed(batches):
    """Payloads go through the shuffle compressed."""
    from zstandard import ZstdCompressor

    press = ZstdCompressor(level=5).compress
    for batch in batches:
        frames = [press(h.encode("utf-8", "replace")) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(frames, pa.binary())], names=batch.schema.names)


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives to ``folder`` and returns the manifest; a file that it does not list is a failed attempt's."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).alias("url"), F.sha1(body).alias("_digest"), F.octet_length(body).alias("_n"), body.alias("html"))
    newest = written(rows.groupBy("_digest").agg(F.max("id").alias("_newest"), F.count("*").alias("n")), new_folder(pages.sparkSession, "warc-newest"))
    twin = (F.col("id").isNull() | (F.col("id") != F.col("_newest"))) & F.col("_newest").isNotNull() & (F.col("_n") >= least_bytes)
    packed = rows.mapInArrow(_pressed, "id bigint, url string, _digest string, _n int, html binary")
    met = join_spread(packed, newest.drop("n"), ["_digest"], [F.col("id"), F.col("url")], newest)
    dealt = met.select("id", "url", "html", F.when(twin, F.col("_newest")).alias("refers_to"))

    def write(batches):
        from zstandard import ZstdDecompressor

        unpress = ZstdDecompressor().decompress
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "refers_to"))):
                    if out is None:
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc"
                        out, n = fs.open_output_stream(f"{path}/{name}"), 0
                        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        size = len(info)
                    record = page_record(row[0], row[1], unpress(row[2]), row[3], date)
                    out.write(record)
                    n, size = n + 1, size + len(record)
                    if size >= file_bytes:
                        out.close()
                        out = None
                        done.append((name, n, size))
        finally:
            if out is not None:
                out.close()
                done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["file", "n_records", "n_bytes"])

    return written(dealt.mapInArrow(write, MANIFEST), f"{folder}/manifest")


class _Heads:
    """Headers of records in a range of a file, in time linear in the range.

    One pass over the bytes notes where blank lines and lengths stand.  Only what stands after the last blank line of the
    range reads on, once for all candidates, to the next one in the file.
    """

    def __init__(self, file, size: int, start: int, end: int):
        self.file, self.size, self.start = file, size, start
        self.buffer = file.read_at(min(size, end + HEAD_BYTES) - start, start)
        self.blanks = [start + m.start() for m in _BLANK.finditer(self.buffer)]
        self.lengths = [(start + m.start(), start + m.end(), int(m[1])) for m in _LENGTH.finditer(self.buffer)]
        self.upto = start + len(self.buffer)

    def _read_on(self) -> None:
        """Notes what stands between the end of the buffer and the next blank line."""
        while self.upto < self.size:
            # What may straddle the end is read again with it: a blank line, or a length's line.
            begin = max(self.start, self.upto - _LINE)
            part = self.file.read_at(min(self.size - begin, HEAD_BYTES + _LINE), begin)
            last = self.blanks[-1] if self.blanks else -1
            known = self.lengths[-1][0] if self.lengths else -1
            self.blanks += [b for m in _BLANK.finditer(part) if (b := begin + m.start()) > last]
            self.lengths += [(begin + m.start(), begin + m.end(), int(m[1])) for m in _LENGTH.finditer(part) if begin + m.start() > known]
            self.upto = begin + len(part)
            if self.blanks and self.blanks[-1] > last:
                return

    def blank(self, at: int) -> int | None:
        """Where the first blank line after ``at`` begins."""
        k = bisect_left(self.blanks, at)
        if k == len(self.blanks) and self.upto < self.size:
            self._read_on()
        return self.blanks[k] if k < len(self.blanks) else None

    def block(self, at: int) -> tuple[int, int] | None:
        """(begin, length) of the block of a candidate at ``at``."""
        blank = self.blank(at)
        if blank is None:
            return None
        k = bisect_left(self.lengths, (at,))
        return (blank + 4, self.lengths[k][2]) if k < len(self.lengths) and self.lengths[k][1] <= blank else None

    def head(self, at: int) -> bytes:
        """The header of a record at ``at``, up to its blank line."""
        blank = self.blank(at)
        found = self.buffer[at - self.start : blank + 2 - self.start]
        return found if len(found) == blank + 2 - at else self.file.read_at(blank + 2 - at, at)

    def successor(self, at: int) -> int | None:
        block = self.block(at)
        after = block and block[0] + block[1] + 4
        return after if after and after <= self.size else None


def _candidates(folder: str):
    """Per range: each candidate, its successor and where its chain leaves the range (null: it breaks off)."""

    def scan(batches):
        fs, path = file_system(folder)
        for batch in batches:
            for name, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "start", "end"))):
                with fs.open_input_file(f"{path}/{name}") as file:
                    heads = _Heads(file, size, start, end)
                    next_of = {}
                    for found in MAGIC.finditer(heads.buffer, 0, min(len(heads.buffer), end - start + _MAGIC_BYTES)):
                        at = start + found.start()
                        if at < end:
                            next_of[at] = heads.successor(at)
                leaves: dict[int, int | None] = {}
                for at in sorted(next_of, reverse=True):
                    after = next_of[at]
                    leaves[at] = after if after is None or after >= end else leaves.get(after)
                order = sorted(next_of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(order), pa.string()), pa.array(order, pa.int64()), pa.array([next_of[a] for a in order], pa.int64()), pa.array([leaves[a] for a in order], pa.int64())],
                    names=["file", "offset", "successor", "leaves"],
                )

    return scan


def ranges(spark: SparkSession, folder: str, range_bytes: int) -> DataFrame:
    """(file, size, start, end): the byte ranges of the archives in the manifest."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1, F.lit(range_bytes).cast("bigint")))
    cut = files.select("file", F.col("n_bytes").alias("size"), starts.alias("start"))
    return cut.withColumn("end", F.least(F.col("start") + range_bytes, "size"))


def entries(spark: SparkSession, folder: str, range_bytes: int) -> DataFrame:
    """(file, size, start): where the chain from a file's start enters each of its ranges; fails on a broken chain."""
    stage = new_folder(spark, "warc-chain")
    cut = ranges(spark, folder, range_bytes)
    n = cut.count()
    found = written(cut.repartition(max(1, n)).mapInArrow(_candidates(folder), "file string, offset bigint, successor bigint, leaves bigint"), f"{stage}/candidates")
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", F.col("n_bytes").alias("size"))
    ends = files.select("file", F.col("size").alias("offset"), F.col("size").alias("leaves"))  # the end of a file leads to itself
    jump = found.where("leaves IS NOT NULL").select("file", "offset", "leaves").union(ends)
    reached, turn = written(files.select("file", F.lit(0).cast("bigint").alias("offset")), f"{stage}/reached-0"), 0
    while True:
        before, turn = reached.count(), turn + 1
        onward = reached.join(jump, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
        reached = written(reached.union(onward).distinct(), f"{stage}/reached-{turn}")
        if reached.count() == before:
            break
        further = jump.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("_to"))
        jump = written(jump.join(further, ["file", "leaves"]).select("file", "offset", F.col("_to").alias("leaves")), f"{stage}/jump-{turn}")
    broken = files.join(reached, (files["file"] == reached["file"]) & (files["size"] == reached["offset"]), "left_anti").select("file").take(5)
    if broken:
        raise ValueError(f"the chain of records does not reach the end of {[r.file for r in broken]}")
    return reached.join(files, "file").where("offset < size").select("file", "size", F.col("offset").alias("start"))


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rf"\r\n{name}:[ \t]*([^\r\n]*)".encode(), head, re.I)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _page_id(value: str | None) -> int | None:
    digits = value[len(PREFIX) + 1 : -1] if value and value.startswith(f"<{PREFIX}") else ""
    return int(digits) if digits else None


def _parse(folder: str, range_bytes: int):
    def run(batches):
        from .shared import batches_of

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.int64())])
        fs, path = file_system(folder)

        def records():
            for batch in batches:
                for name, size, at in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "start"))):
                    end = min(size, (at // range_bytes + 1) * range_bytes)
                    with fs.open_input_file(f"{path}/{name}") as file:
                        origin, heads = at, _Heads(file, size, at, end)
                        while at < end:
                            head, (block_at, length) = heads.head(at), heads.block(at)
                            block = heads.buffer[block_at - origin : block_at - origin + length]
                            if len(block) < length:
                                block = file.read_at(length, block_at)
                            at = block_at + length + 4
                            kind = _header(head, "WARC-Type")
                            if kind not in ("response", "revisit"):
                                continue
                            http, _, payload = block.partition(b"\r\n\r\n")
                            digest = (_header(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
                            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{name}: the payload before offset {at} has another digest than its record says")
                            n = len(payload) if kind == "response" else int(_LENGTH.search(http + b"\r\n")[1])
                            yield (_page_id(_header(head, "WARC-Record-ID")), _header(head, "WARC-Target-URI"), kind, digest, n, payload if kind == "response" else None, _page_id(_header(head, "WARC-Refers-To")))

        yield from batches_of(records(), schema, 256)

    return run


def read_warc(spark: SparkSession, folder: str, range_bytes: int = 16 << 20) -> DataFrame:
    """The page records of the archives in ``folder``; a revisit's payload is null, its size and digest are the page's."""
    found = written(entries(spark, folder, range_bytes), new_folder(spark, "warc-entries"))
    return found.repartition(max(1, found.count())).mapInArrow(_parse(folder, range_bytes), RECORDS)
