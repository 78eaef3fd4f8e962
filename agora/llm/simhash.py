"""SimHash near-duplicate groups by tiled exact comparison.

A fingerprint has one bit per hash bit, set if more than half of the shingles' hashes have it; a wider fingerprint of
several lanes uses several seeds.  Equal fingerprints are brought together first.  The different ones are dealt into
tiles of bounded size within a class of equal population counts, and two tiles are compared, by exclusive-or and bit
counts in numpy, only if their counts can differ by no more than the radius.  With many fingerprints, and a radius of at
most 8, the population is counted in 2, 4 or 8 parts of a fingerprint, and classes farther apart than the radius in the sum over the parts are
skipped; this is still exact, and keeps the compared share of all pairs falling as the table grows.

Tiles lie in files of the shared folder and pairs of tiles carry places only, so what is shuffled does not grow with the pairs.
A pair yields at most one link per fingerprint (a forest that spans the links found there), so a group of thousands of
copies of each other never becomes all of its pairs.  Groups are the connected components of the links.

With ``jaccard`` the estimate only proposes: fingerprints are taken over the set of a text's different shingles, the sets
lie in files of the shared folder, and a pair within the radius becomes a link only if its sets, read from there, have at
least that Jaccard similarity.  A tile's forest is made of checked links, so a rejected pair hides no true one.

Defined results: text is lower-cased in A-Z only and split into words at ASCII white space.  Fewer words than a shingle
make one shingle of all of them; a text with no word, or a null one, has fingerprint zero and links as any other.
Repeated rows are rows of their own in one group.  A null id never names a group unless the group has no other id.
An empty table gives an empty table.  All columns of the input are kept; an added column replaces one of its name.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import HOT_SHARE, file_system, give_back, join_spread, new_folder, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
SEED = 42
TILE = 8192
SPREAD_ROWS = 4096
SETS_BYTES, TILES_BYTES = 32 << 20, 16 << 20


def fingerprint(text: str | None, shingle: int = 3, lanes: int = 1) -> tuple[list[int], int]:
    """(unsigned lanes, number of shingles) of one text; shingles are hashed in blocks, so memory stays bounded."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if not words:
        return [0] * lanes, 0
    if len(words) < shingle:
        words, shingle = [" ".join(words)], 1
    n = len(words) - shingle + 1
    set_bits = np.zeros((lanes, 64), dtype=np.int64)
    for start in range(0, n, 1 << 16):
        some = words[start : start + (1 << 16) + shingle - 1]
        joined = list(map(" ".join, zip(*[some[k:] for k in range(shingle)])))
        for lane in range(lanes):
            hashes = np.fromiter((xxh64_intdigest(s, SEED + lane) for s in joined), dtype="<u8", count=len(joined))
            set_bits[lane] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * set_bits > n).astype(np.uint8)
    return [int(x) for x in np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)], n


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, lanes: int = 1) -> DataFrame:
    """``docs`` with ``lanes``, an array of signed 64-bit lanes, and ``shingles``, their number."""

    @F.pandas_udf("struct<lanes: array<bigint>, shingles: bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [fingerprint(t, shingle, lanes) for t in texts]
        give_back()
        return pd.DataFrame({"lanes": [np.array(f, dtype=np.uint64).view(np.int64) for f, _ in found], "shingles": [n for _, n in found]})

    df = docs.drop("lanes", "shingles", "__print").withColumn("__print", of(F.col(text)))
    return df.select(*[c for c in df.columns if c != "__print"], "__print.*")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles of one text; empty for a text without a word."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if len(words) < shingle:
        words, shingle = [" ".join(words)] if words else [], 1
    found = []
    for start in range(0, len(words) - shingle + 1, 1 << 16):
        some = words[start : start + (1 << 16) + shingle - 1]
        found.append(np.fromiter((xxh64_intdigest(" ".join(s), SEED) for s in zip(*[some[k:] for k in range(shingle)])), dtype="<u8"))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype="<u8")


def set_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Unsigned lanes of a set of hashes; lanes after the first use the hashes mixed again (the finish of splitmix64)."""
    set_bits = np.zeros((lanes, 64), dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        for lane in range(lanes):
            mixed = hashes[start : start + (1 << 14)]
            if lane:
                mixed = mixed + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                mixed = mixed ^ (mixed >> np.uint64(31))
            set_bits[lane] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((2 * set_bits > len(hashes)).astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1)


def _stored(folder: str, shingle: int, lanes: int):
    """Per text: the key of its shingle set (128 bits), its lanes, and where in the files of ``folder`` the set is.

    A file's name is drawn by the attempt that writes it, so rows of the attempt that counts name its own files.
    """

    def run(batches):
        from xxhash import xxh3_128_digest

        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name, at = uuid.uuid4().int >> 65, 0
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                for part in range(0, batch.num_rows, 256):
                    some = batch.slice(part, 256)
                    keys, prints, counts, places = [], [], [], []
                    for text in some.column("__text").to_pylist():
                        hashes = shingle_set(text, shingle)
                        data = hashes.tobytes()
                        keys.append(xxh3_128_digest(data))
                        prints.append(set_fingerprint(hashes, lanes).view(np.int64))
                        counts.append(len(hashes))
                        places.append(at)
                        out.write(data)
                        at += len(data)
                    arrays = [some.column("__id"), pa.array(prints, pa.list_(pa.int64())), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())]
                    arrays += [pa.array([name] * len(places), pa.int64()), pa.array(places, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["__id", "__lanes", "__shingles", "__own", "__file", "__place"])
                give_back()

    return run


class _Sets:
    """Shingle sets in the files of a folder; those read last stay in memory, up to SETS_BYTES."""

    def __init__(self, folder: str):
        (self.fs, self.path), self.files, self.kept, self.bytes = file_system(folder), OrderedDict(), OrderedDict(), 0

    def read(self, name: int, place: int, n: int) -> np.ndarray:
        key = (name, place)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.fs.open_input_file(f"{self.path}/{name}")
        self.files.move_to_end(name)
        found = np.frombuffer(self.files[name].read_at(8 * n, place), dtype="<u8").copy()
        self.kept[key], self.bytes = found, self.bytes + found.nbytes
        while self.bytes > SETS_BYTES and len(self.kept) > 1:
            self.bytes -= self.kept.popitem(last=False)[1].nbytes
        return found

    def similar(self, one: np.ndarray, others: np.ndarray, jaccard: float) -> np.ndarray:
        """Which of ``others`` (rows of file, place, number) have a set as similar to that of ``one``; read in blocks."""
        mine = self.read(*one.tolist())
        sets = [self.read(*row) for row in others.tolist()]
        sizes = np.array([len(s) for s in sets])
        if not len(mine):
            return sizes == 0
        every = np.concatenate(sets)
        at = np.searchsorted(mine, every)
        found = np.concatenate([[0], np.cumsum(mine[np.minimum(at, len(mine) - 1)] == every)])
        ends = np.cumsum(sizes)
        both = found[ends] - found[ends - sizes]
        return both >= jaccard * (len(mine) + sizes - both)


def _parts_for(distinct: int) -> int:
    """In how many parts of a lane the population is counted: more, as there are more fingerprints to a class."""
    return 1 if distinct <= 2_000_000 else 2 if distinct <= 50_000_000 else 4 if distinct <= 1_000_000_000 else 8


def _populations(lanes: Column, n_lanes: int, parts: int) -> list[Column]:
    """Population counts of ``parts`` parts, each over all lanes."""
    if parts == 1:
        return [sum((F.bit_count(lanes[k]) for k in range(n_lanes)), F.lit(0))]
    width = 64 // parts
    mask = (1 << width) - 1
    return [sum((F.bit_count(F.shiftrightunsigned(lanes[k], p * width).bitwiseAND(F.lit(mask))) for k in range(n_lanes)), F.lit(0)) for p in range(parts)]


@lru_cache(maxsize=8)
def _steps(parts: int, radius: int) -> list[list[int]]:
    """Differences of population counts, over the parts, that add up to no more than the radius."""
    found: list[list[int]] = [[]]
    for _ in range(parts):
        found = [[*f, d] for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return found


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int, check=None, small: tuple[np.ndarray, int] | None = None) -> list[tuple[int, int]]:
    """Links (places in left, then right) within the radius, reduced to a spanning forest; right None: within left.

    ``check`` tells which of some places are similar to a place; only those become links.  ``small`` has a flag per place and the
    radius of pairs with one of these.
    """
    both = left if right is None else np.concatenate([left, right])
    label = np.arange(len(both))
    links: list[tuple[int, int]] = []
    first = 0 if right is None else len(left)
    other = both[first:]
    rows = max(1, 262_144 // max(1, len(other)))
    for start in range(0, len(left), rows):
        block = left[start : start + rows]
        apart = np.bitwise_count(block[:, None, 0] ^ other[None, :, 0])
        if left.shape[1] > 1:
            apart = apart.astype(np.int16)
            for k in range(1, left.shape[1]):
                apart += np.bitwise_count(block[:, None, k] ^ other[None, :, k])
        near = apart <= radius
        if small is not None and small[0].any():
            near |= (apart <= small[1]) & (small[0][start : start + len(block), None] | small[0][None, first:])
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            at = start + i
            hits = np.flatnonzero(near[i]) + first
            hits = hits[label[hits] != label[at]]
            if check is not None:  # nearest first, so that a group is soon one and few pairs are read
                hits, some = hits[np.argsort(apart[i][hits - first], kind="stable")], 1
            while len(hits):
                if check is not None:
                    true = hits[:some][check(at, hits[:some])]
                    hits, some = np.concatenate([true, hits[some:]]) if len(true) else hits[some:], min(2 * some, 64)
                    if not len(true):
                        continue
                found = hits[0]
                links.append((at, int(found)))
                low, high = sorted((label[at], label[found]))
                label[label == high] = low
                hits = hits[label[hits] != label[at]]
    return links


class _Tiles:
    """Tiles in the files of a folder: rows of ``width`` integers; those read last stay in memory, up to TILES_BYTES."""

    def __init__(self, folder: str, width: int):
        (self.fs, self.path), self.width, self.kept, self.bytes = file_system(folder), width, OrderedDict(), 0

    def read(self, name: int, place: int, size: int) -> np.ndarray:
        key = (name, place)
        if key not in self.kept:
            with self.fs.open_input_file(f"{self.path}/{name}") as file:
                self.kept[key] = np.frombuffer(file.read_at(size, place), dtype="<i8").view(np.uint64).reshape(-1, self.width)
            self.bytes += size
            while self.bytes > TILES_BYTES and len(self.kept) > 2:
                self.bytes -= self.kept.popitem(last=False)[1].nbytes
        self.kept.move_to_end(key)
        return self.kept[key]


def _compare(n_lanes: int, radius: int, tiles_folder: str, folder: str | None = None, jaccard: float | None = None, few: int = 0, wide: int = 0):
    """Links of pairs of tiles; sets of up to ``few`` shingles are candidates within ``wide`` bits."""
    width = n_lanes + (1 if folder is None else 4)

    def run(batches):
        sets, tiles = None if folder is None else _Sets(folder), _Tiles(tiles_folder, width)
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                one = tiles.read(left["file"], left["place"], left["size"])
                two = None if left == right else tiles.read(right["file"], right["place"], right["size"])
                ids = one[:, 0] if two is None else np.concatenate([one[:, 0], two[:, 0]])
                check = small = None
                if sets is not None:
                    where = (one if two is None else np.concatenate([one, two]))[:, n_lanes + 1 :].astype(np.int64)
                    small = (where[:, 2] <= few, wide)

                    def check(at, hits, where=where):
                        n, m = where[at, 2], where[hits, 2]
                        good = np.minimum(n, m) >= jaccard * np.maximum(n, m)
                        if good.any():
                            good[good] = sets.similar(where[at], where[hits[good]], jaccard)
                        return good

                lanes = slice(1, n_lanes + 1)
                for x, y in _forest(one[:, lanes], None if two is None else two[:, lanes], radius, check, small):
                    a.append(ids[x])
                    b.append(ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (a, b)], names=["a", "b"])
        sets = tiles = None
        give_back()

    return run


def _packed(folder: str):
    """Per tile: where it is in the files of ``folder``, as little-endian 64-bit integers, of each member the id, then the lanes.

    A file's name is drawn by the attempt that writes it, so rows of the attempt that counts name its own files.
    """

    def run(batches):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name, at = uuid.uuid4().int >> 65, 0
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                places, sizes = [], []
                for members in batch.column("members"):
                    data = members.values.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                    out.write(data)
                    places.append(at)
                    sizes.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array([name] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["tile", "file", "place", "size"])

    return run


def links(distinct: DataFrame, n_lanes: int, radius: int, tile: int = TILE, length_ratio: float | None = None, sets: str | None = None, jaccard: float | None = None, few: int = 0, wide: int = 0) -> DataFrame:
    """Links (a, b) between rows of ``distinct(id, lanes, shingles)`` that join all pairs within the radius.

    With ``sets``, the folder of shingle sets, ``distinct`` has their ``file`` and ``place`` too, and only pairs within
    the radius (``wide``, if one has up to ``few`` shingles) whose sets have a similarity of ``jaccard`` or more are joined.

    With ``length_ratio``, a pair also needs numbers of shingles of at least this ratio up to one class of lengths:
    documents whose similarity reaches the ratio have it, so classes of lengths that are not neighbours are skipped.
    """
    spark = distinct.sparkSession
    folder = new_folder(spark, "simhash-tiles")
    # Moves between parts grow with the power ``parts`` of the radius, and a wide radius skips little in any number of parts.
    parts = 1 if radius > 8 else _parts_for(distinct.count())
    keys = _populations(F.col("lanes"), n_lanes, parts)
    span = F.lit(0) if length_ratio is None else F.floor(F.log(F.col("shingles") + 1.0) / float(-np.log(length_ratio))).cast("int")
    member = [F.array("id"), F.col("lanes")] if sets is None else [F.array("id"), F.col("lanes"), F.array("file", "place", "shingles")]
    df = distinct.select("id", F.concat(*member).alias("__member"), span.alias("__span"), F.array(*keys).alias("__pop"))
    reach = radius
    if radius > 8:  # classes as wide as the radius: those within it are the same class and the next
        df, reach = df.withColumn("__pop", F.array((F.col("__pop")[0] / max(radius, wide)).cast("int"))), 1
    sizes = written(df.groupBy("__span", "__pop").agg(F.count("*").alias("__n")), f"{folder}/classes")
    sizes = sizes.select("__span", "__pop", F.ceil(F.col("__n") / tile).alias("__tiles"))
    name = lambda span, pop, k: F.concat_ws(":", span, F.concat_ws(".", pop.cast("array<string>")), k)

    dealt = df.join(sizes, ["__span", "__pop"]).withColumn("tile", name(F.col("__span"), F.col("__pop"), F.pmod(F.xxhash64("id"), F.col("__tiles"))))
    grouped = dealt.groupBy("tile").agg(F.flatten(F.collect_list("__member")).alias("members"))
    tiles = written(grouped.mapInArrow(_packed(f"{folder}/data"), "tile string, file bigint, place bigint, size bigint"), f"{folder}/tiles")

    moves = _steps(parts, reach)
    spans = (0,) if length_ratio is None else (-1, 0, 1)
    every = F.explode(F.array(*[F.array(*[F.lit(d) for d in (s, *m)]) for s in spans for m in moves]))
    near = sizes.withColumn("__move", every).select(
        F.col("__span").alias("__span1"), F.col("__pop").alias("__pop1"), F.col("__tiles").alias("__tiles1"),
        (F.col("__span") + F.col("__move")[0]).alias("__span"), F.zip_with("__pop", F.slice("__move", 2, parts), lambda a, d: a + d).alias("__pop"),
    )
    pairs = near.join(sizes, ["__span", "__pop"]).withColumn("__k1", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__tiles1") - 1))).withColumn("__k2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__tiles") - 1)))
    pairs = pairs.select(name(F.col("__span1"), F.col("__pop1"), F.col("__k1")).alias("one"), name(F.col("__span"), F.col("__pop"), F.col("__k2")).alias("two")).where("one <= two")
    at = F.struct("file", "place", "size")
    left, right = tiles.select(F.col("tile").alias("one"), at.alias("__one")), tiles.select(F.col("tile").alias("two"), at.alias("__two"))
    work = pairs.join(left, "one").join(right, "two").select(F.col("__one").alias("one"), F.col("__two").alias("two"))
    # Pairs are dealt over the tasks as they come: each is work of about the same size.  In a task a tile meets its partners in turn.
    work = work.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)).sortWithinPartitions("one", "two")
    return written(work.mapInArrow(_compare(n_lanes, radius, f"{folder}/data", sets, jaccard, few, wide), "a bigint, b bigint"), f"{folder}/links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, lanes: int = 1, radius: int = 3, length_ratio: float | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with lanes, shingles and component_id, the least id of the documents that links reach.

    Without ``keep_text`` the text is left out, and texts are read and hashed once only.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "simhash")
    printed = fingerprints(docs.drop("component_id"), text, shingle, lanes)
    slim = written(printed.select(F.col(doc_id).alias("__id"), F.col("lanes").alias("__lanes"), F.col("shingles").alias("__shingles")), f"{folder}/prints")
    # Different fingerprints, and with a ratio different numbers of shingles, are rows of their own; one lane is its own id.
    keys = ["__lanes"] if length_ratio is None else ["__lanes", "__shingles"]
    counted = slim.groupBy(*keys).agg(F.min("__id").alias("least"), F.first("__shingles").alias("shingles"), F.count("*").alias("n"))
    own = F.col("__lanes")[0] if lanes == 1 and length_ratio is None else F.monotonically_increasing_id()
    distinct = written(counted.select(*keys, own.alias("id"), "least", F.col("__lanes").alias("lanes"), "shingles", "n"), f"{folder}/distinct")
    groups = _groups(distinct, links(distinct, lanes, radius, length_ratio=length_ratio), folder)
    found = distinct.join(groups, F.col("id") == F.col("__group")).select(*keys, "component_id")
    kept = [c for c in docs.columns if c not in ("lanes", "shingles", "component_id") and (keep_text or c != text)]
    if set(kept) <= {doc_id, text} and not keep_text:
        printed = slim.select(F.col("__id").alias(doc_id), F.col("__lanes").alias("lanes"), F.col("__shingles").alias("shingles"))
    keyed = printed.withColumns({"__lanes": F.col("lanes"), "__shingles": F.col("shingles")})
    return join_spread(keyed, found, keys, [F.col(doc_id)], distinct.select(*keys, "n")).select(*kept, "lanes", "shingles", "component_id")


def _groups(distinct: DataFrame, linked: DataFrame, folder: str) -> DataFrame:
    """(__group, component_id) for every id of ``distinct``: the least document that its links reach."""
    found = components(linked, "simhash-components")
    named = written(distinct.join(found, F.col("id") == F.col("node"), "left").select("id", "least", "component"), f"{folder}/named")
    # Most fingerprints have no link and name themselves; those of a large group are spread over parts of some SPREAD_ROWS.
    linked = named.where(F.col("component").isNotNull())
    of_root = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.ceil(F.count("*") / SPREAD_ROWS).alias("parts"))
    of_root = written(of_root, f"{folder}/roots")
    spread = of_root.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    # The largest groups, at most HOT_SHARE, are spread; the rows of any other meet its part 0.
    large = F.broadcast(of_root.where("parts > 1").orderBy(F.col("parts").desc(), "component").limit(HOT_SHARE).select(F.col("component").alias("__large"), F.col("parts").alias("__parts")))
    parted = linked.join(large, F.col("component") == F.col("__large"), "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("__parts", F.lit(1).cast("bigint"))))
    together = parted.join(spread.select("component", "part", "component_id"), ["component", "part"]).select(F.col("id").alias("__group"), "component_id")
    alone = named.where(F.col("component").isNull()).select(F.col("id").alias("__group"), F.col("least").alias("component_id"))
    return written(together.union(alone), f"{folder}/groups")


class _Among:
    """Which rows are among those of a stored table (part, row), sorted by row; ``part`` is what a row's number has above 33 bits.

    Numbers of rows that were written together share few parts, so a task reads little of the table, and no row is moved.
    """

    def __init__(self, folder: str):
        self.folder, self.kept = folder, OrderedDict()

    def __getstate__(self):
        return {"folder": self.folder, "kept": OrderedDict()}

    def _part(self, part: int) -> np.ndarray:
        if part not in self.kept:
            while len(self.kept) >= 4:
                self.kept.popitem(last=False)
            fs, path = file_system(self.folder)
            self.kept[part] = np.sort(pq.read_table(path, filesystem=fs, columns=["row"], filters=[("part", "=", part)]).column("row").to_numpy())
        self.kept.move_to_end(part)
        return self.kept[part]

    def has(self, numbers: pd.Series) -> pd.Series:
        rows = numbers.to_numpy()
        found = np.zeros(len(rows), dtype=bool)
        for part in np.unique(rows >> 33).tolist():
            own, held = rows >> 33 == part, self._part(part)
            at = np.minimum(np.searchsorted(held, rows[own]), max(0, len(held) - 1))
            found[own] = held[at] == rows[own] if len(held) else False
        return pd.Series(found)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, lanes: int = 4, radius: int = 52, jaccard: float = 0.8, few: int = 24, wide: int = 80) -> DataFrame:
    """One row of each near-duplicate group, that with the least id (null last); of repeated ids any one row.

    Linked are texts whose sets of five-word shingles have a Jaccard similarity of at least ``jaccard``, counted on
    64-bit hashes.  Pairs to be counted are those of equal sets and those within the radius, of similar numbers of shingles:
    at 0.8 a pair of long texts differs in 39 of 256 bits on average, with a standard deviation below 6.  A set of few
    shingles says less by its bits (at four shingles against five the average is 48), so pairs with a set of up to ``few``
    are counted within ``wide`` bits, five deviations on.
    """
    folder = new_folder(docs.sparkSession, "simhash-keep")
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), f"{folder}/rows")
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__row").alias("row"))
    asked = rows.select(key.alias("__id"), F.col(text).alias("__text"))
    schema = f"__id {asked.schema['__id'].dataType.simpleString()}, __lanes array<bigint>, __shingles bigint, __own binary, __file bigint, __place bigint"
    slim = written(asked.mapInArrow(_stored(f"{folder}/sets", shingle, lanes), schema), f"{folder}/prints")
    # Lanes and number are the set's own; where it is read may be any of its copies.
    place = F.min(F.struct("__file", "__place"))
    # A set goes by the row of its first document, which no other set has.
    distinct = slim.groupBy("__own").agg(F.min("__id").alias("least"), F.first("__lanes").alias("lanes"), F.first("__shingles").alias("shingles"), place.alias("at"))
    distinct = written(distinct.select(F.col("least.row").alias("id"), "least", "lanes", "shingles", F.col("at.__file").alias("file"), F.col("at.__place").alias("place")), f"{folder}/distinct")
    groups = _groups(distinct, links(distinct, lanes, radius, length_ratio=jaccard, sets=f"{folder}/sets", jaccard=jaccard, few=few, wide=max(radius, wide)), folder)
    first = groups.select(F.shiftrightunsigned("component_id.row", 33).alias("part"), F.col("component_id.row").alias("row"))
    written(first.repartitionByRange("row").sortWithinPartitions("row"), f"{folder}/first")
    among = _Among(f"{folder}/first")

    @F.pandas_udf("boolean")
    def is_first(numbers: pd.Series) -> pd.Series:
        return among.has(numbers)

    return rows.where(is_first("__row")).select(*docs.columns)
