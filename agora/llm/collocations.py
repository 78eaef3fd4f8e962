"""Phrases whose words stand together more often than their parts would tell.

Tasks read documents in shards of one language and bounded bytes.  numpy cuts a shard into words and pieces and numbers the
words; prefix doubling ranks its suffixes by their first words, never beyond a piece; neighbours in the suffix array have a
longest common prefix, and its intervals of n words or more are the shard's n-grams with their counts.  Spark adds the counts of
all shards by key.

A word's key is a 64-bit hash of word and language.  The table of all words shows whether two of them share one; if ever, another
seed is taken, so keys are exact and an n-gram is its words' keys.  Phrases are spelt at the end, for those that can be reported.

A phrase that is frequent enough has only parts that are, so lengths are counted one after the other: the n-grams that reach
``least`` leave a filter of bits in the shared folder, and shards count an (n+1)-gram only where the filter has both its n-grams.
A filter has a fixed number of bits; one that fills up, or two n-grams of one bit, save less and lose nothing.

Defined results: a null or empty text has no word; a null language is ``und``, as is that name.  Words and pieces are
those of bytes, so invalid text stays as it is.  Repeated rows count each time.  Other columns are not read.  An empty table, and
a language without a frequent phrase, give no row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import file_system, give_back, join_spread, new_folder, written

BREAKS = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytes(10 if b in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SHARD_BYTES = 6 << 20
FILTER_BITS = 27
#: By how many bits a key turns before the next word goes in.
TURN = 23
BUCKETS = 32


def blocks(text: bytes, longest: int, size: int = SHARD_BYTES) -> Iterator[tuple[bytes, int]]:
    """(bytes, end): parts of a cleaned text, cut between pieces or else between words; phrases count if they begin before ``end``.

    A part that ends inside of a piece is followed by as many of its next words as a phrase can reach.
    """
    ahead = re.compile(rb"(?: +[^ \n]+){0,%d}" % (longest - 1))
    at = 0
    while len(text) - at > size:
        end = text.rfind(b"\n", at, at + size)
        if end <= at:
            end = text.rfind(b" ", at, at + size)
        if end <= at:  # one word fills the part
            end = min((p for p in (text.find(b" ", at + 1), text.find(b"\n", at + 1)) if p > 0), default=len(text))
        yield text[at : ahead.match(text, end).end()], end - at
        at = end
    yield text[at:], len(text) - at


def shards(batches: Iterator[pa.RecordBatch], longest: int, size: int = SHARD_BYTES) -> Iterator[tuple[str, bytes, int]]:
    """(language, cleaned bytes, end) of documents put together up to ``size`` bytes; the largest part goes first when there are many."""
    kept: dict[str, list[bytes]] = defaultdict(list)
    held: dict[str, int] = defaultdict(int)

    def flush(lang: str):
        text = b"\n".join(kept.pop(lang))
        held.pop(lang)
        yield from ((lang, *b) for b in blocks(text, longest, size))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            text = text.as_py()
            if text:
                kept[lang].append(text.translate(_BYTES))
                held[lang] += len(text)
                if held[lang] >= size:
                    yield from flush(lang)
                elif sum(held.values()) >= 2 * size:
                    yield from flush(max(held, key=held.get))
    for lang in list(kept):
        yield from flush(lang)


class Shard:
    """The words of a shard: ``ids`` into ``words``, and ``room``, how many words a piece still has from each place on."""

    def __init__(self, text: bytes, end: int):
        b = np.frombuffer(text, dtype=np.uint8)
        gap = (b == 32) | (b == 10)
        begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(b) else np.zeros(0, dtype=np.int64)
        ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1 if len(b) else begins
        offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
        data = np.ascontiguousarray(b[~gap])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        pieces = np.cumsum(b == 10, dtype=np.int32)[begins]
        last = np.flatnonzero(np.concatenate([pieces[1:] != pieces[:-1], [True]])) if len(begins) else begins
        sizes = np.diff(np.concatenate([[-1], last]))
        self.room = (np.repeat(last, sizes) - np.arange(len(begins)) + 1).astype(np.int32)
        self.own = begins < end

    def word_keys(self, lang: str, seed: int) -> np.ndarray:
        """The key of the word at every place."""
        from xxhash import xxh64_intdigest

        seed = xxh64_intdigest(lang.encode(), seed)
        return np.fromiter((xxh64_intdigest(w, seed) for w in self.words.to_pylist()), dtype=np.uint64, count=len(self.words))[self.ids]

    def starts(self, n: int) -> np.ndarray:
        """Places of this shard's own where n words follow in the piece."""
        return np.flatnonzero((self.room >= n) & self.own)

    def suffixes(self, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array of ``starts`` by their first n words, longest common prefix with the one before, at most n).

        Prefix doubling: ranks by h words and the ranks h places on give ranks by 2 h; the last step overlaps to end at n.
        """
        rank, h = self.ids.astype(np.int64) + 1, 1
        key = rank
        while h < n:
            step = min(h, n - h)
            after = np.zeros_like(rank)
            after[: len(rank) - step] = rank[step:]
            after[self.room <= step] = 0  # nothing is left of the piece, which comes before any word
            key = rank * (int(rank.max(initial=0)) + 1) + after
            h += step
            if h < n:
                rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        order = starts[np.argsort(key[starts], kind="stable")]
        common = np.zeros(len(order), dtype=np.int8)
        same = np.ones(max(0, len(order) - 1), dtype=bool)
        for k in range(n):
            a, b = order[:-1], order[1:]
            same &= (self.room[a] > k) & (self.room[b] > k)
            same &= self.ids[np.minimum(a + k, len(self.ids) - 1)] == self.ids[np.minimum(b + k, len(self.ids) - 1)]
            common[1:] += same
        return order, common

    def counts(self, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(one place, number) of every n-gram at ``starts``: the intervals of the suffix array with common prefixes of n words."""
        order, common = self.suffixes(starts, n)
        first = np.flatnonzero(common < n)
        return order[first], np.diff(np.concatenate([first, [len(order)]]))

    def spelt(self, places: np.ndarray) -> pa.Array:
        """The words at some places; their bytes are taken as they are."""
        words = self.words.take(pa.array(self.ids[places])).cast(pa.binary())
        return pa.StringArray.from_buffers(len(words), words.buffers()[1], words.buffers()[2]) if len(words) else pa.array([], pa.string())


def fold(words: Sequence[np.ndarray]) -> np.ndarray:
    """One key of the keys of an n-gram's words, as ``_folded`` has it."""
    key = words[0]
    for w in words[1:]:
        key = ((key << np.uint64(TURN)) | (key >> np.uint64(64 - TURN))) ^ w
    return key


def _folded(words: Sequence[str]) -> Column:
    key = F.col(words[0])
    for w in words[1:]:
        key = F.shiftleft(key, TURN).bitwiseOR(F.shiftrightunsigned(key, 64 - TURN)).bitwiseXOR(F.col(w))
    return key


class _Filter:
    """The bits of a stored filter."""

    def __init__(self, folder: str, bits: int):
        fs, path = file_system(folder)
        found = pq.read_table(path, filesystem=fs)
        self.table = np.zeros(1 << (bits - 6), dtype=np.uint64)
        self.table[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slots = ((keys >> np.uint64(6)) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return (self.table[slots] >> (keys & np.uint64(63))) & np.uint64(1) > 0


def _parts(arrays: list[pa.Array], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(arrays, names=names)
    for start in range(0, whole.num_rows, rows):
        yield whole.slice(start, rows)
    give_back()


def _words_counted(seed: int, size: int):
    """(lang, phrase, w1, f) of the words of each shard."""

    def run(batches):
        for lang, text, end in shards(batches, 1, size):
            shard = Shard(text, end)
            places, numbers = shard.counts(shard.starts(1), 1)
            keys = shard.word_keys(lang, seed)[places].view(np.int64)
            yield from _parts([pa.array([lang] * len(places), pa.string()), shard.spelt(places), pa.array(keys), pa.array(numbers, pa.int64())], ["lang", "phrase", "w1", "f"])

    return run


def _phrases_counted(n: int, below: str, seed: int, bits: int, size: int):
    """(w1, ..., wn, f) of the n-grams of each shard both of whose (n-1)-grams the filter ``below`` has."""
    names = [f"w{k}" for k in range(1, n + 1)]

    def run(batches):
        known = _Filter(below, bits)
        for lang, text, end in shards(batches, n, size):
            shard = Shard(text, end)
            keys, starts = shard.word_keys(lang, seed), shard.starts(n)
            for first in (0, 1):
                starts = starts[known.has(fold([keys[starts + k] for k in range(first, first + n - 1)]))]
            places, numbers = shard.counts(starts, n)
            yield from _parts([*[pa.array(keys[places + k].view(np.int64)) for k in range(n)], pa.array(numbers, pa.int64())], [*names, "f"])

    return run


def _filtered(grams: DataFrame, n: int, folder: str, bits: int) -> str:
    """Stores the bits of n-grams: at most 2 ** (bits - 6) rows."""
    key = _folded([f"w{k}" for k in range(1, n + 1)])
    slot = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1)).alias("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), key.bitwiseAND(F.lit(63)).cast("int"))
    written(grams.groupBy(slot).agg(F.bit_or(bit).alias("bits")), folder)
    return folder


def ngrams(docs: DataFrame, longest: int, least: int, folder: str, bits: int = FILTER_BITS, size: int = SHARD_BYTES, hashed: int = 64) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(words, phrases) of ``docs(lang, text)``: all words as (lang, phrase, w1, f), and by length, from 2 to ``longest``, the n-grams of
    at least ``least`` occurrences as (w1, ..., wn, f).  ``w1`` to ``wn`` are keys of words; only tests take fewer ``hashed`` bits."""
    seed = 0
    while True:
        found = docs.mapInArrow(_words_counted(seed, size), "lang string, phrase string, w1 bigint, f bigint")
        key = F.col("w1").bitwiseAND(F.lit((1 << min(hashed + seed, 63)) - 1)) if hashed < 64 else F.col("w1")
        words = written(found.groupBy("lang", "phrase", "w1").agg(F.sum("f").alias("f")), f"{folder}/words-{seed}")
        if words.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        seed += 1
    below = _filtered(words.where(F.col("f") >= least), 1, f"{folder}/filter-1", bits)
    phrases = {}
    for n in range(2, longest + 1):
        names = [f"w{k}" for k in range(1, n + 1)]
        found = docs.mapInArrow(_phrases_counted(n, below, seed, bits, size), ", ".join(f"{c} bigint" for c in (*names, "f")))
        phrases[n] = written(found.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= least), f"{folder}/{n}")
        if n < longest:
            below = _filtered(phrases[n], n, f"{folder}/filter-{n}", bits)
    return words, phrases


def _part(start: Column, length: Column, longest: int) -> list[Column]:
    """The words of a part as as many columns as the longest phrase has, null after its end."""
    part = F.slice("ids", start, length)
    return [F.get(part, F.lit(k)).alias(f"p{k + 1}") for k in range(longest)]


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, bits: int = FILTER_BITS, size: int = SHARD_BYTES) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of the phrase and of the two parts of its lowest-scoring cut, score is floor(10**6 * a * a /
    (l * r)) in decimals of 38 digits, exact for a up to 10**16, n all words of the language.  A phrase goes if its words stand in
    a longer one that occurs at least ``inside_percent`` times as often in a hundred.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "collocations")
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words, phrases = ngrams(read, longest, least, folder, bits, size)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    part = [f"p{k + 1}" for k in range(longest)]
    of = lambda df, n, *more: df.select(F.array(*[f"w{k}" for k in range(1, n + 1)]).alias("ids"), F.col("f"), *more)
    grams = [of(words.where(F.col("f") >= least), 1), *[of(df, n) for n, df in phrases.items()]]
    every = candidates = None
    for n, df in enumerate(grams, 1):
        every = df if every is None else every.unionByName(df)
        if n > 1:
            candidates = df if candidates is None else candidates.unionByName(df)
    size_ = F.size("ids")
    counted = every.select(*_part(F.lit(1), size_, longest), "f")

    # The parts of a phrase occur as often as it does, so they are in the tables too.
    cuts = candidates.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size_ - 1)).alias("cut"))
    cuts = written(cuts.select("ids", "a", "cut", *_part(F.lit(1), F.col("cut"), longest)), f"{folder}/cuts")
    cuts = join_spread(cuts, counted.withColumnRenamed("f", "l"), part, [F.col("ids")]).select("ids", "a", "cut", "l")
    cuts = written(cuts.select("ids", "a", "cut", "l", *_part(F.col("cut") + 1, size_ - F.col("cut"), longest)), f"{folder}/left")
    cuts = join_spread(cuts, counted.withColumnRenamed("f", "r"), part, [F.col("ids")])
    cuts = cuts.withColumns({f"__{c}": F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")})
    cuts = cuts.withColumn("score", F.expr("(1000000 * (__a * __a)) div (__l * __r)").cast("long"))
    scored = cuts.groupBy("ids").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("s")).select("ids", "s.a", "s.l", "s.r", "s.score")

    # Parts shorter than the whole, with the most frequent phrase around them.
    longer = candidates.where(size_ > 2).select("ids", "f", F.explode(F.sequence(F.lit(2), size_ - 1)).alias("length"))
    longer = longer.select("ids", "f", "length", F.explode(F.sequence(F.lit(1), size_ - F.col("length") + 1)).alias("start"))
    around = longer.groupBy(F.slice("ids", F.col("start"), F.col("length")).alias("ids")).agg(F.max("f").alias("around"))
    kept = scored.join(around, "ids", "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a"))).drop("around")
    first = kept.withColumn("p1", F.get("ids", F.lit(0)))
    kept = written(join_spread(written(first, f"{folder}/kept"), words.select(F.col("w1").alias("p1"), "lang"), ["p1"], [F.col("ids")]).drop("p1"), f"{folder}/scored")

    # What ties with a language's last place may be in its list, so it is spelt too; the best of each of BUCKETS parts of a
    # language meet in one task, BUCKETS * top rows at most.
    def best(df: DataFrame, order: list[Column], tie: Column) -> DataFrame:
        some = df.withColumn("__bucket", F.pmod(F.xxhash64(tie), F.lit(BUCKETS)))
        some = some.withColumn("__place", F.row_number().over(Window.partitionBy("lang", "__bucket").orderBy(*order))).where(F.col("__place") <= top)
        return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("__bucket", "__place")

    order = [F.col("score").desc(), F.col("a").desc()]
    last = best(kept, order, F.col("ids")).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("__last"))
    likely = written(kept.join(last, "lang").where(F.struct("score", "a") >= F.col("__last")).drop("__last"), f"{folder}/likely")
    places = likely.select("ids", F.posexplode("ids").alias("at", "p1"))
    spelt = join_spread(places, words.select(F.col("w1").alias("p1"), "phrase"), ["p1"], [F.col("ids")])
    spelt = spelt.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "phrase"))).alias("__words"))
    spelt = spelt.select("ids", F.array_join(F.transform("__words", lambda w: w["phrase"]), " ").alias("phrase"))
    ranked = best(likely.join(spelt, "ids"), [*order, F.col("phrase")], F.col("phrase"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
