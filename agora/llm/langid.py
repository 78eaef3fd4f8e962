"""Language ID: prediction by partial matching over bytes.

For each language a tree of byte contexts of order 0 to ``order`` keeps how often each byte followed.  Statistics are
frozen after training.  In a context seen T times with q different next bytes, a byte seen n times has probability
n / (T + q), and the rest, q / (T + q), is the escape to the next shorter context; below order 0 all 256 bytes are
alike.  So the order varies from byte to byte: it is the longest at which the context was followed by that byte.  The code
length of a text is the sum of -log2 of these probabilities over its bytes, and the language with the shortest code is
predicted.

Trees are held sparsely: for each order the strings (context and next byte) that occur, with their code lengths under a
group of languages, and the contexts with the cost of their escapes.  A byte is looked up at the highest order first and
goes down, paying escapes, while its string is unknown to the group.

Training reads whole texts of at most ``sample`` labelled documents per language, those with the least hash of their id, as long
as they have ``sample_bytes`` bytes together (the first is always read): a bound on the model, not on what is predicted.  Counts
of strings of ``order`` + 1 bytes are a table in the shared folder, sorted by language; the driver has the names of the languages
only.  A worker builds the trees of GROUP languages when it needs them and keeps those of KEPT groups.

Defined results: ``und`` with score 0 for a null text, an empty one, one without a letter (Unicode category L), or if no
language was learned.  Ties between languages go to the smaller name.  Rows are judged one by one; a column of the input
with the name of an added one is replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import file_system, give_back, new_folder, written

UNKNOWN = "und"
ORDER = 4
GROUP = 8
KEPT = 4
MERGED = 300_000
PART = 1 << 18
_HASHES = 1 << 40


class _Keys:
    """Places of 64-bit keys: sorted by a hash, found through the first place of each of its values."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        place = self._hash(keys)
        self.order = np.argsort(place, kind="stable")
        self.keys = np.append(keys[self.order], np.uint64(0))
        counts = np.bincount(place, minlength=1 << bits)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.longest = int(counts.max(initial=0))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given, in the order of the hash; -1 if it is none."""
        place = self._hash(keys)
        at, end = self.first[place], self.first[place + 1]
        found = np.where((self.keys[at] == keys) & (at < end), at, -1)
        open_ = np.flatnonzero((found < 0) & (at + 1 < end))
        for k in range(1, self.longest):
            if not len(open_):
                break
            now = at[open_] + k
            hit = self.keys[now] == keys[open_]
            found[open_[hit]] = now[hit]
            open_ = open_[~hit & (now + 1 < end[open_])]
        return found


class _Tree:
    """The context trees of a few languages: per order, strings with code lengths and contexts with escapes, in bits."""

    def __init__(self, codes: list[np.ndarray], counts: list[np.ndarray], order: int):
        self.levels: list[tuple[_Keys, np.ndarray, _Keys, np.ndarray]] = []
        below = None
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            strings = np.unique(np.concatenate([c & mask for c in codes]))
            contexts = np.unique(strings >> np.uint64(8))
            of = np.searchsorted(contexts, strings >> np.uint64(8))
            shorter = None if below is None else np.searchsorted(below[0], strings & np.uint64((1 << 8 * k) - 1))
            lengths = np.zeros((len(strings), len(codes)), dtype=np.float32)
            escapes = np.zeros((len(contexts), len(codes)), dtype=np.float32)
            for lang, (c, n) in enumerate(zip(codes, counts)):  # a language at a time, so that little is held beside the result
                seen = np.bincount(np.searchsorted(strings, c & mask), n, len(strings))
                total, kinds = np.bincount(of, seen, len(contexts)), np.bincount(of, seen > 0, len(contexts))
                weight = np.where(total > 0, total + kinds, 1.0)
                escape = -np.log2(np.where(total > 0, kinds / weight, 1.0))
                further = escape[of] + (8.0 if below is None else below[1][shorter, lang])
                lengths[:, lang] = np.where(seen > 0, np.log2(weight)[of] - np.log2(np.maximum(seen, 1)), further)
                escapes[:, lang] = escape
            below = strings, lengths
            keys, roots = _Keys(strings), _Keys(contexts)
            self.levels.append((keys, lengths[keys.order], roots, escapes[roots.order]))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string, after the bytes before it: [string, language]."""
        out = np.zeros((len(codes), self.levels[0][1].shape[1]), dtype=np.float32)
        open_ = np.arange(len(codes))
        for k in range(len(self.levels) - 1, -1, -1):
            keys, lengths, roots, escapes = self.levels[k]
            own = codes[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = keys.find(own)
            hit = at >= 0
            out[open_[hit]] += lengths[at[hit]]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                return out
            root = roots.find(own >> np.uint64(8))
            out[open_[root >= 0]] += escapes[root[root >= 0]]
        out[open_] += 8.0
        return out


@dataclass
class Model:
    """Languages, and where the counts of their strings of ``order`` + 1 bytes are; zero bytes stand for what is before the start.

    The table in ``folder`` has lang, code (a string as a 64-bit integer, the next byte lowest) and n.
    """

    languages: list[str]
    folder: str | None = None
    order: int = ORDER
    _trees: OrderedDict[tuple[str, ...], _Tree] = field(default_factory=OrderedDict)

    def __getstate__(self):
        return {"languages": self.languages, "folder": self.folder, "order": self.order, "_trees": OrderedDict()}

    def _tree(self, names: tuple[str, ...]) -> _Tree:
        if names not in self._trees:
            while len(self._trees) >= KEPT:
                self._trees.popitem(last=False)
            fs, path = file_system(self.folder)
            table = pq.read_table(path, filesystem=fs, filters=[("lang", "in", list(names))]).combine_chunks()
            lang, codes, counts = table.column("lang"), table.column("code").to_numpy(), table.column("n").to_numpy()
            codes_of, counts_of = [], []
            for name in names:
                own = pc.equal(lang, name).to_numpy()
                order = np.argsort(codes[own], kind="stable")
                codes_of.append(codes[own][order].astype(np.uint64))
                counts_of.append(counts[own][order])
            self._trees[names] = _Tree(codes_of, counts_of, self.order)
        self._trees.move_to_end(names)
        return self._trees[names]

    def forget(self) -> None:
        """Drops the trees; they are built again when they are needed."""
        self._trees.clear()

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text under each language: [text, language]."""
        chunks: list[list[tuple[int, int]]] = []
        held = PART
        for row, text in enumerate(texts):
            for start in range(0, len(text), PART):
                if held >= PART:
                    chunks.append([])
                    held = 0
                chunks[-1].append((row, start))
                held += min(PART, len(text) - start)
        total = np.zeros((len(texts), len(self.languages)))
        for k in range(0, len(self.languages) if chunks else 0, GROUP):
            tree = self._tree(tuple(self.languages[k : k + GROUP]))
            for chunk in chunks:
                parts = [texts[row][max(0, start - self.order) : start].rjust(self.order, b"\0") + texts[row][start : start + PART] for row, start in chunk]
                np.add.at(total[:, k : k + GROUP], [row for row, _ in chunk], self._sums(tree, parts))
        return total

    def _sums(self, tree: _Tree, parts: list[bytes]) -> np.ndarray:
        """Code length of each part, which begins with ``order`` bytes that are only context."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = strings(np.frombuffer(b"".join(parts), np.uint8), self.order)
        own = lengths - self.order
        firsts = np.cumsum(own) - own
        # Strings that end in the first bytes of a part reach over its begin; those are left out.
        at = np.arange(int(own.sum())) + np.repeat((np.cumsum(lengths) - lengths) - firsts, own)
        return np.add.reduceat(tree.bits(codes[at]), firsts, axis=0, dtype=np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and the share of its code in the sum of two to minus each code length."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        asked = [k for k, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        bits = self.bits([texts[k].encode("utf-8", "replace") for k in asked])
        best = bits.argmin(axis=1) if asked else []
        for k, own, row in zip(asked, best, bits):
            names[k], scores[k] = self.languages[own], float(1.0 / np.exp2(np.maximum(row[own] - row, -1000)).sum())
        return names, scores


def strings(data: np.ndarray, order: int) -> np.ndarray:
    """Every string of ``order`` + 1 bytes in ``data`` as a 64-bit integer, its last byte lowest."""
    n = max(0, len(data) - order)
    codes = np.zeros(n, dtype=np.uint64)
    for k in range(order + 1):
        codes = (codes << np.uint64(8)) | data[k : k + n]
    return codes


def _count_strings(order: int):
    """Counts of (language, string); a task puts its texts together, up to MERGED different strings, and counts them in parts."""

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}
        rows = 0

        def put_together():
            for lang, parts in fresh.items():
                codes, counts = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                new, n = np.unique(np.concatenate(parts), return_counts=True)
                every, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
                held[lang] = every, np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)
            fresh.clear()

        def emit():
            for lang, (codes, counts) in held.items():
                for start in range(0, len(codes), 1 << 16):
                    some = codes[start : start + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[start : start + (1 << 16)])], names=["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(bytes(order) + (text or "").encode("utf-8", "replace"), dtype=np.uint8)
                for start in range(0, max(1, len(data) - order), 1 << 20):
                    fresh.setdefault(lang, []).append(strings(data[start : start + (1 << 20) + order], order))
                    rows += len(fresh[lang][-1])
                    if rows >= MERGED:
                        put_together()
                        rows = 0
                        if sum(len(c) for c, _ in held.values()) >= MERGED:
                            yield from emit()
        put_together()
        yield from emit()

    return run


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = 1000, order: int = ORDER, sample_bytes: int = 16 << 20) -> Model:
    """A model from documents with a non-null language: at most ``sample`` of each, and no more once they have ``sample_bytes`` bytes.

    A bound on the hash, from the number of documents of a language, leaves about four times ``sample`` of them, so
    that what is ranked does not grow with the table or its number of tasks.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id), F.xxhash64(F.col(text))).alias("__hash"), F.col(text).alias("text"))
    # A row per language, as the model has; as literals they filter in the scan, and no text is shuffled for them.
    bounds = {r.lang: int(4 * sample * _HASHES / r.n) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect() if r.n > 4 * sample}
    place = F.pmod("__hash", F.lit(_HASHES))
    few = usable
    if bounds:
        bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
        few = usable.where(bound.isNull() | (place < bound))
    least = Window.partitionBy("lang").orderBy(place, "__hash")
    before = F.sum(F.octet_length("text").cast("long")).over(least.rowsBetween(Window.unboundedPreceding, -1))
    ranked = few.select("lang", "text", F.row_number().over(least).alias("__place"), F.coalesce(before, F.lit(0)).alias("__before"))
    chosen = ranked.where((F.col("__place") <= sample) & (F.col("__before") < sample_bytes)).select("lang", "text")
    counted = chosen.mapInArrow(_count_strings(order), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    folder = new_folder(labelled.sparkSession, "langid-model")
    counts = written(counted.sortWithinPartitions("lang", "code"), folder)
    return Model(sorted(r.lang for r in counts.select("lang").distinct().collect()), folder, order)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only the text is looked at."""
    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in parts:
                names, scores = model.predict(list(texts))
                yield pd.DataFrame({"lang_pred": names, "score": scores})
        finally:  # a worker outlives the task, and other operators need its memory
            model.forget()
            give_back()

    df = docs.drop("lang_pred", "score").withColumn("__said", predict(F.col(text)))
    return df.select(*[c for c in df.columns if c != "__said"], F.col("__said.lang_pred"), F.col("__said.score"))
