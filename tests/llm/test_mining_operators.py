"""Whitening, collocations and license scans against plain versions."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import collocations, licenses, queries, whitening

SF = "/root/testdata/sf0.001"


def exact_fit(rows):
    """n, sums and the exact scatter of integer rows."""
    n, d = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(d)]
    return n, sums, [[n * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("bits", [5, 19, 31, 60])
def test_scatter_and_deviations_are_exact_at_any_size(bits):
    rng = random.Random(bits)
    rows = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(9000)]
    whole = whitening.Scatter(3)
    for start in range(0, 9000, 3500):
        whole.add(np.array(rows[start : start + 3500], dtype=np.int64))
    got = np.zeros((3, 4), dtype=object)
    for i, k, values in whole.rows():
        assert np.abs(values).max() < 1 << 41
        got[i] += values.astype(object) << (whitening.DIGIT * k)
    assert whole.n == 9000
    assert got.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] + [sum(r[i] for r in rows)] for i in range(3)]
    assert whitening.deviations(np.array(rows[:50], dtype=np.int64)) == [sum(v * v for v in r) for r in rows[:50]]


def test_whitening_equals_a_plain_fit(spark):
    got = queries.op11_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = {r.vec_id: [int(np.floor(1024 * np.float64(c))) + 100_000 for c in r.embedding] for r in table}
    n, sums, m = exact_fit(list(rows.values()))
    v = np.array([[float(Fraction(x, n * n)) for x in r] for r in m])
    spread, axes = np.linalg.eigh(v)
    spread, axes = spread[::-1], axes[:, ::-1]
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        k = r.component - 1
        want = (np.array(rows[r.vec_id]) - np.array(sums) / n) @ axes[:, k] / spread[k] ** 0.5
        sign = signs.setdefault(k, 1 if want * r.whitened > 0 else -1)
        assert abs(want * sign - r.whitened) < 1e-7 and abs(r.explained - spread[k] / np.trace(v)) < 1e-9
        assert r.deviation == sum((n * x - s) ** 2 for x, s in zip(rows[r.vec_id], sums))


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], 7, "a"), (1, [0.5, 1.0], 7, "a"), (None, [0.25, 1.0], 7, None), (3, None, 1, "b"), (4, [1.0, None], 1, "b"), (5, [nan, 1.0], 1, "b"),
            (6, [inf, 1.0], 1, "b"), (7, [], 1, "e"), (8, [3.0], 1, "one"), (9, [1e300, 0.0], 1, "far"), (10, [2.0, 1.0], 1, "c"), (11, [1.0, 2.0, 4e14], 1, "l"), (12, [2.0, 5.0, -4e14], 1, "l")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int, explained string")
    got = whitening.whiten(df, components=2)
    assert got.columns == ["vec_id", "embedding", *whitening.ADDED]
    found = [(r.vec_id, r.n, r.deviation, r.whitened, r.identity_error) for r in got.collect()]
    assert sorted(str(f[0]) for f in found) == ["1", "1", "10", "11", "12", "7", "8", "None"]
    two = [f for f in found if f[0] in (1, None, 10)]
    assert {f[1] for f in two} == {4} and all(f[3][1] is None and f[4] < 1e-9 for f in two)  # the second entry is constant
    one = next(f for f in found if f[0] == 8)
    assert one[1:] == (1, 0, [None], None)
    assert next(f for f in found if f[0] == 7)[1:] == (1, 0, [], None)
    far = [[int(np.floor(1024 * c)) + 100_000 for c in r[1]] for r in rows if r[0] in (11, 12)]
    n, sums, _ = exact_fit(far)
    assert {int(f[2]) for f in found if f[0] in (11, 12)} == {sum((n * x - s) ** 2 for x, s in zip(r, sums)) for r in far} and max(map(max, far)) > 1 << 58
    assert whitening.whiten(df.limit(0)).count() == 0
    flat = whitening.by_component(got.where("vec_id = 10"), "vec_id").collect()
    assert [(r.vec_id, r.component, r.n) for r in flat] == [(10, 1, 4), (10, 2, 4)]
    shifted = {(r.vec_id, r.deviation) for r in whitening.whiten(df, components=2, shift=-(10**12)).collect()}
    assert shifted == {(f[0], f[2]) for f in found}


LOWER = {i: i + 32 for i in range(65, 91)}


def plain_collocations(rows, longest, least, percent, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        kept = []
        frequent = [g for g, a in f.items() if len(g) > 1 and a >= least]
        for g in frequent:
            a = f[g]
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            around = max((f[h] for h in frequent if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))), default=0)
            if 100 * around < percent * a:
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts():
    rng = random.Random(5)
    vocabulary = ["der", "Der", "né", "日本", "x", "new", "york", "city", "of", "a b", "z\x1cq"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!?", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(0, 90)))) for _ in range(60)]
    return [*rows, ("en", None), ("en", ""), (None, " \t\n.,"), ("en", "New York City " * 40), ("en", "x" * 300), *[("de", "same text here same text here")] * 12]


@pytest.mark.parametrize("size, bits, longest", [(12 << 20, 27, 3), (70, 27, 3), (70, 8, 4)])
def test_collocations_equal_a_plain_count(spark, size, bits, longest):
    rows = texts()
    df = spark.createDataFrame([(t, lang, 1, "x", "y") for lang, t in rows], "text string, lang string, n int, phrase string, f string").repartition(3)
    got = collocations.collocations(df, longest=longest, least=4, top=25, size=size, bits=bits).collect()
    want = plain_collocations([(lang, t) for lang, t in rows], longest, 4, 50, 25)
    assert sorted(map(tuple, got)) == want and len(want) > 30


def test_collocations_of_nothing_and_of_a_very_long_text(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("one two three", "en")], "text string, lang string")).count() == 0
    words = [f"w{i % 701}" for i in range(200_000)]
    df = spark.createDataFrame([(" ".join(words), "en")], "text string, lang string")
    got = collocations.collocations(df, size=1 << 16)
    assert sorted(map(tuple, got.collect())) == plain_collocations([("en", " ".join(words))], 3, 10, 50, 2000)


def test_blocks_lose_and_repeat_nothing():
    text = b"aa bb cc dd ee\nff gg\nhh " + b"i" * 40 + b" jj kk ll"
    for size in (1, 5, 9, 16, 200):
        for n in (2, 3):
            found = Counter()
            for block, end in collocations.blocks(text, n, size):
                shard = collocations.Shard(block, end)
                places, numbers = shard.counts(shard.starts(n), n)
                spelt = [shard.spelt(places + k).to_pylist() for k in range(n)]
                found.update(dict(zip(map(" ".join, zip(*spelt)), numbers.tolist())))
            want = Counter(" ".join(w[i : i + n]) for p in text.decode().split("\n") for w in [p.split()] for i in range(len(w) - n + 1))
            assert found == want


def test_words_of_one_key_take_another_seed(spark, tmp_path):
    docs = spark.createDataFrame([("en", " ".join(f"w{i}" for i in range(300)))], "lang string, text string")
    words, _ = collocations.ngrams(docs, 2, 1, str(tmp_path), hashed=12)
    assert words.count() == words.select("w1").distinct().count() == 300 and len(list(tmp_path.glob("words-*"))) > 1


GPL = licenses.NOTICES[11].text


def license_texts():
    words = GPL.split()
    edited = words[:6] + ["quite"] + words[6:20] + words[21:]
    changed = [w if i not in (9, 22) else "blue" for i, w in enumerate(words)]
    half = words[: len(words) // 2]
    return [
        "Licensed under CC BY-NC 4.0.", "cc by cc-by\nCC.BY and MIT\tlicense", "gnu general public licenses", "GNU General  Public\x00License", "ünu mit License née", None, "", " \t.",
        " ".join(edited), "Copyright. " + " ".join(changed) + " mit", " ".join(half), " ".join(words).upper() + " and again " + " ".join(words), "x " * 6_000 + "Apache License", "cc by " * 3000,
        "MIT LİCENSE mit lKcense", "of the software the software to deal in the software", "MIT License", "MIT License",
        " ".join(w if i not in (9, 22) else "blue" for i, w in enumerate(licenses.NOTICES[15].text.split())),
    ]


def test_license_scan_equals_sql_on_edges(spark):
    rows = [(i if i != 5 else None, t, "x", "y") for i, t in enumerate(license_texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, labels string, `row` string")
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  DuckDB reads it
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    scanned = licenses.scan(df)
    assert scanned.columns == ["doc_id", "row", *licenses.ADDED]
    got = sorted((tuple(r) for r in scanned.select(*columns).collect()), key=repr)
    want = sorted(duckdb.sql(f"SELECT {', '.join(columns)} FROM ({queries.OP13_SQL})").fetchall(), key=repr)
    assert got == want
    by_id = {r[0]: r for r in got}
    assert by_id[0][2:7] == (1, 2, 2, "cc-by", "cc-by,cc-by-nc") and by_id[1][2:5] == (4, 0, 7) and by_id[2][2] == 0 and by_id[3][5] == "gpl"
    assert by_id[8][6] == by_id[9][6] == "gpl" and by_id[18][4:7] == (None, "", "mit") and 0.8 <= by_id[18][7] < 1 and by_id[10][6] == "" and by_id[11][2] == 2 and by_id[14][2] == 0
    assert by_id[13][2:5] == (3000, 0, 5998) and by_id[12][3] == 6_000 and by_id[15][6] == ""
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, templates=()).where("n_base > 0 OR labels <> ''").count() == 0
    own = (licenses.Template("own", "a notice of some ten words that nobody else has"), licenses.Template("one", "software"))
    assert licenses.scan(df.withColumn("text", F.lit("see A NOTICE of some ten, words that nobody has")), templates=own).select("labels").distinct().collect()[0][0] == "own"


def test_license_scan_of_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "of the software " * 100_000 + "MIT License")], "doc_id bigint, text string")
    assert [tuple(r) for r in licenses.scan(df).collect()] == [(1, 300_002, 1, 300_000, 300_000, "mit", "mit", 1.0)]


def plain_places(words, template):
    return [i for i in range(len(words)) if words[i : i + len(template)] == template]


def test_base_places_equal_a_plain_search(spark):
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d.text or "").translate(LOWER))
        found = {t.label: plain_places(words, t.text.split()) for t in licenses.BASE}
        every, r = sorted(sum(found.values(), [])), got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(every), *((every[0], every[-1]) if every else (None, None)))
        assert r.base_labels == ",".join(sorted(k for k, v in found.items() if v)) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
