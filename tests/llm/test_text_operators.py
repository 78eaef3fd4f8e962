"""Quality rules, mixing, language ID and SimHash against SQL or brute force."""

import itertools
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from agora.llm import langid, mixing, quality, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, `__words` int"
LONG = "the cat and a dog " * 300
ROWS = [
    (1, "The house and the garden were of a kind with the street in town", "en", "s1", 1, "x", "y", 7),
    (1, "The house and the garden were of a kind with the street in town", "en", "s1", 1, "x", "y", 7),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "s1", 0, None, None, None),
    (4, LONG, "en", "s2", 5, None, None, 1),
    (None, "Der Hund und die Katze sind in dem Haus und nicht auf der Wiese", "de", None, 1, None, None, None),
    (6, "a\nb c\n\n a\nb c\nb c\n#$ * x | y", "en", "s3", 1, None, None, None),
    (7, "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w6 w7 w1 w2 w3 w4 w5", "en", "s3", 1, None, None, None),
    (8, " \t\n ", "fr", "s3", 1, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def pandas(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").toPandas()


def test_quality_equals_sql(spark, docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    documents = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").toPandas()  # noqa: F841  DuckDB reads it
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({queries.OP1_SQL})").fetchall()
    got = quality.judge(docs).where("doc_id IS NOT NULL").select(*columns).distinct().collect()
    assert sorted(map(tuple, got)) == sorted(want)
    judged = quality.judge(docs)
    assert judged.count() == len(ROWS) and [r[0] for r in judged.where("doc_id = 1").select("__words").collect()] != []
    assert quality.judge(docs.limit(0)).count() == 0
    assert judged.where("kept AND n_words > 5").count() >= 2  # a filter on a measure neither fails nor takes for ever


def test_stretches_that_share_a_hash_are_told_apart_by_their_words(spark, docs):
    words = docs.where("doc_id IS NOT NULL").withColumn("__words", quality.word_list(F.col("text")))
    n = lambda **kw: sorted((r.doc_id, r.n_repeat_words) for r in quality._repeat_words(words, 5, **kw).collect())
    assert n(key=lambda *w: F.lit(1).cast("bigint")) == n() == n(key=lambda *w: F.length(w[0]).cast("bigint"))


def test_rates_equal_plain_bisection(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(z), int(n), goal) for s, goal in (("a", 0.4), ("b", 1.7), ("c", 1.0), (None, 1.2)) for z, n in zip(rng.choice(400, 30, replace=False), rng.integers(1, 50, 30))]
    whole = {s: sum(z * n for t, z, n, _ in rows if t == s) for s in {r[0] for r in rows}}
    table = spark.createDataFrame([(s, z, n, whole[s], goal * whole[s]) for s, z, n, goal in rows], "source string, size bigint, n bigint, source_size bigint, target double")
    got = {(r.source, r.size): r.rate for r in mixing.rates(table).collect()}
    for source, total in whole.items():
        own = [(z, n, goal) for s, z, n, goal in rows if s == source]
        mean, goal, low, high = total / sum(n for _, n, _ in own), own[0][2] * total, -60.0, 60.0
        rate = lambda z, x: min(2.0, float(np.exp(min(50.0, x * z / mean))))
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(n * z * rate(z, middle) for z, n, _ in own) < goal else (low, middle)
        assert all(abs(got[source, z] - rate(z, low)) < 1e-6 for z, _, _ in own)


def test_mix_of_very_long_texts(spark):
    rows = [(k, "word " * (200_000 if k == 0 else 10), "a" if k < 30 else "b") for k in range(60)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(mixed) == 60 and all(0 <= r.taken <= 2 * r.size for r in mixed) and max(r.size for r in mixed) == 200_000


def test_mix_meets_targets_and_caps(spark, docs):
    many = spark.range(9000).select("id", F.lit("one two three four five").alias("text"), F.lit("hot").alias("source"))
    rest = spark.range(9000, 12000).select("id", F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 90).cast("int")), " ").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    table = many.union(rest).withColumnRenamed("id", "doc_id")
    mixed = mixing.mix(table, block_rows=500)
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(rows) == 12000 and all(0 <= r.taken <= 2 * r.size for r in rows)
    totals = {}
    for r in rows:
        totals.setdefault(r.source, [r.source_size, r.target, 0, 0])
        totals[r.source][2] += r.taken
        totals[r.source][3] += r.size
    # hot, s0, s1, s2, s3 weigh 3, 1, 2, 3, 1
    goal, weights, caps = 1.5 * sum(t[0] for t in totals.values()), dict(zip(sorted(totals), (3, 1, 2, 3, 1))), {s: 2 * t[0] for s, t in totals.items()}
    full = set()
    while True:
        level = (goal - sum(caps[s] for s in full)) / max(1e-9, sum(w for s, w in weights.items() if s not in full))
        over = {s for s in totals if s not in full and weights[s] * level > caps[s]}
        if not over:
            break
        full |= over
    for s, (own, target, taken, total) in totals.items():
        assert own == total and abs(target - (caps[s] if s in full else weights[s] * level)) < 1e-6 * goal
        assert abs(taken - target) <= 100
    again = {(r.doc_id, r.taken) for r in mixing.mix(table.orderBy(F.rand(3)), block_rows=500).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    odd = mixing.mix(docs)
    assert odd.count() == len(ROWS) and odd.where("doc_id = 2").first().size == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.copied(odd).count() == odd.agg(F.sum("copies")).first()[0]


def test_language_on_held_out_documents(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = queries.op10_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(table.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'")
    n, right = said.agg(F.count("*"), F.count_if(F.expr("lang = lang_pred"))).first()
    assert n > 150 and right / n > 0.97
    model = langid.train(table)
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(rows) == 8 and (rows[2].lang_pred, rows[2].score) == ("und", 0.0) and rows[8].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(docs.limit(0), langid.train(table.limit(0))).count() == 0
    assert langid.Model([]).predict(["abc"]) == (["und"], [0.0])
    texts = ["²½ ①", "12 _ 34", "ª", "ʰ", None, ""]
    assert [name != "und" for name in model.predict(texts)[0]] == [False, False, True, True, False, False]


def plain_bits(grams, text, order):
    """Code length of a text by the method read plainly; ``grams`` are the strings of order + 1 bytes of the training text."""
    padded, total = bytes(order) + text, 0.0
    for i in range(len(text)):
        own, p = padded[i : i + order + 1], 1 / 256
        for k in range(order + 1):
            context = own[order - k : order]
            seen = [g[-1] for g in grams if g[order - k : order] == context]
            if seen:
                kinds = len(set(seen))
                p = seen.count(own[-1]) / (len(seen) + kinds) if own[-1] in seen else kinds / (len(seen) + kinds) * p
        total -= np.log2(p)
    return total


def test_code_lengths_equal_a_plain_reading_of_the_method(spark, monkeypatch):
    monkeypatch.setattr(langid, "GROUP", 2)
    monkeypatch.setattr(langid, "KEPT", 1)
    monkeypatch.setattr(langid, "MERGED", 9)
    learned = {"a": "abracadabra abracadabra", "b": "the cat sat on the mat", "c": "éàü ñandú, él también"}
    rows = [(k, text, lang) for k, (lang, text) in enumerate(learned.items())]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    asked = ["cabqarda", "the cab", "también ñ", "zzz", "a" * 40, "mat on the cat " * 9]
    for part in (langid.PART, 7):
        monkeypatch.setattr(langid, "PART", part)
        bits = model.bits([t.encode() for t in asked])
        for k, lang in enumerate(model.languages):
            data = bytes(4) + learned[lang].encode()
            grams = [data[i : i + 5] for i in range(len(data) - 4)]
            assert all(abs(bits[j, k] - plain_bits(grams, t.encode(), 4)) < 1e-2 for j, t in enumerate(asked))
    names = model.predict(asked)[0]
    assert names == [model.languages[int(np.argmin(b))] for b in bits] and names[:3] == ["a", "b", "c"]


def test_a_language_is_learned_from_bounded_bytes(spark):
    rows = [(k, chr(97 + k) * 30, lang) for k, lang in enumerate("xxxyy")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = lambda **kw: {(r.lang, r.letter): r.n for r in spark.read.parquet(langid.train(table, **kw).folder).groupBy("lang", (F.col("code") % 256).alias("letter")).agg(F.sum("n").alias("n")).collect()}
    assert sum(learned().values()) == 150 and len(learned()) == 5
    for bytes_, docs in ((1, 1), (30, 1), (31, 2)):
        got = learned(sample_bytes=bytes_)
        assert sorted(sum(lang == own for lang, _ in got) for own in "xy") == [docs, docs] and set(got.values()) == {30}


def brute_fingerprint(text, k=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = {i: i for i, _ in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, f), (j, g) in itertools.combinations(prints, 2):
        if (f ^ g).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i, _ in prints}


def test_simhash_equals_brute_force(spark):
    table = pandas(spark, "documents")
    prints = [(int(r.doc_id), brute_fingerprint(r.text)) for r in table.itertuples()]
    want = {(i, f"{dict(prints)[i]:016x}", c) for i, c in brute_components(prints, 3).items()}
    assert {tuple(r) for r in queries.op8_simhash_groups(spark, SF).collect()} == want


@pytest.mark.parametrize("parts,radius", [(1, 3), (2, 3), (4, 4), (1, 14)])
def test_tiles_lose_no_link(spark, monkeypatch, parts, radius):
    rng = np.random.default_rng(parts)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in np.repeat(base, 8)})
    monkeypatch.setattr(simhash, "_parts_for", lambda n: parts)
    rows = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    distinct = spark.createDataFrame(rows, "id bigint").select("id", F.array("id").alias("lanes"), F.lit(9).cast("bigint").alias("shingles"))
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(distinct, 1, radius, tile=16).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in links)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {v: root(v) for v in values} == brute_components([(v, v) for v in values], radius)


def test_a_wide_radius_has_few_moves_on_any_number_of_fingerprints(spark, monkeypatch):
    asked, steps = [], simhash._steps
    monkeypatch.setattr(simhash, "_parts_for", lambda n: 2)
    monkeypatch.setattr(simhash, "_steps", lambda parts, radius: asked.append(len(steps(parts, radius))) or steps(parts, radius))
    rows = [(k, [(1 << k) - 1, 0, 0, 0], 9) for k in (0, 9, 40, 60)] + [(5, [0, 0, 0, -1], 9)]
    distinct = spark.createDataFrame(rows, "id bigint, lanes array<bigint>, shingles bigint")
    found = {frozenset((r.a, r.b)) for r in simhash.links(distinct, 4, 52, length_ratio=0.8).collect()}
    assert asked == [3] and {frozenset(p) for p in ((0, 9), (0, 40), (60, 9), (60, 40))} & found and not any(5 in p for p in found)


def test_several_lanes_group_as_brute_force(spark):
    texts = [f"{a} {b} {c} {d}" for a in "xy" for b in "pq" for c in "mn" for d in "rs"] * 2 + ["", None]
    rows = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), lanes=2, radius=40).collect()
    lanes = {r.doc_id: sum((v % (1 << 64)) << 64 * k for k, v in enumerate(r.lanes)) for r in rows}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(sorted(lanes.items()), 40)


def test_simhash_edge_cases(spark, docs):
    rows = simhash.near_duplicates(docs).select("doc_id", "component_id", "n_chars", "kept").collect()
    assert len(rows) == len(ROWS) and {r.component_id for r in rows if r.doc_id in (2, 3, 8)} == {2}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "4", "None", "6", "7"])


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    text = lambda: [f"w{k}" for k in rng.integers(0, 5000, 300)]
    originals = [text() for _ in range(60)]
    copies = [[*o[:100], "changed", *o[101:]] for o in originals[:20]]
    rows = [(i, " ".join(t)) for i, t in enumerate([*originals, *copies])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def shingles_of(text, k=5):
    words = [w.lower() for w in WORD.findall(text)]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def test_near_copies_are_checked_exactly(spark):
    """Groups by brute force over the shingles: estimates below 0.8, also of pairs in a large group, link nothing."""
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 9000, n)]
    passage, texts = word(200), []
    texts += [passage + word(60) for _ in range(120)]  # Jaccard 0.62 of each two
    for _ in range(30):
        own = word(200)
        texts += [own, [*own[: 200 - n], *word(n)] if (n := int(rng.integers(5, 50))) else own]
    texts += [["same"] * 4000 + word(9), ["same"] * 4000 + word(9), ["same"] * 4000 + word(9)]  # equal fingerprints before
    texts = [" ".join(t) for t in texts]
    sets = [shingles_of(t) for t in texts]
    first = list(range(len(sets)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            first[b] = a
    want = sorted({root(i) for i in range(len(sets))})
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == want and 150 < len(want) < len(texts)


def test_pairs_at_the_least_similarity_are_found_whatever_the_size_of_their_sets(spark):
    """Pairs of Jaccard similarity 0.8 or just above, by the number of shingles of the smaller set."""
    rng = np.random.default_rng(8)
    rows, pairs, k = [], {}, 0
    for size in (4, 5, 8, 9, 12, 16, 17, 24, 25, 40, 80):
        for _ in range(60):
            # The longer text goes on for as many words as keep the similarity.
            words = [f"w{rng.integers(1 << 40)}" for _ in range(size + 4 + size // 4)]
            pairs.setdefault(size, []).append((k, k + 1))
            rows += [(k, " ".join(words[: size + 4])), (k + 1, " ".join(words))]
            k += 2
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id").collect()}
    found = {size: sum(b not in kept for _, b in some) / len(some) for size, some in pairs.items()}
    assert all(a in kept for some in pairs.values() for a, _ in some)
    assert min(found.values()) >= 0.95 and all(found[s] == 1 for s in found if s <= 24), found
