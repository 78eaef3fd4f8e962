"""Token files, packing and counts against the tokenizers library, and the pipeline over them."""

import struct
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agora.llm import packing, queries, token_counts, token_files
from agora.llm.shared import join_spread, new_folder
from agora.llm.tokens import WordwiseEncoder, public_path

SF = "/root/testdata/sf0.001"
NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {n: (WordwiseEncoder(public_path(n), kept=500), Tokenizer.from_file(public_path(n))) for n in NAMES}
ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb c", "a \n b", "it's don't", "x<|endoftext|> y", "<|startoftext|>\n0 1 2", "É  é\tñ\u00a0b", "a\r\nb", "0 0 00\n0", "İ Σας ΑΣ", "e\u0301 \u0301x", "日本 語\u3000x", "a\x1cb c", "\U0001f600 ok"]
TEXTS = [(1, "hello world, it's"), (2, None), (3, ""), (4, "word " * 3000), (None, "no id"), (6, "same"), (6, "same"), (7, "a <|endoftext|> b\n\nc")]


def ids_of(name, text, end=None):
    ids = ENCODERS[name][1].encode(text or "", add_special_tokens=False).ids
    return ids + ([] if end is None else [end])


def check(name, text):
    own, library = ENCODERS[name]
    assert list(struct.unpack(f"<{len(own(text)) // 4}I", own(text))) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_wordwise_ids_on_odd_texts(name):
    for text in [*ODD, *(a + b for a in ODD for b in ODD)]:
        check(name, text)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(NAMES), st.text(st.sampled_from("ab'st09 \n\t\r.,é\u00a0\u0301ßΣ<|>日\x1c\x85"), max_size=40))
def test_wordwise_ids_are_the_librarys(name, text):
    check(name, text)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id bigint, text string, ids string, length int")


def test_token_files_round_trip(spark, docs):
    folder = new_folder(spark, "t")
    token_files.write_token_files(docs, folder, public_path(NAMES[1]), 1, shard_bytes=200)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(((i, struct.pack(f"<{len(x)}I", *x)) for i, t in TEXTS for x in [ids_of(NAMES[1], t, 1)]), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r.id, bytes(r.ids)) for r in rows] == want
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    few = token_files.fetch_documents(spark, folder, spark.createDataFrame([(4,), (7,), (99,)], "id bigint")).collect()
    assert {(r.id, bytes(r.ids)) for r in few} == {x for x in want if x[0] in (4, 7)}
    empty = new_folder(spark, "t")
    token_files.write_token_files(docs.limit(0), empty, public_path(NAMES[1]), 1)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_query_and_dictionary(spark):
    rows = sorted(queries.op2_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at = 0
    for r in rows:
        ids = ids_of(NAMES[1], texts[r.doc_id], 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(rows) == len(texts)


def test_shards_are_of_bounded_size_and_single_runs(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("id") % 50 + 1), lambda i: F.hex(F.xxhash64("id", i))), " ").alias("text"))
    folder = new_folder(spark, "t")
    shards = token_files.write_token_files(docs, folder, public_path(NAMES[1]), 1, shard_bytes=200_000).collect()
    assert len(shards) > 5 and max(s.n_bytes for s in shards) < 3 * 200_000
    rows = token_files.read_token_files(spark, folder)
    assert rows.count() == 3000 and rows.agg(F.sum("n_tokens")).first()[0] == sum(s.n_tokens for s in shards)


def held(rows, lengths, capacity):
    """Every document whole, sequences gapless and within capacity; returns how many there are."""
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for key, n in lengths.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(pieces[key])):
            assert (piece, start) == (k, at) and (k == 0 or length == capacity)
            at += length
        assert at == n
    return len(places)


def test_packing_is_whole_and_tight(spark, docs):
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    lengths = {r.doc_id: len(ids_of(NAMES[0], r.text, 2)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = held(rows, lengths, 1024)
    assert n <= 1.02 * -(-sum(lengths.values()) // 1024) + 1
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        ids = ids_of(NAMES[0], texts[r.doc_id], 2)[r.start : r.start + r.length]
        assert r.ids_crc32 == crc32(struct.pack(f"<{len(ids)}I", *ids))
    twice = packing.pack(docs.where("doc_id = 6").union(docs.where("doc_id = 6")), public_path(NAMES[0]), 2, capacity=5).collect()
    assert len(twice) == 4 and len({(r.sequence_id, r.offset) for r in twice}) == 4
    odd = packing.pack(docs.where("doc_id IS NULL OR doc_id <> 6"), public_path(NAMES[0]), 2, capacity=100, with_ids=True)
    held(odd.collect(), {i: len(ids_of(NAMES[0], t, 2)) for i, t in TEXTS if i != 6}, 100)
    assert packing.sequences(odd).where("length > 100 OR octet_length(ids) <> 4 * length").count() == 0
    assert packing.pack(docs.limit(0), public_path(NAMES[0]), 2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=120))
def test_bins_hold_every_piece_once(lengths):
    kinds = packing.bins(Counter(lengths), 60)
    packed = Counter()
    for often, own in kinds:
        assert often > 0 and sum(length * k for length, k in own.items()) <= 60
        packed.update({length: often * k for length, k in own.items()})
    assert packed == Counter(lengths)


def test_two_small_pieces_replace_one():
    # Greedily 6 + 3 leaves 1 of 10; the two pieces of 2 fit the gap of 4 in place of the 3.
    assert (1, {6: 1, 2: 2}) in packing.bins({6: 1, 3: 1, 2: 2}, 10)


def test_counts_come_from_the_cache(spark, docs):
    cache, path = new_folder(spark, "c"), public_path(NAMES[0])
    rows = token_counts.count_tokens(docs, cache, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == Counter((i, len((t or "").encode()), len(ids_of(NAMES[0], t))) for i, t in TEXTS)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in TEXTS})
    token_counts.count_tokens(docs, cache, path)
    assert spark.read.schema(token_counts.CACHE).parquet(cache).count() == len({t or "" for _, t in TEXTS})
    assert token_counts.count_tokens(docs.limit(0), new_folder(spark, "c"), path).count() == 0


def test_counts_query_and_a_text_that_most_documents_have(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, len(t.encode()), n := len(ids_of(NAMES[0], t)), n > 1024) for i, t in texts.items()}
    assert {tuple(r) for r in queries.op4_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()} == want
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot text").otherwise(F.hex("id")).alias("text"))
    got = token_counts.count_tokens(many, new_folder(spark, "c"), public_path(NAMES[0])).collect()
    assert len({r.doc_id for r in got}) == len(got) == 4000
    assert all(r.n_tokens == len(ids_of(NAMES[0], r.text)) for r in got)


def test_joined_rows_are_each_there_once_whatever_the_skew(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).cast("bigint").alias("key"))
    found = spark.createDataFrame([(7, "hot"), (None, "none"), (9, "nine")], "key bigint, value string")
    got = {r.id: r.value for r in join_spread(rows, found, ["key"], [F.col("id")]).collect()}
    assert len(got) == 6000 and all(v == ("hot" if i % 2 == 0 else "none" if i % 7 == 0 else "nine" if i == 9 else None) for i, v in got.items())
    assert join_spread(rows.limit(0), found, ["key"], [F.col("id")]).count() == 0


def test_pipeline_keeps_columns_of_any_name_and_takes_odd_rows(spark):
    import corpus_pipeline

    text = "the house and the garden of our town were in a street with a view over the hills, but no one had seen them before"
    names = "score lang_pred kept n_words size target taken copies rate lanes component_id".split()
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, text.replace("house", "barn"), "en", None), (None, text.replace("street", "lane"), "en", "b"), (5, "12 34", "en", "b")]
    docs = spark.createDataFrame([(*r, *[f"{n}-{r[0]}" for n in names]) for r in rows], "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for some in (docs, docs.limit(0)):
        out = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns
            assert all(getattr(r, n) == f"{n}-{r.doc_id}" for r in out.collect() for n in names)
        left = {r.doc_id for r in out.collect()}
        assert left <= {1, 4, None} and (bool(left) or some is not docs)
        assert corpus_pipeline.pack(spark, out, SF).count() == out.count()


def test_pipeline_stages(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    good = stages["quality_rules"](spark, kept, SF)
    verdicts = {r.doc_id for r in queries.op1_quality_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdicts
    single = stages["near_duplicates"](spark, good, SF)
    assert single.select("text").distinct().count() == single.count() >= 0.9 * good.select("text").distinct().count()
    mixed = stages["source_mix"](spark, single, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 2").isEmpty()
    packed = stages["best_fit_packing"](spark, mixed, SF)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
