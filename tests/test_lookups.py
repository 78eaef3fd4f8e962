"""Look-ups, inserts, archives, contracts and windows on nulls, repeats and empty tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from agora.functions import contracts, gates
from agora.operators import merges, proofs, relations
from agora.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_composite_keys_are_null_safe(spark):
    held = spark.createDataFrame([(1, "a", 5), (1, None, 6), (2, "a", 7), (1, "a", 8)], "x int, y string, z int")
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (3, "a")], "x int, y string")
    assert rows(relations.looked_up(held, asked, ["x", "y"])) == [(1, "a", 5), (1, "a", 8), (1, None, 6)]
    assert relations.looked_up(held, asked.limit(0), ["x", "y"]).count() == 0
    new = spark.createDataFrame([(1, None), (4, "b"), (4, "b"), (None, None)], "x int, y string")
    assert rows(merges.inserted(held, new, ["x", "y"])) == [(4, "b"), (None, None)]


def test_voters_by_identifier(spark):
    votes = spark.createDataFrame([(1, 1, "n", "a", "A", "yes"), (1, 1, "n", "b", "B", "no"), (1, 1, "n", None, "C", "no"), (1, 2, "n", "a", "A", "yes")], "bill int, session int, namespace string, value string, name string, vote string")
    known = spark.createDataFrame([("n", "a", "p1"), ("n", "a", "p1"), ("n", "b", "p2"), ("n", "b", "p3"), ("m", "a", "p9")], "namespace string, value string, person string")
    got = relations.voters(votes, known, spark.createDataFrame([(1, 1), (1, 1)], "bill int, session int"))
    assert rows(got.select("name", "person", "how")) == [("A", "p1", "identifier"), ("B", None, "conflict"), ("C", None, "unknown")]


def test_archives_and_refetches(spark):
    old = spark.createDataFrame([(1, "a", 2), (2, None, 1), (3, "c", 5)], "k int, c string, version int")
    new = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k int, c string")
    assert rows(merges.archived(old, new, "k", "c")) == [(1, "a", 2, True), (1, "b", 3, False), (4, "d", 1, False)]
    t = lambda d: datetime.datetime(2024, 1, d)
    children = spark.createDataFrame([(s, t(d)) for s in (1, 2, 3) for d in (1, 5)], "source int, changed_at timestamp")
    runs = spark.createDataFrame([(1, t(3), True), (1, t(9), True), (2, t(3), False), (3, t(3), True)], "source int, started timestamp, complete boolean")
    got = merges.refetched(children, runs, F.lit(t(7)), F.col("source") == 3)
    assert [(r.source, r.changed_at.day, r.why) for r in sorted(got.collect())] == [(1, 5, "changed"), (2, 1, "never complete"), (2, 5, "never complete"), (3, 1, "reconciliation"), (3, 5, "reconciliation")]


def test_contracts_say_what_they_skip(spark):
    fields = {"title": "T", "date": "D", "vote": "V", "person": "P", "stage": "S"}
    made = contracts.Contract("s", "bill", True, fields, {"x": "passed"}, {"y": "yes"}, "N", limit=3, cursor="k1")
    row = lambda k, **f: (k, f)
    data = [row("k1", T="a", D="2024-01-01"), row("k2", T=" b ", D="2024-01-02", V="y", P="7", S="x"), row("k3", T=" ", D="2024-01-02"), row("k4", T="c", D="soon", V="z"), row("k5", T="d", D="2024-01-02")]
    df = spark.createDataFrame(data, "record_key string, fields map<string, string>")
    got = contracts.projected(contracts.page(df, "record_key", made), "record_key", made)
    assert rows(got.select("record_key", "title", "stage", "vote", "person", "skipped")) == [("k2", "b", "passed", "yes", "N:7", None), ("k3", None, "unknown", None, None, "no title"), ("k4", "c", "unknown", "unknown", None, "no date")]
    assert rows(contracts.outcome(got, "record_key", made)) == [(1, 2, "k4")]
    with pytest.raises(ValueError):
        contracts.projected(df, "record_key", contracts.Contract("s", "bill", False, fields, namespace="N"))
    for change in ({"fields": {"title": "T"}}, {"namespace": None}, {"limit": 0}):
        with pytest.raises(ValueError):
            contracts.Contract(**{"source": "s", "kind": "bill", "verified": True, "fields": fields, "namespace": "N"} | change)


def test_windows_that_only_together_hold_all_words(spark):
    rng = random.Random(3)
    units = [(d, i, rng.choice([None, "", *(" ".join(rng.choice(["aa", "bb", "b", "cc", "x"]) for _ in range(rng.randrange(1, 4))) for _ in range(4))])) for d in range(12) for i in range(6)]
    wanted = [["aa"], ["bb", "b"], ["cc"]]
    want = []
    for d in range(12):
        texts = [t or "" for e, _, t in units if e == d]
        for width in (2, 3):
            for i in range(6 - width + 1):
                whole = " ".join(texts[i : i + width])
                spans = [min(((whole.index(w), whole.index(w) + len(w)) for w in ws if w in whole), default=None) for ws in wanted]
                if None not in spans:
                    start, end = min(s for s, _ in spans), max(e for _, e in spans)
                    if start < len(texts[i]) and end > len(" ".join(texts[i : i + width - 1])) + 1:
                        want.append((d, i, width, start, end))
    got = proofs.spanning(spark.createDataFrame(units, "doc int, place int, text string"), ["doc"], "place", wanted)
    assert rows(got) == sorted(want, key=repr) and len(want) > 10


def test_a_csv_with_a_schema_is_the_same(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,note\n1,"a ""b"", c"\n2,\n', encoding="utf-8")
    assert rows(files.read_csv(spark, str(tmp_path))) == [("1", 'a "b", c'), ("2", "")] == rows(files.read_csv(spark, str(tmp_path), ["id", "note"]))


def test_own_gates(spark):
    own = (gates.Gate("loud", "!", excuse="quote"), gates.Gate("bare", "claim", proof="proof", facet="f"))
    df = spark.createDataFrame([("a!", None, None), ("quote!", "x", "f"), ("claim", "proof", "f"), ("claim!", "x", "f"), (None, "x", "f"), ("claim", None, None)], "c string, p string, f string")
    got = [r[0] for r in df.select(gates.held_back(F.col("c"), F.col("p"), F.col("f"), own)).collect()]
    assert got == [["loud"], [], [], ["loud", "bare"], ["invalid_claim"], []]
    assert [r[0] for r in spark.createDataFrame([("E5",), (None,), ("XE5",)], "c string").select(gates.leaks(F.lit(None).cast("string"), F.col("c"))).collect()] == [["internal_member_alias"], [], []]


def test_inventories_do_not_read_payloads(spark, capsys):
    from agora.plans import QUERIES

    QUERIES["inventory_with_payload"](spark, "/root/testdata/sf0.001").select("doc_id", "n_chars").explain()
    assert "text:string" not in capsys.readouterr().out
