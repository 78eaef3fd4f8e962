"""Hash trees, batches by jumps and reverse search against plain versions."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from agora.operators import batching, follows, snapshots


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, body string, extra int")


def test_trees_depend_on_rows_alone(spark):
    rng = random.Random(1)
    rows = [(f"k{i}", None if i % 50 == 3 else f"text {rng.random()}", 0) for i in range(700)] + [("k1", "again", 1), ("k2", "", 1), (None, "x", 0), ("k5", "twice", 0), ("k5", "twice", 0)]
    root = lambda r, n: tuple(snapshots.root(snapshots.tree(docs(spark, r).repartition(n), "id", "body")).first())
    one = root(rows, 1)
    assert one == root(rng.sample(rows, len(rows)), 7) and one[1] == len(rows)
    assert one[0] != root(rows[:-1], 2)[0] and one[0] != root([("k2", None, 1) if r == ("k2", "", 1) else r for r in rows], 2)[0]
    assert root([], 1)[1] == 0 and root([(None, None, 1)], 1)[0] != root([], 1)[0]
    assert snapshots.levels_for(0) == 0 and snapshots.levels_for(16) == 0 and snapshots.levels_for(17) == 1 and snapshots.levels_for(4097) == 3


def test_differences_are_found_from_the_root(spark):
    rows = [(f"k{i}", f"t{i}", 0) for i in range(900)]
    later = [(k, "new" if k in ("k7", "k500") else t, 0) for k, t, _ in rows if k != "k30"] + [("k9999", "x", 0)]
    one, two = (snapshots.tree(docs(spark, r), "id", "body", levels=3) for r in (rows, later))
    assert one.groupBy("level").agg(F.sum("n")).distinct().count() == 4
    nodes = snapshots.differing(one, two)
    found = {r.level: r.n for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert found[0] == 1 and found[3] == 4
    assert {"k7", "k500", "k30"} <= {r.id for r in snapshots.in_leaves(docs(spark, rows), "id", nodes).collect()}
    assert {"k9999"} <= {r.id for r in snapshots.in_leaves(docs(spark, later), "id", nodes).collect()}
    assert snapshots.differing(one, one).count() == 0 and snapshots.in_leaves(docs(spark, rows), "id", snapshots.differing(one, one)).count() == 0


def plain_batches(sizes, budget):
    out, used, batch = [], 0, -1
    for s in sizes:
        if batch < 0 or used + s > budget:
            used, batch = 0, batch + 1
        used += s
        out.append(batch)
    return out


def plain_fitting(sizes, budget, most):
    kept, used = [], 0
    for i, s in enumerate(sizes):
        if len(kept) < most and used + s <= budget:
            kept.append(i)
            used += s
    return kept


def test_batches_equal_a_fold(spark):
    rng = random.Random(2)
    keys = {"hot": [rng.randrange(0, 30) for _ in range(3000)], "zero": [0] * 9, "full": [50] * 5, None: [1, 49, 1, 50, 0, 0, 20], "one": [50]}
    rows = [(k, i * 3, s, "x") for k, sizes in keys.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, o int, s int, batch string")
    got = {(r.k, r.o): r.batch for r in batching.batched(df, "k", "o", "s", 50).collect()}
    assert got == {(k, i * 3): b for k, sizes in keys.items() for i, b in enumerate(plain_batches(sizes, 50))}
    kept = batching.fitting(df, "k", "o", "s", 50, 4)
    assert sorted(map(repr, ((r.k, r.o) for r in kept.collect()))) == sorted(map(repr, ((k, i * 3) for k, sizes in keys.items() for i in plain_fitting(sizes, 50, 4)))) and kept.columns == df.columns
    assert batching.batched(df.limit(0), "k", "o", "s", 50).count() == 0 and batching.fitting(df.limit(0), "k", "o", "s", 50, 3).count() == 0
    with pytest.raises(PySparkException):
        batching.batched(df, "k", "o", "s", 49).collect()


def test_follows_equal_a_comparison_of_all(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice("pqr"), str(min(9, int(rng.expovariate(0.5))))) for _ in range(rng.randrange(0, n))]
    stored = [(i, f"u{i % 7}", some(4)) for i in range(120)] + [(500, "u", None), (501, "u", [("p", None)]), (502, "u", [("p", "1"), ("p", "1")])]
    seen = [(i, some(6)) for i in range(60)] + [(100, None), (101, [])]
    marks = "array<struct<kind: string, value: string>>"
    indexed = follows.index(spark.createDataFrame(stored, f"follow int, follower string, marks {marks}"))
    got = sorted(tuple(r) for r in follows.matches(spark.createDataFrame(seen, f"activity int, marks {marks}"), indexed).collect())
    whole = lambda ms: {m for m in ms or [] if m[1] is not None}
    assert got == sorted((a, f, who) for f, who, need in stored for a, has in seen if whole(need) and whole(need) <= whole(has)) and len(got) > 100
    assert indexed.count() == sum(bool(whole(need)) for _, _, need in stored)


def test_equal_follows_are_compared_once(spark):
    """An activity meets each different condition once: comparisons do not grow with the number of follows that share them."""
    marks = "array<struct<kind: string, value: string>>"
    need = [[("n", "1"), ("t", "a")], [("t", "a"), ("n", "1"), ("n", "1")], [("n", "1"), ("t", "b")], [("n", "1:1"), ("t", "b")]]
    indexed = follows.index(spark.createDataFrame([(i, "u", need[i % 4]) for i in range(200)], f"follow int, follower string, marks {marks}"))
    assert indexed.select("condition").distinct().count() == 3 and indexed.count() == 200
    seen = spark.createDataFrame([(1, [("n", "1"), ("t", "a"), ("x", "y")])], f"activity int, marks {marks}")
    assert sorted(r.follow for r in follows.matches(seen, indexed).collect()) == [i for i in range(200) if i % 4 < 2]
