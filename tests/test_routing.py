"""Components, routing and hierarchies against plain walks, on chains of any length and components of any size."""

import hashlib
import random
import time
from collections import Counter

import pytest

from agora.operators import graph, routing


def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "loops"])
def test_components_equal_a_union(spark, kind):
    rng = random.Random(6)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "star": [(50, i) for i in range(200)], "loops": [(1, 1), (2, 2), (2, 3), (3, 2), (3, 2)]}.get(kind)
    if kind == "chain":
        names = rng.sample(range(2000), 1500)
        edges = list(zip(names, names[1:]))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "source int, target int")).collect()}
    assert got == plain_components(edges)


def plain_routes(held, most=3, degree=50):
    often = Counter(a for s in held.values() for a in s)
    route = {k: {a for a in s if 1 < often[a] <= degree} for k, s in held.items()}
    by = {}
    for k, s in route.items():
        for a in s:
            by.setdefault(a, set()).add(k)
    free, want = set(held), {}
    for seed in sorted(held):
        if seed in free:
            others = {k for a in route[seed] for k in by[a]} & free - {seed}
            weight = lambda k: sum(round(10**12 / often[a]) for a in route[seed] & route[k])
            for k in [seed, *sorted(others, key=lambda k: (-weight(k), k))[: most - 1]]:
                free.discard(k)
                want[k] = seed
    return want


@pytest.mark.parametrize("task_links", [400_000, 30])
def test_groups_are_those_of_the_sequence(spark, task_links):
    rng = random.Random(7)
    rows = [(f"r{i:03}", f"a{int(rng.expovariate(0.03))}") for i in range(70) for _ in range(rng.randrange(1, 4))] + [("alone", "only"), ("r000", "a0")]
    held = {}
    for i, a in rows:
        held.setdefault(i, set()).add(a)
    df = spark.createDataFrame(rows, "id string, anchor string")
    assert {r.id: r.seed for r in routing.routed(df, degree=20, task_links=task_links).collect()} == plain_routes(held, degree=20)
    assert {r.id: r.seed for r in routing.routed(df, most=5, task_links=task_links).collect()} == plain_routes(held, most=5)


def test_a_path_of_a_hundred_thousand_ids_takes_few_rounds(spark, monkeypatch):
    names, landed = [], routing.landed
    for module in (routing, graph):
        monkeypatch.setattr(module, "landed", lambda df, path: names.append(path) or landed(df, path))
    df = spark.range(100_000).selectExpr("id", "explode(array(id, id + 1)) AS anchor")
    began = time.perf_counter()
    got = routing.routed(df)
    assert got.count() == 100_000 and got.where("id - seed BETWEEN 0 AND 1").count() == 100_000 and got.select("seed").distinct().count() == 50_000
    rounds = [n for n in names if "/small-" in n]
    assert len(rounds) < 40 and len([n for n in names if "/first-" in n]) == 0 and time.perf_counter() - began < 240


def test_hierarchies_cover_each_level_once(spark):
    rng = random.Random(8)
    rows = sorted({(f"leaf{i:02}", f"a{rng.randrange(25)}") for i in range(40) for _ in range(2)})
    tree = routing.hierarchy(spark.createDataFrame(rows, "id string, anchor string"))
    got = {(r.level, r.parent, r.child) for r in tree.collect()}
    held, want = {}, set()
    for i, a in rows:
        held.setdefault(i, set()).add(a)
    for level in range(1, 9):
        if len(held) < 2:
            break
        groups = {}
        for k, seed in plain_routes(held).items():
            groups.setdefault(seed, []).append(k)
        above = {}
        for group in groups.values():
            if len(group) > 1:
                name = f"parent:{level}:" + hashlib.sha256("\n".join(sorted(group)).encode()).hexdigest()
                above[name] = set().union(*(held[k] for k in group))
                want |= {(level, name, k) for k in group}
        if not above:
            break
        held = above
    assert got == want and max(r[0] for r in got) >= 3
    assert routing.cover_findings(tree).count() == 0
    bad = spark.createDataFrame([(1, "p", "x"), (1, "q", "x"), (1, "q", "y"), (2, "t", "q"), (2, "t", "zz")], "level int, parent string, child string")
    assert sorted(tuple(r) for r in routing.cover_findings(bad).collect()) == [(1, "x", "alone"), (1, "x", "twice"), (2, "zz", "unknown")]
    assert routing.hierarchy(spark.createDataFrame([], "id string, anchor string")).count() == 0


def test_a_hierarchy_divides_its_leaves_once(spark, monkeypatch):
    """Components of the leaves serve all levels, but for those that one task may not walk; either way the tree is the same."""
    rng = random.Random(9)
    rows = sorted({(f"leaf{i:02}", f"a{rng.randrange(30)}") for i in range(40) for _ in range(2)}) + [("far1", "b"), ("far2", "b"), ("none", None)]
    df, calls = spark.createDataFrame(rows, "id string, anchor string"), []
    monkeypatch.setattr(routing, "components", lambda edges: calls.append(1) or graph.components(edges))
    once = {tuple(r) for r in routing.hierarchy(df).collect()}
    assert len(calls) == 1 and len({level for level, *_ in once}) > 2 and not any("none" in row for row in once)
    assert {tuple(r) for r in routing.hierarchy(df, levels=1, task_links=6).collect()} == {row for row in once if row[0] < 2} and len(calls) > 2
