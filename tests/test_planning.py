"""Rules, retraction and repair requests against plain fixpoints."""

import hashlib
import random

import pytest

from agora.operators import planning
from agora.operators.planning import Rule

RULES = (
    Rule("chain", ("reaches", "x", "y"), (("edge", "x", "y"),)),
    Rule("step", ("reaches", "x", "z"), (("reaches", "x", "y"), ("edge", "y", "z"))),
    Rule("both", ("meets", "x"), (("reaches", "x", "y"), ("reaches", "y", "x"), ("kind", "y"))),
    Rule("self", ("loop", "x"), (("reaches", "x", "x"),)),
)


def plain_closure(facts, rules):
    known = set(facts)
    while True:
        new = set()
        for rule in rules:
            bindings = [{}]
            for relation, *variables in rule.body:
                bindings = [m | dict(zip(variables, args)) for m in bindings for r, *args in known if r == relation and len(args) == len(variables) and all(m.get(v, x) == x for v, x in zip(variables, args)) and len({(v, x) for v, x in zip(variables, args)}) == len(set(variables))]
            new |= {(rule.head[0], *[m[v] for v in rule.head[1:]]) for m in bindings}
        if new <= known:
            return known
        known |= new


def row(f):
    return (f[0], f[1], f[2] if len(f) > 2 else None)


def test_rules_over_changes_equal_a_full_evaluation(spark):
    rng = random.Random(4)
    edges = sorted({("edge", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)})
    base = edges[:15] + [("kind", f"n{i}") for i in range(0, 14, 2)]
    before = plain_closure(base, RULES)
    added = edges[15:] + [("kind", "n1"), edges[0]]
    schema = "relation string, a string, b string"
    got = planning.derived(spark.createDataFrame([row(f) for f in before], schema), spark.createDataFrame([row(f) for f in added] + [(None, "x", "y")], schema), RULES).collect()
    after = plain_closure([*base, *added], RULES)
    assert {(r.relation, r.a, r.b) for r in got} == {row(f) for f in after - before - set(added)} and len(got) == len({(r.relation, r.a, r.b) for r in got})
    assert all(r.rule in {"chain", "step", "both", "self"} for r in got) and len(got) > 10
    empty = spark.createDataFrame([], schema)
    assert planning.derived(spark.createDataFrame([row(f) for f in before], schema), empty, RULES).count() == 0
    assert {(r.relation, r.a, r.b) for r in planning.derived(empty, spark.createDataFrame([row(f) for f in base], schema), RULES).collect()} == {row(f) for f in before - set(base)}


@pytest.mark.parametrize("body", [(), (("p", "x"), ("q", "y")), (("p", "x", "y", "z"),), (("p", "X"),)])
def test_rules_that_are_refused(body):
    with pytest.raises(ValueError):
        Rule("r", ("h", "x"), body)


def plain_alive(supports, grounds):
    alive = set(grounds)
    while True:
        more = {f for f, s in supports for p in [supports[f, s]] if p <= alive} - alive
        if not more:
            return alive
        alive |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_retraction_equals_a_fixpoint_from_the_grounds(spark, seed):
    rng = random.Random(seed)
    grounds = [f"g{i}" for i in range(12)]
    supports = {}
    for i in range(40):  # premises may come later, so some circles have no ground of their own
        for s in range(rng.randrange(1, 3)):
            supports[f"f{i}", f"s{i}-{s}"] = {rng.choice(grounds) if rng.random() < 0.55 else f"f{rng.randrange(40)}" for _ in range(rng.randrange(1, 3))}
    before = plain_alive(supports, grounds)
    supports = {k: p for k, p in supports.items() if k[0] in before and p <= before}
    rows = [(f, s, p) for (f, s), ps in supports.items() for p in ps]
    gone = grounds[:5]
    got = planning.retracted(spark.createDataFrame(rows + rows[:3], "fact string, support string, premise string"), spark.createDataFrame([(g,) for g in gone] + [(None,)], "fact string")).collect()
    after = plain_alive(supports, grounds[5:])
    assert {r.fact for r in got} == before - after - set(gone) and got
    assert all(r.lost == len({s for f, s in supports if f == r.fact}) for r in got)


def test_facts_that_support_each_other_go_with_their_ground(spark):
    rows = [("a", "1", "g"), ("a", "2", "b"), ("b", "1", "a"), ("c", "1", "b"), ("c", "2", "h")]
    df = spark.createDataFrame(rows, "fact string, support string, premise string")
    assert {r.fact for r in planning.retracted(df, spark.createDataFrame([("g",)], "fact string")).collect()} == {"a", "b"}
    assert planning.retracted(df, spark.createDataFrame([("x",)], "fact string")).count() == 0


def test_retraction_lands_only_what_grounds_do_not_decide(spark, monkeypatch):
    rows = [(f"f{i}", str(s), f"g{10 * i + s}") for i in range(30) for s in range(4)] + [("top", "1", "f0"), ("top", "2", "f1"), ("top", None, "f2"), ("side", "1", None)]
    gone = [(f"g{s}",) for s in range(4)] + [(f"g{s}",) for s in (10, 20, 21, 22, 23)]
    landed, kept = [], planning.landed
    monkeypatch.setattr(planning, "landed", lambda df, path: (lambda d: (landed.append(d.count()), d)[1])(kept(df, path)))
    got = planning.retracted(spark.createDataFrame(rows, "fact string, support string, premise string"), spark.createDataFrame(gone, "fact string")).collect()
    assert {tuple(r) for r in got} == {("f0", 4), ("f2", 4)}  # f1 keeps three supports and so keeps top
    assert max(landed) <= len(gone)


def test_requests_are_new_versioned_and_bounded(spark):
    fact = "relation string, a string, b string"
    wanted = spark.createDataFrame([("r", "1", "2", "d2"), ("r", "1", "2", "d1"), ("r", "3", None, "d1"), ("r", "5", "6", "d1"), ("r", "7", "8", "d9")], fact + ", dependency string")
    existing = spark.createDataFrame([("r", "5", "6")], fact)
    asked = hashlib.sha256("repair|m|1:r|1:7|1:8|2:d9".encode()).hexdigest()
    jobs = spark.createDataFrame([("old", "r", "3", None, 4, "complete"), (asked, "r", "7", "8", 1, "planned"), ("y", "q", "1", "2", 9, "failed")], "key string, " + fact + ", version int, state string")
    got = [(r.a, r.b, r.dependency, r.version, r.place) for r in planning.requests(wanted, existing, jobs, "m", 3).orderBy("place").collect()]
    assert got == [("1", "2", "d1", 1, 1), ("3", None, "d1", 5, 2)]
    assert planning.requests(wanted, existing, jobs, "m", 2).count() == 1 and planning.requests(wanted, existing, jobs, "m", 1).count() == 0
    assert planning.requests(wanted, existing, jobs, "n", 9).count() == 3  # another model is asked anew


def test_artifacts_lose_only_removed_edges(spark):
    artifacts = spark.createDataFrame([("x", 3), ("y", 1)], "artifact string, version int")
    edges = spark.createDataFrame([("x", "e2"), ("x", "e1"), ("x", "e3"), ("y", "e4")], "artifact string, edge string")
    got = planning.repaired_artifacts(artifacts, edges, spark.createDataFrame([("e2",), ("e1",), ("e9",)], "edge string")).collect()
    assert [tuple(r) for r in got] == [("x", 4, 1, ["e1", "e2"])]
