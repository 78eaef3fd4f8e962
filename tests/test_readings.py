"""Readings: one that is whole, and one change for every rule."""

import copy

from pyspark.sql import functions as F

from agora.operators import readings
from agora.plans import repairs

PINS = {"contexts": "reading string, event string, version string", "evidence": "reading string, id string", "people": "reading string, person string, evidence array<string>", "blocks": "reading string, place int, text string, evidence array<string>, people array<string>"}
GOOD = {"contexts": [["a1", "1"], ["a2", "1"]], "evidence": [["e1"], ["e2"]], "people": [["p1", ["e1"]]], "blocks": [[1, "text", ["e1", "e2"], ["p1"]], [2, "more", ["e2"], None]]}
PUBLIC = {
    "contexts": ([("a1", "1", None), ("a2", "1", "b"), ("a3", "1", None)], "event string, version string, bill string"), "cited": ([("a1", "1", "e1"), ("a2", "1", "e2"), ("a3", "1", "e3")], "event string, version string, id string"),
    "actors": ([("a1", "1", "p1", ["e1"]), ("a2", "1", "p2", ["e2"])], "event string, version string, person string, evidence array<string>"), "evidence": ([("e1", "one"), ("e2", "two"), ("e3", "three")], "id string, excerpt string"),
    "profiles": ([("p1", "Kim", "person"), ("p2", "Lee", "person"), ("o1", "Org", "organization")], "person string, name string, kind string"),
}
CASES = [
    ("no context", "contexts", []), ("context pinned twice", "contexts", [["a1", "1"], ["a2", "1"], ["a2", "1"]]), ("evidence pinned twice", "evidence", [["e1"], ["e2"], ["e2"]]), ("person pinned twice", "people", [["p1", ["e1"]]] * 2), ("context unavailable", "contexts", [["a1", "1"], ["a2", "2"]]),
    ("evidence unavailable", "evidence", [["e1"], ["e2"], ["e9"]]), ("evidence of no pinned context", "evidence", [["e1"], ["e2"], ["e3"]]), ("person unavailable", "people", [["o1", ["e1"]]]), ("person without evidence", "people", [["p1", []]]), ("evidence of a person is not pinned", "people", [["p1", ["e1", "e3"]]]),
    ("person has no such role", "people", [["p1", ["e2"]]]), ("evidence of a block is not pinned", "blocks", [[1, "t", ["e3"], []]]), ("person of a block is not pinned", "blocks", [[1, "t", ["e1"], ["p2"]]]), ("person and block share no evidence", "blocks", [[1, "t", ["e2"], ["p1"]]]),
]


def test_readings_are_whole_or_none(spark):
    made = {"good": GOOD} | {str(i): copy.deepcopy(GOOD) | {table: rows} for i, (_, table, rows) in enumerate(CASES)}
    pins = {name: spark.createDataFrame([(r, *row) for r, tables in made.items() for row in tables[name]], schema) for name, schema in PINS.items()}
    public = {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in PUBLIC.items()}
    asked = spark.createDataFrame([(r,) for r in made], "reading string")
    found = {}
    for r in readings.findings(asked, pins, public).collect():
        found.setdefault(r.reading, set()).add(r.rule)
    assert "good" not in found
    for i, (rule, *_) in enumerate(CASES):
        assert rule in found[str(i)], (rule, found[str(i)])
    got = readings.assembled(asked, pins, public).collect()
    assert [r.reading for r in got] == ["good"]
    row = got[0].asDict(recursive=True)
    assert row["contexts"] == [{"event": "a1", "version": "1"}, {"event": "a2", "version": "1"}] and row["evidence"] == [{"id": "e1", "excerpt": "one"}, {"id": "e2", "excerpt": "two"}]
    assert row["people"] == [{"person": "p1", "name": "Kim", "evidence": ["e1"]}] and [b["people"] for b in row["blocks"]] == [["p1"], []]


def test_a_large_reading_is_held_against_its_pins_as_rows(spark):
    """No row carries all evidence of its reading: arrays on every person would be the square of it."""
    n = spark.range(3_000).select(F.lit("r").alias("reading"), F.concat(F.lit("p"), "id").alias("person"), F.concat(F.lit("e"), "id").alias("id"))
    one = F.array("id").alias("evidence")
    event = [F.lit("a").alias("event"), F.lit("1").alias("version")]
    pins = {"contexts": n.select("reading", *event).distinct(), "evidence": n.select("reading", "id"), "people": n.select("reading", "person", one), "blocks": n.groupBy("reading").agg(F.collect_list("id").alias("evidence"), F.collect_list("person").alias("people")).select("reading", F.lit(1).alias("place"), F.lit("t").alias("text"), "evidence", F.slice("people", 1, 3).alias("people"))}
    public = {"contexts": n.select(*event).distinct(), "cited": n.select(*event, "id"), "actors": n.select(*event, "person", one), "evidence": n.select("id", F.lit("x").alias("excerpt")), "profiles": n.select("person", F.lit("x").alias("name"), F.lit("person").alias("kind"))}
    held = readings.findings(n.select("reading").distinct(), pins, public)
    assert "collect_set" not in held._jdf.queryExecution().optimizedPlan().toString()
    assert held.isEmpty()
    (row,) = readings.assembled(n.select("reading").distinct(), pins, public).select("reading", F.size("people"), F.size("evidence")).collect()
    assert tuple(row) == ("r", 3_000, 3_000)


def test_pins_on_orders_are_read_off_the_landed_lines(spark):
    """Contexts and evidence of ``pinned_readings`` take no shuffle of their own."""
    pins, _ = repairs.reading_tables(spark, "/root/testdata/sf0.001")
    for name in ("contexts", "evidence"):
        assert "Exchange" not in pins[name]._jdf.queryExecution().executedPlan().toString()
        assert pins[name].count() == pins[name].distinct().count() > 0
