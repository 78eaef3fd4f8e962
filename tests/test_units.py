"""Text forms and merges on small tables."""

from agora.functions import units
from agora.operators import merges


def test_cut_bytes_keeps_code_points():
    text = "aé한😀" * 5
    for most in (4, 5, 7, 100):
        pieces = units.cut_bytes(text, most)
        assert "".join(pieces) == text and all(len(p.encode()) <= most for p in pieces)
    assert units.cut_bytes("", 4) == []


def test_text_forms(spark):
    df = spark.createDataFrame([("Ａ  b ", '{"b":{"d":1,"c":[2]},"a":"한"}'), (None, "{"), ("", None)], "t string, j string")
    rows = df.select(units.nfkc("t"), units.canonical_json("j"), units.byte_prefix(2)("t"), units.byte_units(3)("t")).collect()
    assert [tuple(r) for r in rows] == [("A b", '{"a":"한","b":{"c":[2],"d":1}}', "", ["Ａ", "  b", " "]), (None, None, None, None), ("", None, "", [])]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "k int, h string, at int")
    new = spark.createDataFrame([(1, "a", 2), (2, "c", 2), (3, None, 2), (4, None, 2)], "k int, h string, at int")
    assert {tuple(r) for r in merges.upserted(old, new, "k", "h").collect()} == {(1, "a", 1, 2), (2, "c", 2, 2), (3, None, 1, 2), (4, None, 2, 2)}
    assert {tuple(r) for r in merges.import_outcomes(old, new, "k", "h").collect()} == {(1, "replayed"), (2, "conflict"), (3, "replayed"), (4, "imported")}
