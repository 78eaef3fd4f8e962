"""Invariants of the generic operators on small frames."""

from pyspark.sql import functions as F

from agora.functions import headlines
from agora.operators import clustering, graph, ordered, paging, relations
from agora.streaming import incremental


def test_old_approval_does_not_return(spark):
    df = spark.createDataFrame([("a", 1, "approved"), ("a", 2, "rejected"), ("b", 1, "approved")], "k string, t int, d string")
    assert [r.k for r in ordered.decided(df, ["k"], [F.col("t").desc()], F.col("d") == "approved").collect()] == ["b"]


def test_a_b_a_is_three_generations(spark):
    df = spark.createDataFrame([("x", 1, "A"), ("x", 2, "B"), ("x", 3, "B"), ("x", 4, "A")], "k string, t int, v string")
    assert [r.generation for r in ordered.changes(df, ["k"], [F.col("t")], "v").orderBy("t").collect()] == [1, 2, 2, 3]


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("k", 1, 3), ("k", 3, 5), ("k", 7, 8), ("k", 2, 2)], "k string, a int, b int")
    assert sorted((r.a, r.b, r.parts) for r in ordered.merged_intervals(df, ["k"], "a", "b").collect()) == [(1, 5, 3), (7, 8, 1)]


def test_claim_dies_when_any_scope_is_touched(spark):
    df = spark.createDataFrame([("e", "s1", 1, "old"), ("e", "s2", 1, "old"), ("e", "s2", 2, "new")], "e string, s string, r int, c string")
    assert {r.c: r.survives for r in ordered.surviving_claims(df, "e", "s", "r", "c").collect()} == {"old": False, "new": True}


def test_claims_of_many_rows_are_spread_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    rows = [(e, s, r, f"{e}-{r}") for e in range(20) for r in range(3) for s in range(r, 4)]
    df = spark.createDataFrame(rows + rows[::3], "e int, s int, r int, c string")
    found = ordered.surviving_claims(df, "e", "s", "r", "c", len(rows) * 2)
    assert found.rdd.getNumPartitions() == -(-len(rows) * 2 // 10) > 4
    assert {(r.c, r.survives, r.scopes) for r in found.collect()} == {(f"{e}-{r}", r == 2, 4 - r) for e in range(20) for r in range(3)}


def test_keyset_pages_cover_everything_once(spark):
    df = spark.range(25).select("id", (F.col("id") % 3).alias("k"))
    order, seen, cursor = [("k", True), ("id", True)], [], None
    while True:
        page = paging.keyset_page(df, order, 7, cursor).collect()
        seen += [r.id for r in page[:7]]
        if len(page) <= 7:
            break
        cursor = (page[6].k, page[6].id)
    assert sorted(seen) == list(range(25)) and len(seen) == 25


def test_snapshot_diff_handles_null_values(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "c"), (4, "d")], "k int, v string")
    assert {r.k: r.status for r in relations.snapshot_diff(old, new, "k", "v").collect()} == {1: "unchanged", 2: "changed", 3: "removed", 4: "new"}


def test_neighbourhood_counts_the_shortest_way(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "source string, target string")
    found = graph.neighbourhood(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r.node: r.distance for r in found.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", "2024-01-01 00:01:00"), (2, "a", "2024-01-01 00:02:00"), (3, "b", "2024-01-01 00:09:00"), (9, "z", "2024-01-03 00:00:00")], "id int, k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = incremental.landed(spark, str(tmp_path / "in"), events.schema)
    incremental.run_now(incremental.bucketed(stream, "at", ["k"]), str(tmp_path / "c1"), path=str(tmp_path / "buckets"))
    assert {(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "buckets")).collect()} >= {("a", 2), ("b", 1)}
    for checkpoint in ("c2", "c3"):  # a new checkpoint replays the whole input
        incremental.run_now(stream, str(tmp_path / checkpoint), each=incremental.append_new(["id"], str(tmp_path / "ledger")))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4


def test_pairs_of_anchors_are_added_up_where_their_left_item_is(spark):
    rows = [(i, f"a{a}") for a in range(40) for i in range(a, 60, 1 + a % 7)] + [(1, "a39"), (None, "two"), (2, "two"), (3, None), (4, None)]
    df = spark.createDataFrame(rows + rows[:9], "item int, anchor string")
    by = {}
    for i, a in set(rows):
        by.setdefault(a, []).append(i)
    want = {}
    for a, items in by.items():
        for x in items if a and 2 <= len(items) <= 12 else ():
            for y in items:
                if x is not None and y is not None and x < y:
                    want[x, y] = want.get((x, y), 0) + 1 / len(items)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # items go over the ends of batches
    found = relations.anchor_similarity(df, "item", "anchor", 2, 12)
    got = {(r["left"], r["right"]): r.weight for r in found.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) > 100 and all(abs(got[k] - w) < 1e-9 for k, w in want.items())
    assert "hashpartitioning(left#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", right#" not in plan.split("hashpartitioning(left#")[1].split(")")[0]


def test_titles_of_the_same_words_are_compared_once(spark, monkeypatch):
    words = ("국회", "소방안전 예산", "반도체 지원", "철도노조 파업", "개인정보 해킹", "연금 개정안", "budget plan 2024", "소방 x")
    titles = [(run, f"{a} {b} {c}") for run in (1, 2) for i, a in enumerate(words) for b in words[: 5 + run] for c in words[i % 3 :: 3]] + [(3, None), (None, "a"), (1, "")]
    df = spark.createDataFrame(titles + titles[:50], "run int, title string")
    kept = df.distinct().withColumn("s", headlines.signature(F.col("title")))
    plain = kept.alias("x").join(kept.alias("y"), F.expr("x.run = y.run AND x.title < y.title")).select("x.run", F.col("x.title").alias("left"), F.col("y.title").alias("right"), headlines.similarity(F.col("x.s"), F.col("y.s")).alias("similarity"))
    want = sorted(tuple(r) for r in plain.where("similarity >= 0.42").collect())
    counts, landed = [], clustering.landed
    monkeypatch.setattr(clustering, "landed", lambda d, path: (lambda x: (counts.append(x.count()), x)[1])(landed(d, path)))
    assert sorted(tuple(r) for r in clustering.similar_titles(df).collect()) == want and len(want) > 1000
    assert 0 < counts[0] < kept.count() / 2
