"""Queries of look-ups, identities, inserts, archives, reconciliations and spanning windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merges, ordered, proofs, relations
from ..sources import manifests
from .registry import query, table


@query("JN-25", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE (l_orderkey, l_partkey, l_suppkey) IN (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.08 AND l_returnflag = 'R')""")
def triple_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by a list of triples of order, part and supplier."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    return relations.looked_up(lines, lines.where("l_discount > 0.08 AND l_returnflag = 'R'").select(*keys), keys).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("JN-30", """WITH i AS (SELECT s_nationkey % 3 AS ns, s_suppkey % 60 AS value, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS person FROM supplier GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n = 1 THEN person END AS person, CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN 'identifier' ELSE 'unknown' END AS how
FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' LEFT JOIN i ON ns = l_partkey % 3 AND value = l_suppkey""")
def vote_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voters of held sessions by their identifiers: known, in conflict, or unknown."""
    suppliers, lines = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    identifiers = suppliers.select((F.col("s_nationkey") % 3).alias("namespace"), (F.col("s_suppkey") % 60).alias("value"), F.col("s_suppkey").alias("person"))
    votes = lines.select(F.col("l_orderkey").alias("bill"), F.lit(1).alias("session"), (F.col("l_partkey") % 3).cast("int").alias("namespace"), F.col("l_suppkey").alias("value"), "l_linenumber", "l_partkey")
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("bill"), F.lit(1).alias("session"))
    found = relations.voters(votes, identifiers, held)
    return found.select(F.col("bill").alias("l_orderkey"), "l_linenumber", "l_partkey", F.col("value").alias("l_suppkey"), "person", "how")


@query("FL-28", """SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k FROM events WHERE (props::JSON ->> '$.k')::INTEGER NOT IN (SELECT p_size FROM part WHERE p_size IS NOT NULL) AND event_type <> 'error'""")
def unknown_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose domain, in their JSON, no catalog knows; an anti-join, as the catalog may be of any size."""
    events = table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    known = table(spark, sf_dir, "part").select(F.col("p_size").alias("k")).where("k IS NOT NULL").distinct()
    return events.where("k IS NOT NULL").join(known, "k", "left_anti").select("event_id", "k")


@query("SNK-04", """WITH s AS (SELECT DISTINCT o_custkey AS person, o_orderpriority AS position FROM orders WHERE o_orderkey % 3 = 0), i AS (SELECT DISTINCT o_custkey AS person, o_orderpriority AS position FROM orders WHERE o_orderkey % 3 > 0)
SELECT 'position' AS what, person, position AS target FROM (SELECT * FROM i EXCEPT SELECT * FROM s)
UNION ALL SELECT 'link', o_custkey, l_partkey::VARCHAR FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 1 EXCEPT SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1)""")
def position_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and links of people that an import adds: none that is there, each once."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    position = orders.select("o_orderkey", F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("target"))
    link = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("l_linenumber", F.col("o_custkey").alias("person"), F.col("l_partkey").cast("string").alias("target"))
    keys = ["person", "target"]
    added = merges.inserted(position.where("o_orderkey % 3 = 0"), position.where("o_orderkey % 3 > 0").select(*keys), keys)
    linked = merges.inserted(link.where("l_linenumber = 1"), link.where("l_linenumber > 1").select(*keys), keys)
    return added.select(F.lit("position").alias("what"), *keys).unionByName(linked.select(F.lit("link").alias("what"), *keys))


@query("CD-04", """SELECT doc_id, sha256(coalesce(text, '')) AS hash, 3 AS version, true AS archived FROM documents WHERE doc_id % 5 = 1 AND doc_id % 7 > 0
UNION ALL SELECT doc_id, sha256(coalesce(text, '') || ' changed'), 4, false FROM documents WHERE doc_id % 5 = 1 AND doc_id % 7 > 0 UNION ALL SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 1 THEN ' changed' ELSE '' END), 1, false FROM documents WHERE doc_id % 7 = 0""")
def archived_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that changed documents leave behind and begin; new documents begin with their first, unchanged ones are left alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.where("doc_id % 7 > 0").withColumn("version", F.lit(3))
    new = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return merges.archived(old, new, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("hash"), "version", "archived")


@query("SM-04", """WITH runs AS (SELECT o_custkey % 50 AS source, o_orderdate AS started, bool_and(o_orderstatus = 'F') AS complete FROM orders GROUP BY ALL), w AS (SELECT source, max(started) FILTER (complete AND started <= TIMESTAMP '1997-06-02') AS wm FROM runs GROUP BY source)
SELECT o_orderkey, CASE WHEN (o_custkey % 50) % 7 = 1 THEN 'reconciliation' WHEN wm IS NULL THEN 'never complete' ELSE 'changed' END AS why FROM orders JOIN w ON source = o_custkey % 50 WHERE (o_custkey % 50) % 7 = 1 OR wm IS NULL OR o_orderdate >= wm""")
def weekly_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of one Monday fetches again: all of the sources whose day it is, of others what has changed."""
    orders = table(spark, sf_dir, "orders").withColumn("source", F.col("o_custkey") % 50)
    runs = orders.groupBy("source", F.col("o_orderdate").alias("started")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("complete"))
    children = orders.select("source", "o_orderkey", F.col("o_orderdate").alias("changed_at"))
    day = F.lit("1997-06-02").cast("timestamp_ntz")
    # A source is reconciled on the weekday of its number: 1 is Monday.
    return merges.refetched(children, runs, day, F.col("source") % 7 == F.weekday("day") + 1).select("o_orderkey", "why")


@query("ST-02", """WITH u AS (SELECT user_id, event_id, ts, 0 AS feed FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, ts, 1 FROM events WHERE event_id % 2 = 0),
d AS (SELECT user_id, event_id, any_value(ts) AS ts, min(feed) AS feed FROM u GROUP BY ALL)
SELECT user_id, event_id, feed, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM d) WHERE place <= 100""")
def newest_of_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest of each user's two feeds, each activity once."""
    df = table(spark, sf_dir, "events")
    feed = lambda rows, n: rows.select("user_id", "event_id", "ts", F.lit(n).alias("feed"))
    both = feed(df.where("event_type = 'view'"), 0).unionByName(feed(df.where("event_id % 2 = 0"), 1))
    once = both.groupBy("user_id", "event_id").agg(F.first("ts").alias("ts"), F.min("feed").alias("feed"))
    return ordered.ranked(once, ["user_id"], [F.col("ts").desc(), F.col("event_id")], "place").where(F.col("place") <= 100).select("user_id", "event_id", "feed", "place")


_WANTED = [["the", "der"], ["of", "und"], ["is", "que"]]
_FIRST = "least(" + ", ".join("list_min(list_filter([" + ", ".join(f"CASE WHEN strpos(w, '{x}') > 0 THEN strpos(w, '{x}') - 1 END" for x in words) + "], lambda x: x IS NOT NULL))" for words in _WANTED) + ")"


def _end(words: list[str]) -> str:
    """Where the first word of a list ends; of words that begin at one place the shorter."""
    best = "least(" + ", ".join(f"CASE WHEN strpos(w, '{x}') > 0 THEN strpos(w, '{x}') * 1000 + {len(x)} ELSE 999999999 END" for x in words) + ")"
    return f"({best} // 1000 - 1 + {best} % 1000)"


@query("WN-20", f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS a, lead(coalesce(text, ''), 1) OVER o AS b, lead(coalesce(text, ''), 2) OVER o AS c FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
v AS (SELECT conv_id, turn, 2 AS width, a, a || ' ' || b AS w, length(a) + 1 AS last FROM t WHERE b IS NOT NULL UNION ALL SELECT conv_id, turn, 3, a, a || ' ' || b || ' ' || c, length(a) + length(b) + 2 FROM t WHERE c IS NOT NULL),
g AS (SELECT * FROM v WHERE {' AND '.join('(' + ' OR '.join(f"contains(w, '{x}')" for x in words) + ')' for words in _WANTED)}),
s AS (SELECT *, {_FIRST} AS first, greatest({', '.join(map(_end, _WANTED))}) AS "end" FROM g)
SELECT conv_id, turn, width, first::INTEGER AS "start", "end"::INTEGER AS "end" FROM s WHERE first < length(a) AND "end" > last""")
def spanning_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two and three turns that only together name one of each list of words, with the smallest stretch of theirs."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = proofs.spanning(turns, ["conv_id"], "turn", _WANTED)
    return found.select("conv_id", "turn", "width", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("SRC-25", """SELECT s.doc_id, s.n_chars, CASE WHEN s.doc_id % 10 = 0 THEN length(d.text) END AS payload FROM documents s JOIN documents d USING (doc_id) WHERE s.lang = 'en'""")
def inventory_with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory without payloads, which the scan does not read, and the payloads of the rows that ask for them."""
    docs = table(spark, sf_dir, "documents")
    listed = docs.where("lang = 'en'").select("doc_id", "n_chars")
    payload = docs.where("doc_id % 10 = 0").select("doc_id", F.length("text").alias("payload"))
    return listed.join(payload, "doc_id", "left").select("doc_id", "n_chars", "payload")


@query("SRC-21", """WITH m AS (SELECT DISTINCT l_orderkey AS job, l_partkey AS part, l_suppkey AS supp FROM lineitem), c AS (SELECT job, count(*) AS n, count(DISTINCT part) AS d, count(*) FILTER (part % 10 <> 3) AS found FROM m GROUP BY job)
SELECT job, CASE WHEN n > 5 OR d < n THEN 'invalid' WHEN job % 7 = 1 THEN 'replayed' WHEN job % 7 = 2 THEN 'conflict' WHEN found = n THEN 'complete' ELSE 'partial' END AS outcome, found, n - found AS missing FROM c""")
def manifest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that collect the parts of an order: invalid lists, replays, conflicts with a receipt, complete and partial ones."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.concat_ws("-", F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("place"), F.col("l_partkey").alias("document"), F.concat(F.lit("https://a.go.kr/"), "l_partkey").alias("url")).distinct()
    landed = table(spark, sf_dir, "part").where("p_partkey % 10 <> 3").select(F.concat(F.lit("https://a.go.kr/"), "p_partkey").alias("url"), F.col("p_name").alias("body"))
    first = manifests.collected(lines, landed, lines.select("job", F.lit("").alias("manifest")).limit(0), most=5)[0]
    receipts = first.where("job % 7 IN (1, 2)").select("job", F.when(F.col("job") % 7 == 1, F.col("manifest")).otherwise("another").alias("manifest"))
    return manifests.collected(lines, landed, receipts, most=5)[0].select("job", "outcome", "found", "missing")


@query("SRC-26", """SELECT s_suppkey AS id, CASE WHEN s_nationkey % 6 > 0 THEN 'issue ' || s_nationkey END AS issue, ps.p_partkey AS plan, ps.p_size AS values FROM supplier LEFT JOIN part ps ON ps.p_partkey % 150 = s_suppkey WHERE s_acctbal > 0""")
def active_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active sources with their issues and parameter plans."""
    issues = table(spark, sf_dir, "nation").where("n_nationkey % 6 > 0").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("issue "), "n_nationkey").alias("name"))
    plans = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 150).alias("source"), F.col("p_size").alias("values"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("issue"), (F.col("s_acctbal") > 0).alias("active"))
    return manifests.active(sources, plans, issues)


@query("SRC-26", """SELECT 'sources' AS dimension, 'no such issues' AS rule, s_suppkey::VARCHAR AS id FROM supplier WHERE s_nationkey % 6 = 0 UNION ALL SELECT 'plans', 'no such sources', p_partkey::VARCHAR FROM part WHERE p_partkey % 150 NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'issues', 'key twice', n_regionkey::VARCHAR FROM (SELECT n_regionkey FROM nation WHERE n_nationkey % 6 > 0 GROUP BY n_regionkey HAVING count(*) > 1)""")
def broken_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the dimensions: issues keyed by region stand twice, sources of issues and plans of sources that are not there."""
    kept = table(spark, sf_dir, "nation").where("n_nationkey % 6 > 0")
    suppliers, parts = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    good = {"issues": kept.select(F.col("n_nationkey").alias("id")), "sources": suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("issue")), "plans": parts.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 150).alias("source"))}
    lost = manifests.broken(good, {("sources", "issue"): "issues", ("plans", "source"): "sources"})
    return lost.unionByName(manifests.broken({"issues": kept.select(F.col("n_regionkey").alias("id"))}, {}))
