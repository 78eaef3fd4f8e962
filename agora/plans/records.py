"""Queries over versioned records: latest versions, feeds, existence joins, change data, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, ordered, paging, relations
from .registry import query, table

def newest():
    return [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]


@query("WN-03 CD-11", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_version_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], newest()).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WN-01 WN-02", """
SELECT o_custkey, o_orderpriority, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
WHERE r = 1 AND o_orderstatus = 'F'""")
def rank_then_filter_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered.decided(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], newest(), F.col("o_orderstatus") == "F")
    return df.select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SL-01 FL-01", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21""")
def feed_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return paging.keyset_page(df, [("o_orderdate", True), ("o_orderkey", True)], 20).select("o_orderkey", "o_custkey")


@query("SL-02", """
SELECT event_id, user_id, event_type FROM events
WHERE event_type > 'error' OR (event_type = 'error' AND user_id > 20) OR (event_type = 'error' AND user_id = 20 AND event_id > 500)
ORDER BY event_type, user_id, event_id LIMIT 51""")
def feed_keyset_three_key_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [("event_type", False), ("user_id", False), ("event_id", False)]
    return paging.keyset_page(table(spark, sf_dir, "events"), order, 50, ("error", 20, 500)).select("event_id", "user_id", "event_type")


@query("FL-01 JN-07", """
SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING')""")
def feed_filtered_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf_dir, "orders")
    return orders.join(building, orders.o_custkey == building.c_custkey, "left_semi").join(returned, orders.o_orderkey == returned.l_orderkey, "left_semi").select("o_orderkey")


@query("JN-08 JN-10", """
SELECT o_orderkey, o_custkey FROM orders o JOIN customer c ON o_custkey = c_custkey AND c_mktsegment = 'AUTOMOBILE'
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')""")
def digest_undelivered_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    followed = table(spark, sf_dir, "customer").where("c_mktsegment = 'AUTOMOBILE'").select("c_custkey")
    delivered = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey")
    orders = table(spark, sf_dir, "orders").join(followed, F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(delivered, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("JN-10 JN-11", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
OR EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity >= 50)
OR c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def disjunctive_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    large = orders.join(table(spark, sf_dir, "lineitem").where("l_quantity >= 50"), F.col("l_orderkey") == F.col("o_orderkey"))
    owing = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    return relations.any_exists(table(spark, sf_dir, "customer"), "c_custkey", (orders.where("o_orderstatus = 'P'"), "o_custkey"), (large, "o_custkey"), (owing, "s_suppkey")).select("c_custkey")


@query("JN-09 CD-02", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1997-01-01')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01')""")
def stale_and_not_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    return relations.exists_and_not(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", ~fresh, fresh).select("c_custkey")


@query("JN-12 JN-06", """
SELECT c_custkey, c_name, (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS position
FROM customer""")
def directory_latest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = ordered.latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], newest()).select("o_custkey", F.col("o_orderpriority").alias("position"))
    return table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "position")


@query("JN-13", """
WITH alias AS (SELECT n_nationkey AS a, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS t FROM nation WHERE n_nationkey % 2 = 1)
SELECT coalesce(t, s_nationkey) AS s_nationkey, count(*) AS n FROM supplier LEFT JOIN alias ON a = s_nationkey GROUP BY ALL""")
def alias_resolved_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 1")
    aliases = odd.select(F.col("n_nationkey").alias("a"), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")).alias("t"))
    return relations.resolved(table(spark, sf_dir, "supplier"), "s_nationkey", aliases, "a", "t").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("JN-04 SF-09", """
SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE term <> '' GROUP BY term""")
def lateral_csv_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))


@query("CD-03 AG-02", """
SELECT o_custkey, max(year(o_orderdate)) AS term,
  CASE WHEN max(year(o_orderdate)) = (SELECT max(year(o_orderdate)) FROM orders) THEN 'CURRENT' ELSE 'FORMER' END AS status
FROM orders GROUP BY o_custkey""")
def legislator_status_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("term"))
    last = terms.agg(F.max("term").alias("last"))
    return terms.join(last).select("o_custkey", F.col("term").cast("bigint").alias("term"), F.when(F.col("term") == F.col("last"), "CURRENT").otherwise("FORMER").alias("status"))


@query("JN-02 FL-04", """
SELECT o_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' GROUP BY o_orderkey""")
def history_join_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders").where((at >= F.lit("1996-01-01").cast("timestamp_ntz")) & (at < F.lit("1996-07-01").cast("timestamp_ntz"))).select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("JN-01 JN-06", """
SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_orderkey), 0) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def status_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("latest"))
    joined = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("latest", F.lit(0)).alias("latest"))


VERSIONS = "CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' ' ELSE coalesce(text, '') END"


@query("CD-01 CD-12", f"""
SELECT changed, semantic, count(*) AS n FROM (
  SELECT sha1(coalesce(text, '')) <> sha1({VERSIONS}) AS changed,
    sha1(regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g')) <> sha1(regexp_replace(trim({VERSIONS}), '\\s+', ' ', 'g')) AS semantic FROM documents) GROUP BY ALL""")
def change_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.coalesce("text", F.lit(""))
    new = F.when(F.col("doc_id") % 7 == 0, F.concat(old, F.lit(" "))).otherwise(old)
    meaning = lambda c: F.sha1(F.regexp_replace(F.trim(c), r"\s+", " "))
    return table(spark, sf_dir, "documents").select((F.sha1(old) != F.sha1(new)).alias("changed"), (meaning(old) != meaning(new)).alias("semantic")).groupBy("changed", "semantic").agg(F.count("*").alias("n"))


@query("JN-21 CD-10 CD-13", """
WITH a AS (SELECT doc_id, sha1(text) AS h FROM documents WHERE doc_id % 5 <> 0),
b AS (SELECT doc_id, sha1(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 6 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'removed'
  WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def snapshot_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha1("text").alias("h"))
    new = docs.where("doc_id % 6 <> 0").select("doc_id", F.sha1(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return relations.snapshot_diff(old, new, "doc_id", "h")


@query("WN-10 WN-06", """
WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT event_id, (sum(CASE WHEN r = 1 OR p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS generation FROM l""")
def generation_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.changes(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "generation")


@query("WN-06 WN-07 WN-09", """
WITH ok AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS ordinal FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, ordinal, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_seen FROM ok WHERE p IS NULL OR p <> event_type""")
def transition_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = table(spark, sf_dir, "events").where("event_type <> 'error'")
    df = ordered.changes(ordered.ranked(ok, ["user_id"], [F.col("ts"), F.col("event_id")], "ordinal"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return df.where("changed").select("event_id", F.col("ordinal").cast("bigint").alias("ordinal"), "event_type", F.min("event_id").over(Window.partitionBy("user_id", "event_type")).alias("first_seen"))


@query("AG-03 AG-04 JN-30", """
WITH g AS (SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_suppkey) AS voters, max(l_linenumber) AS latest, count(DISTINCT l_returnflag) AS results FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, rows, voters, latest, results > 1 AS conflict FROM g JOIN orders ON o_orderkey = l_orderkey WHERE rows <= 500""")
def vote_session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.size(F.collect_set("l_suppkey")).cast("bigint").alias("voters"), F.max("l_linenumber").alias("latest"), (F.min("l_returnflag") != F.max("l_returnflag")).alias("conflict"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return lines.where("rows <= 500").join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("AG-04 AG-17", """
SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(DISTINCT l_partkey) > 1""")
def vote_conflict_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("a <> b").select("l_orderkey", "l_suppkey")


@query("SF-01", """
SELECT 'customer' AS kind, sha1('person|' || c_name || '|' || c_mktsegment) AS identity, 'p_' || sha256(c_name) AS public_id FROM customer
UNION ALL SELECT 'supplier', sha1('person|' || s_name || '|'), 'p_' || sha256(s_name) FROM supplier""")
def identity_hash_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    def person(df: DataFrame, kind: str, name: str, title) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.sha1(F.concat_ws("|", F.lit("person"), name, title)).alias("identity"), F.concat(F.lit("p_"), F.sha2(F.col(name), 256)).alias("public_id"))

    return person(table(spark, sf_dir, "customer"), "customer", "c_name", F.col("c_mktsegment")).union(person(table(spark, sf_dir, "supplier"), "supplier", "s_name", F.lit("")))


@query("PJ-01 SF-04 SF-05", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR
  WHEN o_orderkey % 3 = 1 THEN sha1(length(o_custkey::VARCHAR) || ':' || o_custkey || length(o_orderpriority) || ':' || o_orderpriority)
  ELSE 'unresolved:' || sha1('c=' || o_custkey || '&k=' || o_orderkey) END AS record_key FROM orders""")
def record_key_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.concat(F.length(c), F.lit(":"), c)
    cust, key = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    pairs = F.array_sort(F.array(F.concat(F.lit("k="), key), F.concat(F.lit("c="), cust)))
    chosen = F.when(F.col("o_orderkey") % 3 == 0, key).when(F.col("o_orderkey") % 3 == 1, F.sha1(F.concat(part(cust), part(F.col("o_orderpriority"))))).otherwise(F.concat(F.lit("unresolved:"), F.sha1(F.array_join(pairs, "&"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", chosen.alias("record_key"))


@query("PJ-03", """
SELECT DISTINCT p_partkey, kind, value FROM (
  SELECT p_partkey, 'brand' AS kind, trim(p_brand) AS value FROM part UNION ALL SELECT p_partkey, 'type', trim(p_type) FROM part
  UNION ALL SELECT p_partkey, 'first', coalesce(nullif(trim(p_name), ''), p_brand) FROM part) WHERE value <> ''""")
def unpivot_people_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(F.struct(F.lit("brand").alias("kind"), F.trim("p_brand").alias("value")), F.struct(F.lit("type").alias("kind"), F.trim("p_type").alias("value")), F.struct(F.lit("first").alias("kind"), F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), "p_brand").alias("value")))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(fields)).where("value <> ''").distinct()


@query("ST-03 SNK-03 SNK-01", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0""")
def insert_ignore_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rows = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(-1.0))
    return relations.insert_ignore(orders.where("o_orderkey % 2 = 0"), rows, ["o_orderkey"])


@query("ST-07", """
WITH k AS (SELECT n_nationkey AS key, 'known' AS c FROM nation WHERE n_nationkey % 2 = 0), o AS (SELECT DISTINCT s_nationkey AS key, 'observed' AS c FROM supplier)
SELECT coalesce(k.key, o.key) AS key, coalesce(o.c, k.c) AS coverage FROM k FULL JOIN o ON k.key = o.key""")
def coverage_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.lit("known").alias("k"))
    seen = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")).distinct().withColumn("o", F.lit("observed"))
    return known.join(seen, "key", "full_outer").select("key", F.coalesce("o", "k").alias("coverage"))


@query("ST-04 ST-05", """
SELECT 'removed' AS kind, c_custkey AS key FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'both', c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'added', o_custkey FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def source_overlap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(1).alias("a")).distinct()
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct().withColumn("b", F.lit(1))
    kind = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("both")
    return a.join(b, "key", "full_outer").select(kind.alias("kind"), "key")


@query("ST-01 SRC-28", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")))
def inventory_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        own = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("WN-18", """
WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
e AS (SELECT o_custkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT e.l_orderkey, e.l_linenumber, t.o_orderkey AS tenure FROM e JOIN t ON t.o_custkey = e.o_custkey AND a <= l_shipdate AND (b IS NULL OR l_shipdate < b)""")
def point_in_time_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    tenures = orders.select("o_custkey", F.col("o_orderkey").alias("tenure"), F.col("o_orderdate").alias("a"), following.alias("b"))
    shipped = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return relations.valid_at(shipped, tenures, ["o_custkey"], "l_shipdate", "a", "b").select("l_orderkey", "l_linenumber", "tenure")


@query("WN-17", """
WITH c AS (SELECT DISTINCT o_custkey, l_suppkey, o_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT *, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey, l_suppkey) AS own FROM c)
SELECT o_custkey, o_orderkey, bool_and(own) AS survives, count(*) AS scopes FROM m GROUP BY ALL""")
def supersede_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    claims = claims.select("o_custkey", "l_suppkey", "o_orderkey", F.col("o_orderkey").alias("revision"))
    # The table's own row count is read from its files' footers.
    return ordered.surviving_claims(claims, "o_custkey", "l_suppkey", "revision", "o_orderkey", table(spark, sf_dir, "lineitem").count())


@query("JN-14 SNK-16 SNK-17", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01')""")
def delete_join_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))).select("o_orderkey")
    return table(spark, sf_dir, "lineitem").join(gone, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query("JN-15 JN-32", """
SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus <> 'P' AND l_returnflag <> 'N' GROUP BY n_name""")
def published_context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("GR-10", """
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h1 AS (SELECT DISTINCT b AS node FROM u WHERE a = 's1'), h2 AS (SELECT DISTINCT u.b AS node FROM h1 JOIN u ON u.a = h1.node)
SELECT node, min(d) AS distance FROM (SELECT 's1' AS node, 0 AS d UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node""")
def graph_neighbourhood_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return graph.neighbourhood(edges, spark.sql("SELECT 's1' AS node"), 2)


@query("GR-12 GR-13", """
WITH a AS (SELECT o_orderkey AS id, o_orderstatus <> 'F' OR o_orderkey % 5 > 0 AS v0 FROM orders), c AS (SELECT o_orderkey AS parent, o_orderkey // 2 AS child FROM orders),
l1 AS (SELECT id, v0 AND NOT EXISTS (SELECT 1 FROM c JOIN a k ON k.id = c.child WHERE c.parent = a.id AND NOT k.v0) AS v FROM a),
l2 AS (SELECT id, v AND NOT EXISTS (SELECT 1 FROM c JOIN l1 k ON k.id = c.child WHERE c.parent = l1.id AND NOT k.v) AS v FROM l1)
SELECT id, v AS valid FROM l2""")
def artifact_dag_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    artifacts = orders.select(F.col("o_orderkey").alias("id"), ((F.col("o_orderstatus") != "F") | (F.col("o_orderkey") % 5 > 0)).alias("current"))
    children = orders.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 2).alias("child"))
    return graph.valid_artifacts(artifacts, children, 2)


@query("JN-26 AG-29", """
WITH p AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS anchor FROM lineitem), d AS (SELECT anchor, count(*) AS df FROM p GROUP BY anchor HAVING count(*) BETWEEN 2 AND 50)
SELECT a.item AS "left", b.item AS "right", round(sum(1.0 / df), 6) AS weight FROM p a JOIN d USING (anchor) JOIN p b USING (anchor) WHERE a.item < b.item GROUP BY ALL""")
def anchor_df_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.anchor_similarity(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").withColumn("weight", F.round("weight", 6))


@query("AG-25", """
SELECT p_name AS name, count(*) AS n, count(DISTINCT p_brand) > 1 AS conflict FROM part GROUP BY p_name""")
def identity_conflict_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), (F.min("p_brand") != F.max("p_brand")).alias("conflict"))


@query("FL-12 FL-13", """
SELECT 'order_without_customer' AS violation, o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0)
UNION ALL SELECT 'line_without_order', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 > 0)""")
def referential_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer").where("c_custkey % 10 > 0"), table(spark, sf_dir, "orders")
    a = relations.violations(orders, "o_custkey", customers, "c_custkey", "order_without_customer")
    return a.unionByName(relations.violations(table(spark, sf_dir, "lineitem"), "l_orderkey", orders.where("o_orderkey % 10 > 0"), "o_orderkey", "line_without_order"))


@query("ST-09", """
SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AND max(l_linenumber) = count(*) AS covered FROM lineitem GROUP BY l_orderkey""")
def partition_cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(((F.count("*") == F.size(F.collect_set("l_linenumber"))) & (F.max("l_linenumber") == F.count("*"))).alias("covered"))


@query("JN-29", """
WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier), b AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey)
SELECT n_name, CASE WHEN a.k IS NULL AND b.k IS NULL THEN 'none' WHEN a.k IS NULL THEN 'no_supplier' WHEN b.k IS NULL THEN 'no_customer' ELSE 'both' END AS reason
FROM nation LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey""")
def office_two_way_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("a")).distinct()
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("b")).distinct()
    df = table(spark, sf_dir, "nation").join(a, F.col("a") == F.col("n_nationkey"), "left").join(b, F.col("b") == F.col("n_nationkey"), "left")
    reason = F.when(F.col("a").isNull() & F.col("b").isNull(), "none").when(F.col("a").isNull(), "no_supplier").when(F.col("b").isNull(), "no_customer").otherwise("both")
    return df.select("n_name", reason.alias("reason"))


@query("JN-19", "SELECT r_name, n_name FROM region, nation")
def parameter_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_name").join(table(spark, sf_dir, "nation").select("n_name"))  # two fixed lists


@query("FL-06", """
SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '1') ORDER BY c_name, c_custkey LIMIT 24 OFFSET 24""")
def people_directory_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.offset_page(table(spark, sf_dir, "customer").where(F.col("c_name").contains("1")), [F.col("c_name"), F.col("c_custkey")], 24, 1).select("c_custkey", "c_name")


@query("SL-07", """
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey LIMIT 100""")
def priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, "o_orderpriority", "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")


@query("FL-20 GR-15", """
SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_size <= 10 AND l_returnflag = 'R') OR (p_size > 40 AND l_returnflag = 'A')""")
def typed_endpoint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") <= 10, "R").when(F.col("p_size") > 40, "A")
    allowed = table(spark, sf_dir, "part").select("p_partkey", kind.alias("flag")).where("flag IS NOT NULL")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return lines.join(allowed, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("flag") == F.col("l_returnflag")), "left_semi").select("l_orderkey", "l_linenumber")
