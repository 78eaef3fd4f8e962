"""Read surface and change data: opaque cursors, publication gates, resolved identities, tenures, snapshots, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import forms
from ..functions import text as words
from ..operators import ordered, paging, relations
from .people import case
from .registry import query, table


@query("SL-01 SF-22 FL-01", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 25""")
def feed_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first, by the opaque cursor that the first one gave; a cursor of another filter is refused."""
    order, wanted = [("o_orderdate", True), ("o_orderkey", True)], {"priority": "1-URGENT"}
    feed = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    _, cursor = paging.cursor_page(feed, order, 25, wanted)
    page, _ = paging.cursor_page(feed, order, 25, wanted, cursor)
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SL-02", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 40""")
def timeline_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys, one of them in the other direction."""
    order = [("o_orderstatus", False), ("o_totalprice", True), ("o_orderkey", False)]
    df = table(spark, sf_dir, "orders")
    _, cursor = paging.cursor_page(df, order, 40, {})
    page, _ = paging.cursor_page(df, order, 40, {}, cursor)
    return page.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SL-04 FL-06 WN-18", """WITH o AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS office, max(o_orderdate) AS seen FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT c_custkey, c_name || CASE WHEN c_custkey % 9 = 0 THEN ' 100%_x' ELSE '' END AS name, office FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_custkey % 9 = 0 AND c_name > 'Customer#000000030' ORDER BY c_name, c_custkey LIMIT 20""")
def people_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People whose name holds a text, wild cards taken literally, with their latest office, by name and id after a cursor."""
    name = F.concat("c_name", F.when(F.col("c_custkey") % 9 == 0, " 100%_x").otherwise(""))
    df = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).where(F.col("name").contains("0%_x"))
    page = paging.keyset_page(df, [("name", False), ("c_custkey", False)], 19, ["Customer#000000030", -1])
    latest = ordered.latest_by(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return page.join(latest.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("office")), "c_custkey", "left").select("c_custkey", "name", "office")


@query("SL-05", """SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 20) AS total FROM part WHERE p_size > 20 ORDER BY p_name, p_partkey LIMIT 24 OFFSET 24""")
def paged_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 24 with the number of all."""
    df = table(spark, sf_dir, "part").where("p_size > 20").select("p_partkey", "p_name")
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return paging.offset_page(df, [F.col("p_name"), F.col("p_partkey")], 24, 1).join(total)


@query("FL-05", """SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0 OR s_acctbal < 2000 ORDER BY s_suppkey % 3 > 0, s_acctbal, s_suppkey LIMIT 30""")
def due_for_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Never verified, or last before the cutoff; the oldest thirty."""
    df = table(spark, sf_dir, "supplier").withColumn("verified", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")))
    due = df.where(F.col("verified").isNull() | (F.col("verified") < 2000))
    return due.orderBy(F.col("verified").isNotNull(), "s_acctbal", "s_suppkey").limit(30).select("s_suppkey", "s_name")


@query("FL-07 FL-08 SM-07", """WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderkey % 3 AS has, o_orderstatus AS state, (['content', 'explanation', 'extraction', 'content'])[1 + o_custkey % 4] AS change FROM orders),
g AS (SELECT *, has = 0 OR state <> 'P' AS shown, has = 0 OR (state <> 'P' AND change NOT IN ('explanation', 'extraction')) AS told FROM v), n AS (SELECT max(o_orderdate) AS at FROM orders)
SELECT o_orderkey, told AND o_orderdate >= n.at - INTERVAL 700 DAY AND o_orderdate < n.at AND o_orderkey % 5 > 0 AS in_digest FROM g, n WHERE shown""")
def publication_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions without a context or with a published one are shown; a digest leaves out changes of explanation or extraction
    only, takes those of its window, and none that was delivered."""
    k, who = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    contexts = orders.where(k % 3 > 0).select(k, F.col("o_orderstatus").alias("state"), case(who, "content", "explanation", "extraction", "content").alias("change"))
    gated = orders.select("o_orderkey", "o_orderdate").join(contexts, "o_orderkey", "left").where(F.col("state").isNull() | (F.col("state") != "P"))
    delivered = orders.where(k % 5 == 0).select(k, F.lit(True).alias("delivered"))
    now = F.broadcast(orders.agg(F.max("o_orderdate").alias("now")))  # one row
    df = gated.join(delivered, "o_orderkey", "left").join(now)
    window = (F.col("o_orderdate") >= F.col("now") - F.expr("INTERVAL 700 DAYS")) & (F.col("o_orderdate") < F.col("now"))
    told = F.col("change").isNull() | ~F.col("change").isin("explanation", "extraction")
    return df.select("o_orderkey", (told & window & F.col("delivered").isNull()).alias("in_digest"))


@query("JN-11", """SELECT o_orderkey FROM orders WHERE o_custkey % 40 = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 = 3 OR l_suppkey = 5) OR o_orderdate::DATE = DATE '1996-01-02' OR o_orderkey % 61 = 4""")
def batches_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that name an id as issue, entity, relation end, context or document; documents stand in JSON."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    raw = orders.select("o_orderkey", F.to_json(F.struct(F.array(F.struct((F.col("o_orderkey") % 61).alias("id"))).alias("documents"))).alias("payload"))
    documents = raw.select("o_orderkey", F.explode(F.from_json("payload", "documents array<struct<id: bigint>>")["documents"]).alias("d")).where("d.id = 4")
    day = orders.where(F.to_date("o_orderdate") == F.lit("1996-01-02").cast("date"))
    return relations.any_exists(
        orders.select("o_orderkey"), "o_orderkey", (orders.where("o_custkey % 40 = 7"), "o_orderkey"), (lines.where("l_partkey % 50 = 3"), "l_orderkey"), (lines.where("l_suppkey = 5"), "l_orderkey"), (day, "o_orderkey"), (documents, "o_orderkey")
    )


@query("JN-13", """WITH a AS (SELECT c_custkey AS alias, c_custkey - 1 AS target FROM customer WHERE c_custkey % 10 = 3), l AS (SELECT o_orderkey, coalesce(target, o_custkey) AS who FROM orders LEFT JOIN a ON alias = o_custkey),
r AS (SELECT s_suppkey, coalesce(target, s_suppkey) AS who FROM supplier LEFT JOIN a ON alias = s_suppkey) SELECT o_orderkey, s_suppkey FROM l JOIN r USING (who)""")
def aliases_on_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ids are equal if they are aliases of one; both sides are resolved before they meet."""
    aliases = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") - 1).alias("target"))
    left = relations.resolved(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("who")), "who", aliases, "alias", "target")
    right = relations.resolved(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("who")), "who", aliases, "alias", "target")
    return left.join(right, "who").select("o_orderkey", "s_suppkey")


@query("JN-16", """WITH t AS (SELECT o_custkey AS person, o_orderkey AS tenure, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderdate + INTERVAL 9 HOUR)::DATE END AS a, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderdate + INTERVAL 9 HOUR)::DATE + 90 END AS b, (o_orderdate + INTERVAL 9 HOUR)::DATE + 30 AS seen, o_orderkey % 7 AS proof FROM orders),
e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS person, (l_shipdate + INTERVAL 20 HOUR)::DATE AS day, l_partkey % 7 AS proof FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(tenure) AS tenure FROM e JOIN t USING (person) WHERE CASE WHEN a IS NOT NULL THEN day >= a AND day <= coalesce(b, seen) ELSE t.proof = e.proof AND day = seen AND (b IS NULL OR day <= b) END GROUP BY ALL""")
def tenure_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tenure that holds on an event's day in Seoul: from its first to its last day, an open one up to the day it was
    seen; one without a first day only on that day and by evidence of the event itself."""
    orders = table(spark, sf_dir, "orders")
    day, k = words.kst_date(F.col("o_orderdate")), F.col("o_orderkey")
    tenures = orders.select(F.col("o_custkey").alias("person"), k.alias("tenure"), F.when(k % 5 > 0, day).alias("a"), F.when(k % 3 == 0, F.date_add(day, 90)).alias("b"), F.date_add(day, 30).alias("seen"), (k % 7).alias("own"))
    events = table(spark, sf_dir, "lineitem").join(orders.select(k.alias("l_orderkey"), F.col("o_custkey").alias("person")), "l_orderkey")
    at = words.kst_date(F.col("l_shipdate") + F.expr("INTERVAL 11 HOURS"))
    events = events.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "person", at.alias("day"), (F.col("l_partkey") % 7).alias("proof"))
    met = relations.tenure_at(events, tenures, ["person"], F.col("own") == F.col("proof"))
    return met.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("tenure").alias("tenure"))


@query("JN-21 CD-10 CD-13", """WITH o AS (SELECT c_custkey AS key, c_name AS name, c_mktsegment AS body FROM customer WHERE c_custkey % 11 > 0), n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 1 THEN c_name || ' II' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 2 THEN c_mktsegment || '+' ELSE c_mktsegment END AS body FROM customer WHERE c_custkey % 13 > 0)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'removed' WHEN o.name <> n.name THEN 'renamed' WHEN o.body <> n.body THEN 'changed' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.key = n.key""")
def roster_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new roster does to an old one; a new name under the same id comes before other changes."""
    k, name = F.col("c_custkey"), F.col("c_name")
    c = table(spark, sf_dir, "customer")
    old = c.where(k % 11 > 0).select(k.alias("key"), name.alias("name"), F.col("c_mktsegment").alias("body"))
    new = c.where(k % 13 > 0).select(k.alias("key"), F.when(k % 6 == 1, F.concat(name, F.lit(" II"))).otherwise(name).alias("name"), F.when(k % 4 == 2, F.concat("c_mktsegment", F.lit("+"))).otherwise(F.col("c_mktsegment")).alias("body"))
    return relations.roster_diff(old, new, "key", "name", ["body"])


@query("CD-02", """WITH r AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 1000 DAY)
SELECT 'record' AS what, o_orderkey AS key FROM r UNION ALL SELECT 'link', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM r))
UNION ALL SELECT 'person', o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_orderkey IN (SELECT o_orderkey FROM r))""")
def snapshot_finalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when a snapshot is closed: records not seen since its start, their links, and people without any other record."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    start = F.broadcast(orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 1000 DAYS")).alias("start")))  # one row
    marked = orders.join(start).withColumn("gone", F.col("o_orderdate") < F.col("start"))
    gone = marked.where("gone")
    links = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    people = marked.groupBy("o_custkey").agg(F.bool_and("gone").alias("gone")).where("gone")
    part = lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).alias("key"))
    return part(gone, "record", "o_orderkey").union(part(links, "link", "l_orderkey")).union(part(people, "person", "o_custkey"))


@query("SM-02 SNK-06", """WITH runs AS (SELECT o_custkey % 50 AS source, o_orderdate AS started, bool_and(o_orderstatus = 'F') OVER (PARTITION BY o_custkey % 50, o_orderdate) AS complete FROM orders),
w AS (SELECT source, max(started) FILTER (complete) AS wm, max(started) AS last FROM runs GROUP BY source)
SELECT source, count(*) FILTER (source % 7 = 0 OR wm IS NULL OR o_orderdate >= wm) AS refetch FROM w JOIN orders ON o_custkey % 50 = source GROUP BY source""")
def incremental_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many children a source fetches again: those changed since its last complete run began, all of them without one or in
    the weekly reconciliation."""
    orders = table(spark, sf_dir, "orders").withColumn("source", F.col("o_custkey") % 50)
    runs = orders.groupBy("source", "o_orderdate").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("complete"))
    marks = runs.groupBy("source").agg(F.max(F.when(F.col("complete"), F.col("o_orderdate"))).alias("wm"))
    again = (F.col("source") % 7 == 0) | F.col("wm").isNull() | (F.col("o_orderdate") >= F.col("wm"))
    return orders.join(marks, "source").groupBy("source").agg(F.count_if(again).alias("refetch"))


@query("SM-12", """WITH a AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderstatus AS state, o_orderpriority AS reason FROM orders), l AS (SELECT key, arg_max(state, seq) AS state, arg_max(reason, seq) AS reason, count(*) AS attempts FROM a GROUP BY key)
SELECT key, CASE WHEN reason = '1-URGENT' THEN 'shorter' WHEN reason IN ('2-HIGH', '3-MEDIUM') THEN 'repair' ELSE 'same' END AS plan, attempts + 1 AS version FROM l WHERE state = 'O' AND attempts < 12""")
def retry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every logical key whose latest attempt failed: what is changed follows from why, the version goes up."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey").alias("l"), F.count("*").alias("attempts"))
    plan = F.when(F.col("l.o_orderpriority") == "1-URGENT", "shorter").when(F.col("l.o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "repair").otherwise("same")
    return a.where((F.col("l.o_orderstatus") == "O") & (F.col("attempts") < 12)).select("key", plan.alias("plan"), (F.col("attempts") + 1).alias("version"))


@query("AG-14", """SELECT level, name, count(*) AS n FROM (SELECT unnest(['all', 'kind', 'brand']) AS level, unnest(['all', p_type, split_part(p_brand, '#', 1)]) AS name FROM part) GROUP BY ALL""")
def coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by level in one pass over rows of (level, name)."""
    levels = F.array(*[F.struct(F.lit(level).alias("level"), name.alias("name")) for level, name in (("all", F.lit("all")), ("kind", F.col("p_type")), ("brand", F.split("p_brand", "#")[0]))])
    return table(spark, sf_dir, "part").select(F.explode(levels).alias("l")).groupBy("l.level", "l.name").agg(F.count("*").alias("n"))


@query("AG-28", """WITH s AS (SELECT l_orderkey AS artifact, 's' || l_suppkey AS scope, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY l_orderkey, l_suppkey) SELECT artifact, string_agg(scope || ':' || part, ',' ORDER BY scope) AS sources FROM s GROUP BY artifact""")
def merged_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of an artifact, the last of each scope, in the order of scopes."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("artifact"), F.concat(F.lit("s"), "l_suppkey").alias("scope")).agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("scope", "part")))
    return last.groupBy("artifact").agg(F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["scope"], s["part"])), ",").alias("sources"))


@query("SF-07", """SELECT event_id, (props::JSON ->> 'k')::INTEGER AS k, (props::JSON ->> 'k')::INTEGER >= 50 AS large, 2 AS size FROM events WHERE props IS NOT NULL""")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracting, searching and measuring of JSON arrays and objects."""
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.to_json(F.struct(F.array(F.struct(k.alias("id")), F.struct((k + 1).alias("id"))).alias("tenures"), F.when(k >= 50, F.array(F.lit("large"))).otherwise(F.array(F.lit("small"))).alias("tags")))
    df = table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", doc.alias("doc"))
    tags = F.from_json(F.get_json_object("doc", "$.tags"), "array<string>")
    return df.select("event_id", F.get_json_object("doc", "$.tenures[0].id").cast("int").alias("k"), F.array_contains(tags, "large").alias("large"), F.json_array_length(F.get_json_object("doc", "$.tenures")).alias("size"))


@query("SF-34", """SELECT count(*) AS pairs, count(*) FILTER (ts > p) AS later, count(*) FILTER (epoch_ms(ts) = epoch_ms(p) AND ts > p) AS within_a_millisecond FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL""")
def microsecond_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events told apart by microseconds."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    df = table(spark, sf_dir, "events").select("ts", before.alias("p")).where("p IS NOT NULL")
    same = F.date_trunc("millisecond", "ts") == F.date_trunc("millisecond", "p")
    return df.agg(F.count("*").alias("pairs"), F.count_if(F.col("ts") > F.col("p")).alias("later"), F.count_if(same & (F.col("ts") > F.col("p"))).alias("within_a_millisecond"))


@query("SNK-08", """WITH v AS (SELECT o_custkey AS scope, o_orderkey AS seq, o_orderstatus AS h, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT scope, arg_max(h, seq) AS fingerprint, count(*) FILTER (p IS NULL OR p <> h) AS generation, scope % 6 > 0 AS active FROM v GROUP BY scope""")
def source_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after all puts: the last content, which generation that is, and whether the scope was retired."""
    df = ordered.changes(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], "o_orderstatus")
    return df.groupBy(F.col("o_custkey").alias("scope")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("fingerprint"), F.max("generation").alias("generation")).withColumn("active", F.col("scope") % 6 > 0)


@query("FL-17 PJ-08", """SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN 'contact' WHEN o_custkey % 6 = 1 THEN 'licence' WHEN o_custkey % 6 = 2 THEN 'body' WHEN o_orderstatus = 'P' THEN 'date' ELSE 'publish' END AS reason, CASE WHEN o_custkey % 6 = 2 THEN '본문 없음' ELSE '본문 있음' END || CASE WHEN o_orderstatus = 'P' THEN ' · 게시일 없음' ELSE '' END AS coverage FROM orders""")
def announcement_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which announcements a person must see and why, with what their source covers."""
    who = F.col("o_custkey")
    text = case(who, F.concat(F.lit("문의 02-123-"), F.lpad((who % 10000).cast("string"), 4, "0")), "본문", "", "본문", "본문", "본문")
    licence, published = F.when(who % 6 == 1, "restricted").otherwise("allowed"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    reason = F.when(forms.has_contact(text), "contact").when(licence != "allowed", "licence").when(F.trim(text) == "", "body").when(published.isNull(), "date").otherwise("publish")
    coverage = F.concat_ws(" · ", F.when(F.trim(text) == "", "본문 없음").otherwise("본문 있음"), F.when(published.isNull(), "게시일 없음"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"), coverage.alias("coverage"))
