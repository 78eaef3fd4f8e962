"""Queries over the graph of published revisions.  Orders are revisions, their lines relations between customers and parts
with evidence in documents of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge, routing
from ..sources.landing import folder, landed
from .registry import query, table

_LINES = """lines AS (SELECT l_orderkey AS batch, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, min(l_returnflag) AS flag, min(l_discount) AS discount,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ref FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
rev AS (SELECT o_orderkey AS batch, o_orderdate AS reviewed_at FROM orders WHERE o_orderstatus <> 'P'),
ent AS (SELECT o_orderkey AS batch, 'person' AS kind, 'c' || o_custkey AS id, 'Customer ' || o_custkey || ' ' || o_orderpriority AS name FROM orders
  UNION ALL SELECT batch, 'bill', 'p' || part, 'Part ' || part || ' ' || flag FROM lines),
nodes AS (SELECT kind || ':' || id AS key, kind, id, name AS label FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY reviewed_at DESC, batch DESC, name) AS r FROM ent JOIN rev USING (batch)) WHERE r = 1),
rel AS (SELECT lines.batch, ref, 'c' || o_custkey AS subject, 'p' || part AS object, CASE WHEN line % 2 = 0 THEN 'co_sponsor' ELSE 'lead_sponsor' END AS type,
  CASE flag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS decision, supp, discount FROM lines JOIN orders ON o_orderkey = lines.batch),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, object, type ORDER BY reviewed_at DESC, batch DESC, ref DESC) AS r FROM rel JOIN rev USING (batch)) WHERE r = 1)"""


def _edges(decision: str, good: str, label: str) -> str:
    return f"""kept AS (SELECT * FROM latest WHERE {decision} AND {good}),
edges0 AS (SELECT 'person:' || subject AS source, 'bill:' || object AS target, type, {label} AS label, ref FROM kept
  UNION SELECT k, 'document:s' || supp, 'supported_by', '{knowledge.SUPPORT}', ref FROM (SELECT unnest(['person:' || subject, 'bill:' || object]) AS k, supp, ref FROM kept)),
edges AS (SELECT 'ge_' || sha256(source || '|' || target || '|' || type || '|' || label || '|' || ref) AS id, source, target, type, label FROM edges0)"""


_PUBLIC = _edges("decision = 'approved'", "discount < 0.05", "type")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # Dealt by order alone, so that all of a revision stays in one place in what follows.
    df = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(*keys).agg(F.min("l_returnflag").alias("flag"), F.min("l_discount").alias("discount"))
    return df.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "flag", "discount", F.concat_ws("-", *keys).alias("ref"))


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relations, evidence, revisions)."""
    orders, held = table(spark, sf_dir, "orders"), lines(spark, sf_dir)
    people = orders.select(F.col("o_orderkey").alias("batch"), F.lit("person").alias("kind"), F.concat(F.lit("c"), "o_custkey").alias("id"), F.concat(F.lit("Customer "), "o_custkey", F.lit(" "), "o_orderpriority").alias("name"))
    bills = held.select("batch", F.lit("bill").alias("kind"), F.concat(F.lit("p"), "part").alias("id"), F.concat(F.lit("Part "), "part", F.lit(" "), "flag").alias("name"))
    decision = F.when(F.col("flag") == "A", "approved").when(F.col("flag") == "R", "rejected").otherwise("pending")
    who = orders.select(F.col("o_orderkey").alias("batch"), F.concat(F.lit("c"), "o_custkey").alias("subject"))
    relations = held.join(who, "batch").select("batch", F.col("ref").alias("relation_id"), "subject", F.concat(F.lit("p"), "part").alias("object"), F.when(F.col("line") % 2 == 0, "co_sponsor").otherwise("lead_sponsor").alias("type"), decision.alias("decision"), F.array("ref").alias("evidence"))
    evidence = held.select("batch", F.col("ref").alias("id"), F.concat(F.lit("s"), "supp").alias("document"), (F.col("discount") < 0.05).alias("usable"), (F.col("discount") < 0.08).alias("available"))
    revisions = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("batch"), F.col("o_orderdate").alias("reviewed_at"))
    return people.union(bills), relations, evidence, revisions


def graph(spark: SparkSession, sf_dir: str, candidate: bool = False) -> tuple[DataFrame, DataFrame]:
    entities, relations, evidence, revisions = parts(spark, sf_dir)
    return knowledge.nodes(entities, revisions), knowledge.edges(relations, evidence, entities, revisions, knowledge.keys(entities, revisions), candidate)


@query("GR-01", f"WITH {_LINES} SELECT key, kind, id, label FROM nodes")
def knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, _, _, revisions = parts(spark, sf_dir)
    return knowledge.nodes(entities, revisions)


@query("GR-01 GR-02 GR-03", f"WITH {_LINES}, {_PUBLIC} SELECT id, source, target, type, label FROM edges")
def knowledge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1].select("id", "source", "target", "type", "label")


@query("GR-07", f"""WITH {_LINES}, {_edges("true", "discount < 0.08", "CASE decision WHEN 'pending' THEN '검수 대기: ' WHEN 'rejected' THEN '기각: ' ELSE '' END || type")}
SELECT id, source, target, type, label FROM edges""")
def knowledge_candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, candidate=True)[1].select("id", "source", "target", "type", "label")


_ROOTS = "roots AS (SELECT 'person:c' || c_custkey AS root FROM customer WHERE c_custkey % 50 = 0)"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("person:c"), "c_custkey").alias("root"))


_WALK = f"""WITH {_LINES}, {_PUBLIC}, {_ROOTS},
ends AS (SELECT id, type, 0 AS e, source AS node FROM edges UNION ALL SELECT id, type, 1, target FROM edges),
f1 AS (SELECT root, node, 1 + row_number() OVER (PARTITION BY root ORDER BY o) AS place FROM (
  SELECT root, b.node, min({{{{'type': b.type, 'id': b.id, 'e': b.e}}}}) AS o FROM roots JOIN ends a ON a.node = root JOIN ends b ON b.id = a.id WHERE b.node <> root GROUP BY root, b.node)),
s1 AS (SELECT root, root AS node, 1 AS place, 0 AS distance FROM roots UNION ALL SELECT root, node, place, 1 FROM f1 WHERE place <= 40),
f2 AS (SELECT root, node, n + row_number() OVER (PARTITION BY root ORDER BY o) AS place FROM (
  SELECT s1.root, b.node, min({{{{'type': b.type, 'id': b.id, 'e': b.e}}}}) AS o FROM s1 JOIN ends a ON a.node = s1.node JOIN ends b ON b.id = a.id WHERE s1.distance = 1
    AND NOT EXISTS (SELECT 1 FROM s1 x WHERE x.root = s1.root AND x.node = b.node) GROUP BY s1.root, b.node) JOIN (SELECT root, max(place) AS n FROM s1 GROUP BY root) USING (root)),
s2 AS (SELECT * FROM s1 UNION ALL SELECT root, node, place, 2 FROM f2 WHERE place <= 40),
cut AS (SELECT DISTINCT root FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) WHERE place > 40)""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


@query("GR-04 SL-09", _WALK + " SELECT root, node, place, distance, EXISTS (SELECT 1 FROM cut WHERE cut.root = s2.root) AS truncated FROM s2")
def knowledge_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhoods of 40 nodes around every fiftieth customer, in the order of admission, root first."""
    found, flags = knowledge.neighbourhood(graph(spark, sf_dir)[1], roots(spark, sf_dir), depth=2, limit=40)
    return found.join(flags, "root").select("root", "node", F.col("place").cast("bigint").alias("place"), "distance", "truncated")


@query("SL-09", _WALK + """ SELECT a.root, row_number() OVER (PARTITION BY a.root ORDER BY type, id) AS place, id FROM edges JOIN s2 a ON a.node = source JOIN s2 b ON b.root = a.root AND b.node = target""")
def knowledge_inner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the nodes of each neighbourhood, by type and id."""
    known = landed(graph(spark, sf_dir)[1].select("id", "source", "target", "type"), folder(spark, "inner-edges"))
    found, _ = knowledge.neighbourhood(known, roots(spark, sf_dir), depth=2, limit=40)
    return knowledge.inner_edges(known, found).select("root", F.col("place").cast("bigint").alias("place"), "id")


@query("GR-06", f"""WITH {_LINES}, {_ROOTS} SELECT root, coalesce(label, 'Customer#' || lpad(substr(root, 9), 9, '0')) AS label, label IS NULL AS from_directory FROM roots LEFT JOIN nodes ON key = root""")
def knowledge_root_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root that no revision names takes its name from the directory."""
    entities, _, _, revisions = parts(spark, sf_dir)
    known = knowledge.nodes(entities, revisions).select(F.col("key").alias("root"), "label")
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("person:c"), "c_custkey").alias("root"), "c_name")
    df = roots(spark, sf_dir).join(known, "root", "left").join(names, "root", "left")
    return df.select("root", F.coalesce("label", "c_name").alias("label"), F.col("label").isNull().alias("from_directory"))


@query("GR-09", f"""WITH {_LINES}, {_PUBLIC}, {_ROOTS}, hop AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
d1 AS (SELECT DISTINCT root, b AS node FROM roots JOIN hop ON a = root WHERE b <> root),
d2 AS (SELECT DISTINCT root, b AS node FROM d1 JOIN hop ON a = node WHERE b <> root AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.root = d1.root AND x.node = b))
SELECT root, 0 AS distance, 1::BIGINT AS n FROM roots UNION ALL SELECT root, 1, count(*) FROM d1 GROUP BY root UNION ALL SELECT root, 2, count(*) FROM d2 GROUP BY root""")
def layout_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes are how far from each root, as a layout places them on rings."""
    return knowledge.distances(graph(spark, sf_dir)[1], roots(spark, sf_dir), 2).groupBy("root", "distance").agg(F.count("*").alias("n"))


@query("GR-05", """WITH RECURSIVE keys AS (SELECT o_orderkey AS batch, 'c' || o_custkey // 5 AS key FROM orders UNION SELECT o_orderkey, 'd' || strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderpriority = '1-URGENT'),
found AS (SELECT 0::BIGINT AS batch UNION SELECT b.batch FROM found JOIN keys a USING (batch) JOIN keys b ON b.key = a.key) SELECT batch FROM found""")
def revision_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that share a customer group, or the day if urgent, with order 0, directly or through others."""
    orders = table(spark, sf_dir, "orders")
    groups = orders.select(F.col("o_orderkey").alias("batch"), F.concat(F.lit("c"), F.floor(F.col("o_custkey") / 5)).alias("key"))
    days = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("batch"), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("key"))
    return knowledge.closure(groups.union(days), spark.range(1).select(F.col("id").alias("batch")), revisions=10**9)


@query("GR-11 JN-25", """WITH ask AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 100 = 0),
l AS (SELECT 'p' || l_partkey AS subject, 'p' || (l_partkey + l_linenumber) AS object, CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'approved' END AS decision, l_shipdate AS shipped, l_orderkey AS batch, l_suppkey AS rel FROM lineitem),
r AS (SELECT subject, object FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY shipped DESC, batch DESC, rel DESC, decision) AS k FROM l) WHERE k = 1 AND decision = 'approved')
SELECT id, subject, object, place FROM (SELECT id, subject, object, row_number() OVER (PARTITION BY id ORDER BY subject, object) AS place FROM ask JOIN r ON subject = id OR object = id) WHERE place <= 100""")
def bill_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop either side of a bill, by the latest decision on each pair; one join over both ends."""
    bill = lambda c: F.concat(F.lit("p"), c)
    df = table(spark, sf_dir, "lineitem").select(bill(F.col("l_partkey")).alias("subject"), bill(F.col("l_partkey") + F.col("l_linenumber")).alias("object"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("decision"), "l_shipdate", "l_orderkey", "l_suppkey")
    newest = [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_suppkey")] + [F.col("decision")]
    latest = knowledge.ranked(df, ["subject", "object"], newest).where("rank = 1 AND decision = 'approved'").select("subject", "object")
    asked = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(bill(F.col("p_partkey")).alias("id"))
    ends = latest.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("id"), "subject", "object").join(asked, "id")
    return knowledge.ranked(ends, ["id"], [F.col("subject"), F.col("object")], "place").where("place <= 100").select("id", "subject", "object", F.col("place").cast("bigint").alias("place"))


@query("GR-08 AG-25", """WITH n AS (SELECT 'c' || o_custkey AS id, min(o_orderpriority) AS name, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY o_custkey),
e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'd' || strftime(o_orderdate, '%Y-%m-%d') AS b FROM orders),
roots AS (SELECT 'c' || c_custkey AS root FROM customer WHERE c_custkey % 50 = 0),
near AS (SELECT root, root AS node FROM roots UNION SELECT root, b FROM roots JOIN e ON a = root UNION SELECT root, f.a FROM roots JOIN e ON e.a = root JOIN e f ON f.b = e.b),
p AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY node <> root, node) AS place, count(*) OVER (PARTITION BY root) > 20 AS truncated FROM near)
SELECT root, node, place, truncated, coalesce(conflict, false) AS conflict FROM p LEFT JOIN n ON n.id = node WHERE place <= 20""")
def private_graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops, root first, then by id; 20 of them, with whether there are more and whose names differ."""
    orders = table(spark, sf_dir, "orders")
    customer = F.concat(F.lit("c"), "o_custkey")
    named = orders.groupBy(customer.alias("node")).agg((F.size(F.collect_set("o_orderpriority")) > 1).alias("conflict"))
    edges = orders.select(customer.alias("source"), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("target")).distinct()
    asked = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("root"))
    placed, size = knowledge.nearest_two(edges, asked, 20)
    return placed.join(size, "root").join(named, "node", "left").select("root", "node", F.col("place").cast("bigint").alias("place"), "truncated", F.coalesce("conflict", F.lit(False)).alias("conflict"))


_DAG = """WITH RECURSIVE a AS (SELECT p_partkey AS id, p_size AS version, p_partkey % 53 <> 5 AS ok FROM part),
c AS (SELECT p_partkey AS id, p_partkey // 3 AS child, q.p_size + (p_partkey % 97 = 7)::INTEGER AS child_version FROM part JOIN (SELECT p_partkey AS k, p_size FROM part) q ON q.k = p_partkey // 3 WHERE p_partkey > 2)"""


def dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("version"))
    artifacts = part.withColumn("ok", F.col("id") % 53 != 5)
    below = part.select(F.col("id").alias("child"), F.col("version").alias("pinned"))
    children = part.where("id > 2").select("id", F.floor(F.col("id") / 3).alias("child")).join(below, "child")
    return artifacts, children.select("id", "child", (F.col("pinned") + (F.col("id") % 97 == 7).cast("int")).alias("child_version"))


@query("GR-12", _DAG + """, w AS (SELECT id AS root, id, 0 AS level, NOT ok AS bad FROM a
  UNION ALL SELECT w.root, c.child, w.level + 1, coalesce(NOT x.ok OR c.child_version <> x.version, true) OR w.level + 1 > 4 FROM w JOIN c ON c.id = w.id LEFT JOIN a x ON x.id = c.child WHERE w.level <= 4)
SELECT root AS id, NOT bool_or(bad) AS valid FROM w GROUP BY root""")
def artifact_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts whose pinned children are valid in that version, at most four levels below (the operator's default is nine)."""
    artifacts, children = dag(spark, sf_dir)
    return knowledge.valid_artifacts(artifacts, children, levels=4)


@query("GR-13", _DAG + """, s AS (SELECT id FROM a WHERE NOT ok UNION SELECT c.id FROM c JOIN a x ON x.id = c.child WHERE c.child_version <> x.version UNION SELECT c.id FROM s JOIN c ON c.child = s.id)
SELECT 'artifact' AS what, id FROM s UNION ALL SELECT 'job', p_partkey FROM part JOIN s ON s.id = p_partkey // 2 WHERE p_partkey % 4 <> 0 AND p_partkey % 5 <> 0""")
def reconcile_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reconciliation retires: stale artifacts up to the roots, and the jobs on them that nobody holds."""
    artifacts, children = dag(spark, sf_dir)
    jobs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job"), F.floor(F.col("p_partkey") / 2).alias("id"), (F.col("p_partkey") % 4 == 0).alias("leased"), (F.col("p_partkey") % 5 == 0).alias("obsolete"))
    stale, dropped = knowledge.retired(artifacts, children, jobs)
    return stale.select(F.lit("artifact").alias("what"), "id").union(dropped.select(F.lit("job"), F.col("job").alias("id")))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reports, parts of large last lines as their anchors."""
    last = table(spark, sf_dir, "lineitem").where("l_linenumber = 7 AND l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("anchor"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id")).join(last, "o_orderkey").select("id", "anchor")


@query("TX-13")
def routed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports grouped by shared anchors, three at most; a sequence in the rule, tested against its plain reading."""
    return routing.routed(anchors(spark, sf_dir))


@query("GR-14", """SELECT left(sha256(p_brand), 2) AS bucket, 'leaf:' || left(sha256(p_brand), 2) || ':' || sha256(p_partkey::VARCHAR) AS window_key, p_partkey AS artifact FROM part WHERE p_size > 2""")
def leaf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planning window per artifact that has nodes, in the bucket of its source's scope."""
    bucket = F.left(F.sha2("p_brand", 256), F.lit(2))
    return table(spark, sf_dir, "part").where("p_size > 2").select(bucket.alias("bucket"), F.concat(F.lit("leaf:"), bucket, F.lit(":"), F.sha2(F.col("p_partkey").cast("string"), 256)).alias("window_key"), F.col("p_partkey").alias("artifact"))


@query("GR-14")
def report_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents over reports that share anchors, level by level up to a root or to what shares nothing; tested against a plain
    reading."""
    return routing.hierarchy(anchors(spark, sf_dir))


@query("GR-16", """WITH RECURSIVE leaf AS (SELECT DISTINCT o_custkey AS id, l_partkey AS anchor FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 7 AND l_quantity > 40),
up AS (SELECT id, anchor, 0 AS level FROM leaf UNION SELECT CASE WHEN id < 1000000 THEN 1000000 + id % 100000 // 10 ELSE 2000000 + id % 1000000 // 10 END, anchor, level + 1 FROM up WHERE level < 2)
SELECT DISTINCT id, anchor FROM up""")
def inherited_report_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of reports and of the two levels above them: ten customers to a report, ten of those to the next."""
    leaves = anchors(spark, sf_dir)
    one = leaves.select((1000000 + F.floor(F.col("id") % 100000 / 10)).alias("id"), F.col("id").alias("child")).distinct()
    two = one.select((2000000 + F.floor(F.col("id") % 1000000 / 10)).alias("id"), F.col("id").alias("child")).distinct()
    return knowledge.inherited_anchors(leaves, one.union(two), 2)
