"""Queries over evidence: excerpts, audits, mentions, retrieval, reductions, selections, readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import forms
from ..operators import batching, ordered, proofs, retrieval
from .knowledge import dag
from .people import case
from .registry import query, table


@query("PJ-10 PJ-11 WN-12 SF-20", """WITH s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seg FROM conversations),
w AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY seg) AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY seg) AS n, least(length(text), CASE WHEN seg % 3 = 0 THEN 0 ELSE 10 END) AS a FROM s),
e AS (SELECT *, CASE WHEN seg % 2 = 0 THEN length(text) ELSE least(length(text), a + 40) END AS b FROM w)
SELECT conv_id, seg, CASE WHEN role = 'user' THEN substr(text, a + 1, b - a) END AS excerpt, CASE WHEN a > 0 THEN substr(text, greatest(0, a - 300) + 1, a - greatest(0, a - 300)) WHEN p IS NOT NULL THEN right(p, 299) || chr(10) ELSE '' END AS before,
  CASE WHEN b < length(text) THEN substr(text, b + 1, 300) WHEN n IS NOT NULL THEN chr(10) || left(n, 299) ELSE '' END AS after FROM e""")
def evidence_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of turns with what stands around them; the words themselves are shown only under a licence that allows it."""
    seg = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    turns = table(spark, sf_dir, "conversations").withColumn("seg", seg)
    n = F.length("text")
    start = F.least(n, F.when(F.col("seg") % 3 == 0, 0).otherwise(10))
    spans = turns.select("conv_id", "seg", "role", start.alias("start"), F.when(F.col("seg") % 2 == 0, n).otherwise(F.least(n, start + 40)).alias("end"))
    df = proofs.excerpts(spans, turns.select("conv_id", "seg", "text"), ["conv_id"], "seg")
    return df.select("conv_id", F.col("seg").cast("bigint").alias("seg"), F.when(F.col("role") == "user", F.col("excerpt")).alias("excerpt"), "before", "after")


_PROOFS = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, n, unnest(range(0, (n // 300) + 1)) AS k FROM d), q AS (SELECT doc_id, k, n, 300 * k + CASE WHEN doc_id % 7 = 2 THEN 280 ELSE 10 END AS a FROM p)"""


def cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(proofs, units) of all documents: a citation of forty characters per unit, some of them wrong."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    units = proofs.fixed_units(docs, "doc_id", "text", 300).withColumn("version", F.lit("v2"))
    k = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 300).cast("int"))).alias("proof")
    made = docs.select("doc_id", "text", k).withColumn("start", 300 * F.col("proof") + F.when(F.col("doc_id") % 7 == 2, 280).otherwise(10)).withColumn("end", F.col("start") + 40)
    words = F.concat(F.substring("text", F.col("start") + 1, F.lit(39)), F.when(F.col("doc_id") % 7 == 3, F.lit("␞")).otherwise(F.substring("text", F.col("start") + 40, F.lit(1))))
    made = made.where(F.col("end") <= F.length("text") + 60)
    return made.select("doc_id", "proof", F.when(F.col("doc_id") % 7 == 1, "v1").otherwise("v2").alias("version"), "start", "end", words.alias("text")), units


@query("JN-23 AG-26", _PROOFS + """ SELECT CASE WHEN n <= 300 * (a // 300) THEN 'missing' WHEN doc_id % 7 = 1 THEN 'version' WHEN a + 40 > least(n, 300 * (k + 1)) THEN 'interval' WHEN doc_id % 7 = 3 THEN 'wording' ELSE 'valid' END AS finding, count(*) AS n FROM q WHERE a + 40 <= n + 60 GROUP BY finding""")
def provenance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by what is wrong with them: no such unit, another version, outside the unit, other words."""
    made, units = cited(spark, sf_dir)
    return proofs.proof_findings(made, units, "doc_id", 300).groupBy("finding").agg(F.count("*").alias("n"))


@query("RT-09", """WITH u AS (SELECT doc_id, substr(text, 1, 300) AS t, substr(text, 1 + doc_id % 20, 2 + doc_id % 9) AS q FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT doc_id, CASE WHEN length(trim(q)) >= 2 AND len(string_split(t, q)) = 2 THEN strpos(t, q) - 1 END AS "start" FROM u""")
def unique_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a quote stands in the first unit of its document, if it stands there exactly once."""
    k = F.col("doc_id")
    units = proofs.fixed_units(table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", "text"), "doc_id", "text", 300).where("unit = 0")
    quote = F.substring("text", (1 + k % 20).cast("int"), (2 + k % 9).cast("int"))
    return units.select("doc_id", proofs.unique_quote(F.col("text"), quote, F.col("start"))["start"].cast("bigint").alias("start"))


@query("WN-14 PJ-17", """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 260), e AS (SELECT doc_id, n, 250 AS a, least(n, 270 + (doc_id % 5) * 200) AS b FROM d),
g AS (SELECT *, bool_or((doc_id + k) % 11 = 3) AS gap FROM (SELECT *, unnest(range(0, (b - 1) // 300 + 1)) AS k FROM e) GROUP BY ALL)
SELECT doc_id, CASE WHEN bool_or(gap) THEN '' ELSE array_to_string(list_sort(list(k)), ',') END AS units FROM g GROUP BY doc_id""")
def covering_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that cover a span of each document, in order; none if one of them is not kept."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 260).select("doc_id", "text")
    units = proofs.fixed_units(docs, "doc_id", "text", 300).where((F.col("doc_id") + F.col("unit")) % 11 != 3)
    spans = docs.select("doc_id", F.lit(0).alias("span"), F.lit(250).alias("start"), F.least(F.length("text"), (270 + F.col("doc_id") % 5 * 200).cast("int")).alias("end"))
    return proofs.covering_units(spans, units, "doc_id", 300).select("doc_id", F.array_join("units", ",").alias("units"))


def letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, names): letters that name customers by name and by nickname, which several share."""
    k = F.col("o_custkey")
    text = F.concat(F.lit("Meeting of Customer#"), F.lpad(k.cast("string"), 9, "0"), F.lit(" and nick <"), k % 40, F.lit("> on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 3 == 0, F.concat(F.lit("; Customer#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(""))
    texts = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    c = table(spark, sf_dir, "customer")
    names = c.select(F.col("c_name").alias("surface"), F.col("c_custkey").alias("person")).union(c.select(F.concat(F.lit("nick <"), F.col("c_custkey") % 40, F.lit(">")), "c_custkey"))
    return texts, names


@query("TX-12 JN-22 SL-13", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), n AS (SELECT c_custkey % 40 AS nick, count(*) AS n FROM customer GROUP BY nick)
SELECT k AS o_orderkey, 'Customer#' || lpad(c::VARCHAR, 9, '0') AS surface, 11 AS "start", 29 AS "end", 1::BIGINT AS persons FROM o
UNION ALL SELECT k, 'nick <' || c % 40 || '>', 34, 41 + length((c % 40)::VARCHAR), n FROM o JOIN n ON nick = c % 40
UNION ALL SELECT k, 'Customer#' || lpad(c::VARCHAR, 9, '0'), 57 + length((c % 40)::VARCHAR), 75 + length((c % 40)::VARCHAR), 1 FROM o WHERE c % 3 = 0""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a known name with its offsets and how many persons it may mean."""
    texts, names = letters(spark, sf_dir)
    return proofs.mentions(texts, "o_orderkey", "text", names).select("o_orderkey", "surface", "start", "end", F.size("candidates").cast("bigint").alias("persons"))


@query("FL-11", """SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 OR (o_custkey % 40) % 5 = 0 AND o_custkey % 40 < 10""")
def reviewed_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters whose evidence span, the first 42 characters, holds a whole approved mention."""
    texts, names = letters(spark, sf_dir)
    found = proofs.mentions(texts, "o_orderkey", "text", names)
    number = F.regexp_extract("surface", "([0-9]+)", 1).try_cast("int")
    approved = found.where(F.when(F.col("surface").startswith("nick"), number % 5 == 0).otherwise(number % 2 == 0))
    spans = texts.select("o_orderkey", F.lit(0).alias("span"), F.lit(0).alias("start"), F.lit(42).alias("end"))
    return proofs.within_span(approved, spans, "o_orderkey").select("o_orderkey")


@query("PJ-15", """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'A' || o_custkey ELSE '' END || CASE WHEN o_custkey % 4 = 1 THEN '|' || o_orderpriority ELSE '' END AS aliases FROM orders""")
def offered_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of an entity that its source holds literally; others are not offered."""
    k = F.col("o_custkey")
    text = F.concat_ws(" ", F.lit("source of"), F.when(k % 3 == 0, F.concat(F.lit("A"), k)), F.when(k % 4 == 1, F.col("o_orderpriority")))
    offered = F.filter(F.array(F.concat(F.lit("A"), k), F.col("o_orderpriority"), F.lit("absent")), lambda a: text.contains(a))
    out = F.when(F.array_contains(offered, F.col("o_orderpriority")), F.concat(F.when(k % 3 == 0, F.concat(F.lit("A"), k)).otherwise(""), F.lit("|"), "o_orderpriority")).otherwise(F.array_join(offered, "|"))
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("aliases"))


@query("PJ-13 WN-13", """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT doc_id, 0 AS "start", n AS "end" FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 0, least(90, n) FROM d WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 200, least(260, n) FROM d WHERE doc_id % 3 = 1 AND n > 200""")
def source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source may show: all of an allowed text, the cited intervals, merged, of one whose use is unknown, else nothing."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", F.length("text").alias("n"), case(F.col("doc_id"), "allowed", "unknown", "restricted").alias("licence"))
    whole = docs.where("licence = 'allowed'").select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end"))
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 50), (40, 90), (200, 260))])
    cited_ = docs.where("licence = 'unknown'").select("doc_id", "n", F.explode(spans).alias("s")).select("doc_id", "s.start", F.least("s.end", "n").alias("end")).where("start < end")
    return whole.union(ordered.merged_intervals(cited_, ["doc_id"], "start", "end").select("doc_id", "start", "end"))


@query("CD-07", """WITH e AS (SELECT l_orderkey AS k, string_agg(DISTINCT '"e' || lpad(l_partkey::VARCHAR, 8, '0') || '"', ',' ORDER BY '"e' || lpad(l_partkey::VARCHAR, 8, '0') || '"') AS ids FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, 'v_' || sha256('{"activity":{"stage":"' || o_orderstatus || '","title":"t' || o_custkey || '"},"context":{"evidenceIds":[' || ids || ']}}') AS version FROM orders JOIN e ON k = o_orderkey""")
def derived_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version of an activity from its content and sorted evidence; when it was seen and corrected is no part of it."""
    ids = F.array_sort(F.collect_set(F.concat(F.lit("e"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(ids.alias("evidenceIds"))
    content = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("stage"), F.concat(F.lit("t"), "o_custkey").alias("title")).alias("activity"), F.struct("evidenceIds").alias("context")))
    return table(spark, sf_dir, "orders").join(held, "o_orderkey").select("o_orderkey", F.concat(F.lit("v_"), F.sha2(content, 256)).alias("version"))


@query("JN-31", """WITH p AS (SELECT c_custkey FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)), r AS (SELECT n_regionkey, min(n_nationkey) AS org FROM nation GROUP BY n_regionkey HAVING count(*) FILTER (n_nationkey % 5 = n_regionkey % 5) = count(*))
SELECT c_custkey AS person, org, n_regionkey AS rule FROM p, r WHERE (SELECT count(*) FROM p) = 1""")
def ex_officio_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one president with the organisation of each rule whose members all agree; singletons by aggregation, not by joins of
    tables."""
    best = table(spark, sf_dir, "customer").groupBy("c_acctbal").agg(F.count("*").alias("n"), F.min("c_custkey").alias("person"))
    one = best.agg(F.max_by(F.struct("n", "person"), "c_acctbal").alias("b")).where("b.n = 1").select("b.person")
    agree = F.col("n_nationkey") % 5 == F.col("n_regionkey") % 5
    rules = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("org"), F.bool_and(agree).alias("ok")).where("ok")
    return rules.join(F.broadcast(one)).select("person", "org", F.col("n_regionkey").alias("rule"))  # one row


_TERMS = """list_distinct(list_concat(list_concat(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), regexp_extract_all({0}, '[0-9]+')),
  list_filter(flatten(list_transform(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))), lambda f: regexp_matches(f, '[가-힣]'))))"""
_ASKED = "(text || CASE WHEN item_id % 5 = 0 THEN ' 의안 ' || lpad((item_id * 3)::VARCHAR, 7, '0') || '호' ELSE '' END)"


@query("TX-07 TX-08 RT-02", f"""WITH q AS (SELECT item_id, {_ASKED} AS text FROM benchmark), qt AS (SELECT item_id, text, {_TERMS.format("text")} AS t FROM q), d AS (SELECT doc_id, trim(text) AS text, {_TERMS.format("text")} AS t FROM documents WHERE text IS NOT NULL),
o AS (SELECT item_id, doc_id, len(list_intersect(qt.t, d.t)) AS s, len(qt.t) + len(d.t) AS n, length(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) AS chars, CASE WHEN item_id % 5 = 0 AND doc_id = item_id * 3 THEN 0.5 ELSE 0.0 END AS bonus FROM qt, d),
r AS (SELECT item_id, doc_id, round(2 * s / greatest(1, n) * (0.25 + 0.75 * least(chars / 90, 1.0)) + bonus, 9) AS score FROM o WHERE s > 0 OR bonus > 0)
SELECT item_id AS question, doc_id AS document, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lpad(doc_id::VARCHAR, 7, '0')) AS rank FROM r) WHERE rank <= 5""")
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents of each question, exact: sizes of term sets bound what a document can score."""
    text = F.concat("text", F.when(F.col("item_id") % 5 == 0, F.concat(F.lit(" 의안 "), F.lpad((F.col("item_id") * 3).cast("string"), 7, "0"), F.lit("호"))).otherwise(""))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), text.alias("text"))
    held = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("doc-bill-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("document"), "text")
    top = retrieval.top_evidence(asked, held, 5)
    return top.select("question", F.substring("document", 10, 99).cast("bigint").alias("document"), "score", "rank")


def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as proofs of a question, best first; documents are suppliers."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), (F.col("l_suppkey") % 5).alias("document"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), F.round(F.col("l_discount"), 2).alias("score"), F.col("l_quantity").cast("int").alias("bytes"))
    return ordered.ranked(df, ["question"], [F.col("score").desc(), F.col("part"), F.col("line"), F.col("supp")]).drop("part", "line", "supp")


_RANKED = "p AS (SELECT l_orderkey AS question, l_suppkey % 5 AS document, round(l_discount, 2) AS score, l_quantity::INTEGER AS bytes, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_discount, 2) DESC, l_partkey, l_linenumber, l_suppkey)::INTEGER AS rank FROM lineitem)"


@query("TX-09", f"""WITH {_RANKED}, f AS (SELECT question, document AS first FROM p WHERE rank = 1), n AS (SELECT question, arg_min(document, rank) AS next FROM p JOIN f USING (question) WHERE document <> first AND score > 0 AND question % 3 = 0 GROUP BY question),
m AS (SELECT p.*, next, row_number() OVER (PARTITION BY p.question, document IS NOT DISTINCT FROM next ORDER BY rank) AS nth FROM p LEFT JOIN n USING (question))
SELECT question, rank, row_number() OVER (PARTITION BY question ORDER BY CASE WHEN rank = 1 THEN 0 WHEN document = next AND nth <= 2 THEN 1 ELSE 2 END, rank)::INTEGER AS place FROM m""")
def diversified_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs in their new order: questions that compare reserve room for a second document."""
    return retrieval.diversified(ranked_lines(spark, sf_dir), F.col("question") % 3 == 0).select("question", "rank", "place")


@query("TX-10")
def promoted_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs in the order that gives each named neighbour one of its own; a sequence in the rule, tested against it."""
    df = ranked_lines(spark, sf_dir)
    facets = F.filter(F.array(F.col("document") % 3, F.when(F.col("rank") % 2 == 0, 3), F.when(F.col("bytes") > 40, 4)), lambda x: x.isNotNull())
    return retrieval.promoted(df.select("question", F.col("rank").alias("proof"), "rank", "score", F.transform(facets, lambda x: x.cast("int")).alias("facets")))


@query("RT-05", f"""WITH RECURSIVE {_RANKED}, b AS (SELECT question, rank, bytes AS used, 0 AS batch FROM p WHERE rank = 1
  UNION ALL SELECT p.question, p.rank, CASE WHEN used + p.bytes <= 100 THEN used + p.bytes ELSE p.bytes END, batch + (used + p.bytes > 100)::INTEGER FROM b JOIN p ON p.question = b.question AND p.rank = b.rank + 1) SELECT question, rank, batch FROM b""")
def reduction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a question in order, as many to a batch as fit."""
    return batching.batched(ranked_lines(spark, sf_dir), "question", "rank", "bytes", 100).select("question", "rank", "batch")


@query("RT-02", f"""WITH RECURSIVE {_RANKED}, b AS (SELECT question, 0 AS rank, 0 AS used, 0 AS kept, false AS took FROM p WHERE rank = 1
  UNION ALL SELECT p.question, p.rank, used + CASE WHEN kept < 3 AND used + p.bytes <= 90 THEN p.bytes ELSE 0 END, kept + (kept < 3 AND used + p.bytes <= 90)::INTEGER, kept < 3 AND used + p.bytes <= 90 FROM b JOIN p ON p.question = b.question AND p.rank = b.rank + 1)
SELECT question, rank FROM b WHERE took""")
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs that go into a request when tried in order: three at most, none that passes the budget."""
    return batching.fitting(ranked_lines(spark, sf_dir), "question", "rank", "bytes", 90, 3).select("question", "rank")


@query("RT-03", """WITH a AS (SELECT p_partkey AS id, p_size AS version, p_partkey % 53 <> 5 AS safe FROM part), c AS (SELECT p_partkey AS id, p_partkey // 3 AS child, q.p_size + (p_partkey % 97 = 7)::INTEGER AS child_version FROM part JOIN (SELECT p_partkey AS k, p_size FROM part) q ON q.k = p_partkey // 3 WHERE p_partkey > 2),
covered AS (SELECT child, child_version FROM c JOIN a USING (id) WHERE safe) SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM covered WHERE child = a.id AND child_version = a.version) AND (safe OR NOT EXISTS (SELECT 1 FROM c WHERE c.id = a.id))""")
def report_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that no safe parent covers in their very version; parents themselves only if they are safe."""
    reports, children = dag(spark, sf_dir)
    safe = reports.where("ok").select("id")
    covered = children.join(safe, "id", "left_semi").select(F.col("child").alias("id"), F.col("child_version").alias("version"))
    parents = children.select("id").distinct().withColumn("__parent", F.lit(True))
    left = reports.join(covered, ["id", "version"], "left_anti").join(parents, "id", "left")
    return left.where(F.col("ok") | F.col("__parent").isNull()).select("id")


@query("RT-04", """WITH u AS (SELECT o_custkey AS source, o_orderkey AS unit, o_orderkey % 7 = 3 AS contact, o_custkey % 50 = 1 AS titled FROM orders)
SELECT source, count(*) AS units, count(*) FILTER (contact OR titled) AS excluded, count(*) FILTER (NOT (contact OR titled)) AS tasks, min(CASE WHEN NOT (contact OR titled) THEN sha256('q1:source:' || source || ':' || unit) END) AS first_key FROM u GROUP BY source""")
def map_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map tasks over source units; units or titles with contact data are counted and left out."""
    k, who = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(k % 7 == 3, F.concat(F.lit("전화 02-123-4567 / "), k)).otherwise(F.concat(F.lit("unit "), k))
    title = F.when(who % 50 == 1, "a@b.kr").otherwise("title")
    hidden = forms.has_contact(text) | forms.has_contact(title)
    u = table(spark, sf_dir, "orders").select(who.alias("source"), hidden.alias("hidden"), F.sha2(F.concat(F.lit("q1:source:"), who, F.lit(":"), k), 256).alias("key"))
    return u.groupBy("source").agg(F.count("*").alias("units"), F.count_if("hidden").alias("excluded"), F.count_if(~F.col("hidden")).alias("tasks"), F.min(F.when(~F.col("hidden"), F.col("key"))).alias("first_key"))


@query("RT-06", """WITH s AS (SELECT 'u' || o_custkey AS url, CASE o_orderkey % 4 WHEN 0 THEN 'lawmaking-bill-detail' WHEN 1 THEN 'lawmaking-bill-detail' WHEN 2 THEN 'ministry-press-release' ELSE 'other' END AS kind, o_orderpriority = '1-URGENT' AS alternative FROM orders WHERE o_custkey % 3 = o_orderkey % 3),
f AS (SELECT url, CASE WHEN kind = 'ministry-press-release' THEN 'government_followup' WHEN alternative THEN 'alternative_bill' ELSE 'original_bill' END AS facet FROM s WHERE kind <> 'other')
SELECT url, min(facet) AS facet FROM f GROUP BY url HAVING count(DISTINCT facet) = 1""")
def source_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of official documents by address; an address of two kinds has none."""
    k, who = F.col("o_orderkey"), F.col("o_custkey")
    kind = case(k, "lawmaking-bill-detail", "lawmaking-bill-attachment", "ministry-press-release", "other")
    title = F.when(F.col("o_orderpriority") == "1-URGENT", "위원회 대안").otherwise("원안")
    s = table(spark, sf_dir, "orders").where(who % 3 == k % 3).select(F.concat(F.lit("u"), who).alias("url"), kind.alias("kind"), title.alias("title"))
    facet = F.when(F.col("kind").startswith("lawmaking-bill"), F.when(F.col("title").contains("대안"), "alternative_bill").otherwise("original_bill")).when(F.col("kind") == "ministry-press-release", "government_followup")
    named = s.select("url", facet.alias("facet")).where("facet IS NOT NULL").groupBy("url").agg(F.count_distinct("facet").alias("n"), F.min("facet").alias("facet"))
    return named.where("n = 1").select("url", "facet")


@query("RT-07", """WITH j AS (SELECT o_orderkey // 4 AS question, o_orderkey % 2 AS job, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY o_orderkey // 4, o_orderkey % 2)
SELECT question, count(*) AS maps FROM j GROUP BY question HAVING bool_and(state = 'F')""")
def complete_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions all of whose maps are complete by their latest attempt; only these are reduced."""
    jobs = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 4).alias("question"), (F.col("o_orderkey") % 2).alias("job")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"))
    return jobs.groupBy("question").agg(F.count("*").alias("maps"), F.bool_and(F.col("state") == "F").alias("ok")).where("ok").select("question", "maps")


@query("RT-08", """WITH s AS (SELECT l_orderkey AS k, list(l_linenumber) AS chosen, list(DISTINCT l_returnflag) AS hosts FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN len(chosen) > 4 THEN 'many' WHEN len(list_distinct(chosen)) < len(chosen) THEN 'twice' WHEN o_orderstatus = 'P' AND coalesce(len(chosen), 0) > 0 OR o_orderstatus <> 'P' AND coalesce(len(chosen), 0) = 0 THEN 'insufficient'
  WHEN o_orderstatus = 'F' AND NOT list_contains(hosts, 'A') THEN 'coverage' ELSE 'ok' END AS verdict FROM orders LEFT JOIN s ON k = o_orderkey""")
def selection_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections held to their contract: four at most, each once, empty exactly if insufficient, required hosts covered."""
    chosen = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("d"), F.bool_or(F.col("l_returnflag") == "A").alias("covered"))
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(n > 4, "many").when(F.col("d") < n, "twice").when((F.col("o_orderstatus") == "P") == (n > 0), "insufficient").when((F.col("o_orderstatus") == "F") & ~F.col("covered"), "coverage").otherwise("ok")
    return table(spark, sf_dir, "orders").join(chosen, "o_orderkey", "left").select("o_orderkey", verdict.alias("verdict"))


@query("RT-10", """WITH j AS (SELECT o_custkey AS question, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, bool_or(o_orderstatus = 'P') AS failed FROM orders GROUP BY o_custkey)
SELECT c_custkey AS question, CASE WHEN c_custkey % 11 = 0 THEN 'obsolete' WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'insufficient_evidence' ELSE 'completed' END WHEN total IS NULL THEN 'queued' WHEN failed AND done + 0 < total THEN 'failed' ELSE 'running' END AS state,
  CASE WHEN c_custkey % 11 > 0 AND c_custkey % 7 > 0 AND total IS NOT NULL AND NOT failed THEN done || '/' || total END AS progress FROM customer LEFT JOIN j ON question = c_custkey""")
def question_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each question: obsolete sources first, then its answer, then what its jobs amount to."""
    k = F.col("c_custkey")
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.bool_or(F.col("o_orderstatus") == "P").alias("failed"))
    obsolete, answered = k % 11 == 0, k % 7 == 0
    state = F.when(obsolete, "obsolete").when(answered, F.when(k % 2 == 0, "insufficient_evidence").otherwise("completed")).when(F.col("total").isNull(), "queued").when(F.col("failed"), "failed").otherwise("running")
    df = table(spark, sf_dir, "customer").select("c_custkey").join(jobs, "c_custkey", "left").withColumn("state", state)
    return df.select(k.alias("question"), "state", F.when(F.col("state") == "running", F.concat_ws("/", "done", "total")).alias("progress"))


@query("RT-11", """WITH x AS (SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS contexts, count(*) AS n FROM orders GROUP BY o_custkey),
e AS (SELECT o_custkey, bool_and(l_discount < 0.10) AS evidence, count(*) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT o_custkey AS reading, n AS contexts, m AS evidence FROM x JOIN e USING (o_custkey) JOIN customer ON c_custkey = o_custkey WHERE contexts AND evidence AND c_acctbal > 0""")
def issue_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings all of whose pinned contexts are published, evidence usable and people known; one missing pin hides it whole."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") != "P").alias("published"))
    contexts = orders.groupBy("o_custkey").agg(F.count("*").alias("contexts"), F.bool_and("published").alias("__contexts"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_discount") < 0.10).alias("usable"))
    evidence = orders.join(lines, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("evidence"), F.bool_and("usable").alias("__evidence"))
    people_ = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return contexts.where("__contexts").join(evidence.where("__evidence"), "o_custkey").join(people_, "o_custkey", "left_semi").select(F.col("o_custkey").alias("reading"), "contexts", "evidence")


@query("RT-12", """WITH c AS (SELECT DISTINCT o_custkey AS subject, l_partkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'),
k AS (SELECT DISTINCT o_custkey AS subject, l_partkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
SELECT subject, target, row_number() OVER (ORDER BY subject, target) AS place FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.subject = c.subject AND k.target = c.target) ORDER BY place LIMIT 500""")
def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs that no relation has yet, as many as the queue takes, in order."""
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("subject"), F.col("l_partkey").alias("target"), "o_orderstatus", "l_returnflag")
    known = pairs.where("o_orderstatus = 'F'").select("subject", "target")
    fresh = pairs.where("l_returnflag <> 'R'").select("subject", "target").distinct().join(known, ["subject", "target"], "left_anti")
    top = fresh.orderBy("subject", "target").limit(500)
    return top.withColumn("place", F.row_number().over(Window.orderBy("subject", "target")).cast("bigint"))
