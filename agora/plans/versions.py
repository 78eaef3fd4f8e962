"""Queries over versions, pages of sources, catalogues and review plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units
from ..operators import merges, ordered
from .registry import query, table

# Two versions of documents: the first lacks every seventh row, the second every third and differs in every fifth.
_TWO = """WITH o AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id, md5(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 3 <> 0)
"""


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5(text).alias("content_hash"), F.lit(1).alias("at"))
    new = docs.where("doc_id % 3 <> 0").select("doc_id", F.md5(F.concat(text, F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""))).alias("content_hash"), F.lit(2).alias("at"))
    return old, new


@query("SNK-02 SNK-04", _TWO + """
SELECT doc_id, coalesce(n.h, o.h) AS content_hash, CASE WHEN n.h IS NULL OR n.h = o.h THEN 1 ELSE 2 END AS changed_at, CASE WHEN n.h IS NULL THEN 1 ELSE 2 END AS observed_at FROM o FULL JOIN n USING (doc_id)""")
def upsert_conditional_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.upserted(*_two_versions(spark, sf_dir), "doc_id", "content_hash")


@query("CD-05 SNK-14", _TWO + """
SELECT n.doc_id, CASE WHEN o.h IS NULL THEN 'imported' WHEN o.h = n.h THEN 'replayed' ELSE 'conflict' END AS outcome FROM n LEFT JOIN o USING (doc_id)""")
def immutable_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.import_outcomes(*_two_versions(spark, sf_dir), "doc_id", "content_hash")


@query("CD-04 SNK-12 SM-09", _TWO + """
SELECT md5(n.doc_id || '|' || n.h) AS event_id, n.doc_id, n.h AS content_hash FROM n LEFT JOIN o USING (doc_id) WHERE n.h IS DISTINCT FROM o.h AND n.doc_id % 10 <> 0""")
def archive_and_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of changed rows; the ledger has those of every tenth row already."""
    old, new = _two_versions(spark, sf_dir)
    ledger = new.where("doc_id % 10 = 0").select(F.md5(F.concat_ws("|", "doc_id", "content_hash")).alias("event_id"))
    return merges.outbox(old, new, "doc_id", "content_hash", ledger)


@query("SNK-07", """
SELECT o_custkey, o_orderkey, content, n > 1 AS reactivated FROM (SELECT o_custkey, o_orderkey, o_orderstatus AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r,
count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) WHERE r = 1""")
def artifact_current_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifact of each key that is current, and whether its content had been put before."""
    puts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("content"))
    times = puts.withColumn("n", F.count("*").over(Window.partitionBy("o_custkey", "content")))
    return ordered.latest_by(times, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "content", (F.col("n") > 1).alias("reactivated"))


@query("SRC-02 SRC-03", """
WITH t AS (SELECT count(*) AS total FROM events), p AS (SELECT event_id // 100 AS page, count(*) AS n FROM events GROUP BY page)
SELECT page, total, n < 100 OR (page + 1) * 100 >= total AS complete, event_id AS id FROM events JOIN p ON page = event_id // 100, t""")
def page_envelope_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON envelopes of 100 records; the page after the last has the code for no data and no row."""
    events = table(spark, sf_dir, "events")
    pages = events.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.collect_list(F.struct(F.col("event_id").alias("id"))).alias("row"))
    total = F.broadcast(events.agg(F.count("*").alias("total"), (F.floor(F.max("event_id") / 100) + 1).alias("beyond")))  # a single row
    sent = pages.join(total).select("page", F.to_json(F.struct(F.lit("INFO-000").alias("code"), "total", "row")).alias("body"))
    empty = total.select(F.col("beyond").alias("page"), F.to_json(F.struct(F.lit("INFO-200").alias("code"))).alias("body"))
    read = sent.union(empty).select("page", F.from_json("body", "code string, total bigint, row array<struct<id: bigint>>").alias("e")).where("e.code <> 'INFO-200'")
    complete = (F.size("e.row") < 100) | ((F.col("page") + 1) * 100 >= F.col("e.total"))
    return read.select("page", F.col("e.total").alias("total"), complete.alias("complete"), F.explode("e.row.id").alias("id"))


@query("SM-01 SNK-06", """
WITH c AS (SELECT o_custkey % 20 AS source, max(o_orderkey // 100) AS done FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 GROUP BY source),
p AS (SELECT o_custkey % 20 AS source, o_orderkey // 100 AS page, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT p.*, row_number() OVER (PARTITION BY p.source ORDER BY page) AS k FROM p LEFT JOIN c USING (source) WHERE page > coalesce(done // 2, -1))
SELECT source, page, n, max(page) OVER (PARTITION BY source) AS checkpoint FROM r WHERE k <= 5""")
def resumable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five pages of every source after its checkpoint, a row of a control table, and the checkpoint they lead to."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("source"), F.floor(F.col("o_orderkey") / 100).alias("page"), "o_orderkey", "o_orderstatus")
    control = rows.where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").groupBy("source").agg(F.floor(F.max("page") / 2).alias("done"))
    pages = rows.groupBy("source", "page").agg(F.count("*").alias("n")).join(control, "source", "left").where(F.col("page") > F.coalesce("done", F.lit(-1)))
    taken = ordered.ranked(pages, ["source"], [F.col("page")]).where("rank <= 5")
    return taken.select("source", "page", "n", F.max("page").over(Window.partitionBy("source")).alias("checkpoint"))


@query("SRC-18", """
SELECT o_orderkey // 100 AS page, count(*) AS n, count(DISTINCT o_custkey) AS members, 100 AS expected, CASE WHEN count(DISTINCT o_custkey) < count(*) THEN 'duplicate' WHEN count(*) <> 100 THEN 'incomplete' ELSE 'complete' END AS state FROM orders GROUP BY page""")
def roster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a roster against what they claim to hold: a member twice is worse than one missing."""
    pages = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("page")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("members"))
    state = F.when(F.col("members") < F.col("n"), "duplicate").when(F.col("n") != 100, "incomplete").otherwise("complete")
    return pages.select("page", "n", "members", F.lit(100).alias("expected"), state.alias("state"))


@query("SRC-10", """
WITH r AS (SELECT o_custkey AS number, 1 + o_orderkey // 500 AS page, o_orderkey AS k FROM orders), l AS (SELECT max(page) AS last FROM r),
c AS (SELECT page FROM (SELECT DISTINCT page FROM r), l WHERE page <= 3 OR ((page - 4 - 7) % greatest(1, last - 3) + greatest(1, last - 3)) % greatest(1, last - 3) < 5),
o AS (SELECT r.*, row_number() OVER (PARTITION BY number ORDER BY page > 3, page, k) AS w FROM r JOIN c USING (page)) SELECT number, page, k FROM o WHERE w = 1""")
def bill_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle over a board: its three hot pages and five more from the sweep's cursor on, around the end; of a number that
    stands on several pages the first row met counts."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), (1 + F.floor(F.col("o_orderkey") / 500)).alias("page"), F.col("o_orderkey").alias("k"))
    last = F.broadcast(rows.agg(F.greatest(F.lit(1), F.max("page") - 3).alias("rest")))  # a single row
    due = (F.col("page") <= 3) | (F.pmod(F.col("page") - 4 - 7, F.col("rest")) < 5)
    first = ordered.latest_by(rows.join(last).where(due), ["number"], [F.col("page") > 3, F.col("page"), F.col("k")])
    return first.select("number", "page", "k")


@query("SM-08 SRC-06", """
WITH r AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events)
SELECT event_id, ts FROM events, r WHERE ts >= now - INTERVAL 72 HOUR AND ts <= now + INTERVAL 5 MINUTE ORDER BY ts DESC, event_id LIMIT 200""")
def late_future_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest items between 72 hours back and 5 minutes ahead."""
    events = table(spark, sf_dir, "events")
    now = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    near = events.join(F.broadcast(now), F.expr("ts >= now - INTERVAL 72 HOURS AND ts <= now + INTERVAL 5 MINUTES"))  # a single row
    return near.select("event_id", "ts").orderBy(F.col("ts").desc(), "event_id").limit(200)


@query("SL-03 SRC-24 SRC-25", """
SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 50 OR (o_custkey = 50 AND o_orderkey > 100) ORDER BY o_custkey, o_orderkey LIMIT 100""")
def batch_keyset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.expr("o_custkey >= 50 AND (o_custkey > 50 OR o_orderkey > 100)")
    return table(spark, sf_dir, "orders").where(after).select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey").limit(100)


@query("SL-06 WN-11", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = ordered.latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return firsts.select("o_custkey", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@query("ST-06", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def distinct_then_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(keys, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("JN-05", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, length(unnest(l)) AS n_chars FROM l""")
def nested_document_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document by way of a JSON array of objects."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.transform(F.split("text", "\n"), lambda t, k: F.struct((k + 1).alias("line"), t.alias("t")))
    nested = docs.select("doc_id", F.to_json(lines).alias("body")).select("doc_id", F.explode(F.from_json("body", "array<struct<line: bigint, t: string>>")).alias("e"))
    return nested.select("doc_id", "e.line", F.length("e.t").cast("bigint").alias("n_chars"))


@query("FL-03 SF-33", """
SELECT p_partkey, '제' || p_size || '대' AS label, 100000 + p_size AS code FROM part WHERE p_size <= 25 AND p_type <> 'ECONOMY'""")
def active_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "part").where("p_size <= 25 AND p_type <> 'ECONOMY'")
    return active.select("p_partkey", F.format_string("제%d대", "p_size").alias("label"), (F.lit(100000) + F.col("p_size")).alias("code"))


@query("FL-09 SM-03", """
SELECT o_orderkey, o_orderdate >= TIMESTAMP '1997-01-01' AS since_watermark FROM orders WHERE coalesce(o_orderstatus, '') NOT IN ('F', 'P') OR o_orderdate >= TIMESTAMP '1997-01-01'""")
def nonterminal_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents to be asked again: changed since the watermark, or not in a final state."""
    recent = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    open_ = ~F.coalesce("o_orderstatus", F.lit("")).isin("F", "P")
    return table(spark, sf_dir, "orders").where(open_ | recent).select("o_orderkey", recent.alias("since_watermark"))


@query("FL-10", """
SELECT source, count(*) AS n, bool_and(coalesce(quality = 1 AND toxic = 0, false)) AS usable, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 0 ELSE 1 END)::BIGINT AS withheld FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def evidence_usable_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all of a source's documents may be used, and of how many the text is withheld."""
    usable = F.coalesce(F.expr("quality = 1 AND toxic = 0"), F.lit(False))
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.bool_and(usable).alias("usable"), F.count_if(~usable).alias("withheld"))


@query("FL-24", """
SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 365 DAY >= TIMESTAMP '1996-09-01')""")
def current_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a year, open if the status is O: begun by the day observed and not over today."""
    return table(spark, sf_dir, "orders").where("o_orderdate <= TIMESTAMP_NTZ '1996-06-01' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 365 DAYS >= TIMESTAMP_NTZ '1996-09-01')").select("o_orderkey")


@query("SM-11", """
WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS failed FROM events)
SELECT user_id, failed + 1 AS version FROM l WHERE r = 1 AND event_type = 'error' ORDER BY user_id LIMIT 20""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 20 requests, by queue capacity: keys whose latest attempt failed, with a version after the failed ones."""
    events = table(spark, sf_dir, "events")
    latest = F.max_by("event_type", F.struct("ts", "event_id"))
    keys = events.groupBy("user_id").agg(latest.alias("last"), (F.count_if(F.col("event_type") == "error") + 1).alias("version"))
    return keys.where("last = 'error'").select("user_id", "version").orderBy("user_id").limit(20)


@query("PJ-16", """
SELECT sha256('customer:' || c_custkey) AS id, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 AS batch FROM customer""")
def review_batches_of_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ordered.ranked(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.col("c_custkey")])
    return placed.select(F.sha2(F.concat(F.lit("customer:"), "c_custkey"), 256).alias("id"), "c_nationkey", F.floor((F.col("rank") - 1) / 50).alias("batch"))


@query("PJ-18 SF-28", """SELECT p_partkey, left(json_object('id', p_partkey, 'name', p_name)::VARCHAR, 24) AS sample FROM part""")
def json_object_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.left(body, F.lit(24)).alias("sample"))


@query("PJ-06 PJ-07 SF-31 SF-10", """
SELECT md5('order:' || o_orderkey) AS id, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'pending' ELSE 'unknown' END AS stage, strftime(o_orderdate, '%Y.%m.%d') AS shown FROM orders""")
def contract_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as activities by a contract: hashed ids, a stage per status, dates read and shown again."""
    stages = F.create_map(F.lit("F"), F.lit("passed"), F.lit("O"), F.lit("pending"))
    written = F.date_format("o_orderdate", "yyyy.MM.dd")
    read = F.coalesce(F.try_to_timestamp(written, F.lit("yyyy-MM-dd")), F.try_to_timestamp(written, F.lit("yyyy.MM.dd")))
    stage = F.coalesce(F.try_element_at(stages, F.col("o_orderstatus")), F.lit("unknown"))
    return table(spark, sf_dir, "orders").select(F.md5(F.concat(F.lit("order:"), "o_orderkey")).alias("id"), stage.alias("stage"), F.date_format(read, "yyyy.MM.dd").alias("shown"))


@query("PJ-08 PJ-09 SF-29", _TWO + """
SELECT n.doc_id, 'Document ' || n.doc_id || CASE WHEN o.h <> n.h THEN ' (corrected)' ELSE '' END AS title, coalesce(o.h <> n.h, false) AS corrected FROM n LEFT JOIN o USING (doc_id)""")
def announcement_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_versions(spark, sf_dir)
    both = new.join(old.select("doc_id", F.col("content_hash").alias("before")), "doc_id", "left")
    corrected = F.coalesce(F.col("before") != F.col("content_hash"), F.lit(False))
    return both.select("doc_id", F.concat(F.lit("Document "), "doc_id", F.when(corrected, " (corrected)").otherwise("")).alias("title"), corrected.alias("corrected"))


@query("SF-30 SL-13", """
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, list_has_all(list(o_orderstatus), ['F', 'O']) AS has_both, NOT list_has_any(list(o_orderstatus), ['P']) AS apart FROM orders GROUP BY o_custkey""")
def list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set per customer, so that no list grows with the orders."""
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    has_both = F.size(F.array_except(F.array(F.lit("F"), F.lit("O")), "s")) == 0
    return sets.select("o_custkey", F.concat_ws(",", "s").alias("statuses"), has_both.alias("has_both"), (~F.array_contains("s", "P")).alias("apart"))


@query("SF-22", """
SELECT o_orderkey, replace(replace(replace(to_base64(encode(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderkey)), '+', '-'), '/', '_'), '=', '') AS cursor FROM orders""")
def cursor_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.translate(F.base64(F.encode(place, "UTF-8")), "+/=", "-_").alias("cursor"))


@query("AG-27", """
WITH f AS (SELECT md5(coalesce(text, '')) AS h, min(source) AS source FROM documents GROUP BY h HAVING count(DISTINCT source) = 1)
SELECT source, count(*) AS facets FROM f GROUP BY source""")
def facet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that one source only has, counted by source; those of several are ambiguous and dropped."""
    texts = table(spark, sf_dir, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min("source").alias("source"), F.max("source").alias("other"))
    return texts.where("source = other").groupBy("source").agg(F.count("*").alias("facets"))


@query("AG-24 FL-05 FL-22", """
SELECT CASE page_id % 5 WHEN 0 THEN 'redirect' WHEN 1 THEN 'gone' WHEN 2 THEN 'unchecked' ELSE 'ok' END AS health, count(*) AS n, bool_or(page_id % 5 = 2) AS due FROM pages GROUP BY health""")
def verification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of addresses by status code; those never checked are due."""
    code = F.element_at(F.array(*[F.lit(c) for c in (301, 404, None, 200, 204)]), (F.col("page_id") % 5 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").withColumn("code", code)
    health = F.when(F.col("code").isNull(), "unchecked").when(F.col("code") < 300, "ok").when(F.col("code") < 400, "redirect").otherwise("gone")
    return pages.groupBy(health.alias("health")).agg(F.count("*").alias("n"), F.bool_or(F.col("code").isNull()).alias("due"))


@query("AG-23", """
SELECT source, count(l.doc_id) AS labelled, CASE WHEN count(l.doc_id) * 3 >= count(*) THEN count(*) END AS denominator FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def collection_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress by source; the denominator is withheld until a third is labelled."""
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("known"))
    cards = table(spark, sf_dir, "documents").select("doc_id", "source").join(known, "doc_id", "left").groupBy("source").agg(F.count("known").alias("labelled"), F.count("*").alias("total"))
    return cards.select("source", "labelled", F.when(F.col("labelled") * 3 >= F.col("total"), F.col("total")).alias("denominator"))


@query("WN-20", """
SELECT conv_id, turn, width FROM (SELECT conv_id, turn, lead(turn, 1) OVER w AS b, lead(turn, 2) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), (VALUES (2), (3)) AS v(width)
WHERE (width = 2 AND b IS NOT NULL) OR (width = 3 AND c IS NOT NULL)""")
def span_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two and three neighbouring units."""
    along = Window.partitionBy("conv_id").orderBy("turn")
    units_ = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn", 1).over(along).alias("b"), F.lead("turn", 2).over(along).alias("c"))
    widths = F.array_compact(F.array(F.when(F.col("b").isNotNull(), 2), F.when(F.col("c").isNotNull(), 3)))
    return units_.select("conv_id", "turn", F.explode(widths).alias("width"))


@query("WN-15 SF-21")
def byte_bounded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as units of at most 4096 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(units.byte_units(4096)("text")).alias("unit", "text"))
    return docs.select("doc_id", "unit", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("content_hash"))


@query("SF-02 SF-27")
def nfkc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", units.byte_prefix(20)(units.nfkc("p_name")).alias("name"))


@query("SF-06 CD-06", "SELECT event_id, sha256('{\"k\":' || (props::JSON ->> 'k') || ',\"t\":\"' || event_type || '\"}') AS content_hash FROM events WHERE props IS NOT NULL")
def content_hash_without_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the canonical content of a record; its time and value, which belong to the observation, are left out."""
    events = table(spark, sf_dir, "events").where("props IS NOT NULL")
    content = F.concat(F.lit('{"t": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return events.select("event_id", F.sha2(units.canonical_json(content), 256).alias("content_hash"))
