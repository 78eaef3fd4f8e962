"""Cohort, campaign and dashboard reports; policies and gates; published versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as words
from ..operators import ordered
from .people import case
from .registry import query, table

_BETA = """WITH e AS (SELECT user_id, ts, event_id, event_type = 'view' AS opened, CASE WHEN event_id % 3 > 0 THEN 'organic' ELSE 'research' END AS kind FROM events WHERE event_type IN ('view', 'click', 'purchase')),
p AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'friend' ELSE 'external' END AS cohort, min(ts) AS enrolled FROM events GROUP BY user_id),
r AS (SELECT *, max(CASE WHEN opened THEN ts END) OVER (PARTITION BY user_id, kind ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS read FROM e),
a AS (SELECT user_id, arg_min(ts, (ts, event_id)) AS act, arg_min(kind, (ts, event_id)) AS kind FROM r WHERE NOT opened AND read >= ts - INTERVAL 30 MINUTE GROUP BY user_id),
n AS (SELECT max(ts) AS now FROM events),
b AS (SELECT a.user_id, bool_or(e.kind = 'organic') AS org, bool_or(e.kind = 'research') AS res FROM a JOIN e ON e.user_id = a.user_id AND opened AND ts > act AND ts < act + INTERVAL 7 DAY AND (ts + INTERVAL 9 HOUR)::DATE <> (act + INTERVAL 9 HOUR)::DATE GROUP BY a.user_id),
o AS (SELECT user_id, bool_or(kind = 'organic') AS org, bool_or(kind = 'research') AS res FROM e WHERE opened GROUP BY user_id)"""


def activations(events: DataFrame, person: str, at: str, kind: str, opened: Column, minutes: int = 30) -> DataFrame:
    """(person, activated, kind): the first deeper event within ``minutes`` of the last read of its kind of visit."""
    read = ordered.last_before(events, [person, kind], [F.col(at), F.col("event_id")], opened, at, "__read")
    deep = read.where(~opened & (F.col("__read") >= F.col(at) - F.expr(f"INTERVAL {minutes} MINUTES")))
    first = F.min_by(F.struct(at, kind), F.struct(at, "event_id"))
    return deep.groupBy(person).agg(first.alias("__first")).select(person, F.col(f"__first.{at}").alias("activated"), F.col(f"__first.{kind}").alias("__kind"))


@query("AG-07", _BETA + """ SELECT c.cohort, count(p.user_id) AS enrolled, count(a.user_id) AS activated, count(*) FILTER (o.org) AS organic_readers, count(*) FILTER (o.res) AS research_readers,
  count(*) FILTER (a.kind = 'organic') AS organic_activated, count(*) FILTER (a.kind = 'research') AS research_activated, count(*) FILTER (act + INTERVAL 7 DAY <= now) AS eligible,
  count(*) FILTER (act + INTERVAL 7 DAY <= now AND (b.org OR b.res)) AS returned, count(*) FILTER (act + INTERVAL 7 DAY <= now AND b.org) AS organic_returned, count(*) FILTER (act + INTERVAL 7 DAY <= now AND b.res) AS research_returned,
  round(count(*) FILTER (act + INTERVAL 7 DAY <= now AND (b.org OR b.res)) / nullif(count(*) FILTER (act + INTERVAL 7 DAY <= now), 0), 6) AS retention
FROM (VALUES ('friend'), ('external'), ('unseen')) c(cohort) LEFT JOIN p ON p.cohort = c.cohort AND enrolled < TIMESTAMP '2024-01-20' LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN o USING (user_id) CROSS JOIN n GROUP BY c.cohort""")
def beta_cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven measures of each cohort, a cohort without people included: readers, activations, returns on a later day in Seoul
    within seven days of an activation that is seven days old."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 > 0, "organic").otherwise("research")
    used = events.where(F.col("event_type").isin("view", "click", "purchase")).select("user_id", "ts", "event_id", (F.col("event_type") == "view").alias("opened"), kind.alias("kind"))
    first = activations(used, "user_id", "ts", "kind", F.col("opened"))
    opens = used.where("opened")
    is_kind = lambda k: F.bool_or(F.col("kind") == k)
    readers = opens.groupBy("user_id").agg(is_kind("organic").alias("__reads_o"), is_kind("research").alias("__reads_r"))
    later = (F.col("ts") > F.col("activated")) & (F.col("ts") < F.col("activated") + F.expr("INTERVAL 7 DAYS")) & (words.kst_date(F.col("ts")) != words.kst_date(F.col("activated")))
    back = opens.join(first, "user_id").where(later).groupBy("user_id").agg(is_kind("organic").alias("__back_o"), is_kind("research").alias("__back_r"))
    people = events.groupBy("user_id").agg(F.min("ts").alias("enrolled_at")).where("enrolled_at < timestamp_ntz'2024-01-20'").withColumn("cohort", F.when(F.col("user_id") % 2 == 0, "friend").otherwise("external"))
    now = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    df = people.join(first, "user_id", "left").join(readers, "user_id", "left").join(back, "user_id", "left").join(now)
    mature = F.col("activated") + F.expr("INTERVAL 7 DAYS") <= F.col("now")
    measured = df.groupBy("cohort").agg(
        F.count("user_id").alias("enrolled"), F.count("activated").alias("activated"), F.count_if("__reads_o").alias("organic_readers"), F.count_if("__reads_r").alias("research_readers"),
        F.count_if(F.col("__kind") == "organic").alias("organic_activated"), F.count_if(F.col("__kind") == "research").alias("research_activated"), F.count_if(mature).alias("eligible"),
        F.count_if(mature & (F.col("__back_o") | F.col("__back_r"))).alias("returned"), F.count_if(mature & F.col("__back_o")).alias("organic_returned"), F.count_if(mature & F.col("__back_r")).alias("research_returned"),
    )
    cohorts = spark.createDataFrame([("friend",), ("external",), ("unseen",)], "cohort string")
    filled = cohorts.join(measured, "cohort", "left").fillna(0)
    return filled.withColumn("retention", F.round(F.try_divide("returned", "eligible"), 6))


@query("AG-20", """WITH e AS (SELECT user_id, ts, event_id, event_type, (['organic', 'interview', 'unknown'])[1 + event_id % 3] AS kind FROM events),
w AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'error' AND event_id % 200 = 0), p AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'friend' ELSE 'external' END AS cohort FROM e WHERE user_id NOT IN (SELECT user_id FROM w)),
r AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id, kind ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS read FROM e WHERE event_type IN ('view', 'click')),
a AS (SELECT user_id, min(ts) AS act FROM r WHERE event_type = 'click' AND read >= ts - INTERVAL 30 MINUTE GROUP BY user_id),
b AS (SELECT a.user_id, bool_or(kind = 'organic') AS org, bool_or(kind = 'interview') AS pro, bool_or(kind = 'unknown') AS unk FROM a JOIN e ON e.user_id = a.user_id AND event_type = 'view' AND ts > act AND ts < act + INTERVAL 7 DAY AND ts::DATE > act::DATE GROUP BY a.user_id)
SELECT CASE WHEN grouping(cohort) = 1 THEN 'all' ELSE cohort END AS cohort, count(*) AS enrolled, count(act) AS activated, count(*) FILTER (act + INTERVAL 7 DAY <= n.now) AS d7_eligible,
  count(*) FILTER (act + INTERVAL 7 DAY <= n.now AND org) AS d7_organic_returned, count(*) FILTER (act + INTERVAL 7 DAY <= n.now AND pro) AS d7_prompted_returned, count(*) FILTER (act + INTERVAL 7 DAY <= n.now AND unk) AS d7_unknown_returned,
  round(count(*) FILTER (act + INTERVAL 7 DAY <= n.now AND org) / nullif(count(*) FILTER (act + INTERVAL 7 DAY <= n.now), 0), 6) AS d7_organic_rate
FROM p LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) CROSS JOIN (SELECT max(ts) AS now FROM events) n GROUP BY ROLLUP (cohort)""")
def campaign_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation and seventh-day returns of a campaign, in all and by cohort; who withdrew is left out whole, and a person in
    two cohorts stops the report."""
    events = table(spark, sf_dir, "events")
    kind = case(F.col("event_id"), "organic", "interview", "unknown")
    df = events.select("user_id", "ts", "event_id", "event_type", kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, "friend").otherwise("external").alias("cohort"))
    gone = df.where("event_type = 'error' AND event_id % 200 = 0").select("user_id").distinct()
    known = df.groupBy("user_id").agg(F.min("cohort").alias("cohort"), F.count_distinct("cohort").alias("n")).join(gone, "user_id", "left_anti")
    known = known.select("user_id", F.when(F.col("n") > 1, F.raise_error(F.lit("a participant cannot change recruitment cohort"))).otherwise(F.col("cohort")).alias("cohort"))
    used = df.where(F.col("event_type").isin("view", "click")).select("user_id", "ts", "event_id", "kind", (F.col("event_type") == "view").alias("opened"))
    first = activations(used, "user_id", "ts", "kind", F.col("opened")).select("user_id", "activated")
    later = (F.col("ts") > F.col("activated")) & (F.col("ts") < F.col("activated") + F.expr("INTERVAL 7 DAYS")) & (F.to_date("ts") > F.to_date("activated"))
    is_kind = lambda k: F.bool_or(F.col("kind") == k)
    back = used.where("opened").join(first, "user_id").where(later).groupBy("user_id").agg(is_kind("organic").alias("o"), is_kind("interview").alias("p"), is_kind("unknown").alias("u"))
    now = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    mature = F.col("activated") + F.expr("INTERVAL 7 DAYS") <= F.col("now")
    every = known.join(first, "user_id", "left").join(back, "user_id", "left").join(now).rollup("cohort").agg(
        F.count("*").alias("enrolled"), F.count("activated").alias("activated"), F.count_if(mature).alias("d7_eligible"), F.count_if(mature & F.col("o")).alias("d7_organic_returned"),
        F.count_if(mature & F.col("p")).alias("d7_prompted_returned"), F.count_if(mature & F.col("u")).alias("d7_unknown_returned"),
    )
    return every.withColumn("cohort", F.coalesce("cohort", F.lit("all"))).withColumn("d7_organic_rate", F.round(F.try_divide("d7_organic_returned", "d7_eligible"), 6))


# Outcomes of a source on a day.
OUTCOMES = ("SCHEDULED", "RUNNING", "SUCCESS_CHANGED", "SUCCESS_UNCHANGED", "SUCCESS_EMPTY", "SKIPPED_NO_PARENT_CHANGES", "PARTIAL", "FAILED", "RETRY_EXHAUSTED", "MISSED", "AUTOMATION_DISABLED")
_OUTCOMES = "[" + ", ".join(f"'{o}'" for o in OUTCOMES) + "]"


@query("AG-09 AG-10 WN-03", f"""WITH h AS (SELECT user_id, ts::DATE AS day, arg_max(event_id, (ts, -event_id)) AS e FROM events GROUP BY user_id, ts::DATE), s AS (SELECT day, ({_OUTCOMES})[1 + CASE WHEN day(day) % 4 = 0 THEN 2 + e % 4 WHEN day(day) % 4 = 1 THEN e % 6 WHEN day(day) = 2 THEN 10 ELSE e % 11 END] AS o FROM h)
SELECT day, count(*) AS expected, """ + ", ".join(f"count(*) FILTER (o = '{o}') AS {o.lower()}" for o in OUTCOMES) + """,
  CASE WHEN count(*) FILTER (o IN ('FAILED', 'RETRY_EXHAUSTED', 'PARTIAL', 'MISSED')) > 0 THEN 'ATTENTION' WHEN count(*) FILTER (o = 'RUNNING') > 0 THEN 'RUNNING' WHEN count(*) FILTER (o = 'SCHEDULED') > 0 THEN 'SCHEDULED'
  WHEN count(*) FILTER (o = 'AUTOMATION_DISABLED') = count(*) THEN 'AUTOMATION_DISABLED' ELSE 'HEALTHY' END AS overall FROM s GROUP BY day""")
def dashboard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve counters of a day over the latest entry of each source, and the state they amount to."""
    day = F.to_date("ts")
    latest = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(F.max_by("event_id", F.struct("ts", (-F.col("event_id")).alias("e"))).alias("e"))
    d, e = F.dayofmonth("day"), F.col("e")
    outcome = F.element_at(F.array(*map(F.lit, OUTCOMES)), (1 + F.when(d % 4 == 0, 2 + e % 4).when(d % 4 == 1, e % 6).when(d == 2, 10).otherwise(e % 11)).cast("int"))
    counted = latest.withColumn("o", outcome).groupBy("day").agg(F.count("*").alias("expected"), *[F.count_if(F.col("o") == name).alias(name.lower()) for name in OUTCOMES])
    bad = F.col("failed") + F.col("retry_exhausted") + F.col("partial") + F.col("missed")
    overall = F.when(bad > 0, "ATTENTION").when(F.col("running") > 0, "RUNNING").when(F.col("scheduled") > 0, "SCHEDULED").when(F.col("automation_disabled") == F.col("expected"), "AUTOMATION_DISABLED").otherwise("HEALTHY")
    return counted.withColumn("overall", overall)


@query("SNK-15 AG-19", """WITH v AS (SELECT o_custkey AS event, o_orderkey AS version, o_orderdate AS moment, o_orderdate::DATE AS day, o_orderstatus = 'P' AS rejected, o_orderpriority <> '5-LOW' AS summary FROM orders),
q AS (SELECT *, NOT rejected AND (NOT summary OR count(*) FILTER (NOT rejected AND summary) OVER (PARTITION BY day ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 3) AS published FROM v)
SELECT version, CASE WHEN rejected THEN 'rejected' WHEN published THEN 'published' ELSE 'held' END AS state, published AND count(*) FILTER (published) OVER (PARTITION BY event ORDER BY moment, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS corrected FROM q""")
def daily_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by their decision; at most three with a summary are published a day, and one after an earlier published one of
    its event is a correction."""
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "P").alias("rejected"), (F.col("o_orderpriority") != "5-LOW").alias("summary"))
    counts = ~F.col("rejected") & F.col("summary")
    day = Window.partitionBy(F.to_date("at")).orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("published", ~F.col("rejected") & (~F.col("summary") | (F.sum(counts.cast("int")).over(day) <= 3)))
    before = Window.partitionBy("event").orderBy("at", "version").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("rejected"), "rejected").when(F.col("published"), "published").otherwise("held")
    return df.select("version", state.alias("state"), (F.col("published") & F.coalesce(F.max(F.col("published").cast("int")).over(before) > 0, F.lit(False))).alias("corrected"))


# What an activity may be, where its source may be.
TYPES = ("bill", "vote", "announcement", "speech", "meeting", "law")
STAGES = ("announced", "scheduled", "proposed", "reviewing", "voted", "passed", "rejected", "alternative", "withdrawn", "promulgated", "effective", "unknown")
VOTES = ("yes", "no", "abstain", "absent", "unknown")


def activity_violations(hosts: tuple[str, ...]) -> Column:
    """Codes of the rules that an activity (id, type, stage, title, url, people, votes of person, session, result) breaks."""
    is_id = lambda c: F.coalesce(c.rlike("^[A-Za-z0-9_-]{1,128}$"), F.lit(False))
    url, votes = F.col("url"), F.col("votes")
    host = F.regexp_extract(url, r"^https://([^/?#:@]+)(?::443)?(?:[/?]|$)", 1)
    suffix = "|".join(h.replace(".", r"\.") for h in hosts)
    official = host.rlike(rf"(^|\.)({suffix})$") & (F.length(url) <= 2048) & ~url.contains("#")
    rules = {
        "identifier": is_id(F.col("id")), "type": F.col("type").isin(*TYPES), "stage": F.col("stage").isin(*STAGES), "title": (F.trim("title") != "") & (F.length("title") <= 500), "source": official,
        "people": (F.size("people") <= 500) & F.forall("people", is_id), "vote": F.forall(votes, lambda v: v["result"].isin(*VOTES) & is_id(v["session"])), "voter": F.forall(votes, lambda v: F.array_contains("people", v["person"])),
        "twice": F.size(F.array_distinct(F.transform(votes, lambda v: F.struct(v["person"], v["session"])))) == F.size(votes),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), name) for name, good in rules.items()]))


@query("FL-14 FL-15", """SELECT o_orderkey AS key, array_to_string(list_filter([CASE WHEN o_custkey % 7 = 1 THEN 'identifier' END, CASE WHEN o_orderkey % 6 = 5 THEN 'type' END, CASE WHEN o_custkey % 13 = 2 THEN 'title' END,
  CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN 'source' END, CASE WHEN o_custkey % 11 = 3 THEN 'vote' END, CASE WHEN o_orderkey % 9 = 4 THEN 'voter' END, CASE WHEN o_orderkey % 10 = 7 THEN 'twice' END], lambda x: x IS NOT NULL), ',') AS codes FROM orders""")
def activity_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, who = F.col("o_orderkey"), F.col("o_custkey")
    vote = lambda person: F.struct(person.alias("person"), F.lit("s1").alias("session"), F.when(who % 11 == 3, "maybe").otherwise("yes").alias("result"))
    mine, other = F.concat(F.lit("p"), who), F.concat(F.lit("q"), who)
    votes = F.when(k % 10 == 7, F.array(vote(mine), vote(mine))).otherwise(F.array(vote(mine)))
    votes = F.when(k % 9 == 4, F.concat(votes, F.array(vote(F.lit("stranger"))))).otherwise(votes)
    df = table(spark, sf_dir, "orders").select(
        k.alias("key"), F.when(who % 7 == 1, F.concat(F.lit("a b"), k)).otherwise(F.concat(F.lit("a"), k)).alias("id"), F.element_at(F.array(*map(F.lit, (*TYPES[:5], "rumour"))), (k % 6 + 1).cast("int")).alias("type"), F.lit("passed").alias("stage"),
        F.when(who % 13 == 2, "  ").otherwise("title").alias("title"), case(k, "https://www.assembly.go.kr/a", "http://assembly.go.kr/", "https://assembly.go.kr:443/x?y", "https://assembly.go.kr.evil.org/", "https://likms.assembly.go.kr/#top").alias("url"), F.array(mine, other).alias("people"), votes.alias("votes"),
    )
    return df.select("key", F.array_join(activity_violations(("assembly.go.kr",)), ",").alias("codes"))


@query("FL-26", """SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CASE WHEN l_linenumber < 5 AND l_partkey % 3 > 0 AND l_suppkey % 4 > 0 AND l_discount < 0.08 AND l_quantity > 10 THEN 'approved' ELSE 'pending' END AS decision,
  l_linenumber < 5 AND l_partkey % 3 > 0 AND l_suppkey % 4 > 0 AND l_quantity > 10 AS eligible, array_to_string(list_filter([CASE WHEN l_linenumber >= 5 THEN 'human_role_review' END, CASE WHEN l_partkey % 3 = 0 OR l_suppkey % 4 = 0 THEN 'identity_review' END,
  CASE WHEN l_discount >= 0.08 THEN 'source_use_review' END, CASE WHEN l_quantity <= 10 THEN 'relation_grounding_review' END], lambda x: x IS NOT NULL), ',') AS blocked FROM lineitem""")
def automatic_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What needs no person: a general relation between two bound identities, on usable sources that name both and the relation."""
    df = table(spark, sf_dir, "lineitem")
    verified = df.join(table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("__part")), "l_partkey", "left")
    verified = verified.join(table(spark, sf_dir, "supplier").where("s_suppkey % 4 > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("__supp")), "l_suppkey", "left")
    general, bound = F.col("l_linenumber") < 5, F.coalesce(F.col("__part") & F.col("__supp"), F.lit(False))
    usable, grounded = F.col("l_discount") < 0.08, F.col("l_quantity") > 10
    reasons = (("human_role_review", general), ("identity_review", bound), ("source_use_review", usable), ("relation_grounding_review", grounded))
    blocked = F.array_compact(F.array(*[F.when(~good, name) for name, good in reasons]))
    return verified.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.when(F.size(blocked) == 0, "approved").otherwise("pending").alias("decision"), (general & bound & grounded).alias("eligible"), F.array_join(blocked, ",").alias("blocked")
    )


@query("FL-27 WN-23", """WITH b AS (SELECT o_orderkey AS asset, o_orderdate AS slot, o_custkey, (SELECT max(o_orderdate) FROM orders) - INTERVAL 2 DAY AS now FROM orders)
SELECT asset, array_to_string(list_filter([CASE WHEN slot <= now THEN 'slot' END, CASE WHEN o_custkey % 4 = 0 THEN 'reserved' END, CASE WHEN o_custkey % 5 = 1 THEN 'unchecked' WHEN o_custkey % 5 = 2 THEN 'stale' END, CASE WHEN o_custkey % 3 = 0 THEN 'approval' END], lambda x: x IS NOT NULL), ',') AS held,
  CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN date_diff('hour', slot, now) >= 72 THEN 72 WHEN date_diff('hour', slot, now) >= 24 THEN 24 END::INTEGER AS mature,
  CASE WHEN o_custkey % 6 <> 0 AND date_diff('hour', slot, now) >= 24 AND o_custkey % 10 > 0 THEN round((o_custkey % 50) / (o_custkey % 10) * 100, 6) END AS saves_per_100 FROM b""")
def publication_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds an asset back before its slot, and which observation of a post is old enough to be read; a rate over nothing
    is unknown."""
    orders = table(spark, sf_dir, "orders")
    now = F.broadcast(orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 2 DAYS")).alias("now")))  # one row
    who = F.col("o_custkey")
    checked = F.when(who % 5 == 1, None).when(who % 5 == 2, F.col("now") - F.expr("INTERVAL 30 HOURS")).otherwise(F.col("now") - F.expr("INTERVAL 3 HOURS"))
    df = orders.join(now).select(F.col("o_orderkey").alias("asset"), F.col("o_orderdate").alias("slot"), "now", checked.alias("checked"), (who % 4 == 0).alias("reserved"), (who % 3 > 0).alias("approved"), (who % 6 > 0).alias("posted"), (who % 50).alias("saves"), (who % 10).alias("reach"))
    fresh = (F.col("checked") <= F.col("now")) & (F.col("checked") >= F.col("now") - F.expr("INTERVAL 24 HOURS"))
    held = F.array_compact(F.array(F.when(F.col("slot") <= F.col("now"), "slot"), F.when(F.col("reserved"), "reserved"), F.when(F.col("checked").isNull(), "unchecked").when(~fresh, "stale"), F.when(~F.col("approved"), "approval")))
    old = lambda n: F.col("posted") & (F.col("slot") <= F.col("now") - F.expr(f"INTERVAL {n} HOURS"))
    rate = F.when(old(24) & (F.col("reach") > 0), F.round(F.col("saves") / F.col("reach") * 100, 6))
    return df.select("asset", F.array_join(held, ",").alias("held"), F.when(old(72), 72).when(old(24), 24).alias("mature"), rate.alias("saves_per_100"))


@query("SL-10 SL-11", """WITH j AS (SELECT o_orderkey AS job, o_custkey % 5 = 0 AS recovery, (['extract', 'community', 'answer'])[1 + o_custkey % 3] AS kind, o_orderkey % 4 AS attempts FROM orders)
SELECT job, row_number() OVER (ORDER BY NOT recovery, CASE kind WHEN 'answer' THEN 0 WHEN 'extract' THEN 1 ELSE 2 END, attempts, job) AS place FROM j ORDER BY place LIMIT 100""")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred jobs that come next: recoveries, then by kind, fewest attempts first."""
    who = F.col("o_custkey")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), (who % 5 == 0).alias("recovery"), case(who, "extract", "community", "answer").alias("kind"), (F.col("o_orderkey") % 4).alias("attempts"))
    order = [F.col("recovery").desc(), F.when(F.col("kind") == "answer", 0).when(F.col("kind") == "extract", 1).otherwise(2), F.col("attempts"), F.col("job")]
    top = jobs.orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("job", F.col("place").cast("bigint").alias("place"))


@query("SL-11", """SELECT n_nationkey AS source, row_number() OVER (ORDER BY n_nationkey % 3 <> 0, n_nationkey) AS place FROM nation""")
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that depend on records of another come after all that do not; a catalog of bounded size."""
    depends = F.col("n_nationkey") % 3 != 0
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), F.row_number().over(Window.orderBy(depends, "n_nationkey")).cast("bigint").alias("place"))


@query("AG-16 WN-04 RT-10", """WITH a AS (SELECT o_custkey AS key, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'queued' END AS state FROM orders),
l AS (SELECT key, arg_max(state, seq) AS state, count(*) FILTER (state = 'failed') AS failures, max(seq) FILTER (state = 'failed') AS failed, max(seq) FILTER (state = 'completed') AS done FROM a GROUP BY key)
SELECT state, count(*) AS n, count(*) FILTER (state = 'failed') AS unresolved, count(*) FILTER (state = 'queued' AND failures > 0 AND failed > coalesce(done, -1)) AS recovering FROM l GROUP BY state""")
def attempt_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest attempts by state, failures that nothing has replaced, and failed keys whose new attempt waits."""
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("queued")
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), state.alias("state"))
    upto = lambda s: F.max(F.when(F.col("state") == s, F.col("seq")))
    last = a.groupBy("key").agg(F.max_by("state", "seq").alias("state"), upto("failed").alias("failed"), upto("completed").alias("done"))
    waits = (F.col("state") == "queued") & (F.col("failed") > F.coalesce("done", F.lit(-1)))
    return last.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "failed").alias("unresolved"), F.count_if(waits).alias("recovering"))
