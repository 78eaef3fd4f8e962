"""Queries over events: retention, cohorts, dashboards, rates, budgets, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ordered, relations
from .registry import query, table


@query("AG-01 FL-02 SF-07", """
SELECT k, max(event_id) AS latest, count(*) AS n FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) WHERE k IS NOT NULL AND k <> ''
GROUP BY k ORDER BY latest DESC, k LIMIT 20""")
def json_field_group_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k IS NOT NULL AND k <> ''")
    return df.groupBy("k").agg(F.max("event_id").alias("latest"), F.count("*").alias("n")).orderBy(F.desc("latest"), "k").limit(20)


@query("JN-03 JN-25", """
SELECT n_name, count(*) AS n FROM events JOIN nation ON n_nationkey = TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) GROUP BY n_name""")
def json_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return keyed.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("WN-03 AG-09 AG-10", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases,
  CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'ATTENTION' ELSE 'HEALTHY' END AS overall FROM l WHERE r = 1 GROUP BY day""")
def dashboard_status_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    latest = ordered.latest_by(df, ["user_id", "day"], [F.col("ts").desc(), F.col("event_id").desc()])
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return latest.groupBy("day").agg(n("error").alias("errors"), n("view").alias("views"), n("purchase").alias("purchases"), F.when(n("error") > 0, "ATTENTION").otherwise("HEALTHY").alias("overall"))


@query("JN-20", """
WITH d AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events), k AS (SELECT DISTINCT user_id FROM events),
f AS (SELECT ts::DATE AS day, user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, user_id, coalesce(n, 0) AS n, latest, n IS NULL AS missed FROM d CROSS JOIN k LEFT JOIN f USING (day, user_id)""")
def calendar_scaffold_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every calendar day with every user: how many events, the latest of them, or that there was none."""
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    ends = df.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    found = df.groupBy("day", "user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    out = relations.scaffold(F.broadcast(days), df.select("user_id").distinct(), found, ["day", "user_id"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", F.coalesce("n", F.lit(0)).alias("n"), "latest", F.col("n").isNull().alias("missed"))


@query("AG-11 AG-12 FL-23", """
SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed,
  CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'SUCCESS' WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'FAILED' ELSE 'PARTIAL' END AS outcome,
  bool_and(value IS NOT NULL) AS complete FROM events GROUP BY user_id""")
def run_outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed, runs = F.count_if(F.col("event_type") == "error"), F.count("*")
    outcome = F.when(failed == 0, "SUCCESS").when(failed == runs, "FAILED").otherwise("PARTIAL")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(runs.alias("runs"), failed.alias("failed"), outcome.alias("outcome"), F.bool_and(F.col("value").isNotNull()).alias("complete"))


@query("AG-12", """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS messages FROM customer GROUP BY c_nationkey""")
def distinct_messages_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "; ").alias("messages"))


@query("AG-05 JN-18", """
WITH f AS (SELECT user_id, min(ts) AS at FROM events WHERE event_type = 'signup' GROUP BY user_id),
a AS (SELECT f.user_id, min(ts) AS at FROM f JOIN events e ON e.user_id = f.user_id AND event_type = 'view' AND ts >= f.at GROUP BY f.user_id),
r AS (SELECT a.user_id, a.at <= (SELECT max(ts) FROM events) - INTERVAL 28 DAY AS eligible,
  EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND event_type = 'view' AND ts >= a.at + INTERVAL 21 DAY AND ts < a.at + INTERVAL 28 DAY) AS returned FROM a)
SELECT count(*) AS activated, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND returned) AS returned,
  round(count(*) FILTER (eligible AND returned) / nullif(count(*) FILTER (eligible), 0), 6) AS retention FROM r""")
def usage_week4_retention(spark: SparkSession, sf_dir: str, first_day: int = 21, last_day: int = 28) -> DataFrame:
    """Follow, first open after it, return from ``first_day`` to before ``last_day`` days later."""
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    follow = df.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("follow"))
    opens = df.where("event_type = 'view'").join(follow, "user_id").where("ts >= follow")
    first = F.min("ts").over(Window.partitionBy("user_id"))
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    back = (F.col("ts") >= F.col("at") + days(first_day)) & (F.col("ts") < F.col("at") + days(last_day))
    per = opens.withColumn("at", first).groupBy("user_id", "at").agg(F.bool_or(back).alias("returned"))
    now = F.broadcast(df.agg(F.max("ts").alias("now")))  # a single row
    per = per.join(now).withColumn("eligible", F.col("at") <= F.col("now") - days(last_day))
    eligible, returned = F.count_if("eligible"), F.count_if(F.col("eligible") & F.col("returned"))
    return per.agg(F.count("*").alias("activated"), eligible.alias("eligible"), returned.alias("returned"), F.round(F.try_divide(returned, eligible), 6).alias("retention"))


@query("AG-06", "SELECT count(*) AS responses, count(*) FILTER (value > 50) AS positive FROM events WHERE event_type = 'purchase'")
def relevance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").agg(F.count("*").alias("responses"), F.count_if(F.col("value") > 50).alias("positive"))


@query("JN-17 WN-08 SM-14", """
WITH w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS read FROM events)
SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM w WHERE event_type = 'click' AND read IS NOT NULL AND ts <= read + INTERVAL 30 MINUTE GROUP BY user_id""")
def cohort_activation_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered.last_before(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "view", "ts", "read")
    return df.where((F.col("event_type") == "click") & (F.col("ts") <= F.col("read") + F.expr("INTERVAL 30 MINUTES"))).groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("AG-07 SF-12", """
WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY user_id),
f AS (SELECT a.user_id, t0 + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) AS eligible, EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND event_type = 'view' AND e.ts > t0
  AND e.ts < t0 + INTERVAL 7 DAY AND (e.ts + INTERVAL 9 HOUR)::DATE <> (t0 + INTERVAL 9 HOUR)::DATE) AS returned FROM a)
SELECT CASE WHEN user_id % 2 = 0 THEN 'friend' ELSE 'external' END AS cohort, count(*) AS activated, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND returned) AS returned FROM f GROUP BY cohort""")
def cohort_d7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    at = df.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("at"))
    back = (F.col("event_type") == "view") & (F.col("ts") > F.col("at")) & (F.col("ts") < F.col("at") + F.expr("INTERVAL 7 DAYS")) & (text.kst_date(F.col("ts")) != text.kst_date(F.col("at")))
    per = df.join(at, "user_id").groupBy("user_id", "at").agg(F.bool_or(back).alias("returned")).join(df.agg(F.max("ts").alias("now")))
    per = per.withColumn("eligible", F.col("at") + F.expr("INTERVAL 7 DAYS") <= F.col("now"))
    cohort = F.when(F.col("user_id") % 2 == 0, "friend").otherwise("external")
    return per.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("activated"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("returned")).alias("returned"))


@query("AG-20", """
SELECT coalesce(c_mktsegment, 'all') AS cohort, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS active FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def cohort_rollup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").rollup("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    return df.select(F.coalesce("c_mktsegment", F.lit("all")).alias("cohort"), "n", "active")


@query("AG-08 SF-12", """
SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS visits FROM events GROUP BY ALL""")
def acquisition_by_kst_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format(text.kst_date(F.col("ts")), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("visits"))


@query("SM-05 SF-13", """
SELECT user_id, event_type, floor(epoch(ts) / 300)::BIGINT AS bucket, min(event_id) AS event_id FROM events GROUP BY ALL""")
def five_minute_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", text.bucket(F.col("ts"), 300).alias("bucket")).agg(F.min("event_id").alias("event_id"))


@query("WN-22 SM-06", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5""")
def hourly_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("hour", text.bucket(F.col("ts"), 3600))
    return ordered.ranked(df, ["user_id", "hour"], [F.col("ts"), F.col("event_id")]).where("rank <= 5").select("event_id")


@query("WN-21", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events""")
def rolling_hour_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("s", text.bucket(F.col("ts"), 1))
    return df.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)).alias("n"))


@query("SM-15", """
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, sum(o_totalprice) OVER w <= 500000 AS admitted FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def budget_running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered.running_cap(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice"), 500000)
    return df.select("o_orderkey", F.round("running", 2).alias("running"), "admitted")


@query("WN-13", """
WITH i AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 1800 AS b FROM events),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS parts FROM g GROUP BY user_id, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", text.bucket(F.col("ts"), 1).alias("a")).withColumn("b", F.col("a") + 1800)
    return ordered.merged_intervals(df, ["user_id"], "a", "b")


@query("WN-16 AG-13", """
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT event_type, count(*) FILTER (ts > now - INTERVAL 6 HOUR) AS recent, count(*) FILTER (ts <= now - INTERVAL 6 HOUR AND ts > now - INTERVAL 12 HOUR) AS previous,
  CASE WHEN min(ts) > max(now) - INTERVAL 12 HOUR THEN 'no-baseline' WHEN count(*) FILTER (ts > now - INTERVAL 6 HOUR) > 0 AND count(*) FILTER (ts <= now - INTERVAL 6 HOUR AND ts > now - INTERVAL 12 HOUR) = 0 THEN 'new'
  WHEN count(*) FILTER (ts > now - INTERVAL 6 HOUR) > count(*) FILTER (ts <= now - INTERVAL 6 HOUR AND ts > now - INTERVAL 12 HOUR) THEN 'rising' ELSE 'steady' END AS growth FROM events, n GROUP BY event_type""")
def radar_growth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", "ts")
    df = df.join(df.agg(F.max("ts").alias("now")))
    six, twelve = F.col("now") - F.expr("INTERVAL 6 HOURS"), F.col("now") - F.expr("INTERVAL 12 HOURS")
    recent, previous = F.count_if(F.col("ts") > six), F.count_if((F.col("ts") <= six) & (F.col("ts") > twelve))
    growth = F.when(F.min("ts") > F.max(twelve), "no-baseline").when((recent > 0) & (previous == 0), "new").when(recent > previous, "rising").otherwise("steady")
    return df.groupBy("event_type").agg(recent.alias("recent"), previous.alias("previous"), growth.alias("growth"))


@query("WN-04", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id DESC) AS r FROM events)
SELECT event_type, count(*) AS n FROM l WHERE r = 1 GROUP BY event_type""")
def latest_attempt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return ordered.latest_by(df, ["user_id", "k"], [F.col("event_id").desc()]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("AG-18 SM-13", "SELECT user_id, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def first_and_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.count("*").alias("n"))


@query("ST-08 JN-24 PJ-14", """
WITH u AS (SELECT event_id, user_id, 0 AS feed FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id, 1 FROM events WHERE user_id % 2 = 0)
SELECT event_id, min(feed) AS feed FROM u GROUP BY event_id""")
def merged_follow_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    both = df.where("event_type = 'view'").select("event_id", F.lit(0).alias("feed")).unionByName(df.where("user_id % 2 = 0").select("event_id", F.lit(1).alias("feed")))
    return both.groupBy("event_id").agg(F.min("feed").alias("feed"))


@query("AG-21 AG-22", """
SELECT o_orderpriority, CASE WHEN count(*) FILTER (o_orderkey % 5 = 0) > 0 THEN NULL ELSE round(sum(o_totalprice), 2) END AS total, count(*) FILTER (o_orderkey % 5 = 0) AS unknown,
  round(100 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 6) AS closed_per_100 FROM orders GROUP BY o_orderpriority""")
def budget_unknown_not_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    unknown = F.count_if(price.isNull())
    closed = F.try_divide(100 * F.count_if(F.col("o_orderstatus") == "F"), F.count("*"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.when(unknown == 0, F.round(F.sum(price), 2)).alias("total"), unknown.alias("unknown"), F.round(closed, 6).alias("closed_per_100"))


@query("SF-26 SM-15", """
SELECT l_returnflag, sum((l_quantity::DECIMAL(18,6) * 150 / 1000000)::DECIMAL(18,6))::DOUBLE AS cost FROM lineitem GROUP BY l_returnflag""")
def cost_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = (F.col("l_quantity").cast("decimal(18,6)") * F.lit(150) / F.lit(1000000)).cast("decimal(18,6)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(cost).cast("double").alias("cost"))
