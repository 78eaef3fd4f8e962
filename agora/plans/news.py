"""News radar: publisher URLs, headline similarity, clusters, search trends, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headlines
from ..operators import clustering
from .registry import query, table

WORDS = ("국회", "소방안전 예산", "반도체 지원", "철도노조 파업", "김철수 의원은", "개인정보 해킹", "연금 개정안", "장관 발표", "주택 공급", "[속보] 서울", "(종합) 부산", "budget plan 2024")
PUBLISHERS = ("연합뉴스", "동아일보", "한겨레", "경향신문")
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"

#: Orders as headlines of a weekly run; two orders may share a URL.
_ARTICLES = f"""articles AS (SELECT date_trunc('week', o_orderdate)::DATE AS run, 'https://www.yna.co.kr/view/' || (o_orderkey - o_orderkey % 3 % 2) AS url,
  ({_LIST(WORDS)})[1 + o_custkey % 12] || ' ' || ({_LIST(WORDS)})[1 + o_orderkey % 11] || ' ' || ({_LIST(WORDS)})[1 + (o_custkey // 12) % 7] AS title,
  ({_LIST(PUBLISHERS)})[1 + o_custkey % 4] AS publisher, o_orderdate + to_seconds(o_orderkey % 86400) AS published_at FROM orders)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (1 + at).cast("int"))
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    title = F.concat_ws(" ", of(WORDS, who % 12), of(WORDS, key % 11), of(WORDS, F.floor(who / 12) % 7))
    at = F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    return table(spark, sf_dir, "orders").select(
        F.date_trunc("week", "o_orderdate").cast("date").alias("run"), F.concat(F.lit("https://www.yna.co.kr/view/"), key - key % 3 % 2).alias("url"), title.alias("title"),
        of(PUBLISHERS, who % 4).alias("publisher"), at.alias("published_at"), (at + F.expr("make_dt_interval(0, 0, o_custkey % 600, 0)")).alias("first_seen"),
    )


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keywords a week."""
    words = F.array(*map(F.lit, ("반도체 지원", "철도 노조", "Budget", "연금", "x", "주택공급")))
    weeks = articles(spark, sf_dir).select("run").distinct()
    n = F.weekofyear("run")
    return weeks.select("run", F.explode(F.array(F.element_at(words, n % 6 + 1), F.element_at(words, (n + 2) % 6 + 1))).alias("keyword"))


_URLS = """WITH u AS (SELECT o_orderkey AS id, CASE o_custkey % 7 WHEN 0 THEN 'http://www.yna.co.kr' WHEN 1 THEN 'https://WWW.yna.co.kr:443' WHEN 2 THEN 'https://u:p@www.donga.com'
  WHEN 3 THEN 'https://www.hani.co.kr:8443' WHEN 4 THEN 'https://www.example.org' WHEN 5 THEN 'HTTPS://www.khan.co.kr' ELSE 'https://yna.co.kr' END
  || '/view/' || o_orderkey || '?utm_source_2=a&id=' || o_orderkey || '&empty=&ref=' || o_orderstatus || '&gclid=1#top' AS url FROM orders)"""


@query("SF-15 SF-16", _URLS + """, p AS (SELECT id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS net,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM u)
SELECT id, CASE WHEN scheme = 'https' AND net IN ('www.yna.co.kr:443', 'www.yna.co.kr', 'yna.co.kr', 'www.donga.com', 'www.hani.co.kr', 'www.khan.co.kr')
  THEN 'https://' || net || path || '?' || array_to_string(list_filter(string_split(q, '&'), lambda x: NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'gclid=') AND x <> 'empty='), '&') END AS canonical FROM p""")
def publisher_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical article URLs; null for other hosts, schemes, ports and for credentials."""
    which = F.col("o_custkey") % 7
    base = ("http://www.yna.co.kr", "https://WWW.yna.co.kr:443", "https://u:p@www.donga.com", "https://www.hani.co.kr:8443", "https://www.example.org", "HTTPS://www.khan.co.kr", "https://yna.co.kr")
    url = F.concat(F.element_at(F.array(*map(F.lit, base)), (which + 1).cast("int")), F.lit("/view/"), "o_orderkey", F.lit("?utm_source_2=a&id="), "o_orderkey", F.lit("&empty=&ref="), "o_orderstatus", F.lit("&gclid=1#top"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), headlines.publisher_url(url).alias("canonical"))


@query("TX-02 TX-03", f"""WITH {_ARTICLES},
t AS (SELECT DISTINCT run, title, list_distinct(list_filter(regexp_extract_all(title, '[가-힣a-zA-Z]{{3,}}'), lambda w: w NOT IN ({_LIST(headlines.STOP)[1:-1]}))) AS l,
  list_filter({_LIST(headlines.SPECIFIC)}, lambda w: contains(title, w)) AS s,
  list_distinct(flatten(list_transform(list_filter(regexp_extract_all(title, '[가-힣a-zA-Z0-9]{{2,}}'), lambda w: w NOT IN ({_LIST(headlines.STOP)[1:-1]}) AND NOT regexp_matches(w, '{headlines.OFFICE_WORD}')),
    lambda w: list_transform(range(1, length(w)), lambda i: substr(w, i, 2))))) AS p FROM articles)
SELECT a.run, a.title AS "left", b.title AS "right", round(CASE WHEN list_has_any(a.l, b.l) AND list_has_any(a.s, b.s) THEN 0.5 ELSE len(list_intersect(a.p, b.p)) / greatest(1, least(len(a.p), len(b.p))) END, 6) AS similarity
FROM t a JOIN t b ON a.run = b.run AND a.title < b.title
WHERE (list_has_any(a.l, b.l) AND list_has_any(a.s, b.s)) OR (len(list_intersect(a.p, b.p)) >= 4 AND len(list_intersect(a.p, b.p)) / greatest(1, least(len(a.p), len(b.p))) >= 0.42)""")
def headline_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar titles of a run.  Titles of the same words are compared once, by what they share in an index of the run."""
    return clustering.similar_titles(articles(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query("TX-04 TX-05 ST-08")
def radar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all articles of each weekly run; order-dependent, tested against a plain reading."""
    return clustering.clustered(articles(spark, sf_dir)).select("run", "url", "title", "cluster", "representative")


@query("JN-22", f"""WITH {_ARTICLES},
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, url ORDER BY published_at DESC, title) AS r FROM articles) WHERE r = 1),
k AS (SELECT run, unnest([(['반도체 지원', '철도 노조', 'Budget', '연금', 'x', '주택공급'])[weekofyear(run) % 6 + 1], (['반도체 지원', '철도 노조', 'Budget', '연금', 'x', '주택공급'])[(weekofyear(run) + 2) % 6 + 1]]) AS keyword FROM (SELECT DISTINCT run FROM articles))
SELECT run, url, keyword FROM once JOIN k USING (run) WHERE length(keyword) >= 2
  AND contains(lower(regexp_replace(regexp_replace(title, '\\[[^\\]]*\\]|\\([^)]*\\)', '', 'g'), '[^가-힣a-zA-Z0-9]', '', 'g')), replace(keyword, ' ', ''))""")
def trend_keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search keywords in the titles of all articles of their week."""
    return clustering.trend_matches(clustering.newest(articles(spark, sf_dir)), trends(spark, sf_dir))


@query("TX-06 AG-13 WN-16 SL-08")
def radar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best candidates of each run."""
    found = articles(spark, sf_dir)
    runs = found.select("run").distinct().select("run", F.expr("cast(run as timestamp_ntz) + INTERVAL 7 DAYS").alias("now"), (F.weekofyear("run") % 5 > 0).alias("baseline"))
    return clustering.candidates(clustering.clustered(found), runs, trends(spark, sf_dir))
