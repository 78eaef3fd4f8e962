"""Feeds as XML and JSON texts, schemas enforced when they are read."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.headlines import HOSTS, publisher_url
from ..operators.ordered import ranked

RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string, approx_traffic: string>>>"
MOST_BYTES = 2_000_000


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references decoded."""
    return texts.map(html.unescape, na_action="ignore")


def clean(text: Column) -> Column:
    """A text without markup and runs of white space, at most 300 characters."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(unescaped(F.coalesce(text, F.lit(""))), "<[^>]*>", ""), r"\s+", " ")), F.lit(300))


def mail_date(text: Column) -> Column:
    """UTC time of a date as mail headers write it; null without an offset."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    at = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    zero = F.lit(0)
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(zero, zero, zero, (F.unix_micros(at) / 1000000).cast("decimal(18,6)"))


def items(feeds: DataFrame, key: str, xml: str, most: int) -> DataFrame:
    """(key, now, place, title, link, at, traffic) of the first ``most`` items; no feed with declarations or of over 2 MB."""
    safe = ~F.col(xml).rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)") & (F.octet_length(xml) <= MOST_BYTES)
    parsed = feeds.where(safe).select(key, "now", F.from_xml(F.col(xml), RSS).alias("rss"))
    df = parsed.select(key, "now", F.posexplode("rss.channel.item").alias("place", "i")).where(F.col("place") < most)
    return df.select(key, "now", "place", clean(F.col("i.title")).alias("title"), "i.link", mail_date(F.col("i.pubDate")).alias("at"), clean(F.col("i.approx_traffic")).alias("traffic"))


def _recent(hours: int) -> Column:
    return (F.col("at") >= F.col("now") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("at") <= F.col("now") + F.expr("INTERVAL 5 MINUTES"))


def articles(feeds: DataFrame, key: str, xml: str, hosts: tuple[str, ...] = HOSTS) -> DataFrame:
    """(key, url, title, at): headlines of up to three days ago and five minutes ahead, of the feed's own hosts, each URL once."""
    df = items(feeds, key, xml, 200).where((F.col("title") != "") & _recent(72)).withColumn("url", publisher_url(F.col("link"), hosts)).where(F.col("url").isNotNull())
    return ranked(df, [key, "url"], [F.col("place").desc()]).where("rank = 1").select(key, "url", "title", "at")


def keywords(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, keyword, traffic, at): search keywords of up to two days ago."""
    df = items(feeds, key, xml, 50).where((F.col("title") != "") & _recent(48))
    return df.select(key, F.col("title").alias("keyword"), "traffic", "at")


ARTICLE = "struct<title: string, url: string, publisher: string, publishedAt: string>"
FEED = (
    "schemaVersion int, date string, generatedAt string, status string, selectionMethod string, baselineAvailable boolean,"
    f" items array<struct<id: string, title: string, question: string, reason: string, score: int, publishedAt: string, reviewStatus: string, evidence: array<string>, articles: array<{ARTICLE}>>>"
)


def public_feed(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, valid, items): a public radar file is valid as a whole or not at all; columns not in the schema are left behind."""
    feed = raw.select(key, F.octet_length(text).alias("__n"), F.from_json(text, FEED).alias("f"))
    is_text = lambda c, most: F.coalesce((F.trim(c) != "") & (F.length(c) <= most), F.lit(False))
    is_time = lambda c: F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}T.*Z$") & F.try_to_timestamp(c).isNotNull(), F.lit(False))
    article = lambda a: is_text(a["title"], 300) & is_time(a["publishedAt"]) & publisher_url(a["url"]).isNotNull()
    item = lambda i: (
        F.coalesce(i["id"].rlike("^news_[a-f0-9]{16}$"), F.lit(False)) & is_text(i["title"], 300) & is_text(i["question"], 300) & is_text(i["reason"], 1000) & is_time(i["publishedAt"])
        & F.coalesce(i["reviewStatus"] == "unreviewed", F.lit(False)) & F.coalesce(F.size(i["evidence"]) == 0, F.lit(False)) & F.coalesce(F.size(i["articles"]).between(1, 5), F.lit(False)) & F.coalesce(F.forall(i["articles"], article), F.lit(False))
    )
    valid = (
        (F.col("__n") <= 262_144) & (F.col("f.schemaVersion") == 1) & F.try_to_date(F.col("f.date"), "yyyy-MM-dd").isNotNull() & is_time(F.col("f.generatedAt")) & F.col("f.status").isin("ok", "partial", "unavailable")
        & (F.col("f.selectionMethod") == "rules-shortlist-human-review") & F.col("f.baselineAvailable").isNotNull() & (F.size("f.items") <= 10) & F.forall("f.items", item)
    )
    return feed.select(key, F.coalesce(valid, F.lit(False)).alias("valid"), F.when(F.coalesce(valid, F.lit(False)), F.col("f.items")).alias("items"))
