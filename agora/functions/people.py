"""People and their accounts in raw rows; rows are maps of field names to values.  Built in but for NFKC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from . import units

# Field names of upstream rows in the order of preference, titles that make an official, namespaces of ids.
NAME_FIELDS = ("NAAS_NM", "HG_NM", "MEMBER_NAME", "MEM_NM", "SPEAKER_NM", "CHAIR_NM", "CANDIDATE_NM", "NOMINEE_NM", "PERSON_NM")
POSITION_FIELDS = ("JOB_TITLE", "POSITION", "OFFICE", "ROLE", "TITLE")
ORGANIZATION_FIELDS = ("DEPT_NM", "ORG_NM", "PLPT_NM", "BLNG_CMIT_NM", "CMIT_NM", "COMMITTEE_NAME", "PARTY_NAME")
OFFICIAL_TITLES = ("대통령", "국무총리", "부총리", "장관", "차관", "청장", "처장", "공무원", "국무위원", "정부위원", "비서실장", "수석비서관", "검찰총장", "경찰청장")
NAAS, MONA = "OPEN_ASSEMBLY_NAAS_CD", "OPEN_ASSEMBLY_MONA_CD"

# Fields with accounts in order of preference, where a bare handle leads, hosts of each platform.
SOCIAL_FIELDS = (
    ("TWITTER_URL", "X"), ("X_URL", "X"), ("T_URL", "X"), ("YOUTUBE_URL", "YOUTUBE"), ("YT_URL", "YOUTUBE"), ("Y_URL", "YOUTUBE"), ("BLOG_URL", "NAVER_BLOG"), ("B_URL", "NAVER_BLOG"),
    ("FACEBOOK_URL", "FACEBOOK"), ("FB_URL", "FACEBOOK"), ("F_URL", "FACEBOOK"), ("INSTAGRAM_URL", "INSTAGRAM"), ("INSTA_URL", "INSTAGRAM"), ("THREADS_URL", "THREADS"), ("TIKTOK_URL", "TIKTOK"), ("TELEGRAM_URL", "TELEGRAM"),
)
HANDLE_URLS = {"X": "https://x.com/", "YOUTUBE": "https://youtube.com/@", "NAVER_BLOG": "https://blog.naver.com/", "FACEBOOK": "https://facebook.com/", "INSTAGRAM": "https://instagram.com/", "THREADS": "https://threads.net/@", "TIKTOK": "https://tiktok.com/@", "TELEGRAM": "https://t.me/"}
PLATFORM_HOSTS = {
    "X": ("x.com", "twitter.com", "www.twitter.com"), "YOUTUBE": ("youtube.com", "www.youtube.com", "youtu.be"), "NAVER_BLOG": ("blog.naver.com", "m.blog.naver.com"),
    "FACEBOOK": ("facebook.com", "www.facebook.com", "web.facebook.com"), "INSTAGRAM": ("instagram.com", "www.instagram.com"), "THREADS": ("threads.net", "www.threads.net"), "TIKTOK": ("tiktok.com", "www.tiktok.com"), "TELEGRAM": ("t.me", "telegram.me"),
}


def value(fields: Column, name: str) -> Column:
    """A field without white space around it; null if blank or missing."""
    trimmed = F.trim(F.try_element_at(fields, F.lit(name)))
    return F.when(trimmed != "", trimmed)


def first_value(fields: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[value(fields, n) for n in names])


def compact(name: Column) -> Column:
    """A name in NFKC without white space."""
    return F.regexp_replace(units.nfkc(name), r"\s+", "")


def people(rows: DataFrame, key: str, member: Column, roster: Column) -> DataFrame:
    """(key, name, kind, identity_key, position, organization, status, namespace), each person of a row once.

    ``rows`` has ``key`` and ``fields``.  In a member source the id that belongs to the name, NAAS before MONA, verifies its
    person; in a roster whose two names agree, the second is an alias and no person of its own.
    """
    f = F.col("fields")
    naas = member & value(f, "NAAS_CD").isNotNull() & value(f, "NAAS_NM").isNotNull()
    mona = ~naas & member & value(f, "MONA_CD").isNotNull() & value(f, "HG_NM").isNotNull()
    both = roster & naas & value(f, "MONA_CD").isNotNull() & value(f, "HG_NM").isNotNull()
    names = F.array(*[F.struct(F.lit(n).alias("field"), value(f, n).alias("name")) for n in NAME_FIELDS])
    df = rows.select(
        key, F.when(naas, "NAAS_NM").when(mona, "HG_NM").alias("primary"), F.when(naas, value(f, "NAAS_CD")).when(mona, value(f, "MONA_CD")).alias("external"),
        F.when(naas, NAAS).when(mona, MONA).alias("space"), both.alias("both"), value(f, "NAAS_NM").alias("one"), value(f, "HG_NM").alias("two"),
        first_value(f, POSITION_FIELDS).alias("position"), first_value(f, ORGANIZATION_FIELDS).alias("organization"), F.filter(names, lambda s: s["name"].isNotNull()).alias("names"),
    )
    df = df.withColumn("alias", F.col("both") & (compact(F.col("one")) == compact(F.col("two")))).withColumn("said", F.explode("names"))
    df = df.where(~(F.coalesce("alias", F.lit(False)) & (F.col("said.field") == "HG_NM"))).withColumn("name", compact(F.col("said.name")))
    own = F.coalesce(F.col("said.field") == F.col("primary"), F.lit(False))
    official = F.coalesce(F.col("position").rlike("|".join(OFFICIAL_TITLES)), F.lit(False))
    part = lambda c: F.coalesce(units.nfkc_trimmed(F.col(c)), F.lit(""))
    identity = F.when(own, F.concat(F.lit("assembly-member:"), "space", F.lit(":"), F.sha1("external"))).otherwise(F.concat(F.lit("provisional-person:"), F.sha1(F.concat_ws("|", "name", part("position"), part("organization")))))
    return df.select(
        key, "name", F.when(own, "LEGISLATOR").when(official, "PUBLIC_OFFICIAL").otherwise("OTHER").alias("kind"), identity.alias("identity_key"), "position", "organization",
        F.when(own, "VERIFIED_EXTERNAL_ID").otherwise("PROVISIONAL_NAME_MATCH").alias("status"), F.when(own, F.col("space")).alias("namespace"),
    ).distinct()


def accounts(rows: DataFrame, key: str) -> DataFrame:
    """(key, platform, url, handle): of each platform the first field that holds an https URL or a handle of it."""
    f = F.col("fields")
    listed = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(platform).alias("platform"), value(f, field).alias("raw")) for n, (field, platform) in enumerate(SOCIAL_FIELDS)])
    df = rows.select(key, F.explode(F.filter(listed, lambda s: s["raw"].isNotNull())).alias("s")).select(key, "s.*")
    prefix = F.create_map(*[F.lit(x) for pair in HANDLE_URLS.items() for x in pair])[F.col("platform")]
    url = F.when(F.col("raw").contains(":"), F.col("raw")).otherwise(F.concat(prefix, F.regexp_replace("raw", "^@", "")))
    part = lambda n: F.regexp_extract(F.col("url"), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)", n)
    df = df.withColumn("url", url).where(~F.col("url").rlike(r'[\s<>"{}|\\^`]')).select(key, "place", "platform", F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), F.regexp_replace(part(3), "/+$", "").alias("path"))
    allowed = F.create_map(*[x for name, hosts in PLATFORM_HOSTS.items() for x in (F.lit(name), F.array(*map(F.lit, hosts)))])[F.col("platform")]
    df = df.where((F.col("scheme") == "https") & F.array_contains(allowed, F.col("host")))
    host = F.when(F.col("platform") == "X", "x.com").when(F.col("platform") == "FACEBOOK", "facebook.com").otherwise(F.regexp_replace("host", r"^www\.", ""))
    handle = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "^@", "")
    first = ranked(df, [key, "platform"], [F.col("place")]).where("rank = 1")
    return first.select(key, "platform", F.concat(F.lit("https://"), host, "path").alias("url"), F.when(handle != "", handle).alias("handle"))


def merged_accounts(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Accounts (identity, platform, url, handle, is_primary, status, evidence) after ``seen`` (identity, platform, url, handle,
    official, evidence): what was seen is primary and others of its platform no longer; a status only rises."""
    keys = ["identity", "platform", "url"]
    new = seen.select(*keys, F.col("handle").alias("__handle"), F.col("official").alias("__official"), F.when(F.col("official"), F.col("evidence")).alias("__evidence"), F.lit(True).alias("__seen"))
    touched = seen.select("identity", "platform").distinct().withColumn("__touched", F.lit(True))
    df = stored.join(new, keys, "full_outer").join(touched, ["identity", "platform"], "left")
    is_new = F.coalesce("__seen", F.lit(False))
    return df.select(
        *keys, F.when(is_new, F.col("__handle")).otherwise(F.col("handle")).alias("handle"), F.when(is_new, True).when(F.col("__touched"), False).otherwise(F.col("is_primary")).alias("is_primary"),
        F.when(F.col("__official"), "OFFICIAL_DIRECTORY").otherwise(F.coalesce("status", F.lit("UNVERIFIED"))).alias("status"), F.coalesce("__evidence", "evidence").alias("evidence"),
    )


def resolved_identities(candidates: DataFrame, register: DataFrame) -> DataFrame:
    """(person, identity, conflict): the identity that a person's identifiers are registered for, else its own; identifiers
    of two identities are a conflict and resolve to none.  ``candidates`` has person, own, namespace, external."""
    met = candidates.join(register, ["namespace", "external"], "left").groupBy("person", "own").agg(F.count_distinct("identity").alias("n"), F.min("identity").alias("identity"))
    return met.select("person", F.when(F.col("n") <= 1, F.coalesce("identity", "own")).alias("identity"), (F.col("n") > 1).alias("conflict"))
