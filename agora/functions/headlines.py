"""Headline expressions: normalised titles, character pairs, similarity, publisher URLs.  All built in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning for a topic, words that make a topic worth explaining, those of them that are
# specific, endings of words that name an office, and hosts of publishers.
STOP = ("국회", "정부", "대통령", "민주당", "국민의힘", "국힘", "총리", "오늘", "내일", "대한", "위해", "관련", "발표", "의원", "국감", "기자", "단독", "속보", "종합")
VALUE = ("법안", "법원", "예산", "세금", "수사", "소방", "안전", "철도", "반도체", "연금", "주택", "개정", "기소", "지원", "감사", "해킹", "개인정보")
SPECIFIC = ("소방", "철도", "반도체", "연금", "주택", "해킹", "개인정보")
OFFICE_WORD = "(법원장|대통령|총리|장관|위원장|대변인|지사|시장|의원|대표|차관|사무처장)(은|는|이|가|의)?$"
HOSTS = ("www.yna.co.kr", "yna.co.kr", "www.donga.com", "www.hani.co.kr", "www.khan.co.kr")
WRAPPED = r"\[[^\]]*\]|\([^)]*\)"
NOT_WORD = "[^가-힣a-zA-Z0-9]"


def normalised(title: Column) -> Column:
    """A title without bracketed parts, punctuation and case, for copy detection."""
    return F.lower(F.regexp_replace(F.regexp_replace(title, WRAPPED, ""), NOT_WORD, ""))


def pairs(title: Column) -> Column:
    """Different pairs of neighbouring characters within words that are neither stop words nor end in an office."""
    words = F.regexp_extract_all(title, F.lit("([가-힣a-zA-Z0-9]{2,})"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(*STOP) & ~w.rlike(OFFICE_WORD))
    return F.array_distinct(F.flatten(F.transform(kept, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))))


def long_words(title: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(title, F.lit("([가-힣a-zA-Z]{3,})"), F.lit(1))), F.array(*map(F.lit, STOP)))


def specific_words(title: Column) -> Column:
    return F.filter(F.array(*map(F.lit, SPECIFIC)), lambda w: title.contains(w))


def similarity(a: Column, b: Column) -> Column:
    """Of two structs (pairs, long, specific): 0.5 if they share a long and a specific word, else the overlap of their
    pairs over the smaller set, 0 below four shared pairs."""
    shared = F.size(F.array_intersect(a["pairs"], b["pairs"]))
    overlap = F.when(shared >= 4, shared / F.greatest(F.lit(1), F.least(F.size(a["pairs"]), F.size(b["pairs"])))).otherwise(0.0)
    return F.when(F.arrays_overlap(a["long"], b["long"]) & F.arrays_overlap(a["specific"], b["specific"]), 0.5).otherwise(overlap)


def signature(title: Column) -> Column:
    return F.struct(pairs(title).alias("pairs"), long_words(title).alias("long"), specific_words(title).alias("specific"))


def publisher_url(url: Column, hosts: Sequence[str] = HOSTS) -> Column:
    """A publisher's https URL without fragment, campaign parameters and empty ones; null for any other URL.

    Parameters that stay are kept as they are written.
    """
    url = F.trim(url)
    part = lambda n: F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", n)
    host, port = F.lower(F.regexp_extract(part(2), r"^([^:]*)", 1)), F.regexp_extract(part(2), r":([0-9]*)$", 1)
    good = (F.lower(part(1)) == "https") & host.isin(*hosts) & ~part(2).contains("@") & port.isin("", "443") & (F.length(url) <= 2048)
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    kept = F.filter(F.split(part(4), "&"), lambda p: p.rlike("=.") & ~name(p).startswith("utm_") & ~name(p).isin("fbclid", "gclid"))
    query = F.array_join(kept, "&")
    return F.when(good, F.concat(F.lit("https://"), F.lower(part(2)), part(3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
