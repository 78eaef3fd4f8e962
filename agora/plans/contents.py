"""Queries over texts and pages: full-text filters, evidence, detectors, segments, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headlines
from ..functions import text as words
from ..operators import mentions, ordered, retrieval
from .registry import query, table

# Patterns of contact data.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?[0-9]{3}\)?[- ][0-9]{3}-[0-9]{4}"

_BIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2), lambda w: list_transform(range(1, length(w)), lambda i: substr(w, i, 2)))))"


@query("TX-01", f"""
SELECT doc_id FROM documents WHERE len(list_intersect({_BIGRAMS.format("text")}, {_BIGRAMS.format("'quality zebra'")})) > 0""")
def ngram_fulltext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.arrays_overlap(words.bigrams(F.col("text")), words.bigrams(F.lit("quality zebra")))).select("doc_id")


@query("", f"""
WITH b AS (SELECT item_id, {_BIGRAMS.format("text")} AS s FROM benchmark)
SELECT a.item_id AS "left", b.item_id AS "right", round(len(list_intersect(a.s, b.s)) / greatest(1, least(len(a.s), len(b.s))), 6) AS overlap FROM b a JOIN b ON a.item_id < b.item_id
WHERE len(list_intersect(a.s, b.s)) >= 4 AND len(list_intersect(a.s, b.s)) / greatest(1, least(len(a.s), len(b.s))) >= 0.42""")
def title_bigram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates share a bigram; they come from an inverted index of bigrams, and the overlap is counted there."""
    sets = table(spark, sf_dir, "benchmark").select("item_id", words.bigrams(F.col("text")).alias("s"))
    index = sets.select("item_id", F.size("s").alias("n"), F.explode("s").alias("g"))
    pairs = index.select(F.col("item_id").alias("left"), F.col("n").alias("n1"), "g").join(index.select(F.col("item_id").alias("right"), F.col("n").alias("n2"), "g"), "g").where("left < right")
    shared = pairs.groupBy("left", "right", "n1", "n2").agg(F.count("*").alias("both")).where("both >= 4")
    ratio = F.col("both") / F.greatest(F.lit(1), F.least("n1", "n2"))
    return shared.where(ratio >= 0.42).select("left", "right", F.round(ratio, 6).alias("overlap"))


@query("", """
WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM benchmark),
d AS (SELECT doc_id, length(text) AS n, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM documents),
o AS (SELECT item_id, doc_id, len(q.t) AS nq, len(d.t) AS nd, n, len(list_intersect(q.t, d.t)) AS s FROM q, d),
p AS (SELECT item_id, doc_id, round(2 * (s / nd) * (s / nq) / (s / nd + s / nq) * (0.25 + 0.75 * least(n / 90, 1.0)), 9) AS score FROM o WHERE s > 0)
SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p) WHERE rank <= 5""")
def evidence_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents of each question by shared words; sizes of the word sets bound what a document can score."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text")
    held = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("document"), "text")
    length = lambda t: 0.25 + 0.75 * F.least(F.length(t) / 90, F.lit(1.0))
    top = retrieval.top_evidence(asked, held, 5, terms_of=words.terms, detail_of=length, bills=False)
    return top.select(F.col("question").alias("item_id"), F.col("document").alias("doc_id"), "score", "rank")


@query("", """
SELECT doc_id, n_name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(upper(text), '[^A-Z]+')) AS w FROM documents) JOIN nation ON w = n_name GROUP BY ALL""")
def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.upper("text"), "[^A-Z]+")).alias("w"))
    return found.join(table(spark, sf_dir, "nation").select("n_name"), F.col("w") == F.col("n_name")).groupBy("doc_id", "n_name").agg(F.count("*").alias("n"))


@query("", f"""
SELECT doc_id, regexp_matches(text, '{EMAIL}') AS email, regexp_matches(text, '{PHONE}') AS phone FROM documents
WHERE regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{PHONE}')""")
def contact_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(EMAIL).alias("email"), F.col("text").rlike(PHONE).alias("phone"))
    return df.where("email OR phone")


@query("FL-17", f"""
SELECT d.doc_id, CASE WHEN regexp_matches(d.text, '{EMAIL}') THEN 'contact' WHEN coalesce(toxic, 0) = 1 THEN 'toxic' WHEN length(trim(coalesce(d.text, ''))) < 40 THEN 'too_short' WHEN quality = 0 THEN 'quality' ELSE 'publish' END AS reason
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def publication_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = F.when(F.col("text").rlike(EMAIL), "contact").when(F.coalesce("toxic", F.lit(0)) == 1, "toxic").when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 40, "too_short").when(F.col("quality") == 0, "quality").otherwise("publish")
    return df.select("doc_id", reason.alias("reason"))


@query("FL-25", """
SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN 'number' END, CASE WHEN regexp_matches(text, '(?i)\\b(will|shall)\\b') THEN 'future' END], lambda x: x IS NOT NULL), ',') AS codes FROM documents""")
def claim_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    codes = F.array_compact(F.array(F.when(F.length(t) < 100, "short"), F.when(t.rlike("[0-9]{4,}"), "number"), F.when(t.rlike(r"(?i)\b(will|shall)\b"), "future")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(codes, ",").alias("codes"))


@query("AG-14 JN-28", """
SELECT lang, count(*) AS expected, count(l.doc_id) AS indexed, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return df.groupBy("lang").agg(F.count("*").alias("expected"), F.count("hit").alias("indexed"), (F.count("*") - F.count("hit")).alias("missing"))


@query("AG-15 FL-28", """
SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE 'other' END AS domain, count(*) AS sources, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY domain""")
def landscape_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("source").isin("src0", "src1", "src2"), F.col("source")).otherwise("other")
    return table(spark, sf_dir, "documents").groupBy(domain.alias("domain")).agg(F.count("*").alias("sources"), F.sum("n_chars").alias("chars"), F.size(F.collect_set("lang")).cast("bigint").alias("langs"))


@query("SF-15", """
SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^=&]*|fbclid|gclid)=[^&]*', '\\1', 'g'), '&{2,}', '&', 'g'), '\\?&', '?', 'g'), '[?&]$', '') AS canonical FROM pages""")
def url_canonical_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", words.host(F.col("url")).alias("host"), words.canonical_url(F.col("url")).alias("canonical"))


@query("FL-15 SF-15", """
SELECT page_id, starts_with(url, 'https://') AND NOT contains(url, '#') AND regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '(^|\\.)example\\.org$') AS official FROM pages""")
def official_host_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = F.col("url").startswith("https://") & ~F.col("url").contains("#") & words.host(F.col("url")).rlike(r"(^|\.)example\.org$")
    return table(spark, sf_dir, "pages").select("page_id", official.alias("official"))


@query("SRC-22", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("", """
WITH w AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS quote FROM benchmark)
SELECT doc_id, item_id, (length(text) - length(replace(text, quote, ''))) // length(quote) AS n FROM documents JOIN w ON contains(text, quote)""")
def containment_proof_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often documents hold a question's opening eight words, by substring.

    Places of quotes of any length come from the dictionary scan, so no document is held against every quote.  Intervals,
    versions and findings are ``provenance_audit``.
    """
    quote = F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("quote")
    quotes = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", quote)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    met = mentions.places(docs, ["doc_id"], "text", quotes, "quote").select("doc_id", F.col("surface").alias("quote")).distinct()
    count = F.floor((F.length("text") - F.length(F.replace("text", "quote", F.lit("")))) / F.length("quote"))
    return met.join(docs, "doc_id").join(quotes, "quote").select("doc_id", "item_id", count.alias("n"))


@query("WN-14", """
WITH t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, bool_and(p IS NULL OR p + 1 = turn) AS covered FROM t GROUP BY conv_id""")
def contiguous_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"))
    return ordered.contiguous(turns, ["conv_id"], "start", "end")


@query("WN-12", """
SELECT conv_id, turn, right(coalesce(lag(text) OVER w, ''), 300) AS before, left(coalesce(lead(text) OVER w, ''), 300) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def segment_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.lag("text").over(w), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.right(before, F.lit(300)).alias("before"), F.left(F.coalesce(F.lead("text").over(w), F.lit("")), F.lit(300)).alias("after"))


@query("AG-28", """
SELECT source, doc_id AS last_doc, sha1(source || ':' || doc_id) AS fingerprint FROM (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source)""")
def dependency_last_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("last_doc"))
    return last.select("source", "last_doc", F.sha1(F.concat_ws(":", "source", "last_doc")).alias("fingerprint"))


@query("SF-03 SF-19", """
SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]|\\([^)]*\\)', '', 'g'), '[^가-힣a-zA-Z0-9]', '', 'g'))) AS normal_hash, regexp_matches(text, 'the|und') AS keyword FROM documents""")
def keyword_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text holds one of some words, and the hash of its form without brackets, punctuation and case."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(headlines.normalised(F.col("text")), 256).alias("normal_hash"), F.col("text").rlike("the|und").alias("keyword"))
