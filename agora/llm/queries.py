"""The registered queries of the numbered operators, each over its whole table, and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, html, langid, licenses, mixing, packing, quality, simhash, token_counts, token_files, topk, warc, whitening
from .shared import new_folder
from .tokens import public_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    folder = new_folder(spark, "op2-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a cache that starts empty."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "op4-cache"), public_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others of every hundredth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = new_folder(spark, "op7-warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grouped = simhash.near_duplicates(docs, shingle=3, lanes=1, radius=3, keep_text=False)
    return grouped.select("doc_id", F.lpad(F.lower(F.hex(F.col("lanes")[0])), 16, "0").alias("fingerprint"), "component_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 3, 1, 2, ... at 150 % of their words."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def fold(doc_id: str = "doc_id"):
    """True for documents that the classifier may not learn from; null ids are neither held out nor learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~fold()))
    said = langid.identify(docs.select("doc_id", "text"), model)
    return said.select("doc_id", F.coalesce(fold(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 8 whitened components, with its exact deviation; null where that passes 63 bits."""
    found = whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8), "vec_id")
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of 2 to 3 words of each language."""
    found = collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside_percent=50, top=2000)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_files, op3_best_fit_packing, op4_token_counts, op5_html_text, op6_exact_top_k, op7_warc, op8_simhash_groups, op9_source_mix, op10_language_id, op11_whitening, op12_collocations, op13_license_scan)}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.STOP_WORDS)

OP1_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
parts AS (
  SELECT doc_id, body,
    list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM (
    SELECT doc_id, unnest(range(1, len(words) - 3)) AS i,
      unnest(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))) AS w
    FROM parts WHERE len(words) >= 5)),
starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM windows WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(5, coalesce(next - i, 5))) AS n FROM starts GROUP BY doc_id),
measured AS (
  SELECT p.doc_id,
    len(words)::BIGINT AS n_words,
    length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines,
    length(regexp_replace(body, '\P{{Lu}}', '', 'g')) AS capitals,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}'))) AS letter_words,
    len(list_filter(words, lambda w: rtrim(lower(w), '.,;:!?') IN ({_STOP}))) AS stops,
    len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]'))) AS bullets,
    len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
  FROM parts p LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1 AND letter_words / n_words >= 0.7
    AND capitals / word_chars <= 0.5 AND (stops + 1) / n_words >= 0.05 AND n_dup_lines / n_lines <= 0.5
    AND bullets / n_lines <= 0.9 AND ellipses / n_lines <= 0.3 AS kept
FROM measured
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha1(body)) AS newest FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || rpad(substr(hex, 1 + (5 * i) // 4, 2), 2, '0'))::INTEGER >> (3 - (5 * i) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM d
"""

OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) FROM w),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.head JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, part, max(a) AS around FROM (
    SELECT lang, a, array_to_string(ws[1:2], ' ') AS part FROM c WHERE m = 3 UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM c WHERE m = 3)
  GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.part = b.phrase WHERE o.around IS NULL OR 100 * o.around < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.*, n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN totals USING (lang))
WHERE rank <= 2000
"""

_TEMPLATES = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, string_split('{t.text}', ' '))" for i, t in enumerate(licenses.BASE + licenses.NOTICES))

OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.GAPS}'), lambda w: w <> '') AS ws
  FROM documents),
templates(template, label, base, ws) AS (VALUES {_TEMPLATES}),
t AS (
  SELECT *, len(ws) AS m, CASE WHEN len(ws) >= 5 THEN 5 ELSE 2 END AS k,
    CASE WHEN len(ws) < 8 THEN 0 ELSE len(ws) // 10 END AS band, CASE WHEN len(ws) < 8 THEN 1.0 ELSE 0.8 END AS least
  FROM templates),
tw AS (SELECT template, label, base, m, k, band, least, q, array_to_string(ws[q + 1:q + k], ' ') AS gram FROM (SELECT *, unnest(range(0, m - k + 1)) AS q FROM t)),
dw AS (
  SELECT row, 2 AS k, unnest(range(0, len(ws) - 1)) AS p, unnest(list_transform(range(0, len(ws) - 1), lambda i: array_to_string(ws[i + 1:i + 2], ' '))) AS gram FROM docs
  UNION ALL SELECT row, 5, unnest(range(0, len(ws) - 4)), unnest(list_transform(range(0, len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) FROM docs),
met AS (SELECT dw.row, dw.p, tw.* FROM dw JOIN tw ON dw.gram = tw.gram AND dw.k = tw.k),
steps AS (SELECT *, p - q AS diagonal, CASE WHEN p - q - lag(p - q) OVER (PARTITION BY row, template ORDER BY p - q) <= band THEN 0 ELSE 1 END AS begins FROM met),
islands AS (SELECT *, sum(begins) OVER (PARTITION BY row, template ORDER BY diagonal RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM steps),
covered AS (SELECT row, template, label, base, m, least, island, p, unnest(range(q, q + k)) AS word FROM islands),
places AS (
  SELECT row, template, label, base, island, min(p) AS first, count(DISTINCT word) / m AS similarity
  FROM covered GROUP BY row, template, label, base, m, least, island HAVING count(DISTINCT word) / m >= least),
found AS (
  SELECT row, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(similarity) AS score
  FROM places GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (row)
"""

ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op6_exact_top_k": OP6_SQL, "op7_warc": OP7_SQL, "op12_collocations": OP12_SQL, "op13_license_scan": OP13_SQL}
