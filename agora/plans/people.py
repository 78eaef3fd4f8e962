"""Queries over people, accounts, contacts, spellings, laws.  Rows of customers, suppliers and orders are dressed as upstream
rows; the SQL states what each must become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms, people
from .registry import query, table


def case(key: Column, *values: str | Column | None) -> Column:
    """The value at ``key`` modulo the number of values; strings are literals."""
    made = [F.lit(v) if v is None or isinstance(v, str) else v for v in values]
    return F.element_at(F.array(*[m.cast("string") for m in made]), (key % len(made) + 1).cast("int"))


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    fields = {
        "NAAS_CD": F.when(k % 3 == 0, F.concat(F.lit("N"), k)), "NAAS_NM": F.when(k % 3 == 0, F.concat(F.lit(" "), name)), "MONA_CD": F.when(k % 2 == 0, F.concat(F.lit("M"), k)),
        "HG_NM": F.when(k % 2 == 0, F.when(k % 5 == 0, F.concat(F.lit("Other "), k)).otherwise(F.replace(name, F.lit("#"), F.lit(" #")))), "SPEAKER_NM": F.when(k % 4 == 1, F.concat(F.lit("Speaker "), "c_nationkey")),
        "CHAIR_NM": F.when(k % 8 == 1, F.concat(F.lit("Speaker"), "c_nationkey")), "OFFICE": case(k, "장관", " ", None, "과장", "국무총리 비서실장"), "PARTY_NAME": F.col("c_mktsegment"),
    }
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v)]).alias("fields"))


@query("PJ-01 PJ-02 PJ-03 PJ-04 SF-03", """
WITH r AS (SELECT c_custkey AS k, replace(c_name, ' ', '') AS nm, nullif(trim((['장관', ' ', '', '과장', '국무총리 비서실장'])[1 + c_custkey % 5]), '') AS pos, c_mktsegment AS org, c_nationkey AS nat FROM customer),
s AS (SELECT k, nm AS name, 'OPEN_ASSEMBLY_NAAS_CD' AS namespace, 'N' || k AS ext, pos, org FROM r WHERE k % 3 = 0
  UNION ALL SELECT k, CASE WHEN k % 5 = 0 THEN 'Other' || k ELSE nm END, CASE WHEN k % 3 <> 0 THEN 'OPEN_ASSEMBLY_MONA_CD' END, 'M' || k, pos, org FROM r WHERE k % 2 = 0 AND NOT (k % 3 = 0 AND k % 5 <> 0 AND k % 7 = 0)
  UNION SELECT k, 'Speaker' || nat, NULL, NULL, pos, org FROM r WHERE k % 4 = 1)
SELECT DISTINCT k AS id, name, CASE WHEN namespace IS NOT NULL THEN 'LEGISLATOR' WHEN pos IN ('장관', '국무총리 비서실장') THEN 'PUBLIC_OFFICIAL' ELSE 'OTHER' END AS kind,
  CASE WHEN namespace IS NOT NULL THEN 'assembly-member:' || namespace || ':' || sha1(ext) ELSE 'provisional-person:' || sha1(name || '|' || coalesce(pos, '') || '|' || org) END AS identity_key,
  CASE WHEN namespace IS NOT NULL THEN 'VERIFIED_EXTERNAL_ID' ELSE 'PROVISIONAL_NAME_MATCH' END AS status FROM s""")
def people_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People in rows of a member source; every seventh row is from a roster, where agreeing names are one person."""
    found = people.people(customer_rows(spark, sf_dir), "id", F.lit(True), F.col("id") % 7 == 0)
    return found.select("id", "name", "kind", "identity_key", "status")


def supplier_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    who = F.concat(F.lit("user"), k)
    fields = {
        "TWITTER_URL": case(k, " ", F.concat(F.lit("@"), who), F.concat(F.lit("https://WWW.twitter.com/"), who, F.lit("//?x=1")), F.concat(F.lit("http://x.com/"), who)), "X_URL": F.concat(F.lit("https://x.com/second"), k),
        "YOUTUBE_URL": case(k, F.concat(F.lit("@"), who), who, F.concat(F.lit("https://youtu.be/"), who), F.concat(F.lit("https://youtube.com.evil/"), who), F.concat(F.lit("https://www.youtube.com/c/"), who)),
        "FB_URL": case(k, F.concat(F.lit("https://web.facebook.com/"), who, F.lit("/")), "https://facebook.com", F.concat(F.lit("https://facebook.com/a b/"), who)), "B_URL": F.when(k % 2 == 0, who), "TELEGRAM_URL": F.concat(F.lit("https://u@telegram.me:443/"), who),
    }
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v)]).alias("fields"))


_ACCOUNTS = """s AS (SELECT s_suppkey AS id, 'user' || s_suppkey AS u FROM supplier), acc AS (
SELECT id, 'X' AS platform, 'https://x.com/' || CASE WHEN id % 4 IN (1, 2) THEN u ELSE 'second' || id END AS url, CASE WHEN id % 4 IN (1, 2) THEN u ELSE 'second' || id END AS handle FROM s
UNION ALL SELECT id, 'YOUTUBE', (['https://youtube.com/@', 'https://youtube.com/@', 'https://youtu.be/', '', 'https://youtube.com/c/'])[1 + id % 5] || u, u FROM s WHERE id % 5 <> 3
UNION ALL SELECT id, 'FACEBOOK', CASE WHEN id % 3 = 0 THEN 'https://facebook.com/' || u ELSE 'https://facebook.com' END, CASE WHEN id % 3 = 0 THEN u END FROM s WHERE id % 3 < 2
UNION ALL SELECT id, 'NAVER_BLOG', 'https://blog.naver.com/' || u, u FROM s WHERE id % 2 = 0
UNION ALL SELECT id, 'TELEGRAM', 'https://telegram.me/' || u, u FROM s)"""


@query("PJ-05 WN-19 SF-16 SF-17", f"WITH {_ACCOUNTS} SELECT id, platform, url, handle FROM acc")
def social_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.accounts(supplier_accounts(spark, sf_dir), "id")


@query("SNK-05", f"""WITH {_ACCOUNTS}, old AS (SELECT id AS identity, platform, CASE WHEN id % 3 = 0 THEN url || '/old' ELSE url END AS url, id % 2 = 0 AS official FROM acc WHERE id % 5 > 0),
new AS (SELECT id AS identity, platform, url, handle, id % 4 = 0 AS official FROM acc WHERE id % 7 > 0)
SELECT coalesce(o.identity, n.identity) AS identity, coalesce(o.platform, n.platform) AS platform, coalesce(o.url, n.url) AS url, n.identity IS NOT NULL OR NOT EXISTS (SELECT 1 FROM new x WHERE x.identity = o.identity AND x.platform = o.platform) AS is_primary,
  CASE WHEN n.official OR coalesce(o.official, false) THEN 'OFFICIAL_DIRECTORY' ELSE 'UNVERIFIED' END AS status, CASE WHEN n.official THEN 'new' WHEN o.identity IS NOT NULL THEN 'old' END AS evidence
FROM old o FULL JOIN new n ON o.identity = n.identity AND o.platform = n.platform AND o.url = n.url""")
def social_account_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored accounts after a new scan: primaries move, a status only rises, evidence stays unless there is newer."""
    found = people.accounts(supplier_accounts(spark, sf_dir), "id").withColumnRenamed("id", "identity")
    k = F.col("identity")
    stored = found.where(k % 5 > 0).select("identity", "platform", F.when(k % 3 == 0, F.concat("url", F.lit("/old"))).otherwise(F.col("url")).alias("url"), "handle", F.lit(True).alias("is_primary"), F.when(k % 2 == 0, "OFFICIAL_DIRECTORY").otherwise("UNVERIFIED").alias("status"), F.lit("old").alias("evidence"))
    seen = found.where(k % 7 > 0).select("identity", "platform", "url", "handle", (k % 4 == 0).alias("official"), F.lit("new").alias("evidence"))
    return people.merged_accounts(stored, seen).select("identity", "platform", "url", "is_primary", "status", "evidence")


@query("CD-08", """WITH c AS (SELECT c_custkey AS person, unnest([c_custkey % 700, 1000 + c_custkey % 900]) AS external FROM customer), r AS (SELECT s_suppkey * 7 AS external, 'i' || s_suppkey AS identity FROM supplier),
m AS (SELECT person, count(DISTINCT identity) AS n, min(identity) AS identity FROM c LEFT JOIN r USING (external) GROUP BY person)
SELECT person, CASE WHEN n <= 1 THEN coalesce(identity, 'own' || person) END AS identity, n > 1 AS conflict FROM m""")
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two identifiers a person against the register; two identities found are a conflict."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("person"), F.concat(F.lit("own"), k).alias("own"), F.lit("n").alias("namespace"), F.explode(F.array(k % 700, 1000 + k % 900)).alias("external"))
    register = table(spark, sf_dir, "supplier").select(F.lit("n").alias("namespace"), (F.col("s_suppkey") * 7).alias("external"), F.concat(F.lit("i"), "s_suppkey").alias("identity"))
    return people.resolved_identities(asked, register)


@query("CD-09", """WITH p AS (SELECT 'key' || c_custkey AS identity_key, c_name AS name FROM customer), b AS (SELECT 'key' || c_custkey AS identity_key, 'e' || c_custkey AS entity_id FROM customer WHERE c_custkey % 3 = 0),
k AS (SELECT c_custkey AS k, 'key' || c_custkey AS identity_key, 'x' || c_custkey % 50 AS entity_id FROM customer WHERE c_custkey % 4 = 1)
SELECT p.identity_key, coalesce(b.entity_id, k.entity_id, 'p_' || sha256(p.identity_key)) AS entity_id, 'p_' || sha256(p.identity_key) AS alias_id, b.entity_id IS NULL AND k.entity_id IS NULL AS new_entity FROM p LEFT JOIN b USING (identity_key) LEFT JOIN k USING (identity_key)""")
def stable_identity_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of people: bound before, known by an identifier, or new by the hash of the key; the hash is always an alias."""
    k = F.col("c_custkey")
    key = F.concat(F.lit("key"), k)
    df = table(spark, sf_dir, "customer")
    bound = df.where(k % 3 == 0).select(key.alias("identity_key"), F.concat(F.lit("e"), k).alias("__bound"))
    known = df.where(k % 4 == 1).select(key.alias("identity_key"), F.concat(F.lit("x"), k % 50).alias("__known"))
    hashed = F.concat(F.lit("p_"), F.sha2("identity_key", 256))
    met = df.select(key.alias("identity_key")).join(bound, "identity_key", "left").join(known, "identity_key", "left")
    return met.select("identity_key", F.coalesce("__bound", "__known", hashed).alias("entity_id"), hashed.alias("alias_id"), (F.col("__bound").isNull() & F.col("__known").isNull()).alias("new_entity"))


_CONTACTS = ("문의 전화: 02-345-1234 까지", "담당자 kim.7@example.go.kr 로", "01012345678", "청사 주소: 서울", "문의 Tel 1588-1234", "우편: 서울특별시 종로", "번호 1234567890123 은 아님", "그냥 글", "가격 12,000원")
_MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}|(?:직장주소|주소)\s*[:：]|(?:\(\s*우편\s*\)|우편\s*[:：])\s*[가-힣]{2,}(?:특별자치시|특별자치도|특별시|광역시|도)\s+[가-힣0-9]"
_PHONE = r"(?:\(?0\d{1,2}\)?[\s.)-]?)\d{3,4}[\s.-]\d{4}|01\d{8,9}|1[568]\d{2}[\s.-]?\d{4}"


@query("FL-16 SF-25", rf"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) || ([{', '.join(f"'{c}'" for c in _CONTACTS)}])[1 + doc_id % {len(_CONTACTS)}] AS text FROM documents),
m AS (SELECT *, regexp_matches(text, '{_MAIL}') AS mail, regexp_matches(text, '(?:^|[^0-9])(?:{_PHONE})(?:[^0-9]|$)') AS phone FROM t),
p AS (SELECT *, CASE WHEN mail THEN regexp_extract(text, '(?s)^(.*?)(?:{_MAIL})', 1) END AS a, CASE WHEN phone THEN regexp_extract(text, '(?s)^(|.*?[^0-9])(?:{_PHONE})(?:[^0-9]|$)', 1) END AS b FROM m),
c AS (SELECT *, CASE WHEN a IS NULL OR length(b) < length(a) THEN b ELSE a END AS before FROM p),
l AS (SELECT *, rtrim(regexp_replace(before, '(?i)(?:연락처|전화번호|전화|휴대전화|휴대폰|팩스|Fax|Tel|직장주소|주소)\s*[:：]?\s*$', ''), ' ') AS kept FROM c)
SELECT doc_id, mail OR phone AS contact, CASE WHEN NOT (mail OR phone) THEN text WHEN regexp_matches(kept, '{_MAIL}') OR regexp_matches(kept, '(?:^|[^0-9])(?:{_PHONE})(?:[^0-9]|$)') THEN '' ELSE kept END AS prefix FROM l""")
def contact_free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold contact data, each with a line more at its end, and what is left before the first."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), case(F.col("doc_id"), *_CONTACTS))
    return table(spark, sf_dir, "documents").select("doc_id", forms.has_contact(text).alias("contact"), forms.contact_free_prefix(text).alias("prefix"))


_SPELT = ("의원 홍길동 발언", "의원 홍 길 동 발언", "홍 길동 그리고 홍  길동", "김홍길 동의", "의원 홍  길동, 질의", "")


@query("SF-23 SF-24", rf"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' ' || ([{', '.join(f"'{c}'" for c in _SPELT)}])[1 + doc_id % {len(_SPELT)}] AS text FROM documents),
f AS (SELECT *, list_distinct(regexp_extract_all(text, '홍[ \t\xa0]{{0,8}}길[ \t\xa0]{{0,8}}동')) AS found, regexp_extract(text, '(?:^|[^\p{{L}}\p{{N}}_])(홍\s*길\s*동)(?:[^\p{{L}}\p{{N}}_]|$)', 1) AS surface FROM t)
SELECT doc_id, CASE WHEN contains(text, '홍길동') THEN '홍길동' WHEN len(found) = 1 THEN found[1] END AS spelling, nullif(surface, '') AS surface FROM f""")
def source_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one spelling of a name in a document, spaces between letters aside, and as a word of its own; several spellings are none."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), case(F.col("doc_id"), *_SPELT))
    return table(spark, sf_dir, "documents").select("doc_id", forms.spelling(text, F.lit("홍길동")).alias("spelling"), F.nullif(forms.spaced_name(text, F.lit("홍길동")), F.lit("")).alias("surface"))


_LABELS = ("경기도 화성시 홍길동", " 홍길동 서울시 ", "누가 발의 했나", "표결 결과", "장관 발언 내용", "투표 시 홍길동은", "홍길동")


@query("TX-11", rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END || ([{', '.join(f"'{c}'" for c in _LABELS)}])[1 + doc_id % {len(_LABELS)}] AS text FROM documents)
SELECT doc_id, regexp_matches(trim(text), '{forms.LABEL}') AS label, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{words}') THEN '{','.join(roles)}' END" for words, roles in forms.HINTS)}], lambda c: c IS NOT NULL), ',') AS hints FROM t""")
def labels_and_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are only a label of name and place, and the roles that a text asks for."""
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise(""), case(F.col("doc_id"), *_LABELS))
    return table(spark, sf_dir, "documents").select("doc_id", forms.is_label(text).alias("label"), F.array_join(forms.role_hints(text), ",").alias("hints"))


@query("TX-14", """SELECT p_partkey AS id, string_split(p_name, ' ')[1] || '|' || string_split(p_name, ' ')[2] || '|Brand-' || p_size || '|' || p_type || '|' || p_name || '|Brand-' || p_size || ' ' || p_type AS names FROM part WHERE len(string_split(p_name, ' ')) = 2""")
def offered_name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a source, then pairs of words, each once."""
    text = F.concat("p_name", F.lit(",  Brand-"), "p_size", F.lit(" "), "p_type", F.lit(". "), "p_name", F.lit(" !"))
    return table(spark, sf_dir, "part").where(F.size(F.split("p_name", " ")) == 2).select(F.col("p_partkey").alias("id"), F.array_join(forms.offered_names(text), "|").alias("names"))


@query("SF-08 SF-11 SF-10 SF-21", """SELECT o_orderkey AS id, (CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 1 + o_custkey % 30 END)::INTEGER AS term,
  CASE o_custkey % 4 WHEN 0 THEN o_orderdate::DATE END AS day, CASE o_custkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - INTERVAL 9 HOUR WHEN 2 THEN o_orderdate - INTERVAL 9 HOUR WHEN 3 THEN o_orderdate - INTERVAL 9 HOUR END AS at,
  (2 + length(o_orderpriority))::INTEGER AS utf16 FROM orders""")
def dates_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of terms, strict dates, instants of days and offsets, lengths in 16-bit units."""
    who, at = F.col("o_custkey"), F.col("o_orderdate")
    day = lambda p: F.date_format(at, p)
    term = F.when(who % 4 == 0, "제헌국회").otherwise(F.concat(F.lit("제"), 1 + who % 30, F.lit("대")))
    written = case(who, F.concat(day("yyyy-MM-dd"), F.lit("T00:00:00Z")), F.concat(day("yyyy-MM-dd"), F.lit("T00:00:00+09:00")), day("yyyy-MM-dd"), F.concat(F.lit("등록일 "), day("yyyy.M.d"), F.lit(".")), "soon")
    digits = case(who, day("yyyyMMdd"), "00000000", "20240231", "2024011")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), forms.assembly_term(term).alias("term"), forms.strict_date(digits).alias("day"), forms.instant(written).alias("at"), forms.utf16_length(F.concat(F.lit("😀"), "o_orderpriority")).alias("utf16"))


@query("SF-14", """SELECT o_orderkey AS id, CASE WHEN dayofweek(o_orderdate) BETWEEN 1 AND 5 AND day(o_orderdate) <= 20 THEN o_orderdate + INTERVAL '6 hours 30 minutes' END AS at FROM orders""")
def schedule_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), forms.scheduled_at(F.col("o_orderdate").cast("date"), "0 30 6,18 1-20 * 1-5").alias("at"))


@query("PJ-12 SF-11 WN-02", """WITH b AS (SELECT o_custkey AS law, o_orderkey AS mst, o_orderdate AS day, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT 'law_' || law || '_' || mst AS id, law::VARCHAR AS law_id, mst::VARCHAR AS mst, 'Ministry ' || law % 5 AS ministry, CASE WHEN mst % 11 <> 3 THEN day::DATE END AS promulgated, day::DATE + 30 AS effective FROM b
WHERE r = 1 AND s <> 'P' AND mst % 7 NOT IN (0, 1, 2, 3)""")
def public_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic data of laws.  The latest document of each law is chosen first and then held to the rules, so a bad newer one
    hides a good older one."""
    law, mst, at = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderdate")
    kind = F.col("o_orderkey") % 7
    segment = lambda field, text: F.struct(F.concat(F.lit(forms.LAW_PREFIX), F.lit(field)).alias("locator"), text.alias("text"))
    title = F.concat(F.lit("법률 "), law)
    segments = [
        segment("법령명_한글", title), segment("법령ID", F.when(kind == 0, "x").otherwise(law)), segment("공포일자", F.when(F.col("o_orderkey") % 11 == 3, "00000000").otherwise(F.date_format(at, "yyyyMMdd"))),
        segment("시행일자", F.when(kind == 1, "20240230").otherwise(F.date_format(F.date_add(at.cast("date"), 30), "yyyyMMdd"))), segment("소관부처.content", F.concat(F.lit("Ministry "), F.col("o_custkey") % 5)), segment("조문", title),
    ]
    again = F.when(kind == 2, F.array(segment("법령ID", law))).otherwise(F.array().cast("array<struct<locator:string,text:string>>"))
    document = F.struct(
        F.concat_ws("_", F.lit("law"), law, mst).alias("id"), F.lit("law").alias("source_key"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("allowed").alias("license_status"), F.lit("partial").alias("body_status"),
        F.concat_ws(":", law, mst).alias("record_key"), F.concat(F.lit("https://www.law.go.kr/LSW/lsInfoP.do?lsiSeq="), F.when(kind == 3, "0").otherwise(mst)).alias("source_url"), title.alias("title"), at.alias("published_at"), F.concat(F.array(*segments), again).alias("segments"),
    )
    latest = people.ranked(table(spark, sf_dir, "orders"), ["o_custkey"], [at.desc(), F.col("o_orderkey").desc()]).where("rank = 1")
    found = latest.select(document.alias("d")).select("d", forms.law(F.col("d")).alias("law")).where(F.col("law").isNotNull())
    return found.select("d.id", "law.law_id", "law.mst", "law.ministry", "law.promulgated", "law.effective")


@query("SF-32", """SELECT l_orderkey AS id, 'json:$.법령.조문[' || (place - 1) || '].조문내용' AS locator, 'part ' || l_partkey AS text FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)""")
def nested_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of nested JSON with the exact path to each, array places included."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: F.struct(F.concat(F.lit("part "), s["l_partkey"]).alias("조문내용"), s["l_linenumber"].alias("번호")))
    raw = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(lines.alias("조문")).alias("법령"))).alias("raw"))
    parsed = F.from_json("raw", "struct<`법령`: struct<`조문`: array<struct<`조문내용`: string>>>>")
    return raw.select("l_orderkey", F.posexplode(parsed["법령"]["조문"]).alias("at", "p")).select(F.col("l_orderkey").alias("id"), F.concat(F.lit("json:$.법령.조문["), "at", F.lit("].조문내용")).alias("locator"), F.col("p.조문내용").alias("text"))
