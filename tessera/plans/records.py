"""Fusion, validation, text, decoding, formatting, privacy and layout queries over the supplied tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from tessera.functions import dates, decode, domains, formatting, fuzzy, privacy, text
from tessera.functions.numbers import half_even_sql
from tessera.operators import fusion, normalize, rules, spatial, templates
from tessera.plans.registry import query, table
from tessera.sources import vault

PEPPER = b"pepper of the synthetic tables"
TODAY = "2024-06-15"

# --- fusion ------------------------------------------------------------------------------------------------------

CANDIDATES = """cand AS (SELECT user_id AS entity, ['id_number','full_name','date_of_birth','issue_date','expiry_date','issue_place'][k % 6 + 1] AS field_key,
 CASE event_type WHEN 'purchase' THEN 'QR' WHEN 'signup' THEN 'MRZ' WHEN 'click' THEN 'OCR' WHEN 'view' THEN 'MANUAL' ELSE 'NONE' END AS source,
 CASE WHEN k % 17 = 0 THEN '' ELSE ((k // 6) % 3)::VARCHAR END AS value, value / 100 AS confidence, (ts, event_id) AS arrival
 FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)),
base AS (SELECT *, CASE source WHEN 'QR' THEN 0 WHEN 'MRZ' THEN 1 WHEN 'OCR' THEN 2 WHEN 'MANUAL' THEN 3 ELSE 4 END AS p,
 least(greatest(confidence, 0.0::DOUBLE), 1.0::DOUBLE) * CASE WHEN source = 'OCR' THEN CASE field_key WHEN 'full_name' THEN 0.75::DOUBLE WHEN 'id_number' THEN 1.0::DOUBLE WHEN 'issue_place' THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END ELSE 1.0::DOUBLE END AS base
 FROM cand WHERE value <> ''),
best AS (SELECT *, count(*) OVER (PARTITION BY entity, field_key, value) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY entity, field_key, source ORDER BY base DESC, arrival) AS r FROM base) WHERE r = 1),
scored AS (SELECT *, least(base + 0.1::DOUBLE * (votes - 1), 1.0::DOUBLE) AS score FROM best),
top AS (SELECT *, row_number() OVER (PARTITION BY entity, field_key ORDER BY score DESC, p) AS rank FROM scored),
sure AS (SELECT entity, field_key, count(DISTINCT value) AS vals, min_by(value, p) AS value, min_by(source, p) AS source FROM best WHERE base >= 0.9 GROUP BY 1, 2),
fused AS (SELECT t.entity, t.field_key, CASE WHEN s.vals >= 2 THEN s.value ELSE t.value END AS value, CASE WHEN s.vals >= 2 THEN s.source ELSE t.source END AS source,
 CASE WHEN s.vals >= 2 THEN 0.5::DOUBLE ELSE t.score END AS confidence, coalesce(s.vals >= 2, false) OR t.score < 0.85::DOUBLE AS needs_review,
 CASE WHEN s.vals >= 2 THEN ['SOURCE_CONFLICT'] ELSE []::VARCHAR[] END AS flags, NOT coalesce(s.vals >= 2, false) AND t.votes > 1 AS agreement
 FROM top t LEFT JOIN sure s USING (entity, field_key) WHERE rank = 1),
six AS (SELECT e.entity, f.field_key, value, coalesce(source, 'NONE') AS source, coalesce(confidence, 0.0::DOUBLE) AS confidence, coalesce(needs_review, true) AS needs_review, coalesce(flags, []::VARCHAR[]) AS flags, coalesce(agreement, false) AS agreement
 FROM (SELECT DISTINCT entity FROM cand) e CROSS JOIN (SELECT unnest(['id_number','full_name','date_of_birth','issue_date','expiry_date','issue_place']) AS field_key) f LEFT JOIN fused USING (entity, field_key)),
mism AS (SELECT entity FROM (SELECT entity, min_by(value, arrival) FILTER (source = 'QR') AS q, min_by(value, arrival) FILTER (source = 'MRZ') AS m FROM base WHERE field_key = 'id_number' GROUP BY 1) WHERE q <> m),
full_fused AS (SELECT s.entity, field_key, value, source, CASE WHEN hit THEN least(confidence, 0.5::DOUBLE) ELSE confidence END AS confidence,
 CASE WHEN hit THEN needs_review OR least(confidence, 0.5::DOUBLE) < 0.85 ELSE needs_review END AS needs_review, CASE WHEN hit THEN list_append(flags, 'CARD_MISMATCH') ELSE flags END AS flags, agreement
 FROM (SELECT *, field_key = 'id_number' AND entity IN (SELECT entity FROM mism) AS hit FROM six) s)"""


def candidates(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("entity"), F.element_at(F.array(*map(F.lit, fusion.FIELDS)), k % 6 + 1).alias("field_key"),
        F.when(e == "purchase", "QR").when(e == "signup", "MRZ").when(e == "click", "OCR").when(e == "view", "MANUAL").otherwise("NONE").alias("source"),
        F.when(k % 17 == 0, "").otherwise((F.floor(k / 6) % 3).cast("string")).alias("value"), (F.col("value") / 100).alias("confidence"), F.struct("ts", "event_id").alias("arrival"),
    )


@query(f"WITH {CANDIDATES} SELECT * FROM fused")
def fusion_winner(spark, d):
    return fusion.fuse_fields(candidates(spark, d))


@query(f"WITH {CANDIDATES} SELECT * FROM full_fused")
def fusion_six_fields(spark, d):
    return fusion.fuse(candidates(spark, d))


@query(f"WITH {CANDIDATES} SELECT field_key, count(*) AS n, count(*) FILTER (len(flags) > 0) AS conflicts FROM fused GROUP BY 1")
def fusion_conflicts(spark, d):
    return fusion.fuse_fields(candidates(spark, d)).groupBy("field_key").agg(F.count("*").alias("n"), F.count(F.when(F.size("flags") > 0, 1)).alias("conflicts"))


@query(f"WITH {CANDIDATES} SELECT entity FROM mism")
def fusion_mismatch(spark, d):
    return fusion.card_mismatch(candidates(spark, d)).select("entity")


_TOTAL = " + ".join(f"coalesce(max(confidence) FILTER (field_key = '{k}' AND value IS NOT NULL), 0.0::DOUBLE) * {w}::DOUBLE" for k, w in fusion.WEIGHTS.items())


@query(f"WITH {CANDIDATES} SELECT entity, {half_even_sql(_TOTAL, 4)} AS overall, {half_even_sql(_TOTAL, 4)} < 0.4::DOUBLE AS needs_retake FROM full_fused GROUP BY entity")
def overall_confidence(spark, d):
    return fusion.overall(fusion.fuse(candidates(spark, d)))


@query(f"""WITH {CANDIDATES} SELECT entity, bool_or(source = 'QR') AS qr_available, bool_or(source = 'MRZ') AS mrz_available, count(*) FILTER (source = 'OCR') AS ocr_lines FROM cand GROUP BY 1""")
def channel_summary(spark, d):
    return fusion.channel_summary(candidates(spark, d)).drop("ocr_confidence")


ZONES = [("FRONT", "id_number"), ("FRONT", "full_name"), ("FRONT", "date_of_birth"), ("FRONT", "expiry_date"), ("BACK", "issue_date"), ("BACK", "issue_place")]


@query(f"""WITH {CANDIDATES}, z(side, field_key) AS (VALUES {", ".join(map(str, ZONES))}), b AS (SELECT entity, field_key, max(confidence) AS best FROM cand GROUP BY 1, 2)
SELECT e.entity, side, min(coalesce(best, 0.0::DOUBLE)) < 0.85 AS wanted FROM (SELECT DISTINCT entity FROM cand) e CROSS JOIN z LEFT JOIN b USING (entity, field_key) GROUP BY 1, 2""")
def sides_wanted(spark, d):
    return fusion.sides_wanted(candidates(spark, d), spark.createDataFrame(ZONES, "side string, field_key string"))


@query(f"WITH {CANDIDATES} SELECT c.entity, c.field_key, c.source, count(*) AS n, count(*) FILTER (c.value = f.value) AS agreeing FROM cand c LEFT JOIN fused f USING (entity, field_key) GROUP BY 1, 2, 3")
def candidate_traces(spark, d):
    c = candidates(spark, d)
    return fusion.traces(c, fusion.fuse_fields(c)).groupBy("entity", "field_key", "source").agg(F.count("*").alias("n"), F.count(F.when(F.col("agrees"), 1)).alias("agreeing"))


# --- validation --------------------------------------------------------------------------------------------------

# One synthetic card an order: an id from its keys, dates around the order's, some of them blank or out of order.
CARDS = """card AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '12345' ELSE lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || (o_orderkey % 6)::VARCHAR || lpad((o_custkey % 100)::VARCHAR, 2, '0') || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') END AS id_number,
 CASE WHEN o_orderkey % 5 = 0 THEN 'AN' ELSE 'NGUYEN VAN AN' END AS full_name,
 CASE WHEN o_orderkey % 17 = 0 THEN '31/02/1990' ELSE strftime(o_orderdate::DATE - ((o_custkey % 30000)::INT), '%Y-%m-%d') END AS date_of_birth,
 CASE WHEN o_orderkey % 31 = 0 THEN '2020-13-01' ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') END AS issue_date,
 CASE WHEN o_orderkey % 7 = 0 THEN 'KHÔNG THỜI HẠN' WHEN o_orderkey % 19 = 0 THEN 'soon' ELSE strftime(o_orderdate::DATE + ((o_custkey % 9000)::INT - 500), '%Y-%m-%d') END AS expiry_date,
 CASE WHEN o_orderkey % 3 = 0 THEN 'BỘ CÔNG AN' WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'HÀ NỘI' END AS issue_place, (o_orderkey % 100)::DOUBLE / 100 AS c, o_orderkey % 29 = 0 AS odd, o_orderkey % 37 = 0 AS blank FROM orders),
parsed AS (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(date_of_birth, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN date_of_birth END AS DATE) AS b, TRY_CAST(issue_date AS DATE) AS i, TRY_CAST(CASE WHEN regexp_full_match(expiry_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN expiry_date END AS DATE) AS x, CASE WHEN length(id_number) = 12 THEN id_number END AS cid FROM card),
aged AS (SELECT *, year(i) - year(b) - CASE WHEN (month(i), day(i)) < (month(b), day(b)) THEN 1 ELSE 0 END AS age, 2024 - year(b) - CASE WHEN (6, 15) < (month(b), day(b)) THEN 1 ELSE 0 END AS now_age FROM parsed)"""

_CARD_TESTS = [
    ("V-OCR-001", "ERROR", "front_image", "blank"), ("V-OCR-006", "ERROR", "issue_date", "issue_date <> '' AND i IS NULL"), ("V-OCR-001", "ERROR", "back_image", "odd"), ("V-OCR-002", "ERROR", "images", "odd"), ("V-OCR-003", "ERROR", "id_number", "id_number <> '' AND cid IS NULL"),
    ("V-OCR-004", "WARNING", "full_name", "full_name = 'AN'"), ("V-OCR-005", "ERROR", "date_of_birth", "date_of_birth <> '' AND b IS NULL"), ("V-OCR-007", "ERROR", "expiry_date", "expiry_date <> '' AND x IS NULL AND expiry_date <> 'KHÔNG THỜI HẠN'"),
    ("V-OCR-008", "ERROR", "expiry_date", "i > x"), ("V-OCR-009", "ERROR", "issue_date", "b >= i"), ("V-OCR-010", "WARNING", "issue_date", "age < 14"), ("V-OCR-011", "WARNING", "date_of_birth", "now_age NOT BETWEEN 14 AND 120"),
    ("V-OCR-012", "ERROR", "issue_date", "i > DATE '2024-06-15'"), ("V-OCR-013", "WARNING", "expiry_date", "i <= x AND x < DATE '2024-06-15'"), ("V-OCR-014", "INFO", "expiry_date", "i <= x AND x - DATE '2024-06-15' BETWEEN 0 AND 89"),
    ("V-OCR-015", "INFO", "expiry_date", "i <= x AND age >= 60"), ("V-OCR-016", "ERROR", "issue_place", "issue_place = 'HÀ NỘI'"), ("V-OCR-017", "ERROR", "id_number", "id_number = ''"), ("V-OCR-017", "ERROR", "issue_place", "issue_place IS NULL"),
    *[("V-OCR-018", "WARNING", f, f"coalesce({f}, '') <> '' AND c < 0.85") for f in rules.FIELDS],
    ("V-OCR-019", "ERROR", "id_number", "odd"), ("V-OCR-020", "WARNING", "full_name", "odd"), ("V-OCR-021", "WARNING", "id_number", "cid[1:3] NOT IN ('001', '002', '003')"),
    ("V-OCR-022", "WARNING", "id_number", "CASE WHEN cid[4] IN ('0', '2', '4') THEN 'MALE' WHEN cid[4] IN ('1', '3', '5') THEN 'FEMALE' END <> 'MALE'"),
    ("V-OCR-023", "WARNING", "date_of_birth", "lpad((year(b) % 100)::VARCHAR, 2, '0') <> cid[5:6] OR NOT (year(b) BETWEEN 1900 + 100 * (cid[4]::INT // 2) AND 1999 + 100 * (cid[4]::INT // 2))"),
]
_ISSUES = " UNION ALL ".join(f"SELECT k, '{code}' AS code, '{sev}' AS severity, '{field}' AS field FROM aged WHERE {test}" for code, sev, field, test in _CARD_TESTS)


def cards(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    text_of = lambda x: x.cast("string")
    ident = F.concat(F.lpad(text_of(k % 1000), 3, "0"), text_of(k % 6), F.lpad(text_of(F.col("o_custkey") % 100), 2, "0"), F.lpad(text_of(k % 1000000), 6, "0"))
    odd = k % 29 == 0
    out = o.select(
        k.alias("k"), F.when(k % 11 == 0, "").when(k % 13 == 0, "12345").otherwise(ident).alias("id_number"), F.when(k % 5 == 0, "AN").otherwise("NGUYEN VAN AN").alias("full_name"),
        F.when(k % 17 == 0, "31/02/1990").otherwise(text_of(F.date_sub(day, (F.col("o_custkey") % 30000).cast("int")))).alias("date_of_birth"), F.when(k % 31 == 0, "2020-13-01").otherwise(text_of(day)).alias("issue_date"),
        F.when(k % 7 == 0, dates.NO_EXPIRY_TEXT).when(k % 19 == 0, "soon").otherwise(text_of(F.date_add(day, (F.col("o_custkey") % 9000 - 500).cast("int")))).alias("expiry_date"),
        F.when(k % 3 == 0, domains.BO_CONG_AN).when(k % 23 == 0, None).otherwise("HÀ NỘI").alias("issue_place"),
        *[((k % 100).cast("double") / 100).alias(f"confidence_{f}") for f in rules.FIELDS],
        *[(F.when(odd, F.array(F.lit(flag))).otherwise(F.array().cast("array<string>")) if flag else F.array().cast("array<string>")).alias(f"flags_{f}") for f, flag in ((f, {"id_number": "CARD_MISMATCH", "full_name": "SOURCE_CONFLICT"}.get(f)) for f in rules.FIELDS)],
        (k % 37 != 0).alias("has_front"), (~odd).alias("has_back"), odd.alias("same_side"), F.lit("MALE").alias("gender"),
    )
    return rules.validate(out, "ocr", rules.Context(F.lit(TODAY).cast("date"), provinces=("001", "002", "003")))


@query(f"WITH {CARDS} {_ISSUES}")
def rule_issue_table(spark, d):
    return rules.issue_table(cards(spark, d).select("k", "issues"), ["k"]).drop("ord")


@query(f"WITH {CARDS}, found AS ({_ISSUES}) SELECT card.k, count(found.k) FILTER (severity = 'ERROR') = 0 AS valid, count(found.k) FILTER (severity = 'WARNING') AS warnings, count(found.k) FILTER (severity = 'INFO') AS infos FROM card LEFT JOIN found ON card.k = found.k GROUP BY card.k")
def rule_report(spark, d):
    n = lambda s: F.size(rules.by_severity(F.col("issues"), s)).cast("long")
    return cards(spark, d).select("k", rules.is_valid(F.col("issues")).alias("valid"), n("WARNING").alias("warnings"), n("INFO").alias("infos"))


@query(f"""WITH {CARDS} SELECT k, CASE WHEN x IS NULL THEN 'CARD_NO_EXPIRY' WHEN x < DATE '{TODAY}' THEN 'CARD_EXPIRED' WHEN x - DATE '{TODAY}' < 90 THEN 'CARD_EXPIRING_SOON' ELSE 'CARD_VALID' END AS status, age, now_age FROM aged WHERE x IS NULL OR i <= x""")
def card_validity(spark, d):
    c = cards(spark, d)
    b, i, x, now = (*(dates.parse_iso(F.col(n)) for n in ("date_of_birth", "issue_date", "expiry_date")), F.lit(TODAY).cast("date"))
    c = c.select("k", dates.validity(i, x, b, now).alias("v"), dates.age_in_years(b, i).cast("long").alias("age"), dates.age_in_years(b, now).cast("long").alias("now_age"))
    return c.where("v is not null").select("k", "v.status", "age", "now_age")


@query("""WITH p AS (SELECT l_orderkey AS contract, l_returnflag AS party, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT o_orderkey AS contract, 'A' AS party, 1 AS least, 2 AS most FROM orders)
SELECT coalesce(p.contract, s.contract) AS contract, coalesce(p.party, s.party) AS party, coalesce(n, 0) AS n, least IS NULL AS undeclared FROM p FULL JOIN s ON p.contract = s.contract AND p.party = s.party WHERE least IS NULL OR NOT coalesce(n, 0) BETWEEN least AND most""")
def party_counts(spark, d):
    parties = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contract"), F.col("l_returnflag").alias("party"))
    schema = table(spark, d, "orders").select(F.col("o_orderkey").alias("contract"), F.lit("A").alias("party"), F.lit(1).alias("least"), F.lit(2).alias("most"))
    return rules.party_counts(parties, schema)


@query("""SELECT contract, customer, nth FROM (SELECT l_orderkey AS contract, l_suppkey % 5 AS customer, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem) WHERE nth > 1""")
def repeated_customers(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contract"), (F.col("l_suppkey") % 5).alias("customer"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    return rules.repeated_customers(p).select("contract", "customer", "nth")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2 HAVING count(*) > 1")
def partial_unique_violations(spark, d):
    return rules.unique_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_quantity") > 10)


@query("SELECT s_suppkey AS contract, 'V-CTR-001' AS code FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 'V-CTR-002' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'V-CTR-008' FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, 'V-CTR-009' FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'V-CTR-010' FROM supplier WHERE s_suppkey % 2 = 0")
def contract_issues(spark, d):
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select(k.alias("contract"), (k % 4 != 0).alias("version_usable"), F.lit(True).alias("file_exists"), F.when(k % 5 == 0, "x").otherwise("y").alias("checksum"), F.lit("y").alias("expected_checksum"), F.when(F.col("s_acctbal") < 0, 0).otherwise(1 << 30).cast("long").alias("free_bytes"), F.when(k % 6 == 0, F.lit(1)).alias("customer_deleted_at"), F.when(k % 2 == 0, F.lit("2020-01-01").cast("date")).alias("card_expiry"))
    return rules.issue_table(rules.validate(c, "contract", rules.Context(F.lit(TODAY).cast("date"))), ["contract"]).select("contract", "code")


@query("""WITH r AS (SELECT p_partkey AS contract, unnest(['a', 'b', 'c']) AS key FROM part) SELECT contract, key FROM r WHERE NOT (key = 'c' AND contract % 2 = 0) AND NOT (key = 'a' AND contract % 3 <> 0)""")
def missing_variables(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("contract"))
    required = p.select("contract", F.explode(F.array(*map(F.lit, "abc"))).alias("key"))
    values = p.select("contract", F.lit("a").alias("key"), F.when(F.col("contract") % 3 == 0, "  ").otherwise("x").alias("value"))
    return rules.missing_variables(required, values, p.where("contract % 2 = 0").select("contract", F.lit("c").alias("key")))


# --- text and domains --------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(trim(regexp_replace(translate(strip_accents(upper(replace(text, 'ß', 'SS'))), '''`’ʼ', ''), '\\s+', ' ', 'g'))) AS folded FROM documents")
def fold_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query("SELECT doc_id, len(regexp_split_to_array(trim(text, chr(32) || chr(10) || chr(9)), '\\s+')) AS words, n_chars FROM documents WHERE trim(text, chr(32) || chr(10) || chr(9)) <> ''")
def word_counts(spark, d):
    t = F.regexp_replace("text", r"^\s+|\s+\z", "")
    return table(spark, d, "documents").where(t != "").select("doc_id", text.word_count(t).cast("long").alias("words"), "n_chars")


PHONES = "CASE WHEN c_custkey % 3 = 0 THEN '+84 9' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '.345.678' WHEN c_custkey % 3 = 1 THEN '03' || (c_custkey % 10)::VARCHAR || '-123-4567' ELSE '0112345678' END"


@query(f"""WITH p AS (SELECT c_custkey, regexp_replace(regexp_replace({PHONES}, '[\\s.()-]', '', 'g'), '^\\+?84', '0') AS v FROM customer), ok AS (SELECT c_custkey, CASE WHEN regexp_full_match(v, '0(3[2-9]|5[2689]|7[06-9]|8[1-9]|9[0-9])[0-9]{{7}}') THEN v END AS phone FROM p)
SELECT *, CASE {" ".join(f"WHEN phone[1:3] IN {tuple(p) if len(p) > 1 else "('" + p[0] + "')"} THEN '{n}'" for n, p in domains.CARRIERS.items())} END AS carrier FROM ok""")
def phone_carriers(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("+84 9"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(".345.678"))).when(k % 3 == 1, F.concat(F.lit("03"), (k % 10).cast("string"), F.lit("-123-4567"))).otherwise("0112345678")
    return table(spark, d, "customer").select("c_custkey", domains.phone(raw).alias("phone")).withColumn("carrier", domains.carrier(F.col("phone")))


@query("""SELECT c_custkey, 'user' || c_custkey || '@' || dom AS email, CASE dom WHEN 'gmial.com' THEN 'user' || c_custkey || '@gmail.com' WHEN 'outlok.com' THEN 'user' || c_custkey || '@outlook.com' END AS suggestion FROM (SELECT c_custkey, ['gmail.com', 'gmial.com', 'outlok.com', 'x.org'][c_custkey % 4 + 1] AS dom FROM customer)""")
def email_typos(spark, d):
    k = F.col("c_custkey")
    dom = F.element_at(F.array(*map(F.lit, ("gmail.com", "gmial.com", "outlok.com", "x.org"))), (k % 4 + 1).cast("int"))
    e = table(spark, d, "customer").select("c_custkey", domains.email(F.concat(F.lit(" User"), k.cast("string"), F.lit("@"), dom)).alias("email"))
    return e.withColumn("suggestion", domains.typo_suggestion(F.col("email")))


IDENT = "lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || (o_orderkey % 7)::VARCHAR || lpad((o_custkey % 100)::VARCHAR, 2, '0') || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0')"


@query(f"""SELECT o_orderkey, x[1:3] AS province, x[4] AS digit, x[5:6] AS years, x[7:12] AS sequence, CASE WHEN x[4] IN ('0','2','4') THEN 'MALE' WHEN x[4] IN ('1','3','5') THEN 'FEMALE' END AS gender, CASE WHEN x[4]::INT < 6 THEN 1900 + 100 * (x[4]::INT // 2) END AS lo FROM (SELECT o_orderkey, {IDENT} AS x FROM orders)""")
def id_structure(spark, d):
    k = F.col("o_orderkey")
    raw = F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), (k % 7).cast("string"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lpad((k % 1000000).cast("string"), 6, "0"))
    o = table(spark, d, "orders").select("o_orderkey", domains.citizen_id(F.translate(raw, "0158", "OISB"), ocr=True).alias("x"))
    x = F.col("x")
    return o.select("o_orderkey", domains.province_code(x).alias("province"), domains.gender_century_digit(x).alias("digit"), domains.birth_year_suffix(x).alias("years"), domains.sequence(x).alias("sequence"), domains.inferred_gender(x).alias("gender"), domains.inferred_birth_years(x)["lo"].alias("lo"))


@query("SELECT c_custkey, '008C' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS account, '008C ' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS display FROM customer")
def securities_accounts(spark, d):
    six = F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0")
    raw = F.when(F.col("c_custkey") % 2 == 0, six).otherwise(F.concat(F.lit("008c-"), six))
    out = table(spark, d, "customer").select("c_custkey", domains.securities_account(raw).alias("account"))
    return out.withColumn("display", domains.securities_display(F.col("account")))


@query("SELECT c_custkey, repeat('7', (c_custkey % 25)::INT) AS account, c_custkey % 25 BETWEEN 9 AND 14 AS fits FROM customer WHERE c_custkey % 25 BETWEEN 6 AND 20")
def bank_accounts(spark, d):
    k = (F.col("c_custkey") % 25).cast("int")
    out = table(spark, d, "customer").select("c_custkey", domains.bank_account(F.concat(F.lit("no "), F.repeat(F.lit("7"), k))).alias("account")).where("account is not null")
    return out.withColumn("fits", domains.matches_bank_length(F.col("account"), F.lit(9), F.lit(14)))


@query("SELECT doc_id, nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{16})(?:[^0-9]|$)', 1), '') AS run FROM documents WHERE regexp_matches(text, '(?:^|[^0-9])[0-9]{16}(?:[^0-9]|$)')")
def find_number_runs(spark, d):
    run = text._found(F.col("text"), r"(?<![0-9])([0-9]{16})(?![0-9])")
    return table(spark, d, "documents").select("doc_id", run.alias("run")).where("run is not null")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS found FROM orders")
def find_dates(spark, d):
    line = F.concat(F.lit("Issued: "), F.date_format("o_orderdate", "dd. MM. yyyy"), F.lit(" at the office"))
    return table(spark, d, "orders").select("o_orderkey", text.find_date(line).alias("found"))


def _anchors_sql() -> str:
    """The phrases printed on cards as rows (ord, anchor, a), a without marks and blanks."""
    rows = []
    for i, phrase in enumerate(fuzzy.BOILERPLATE):
        bare = "".join(c for c in unicodedata.normalize("NFD", phrase.upper()) if not unicodedata.combining(c)).replace("Đ", "D").replace(" ", "")
        rows.append(f"({i}, '{phrase}', '{bare}')")
    return ", ".join(rows)


_OVER = "SELECT line, ord, anchor, a, t, {s} AS s, {l} AS l FROM pairs WHERE length({s}) <= length({l})"


@query(f"""WITH pairs AS (SELECT *, replace(upper(line), ' ', '') AS t FROM (SELECT DISTINCT p_type || ' of birth' AS line FROM part), (VALUES {_anchors_sql()}) v(ord, anchor, a)),
slid AS ({_OVER.format(s="a", l="t")} UNION ALL {_OVER.format(s="t", l="a")}),
places AS (SELECT *, length(s) AS n, [list_sum([CASE WHEN s[j] = c THEN 1::BIGINT << (j - 1) ELSE 0 END for j in range(1, length(s) + 1)])::BIGINT for c in string_split(l, '')] AS m FROM slid),
windows AS (SELECT *, m[greatest(i, 0) + 1 : least(i + n, len(m))] AS w FROM (SELECT *, unnest(range(1 - n, len(m))) AS i FROM places)),
rows AS (SELECT *, list_reduce(list_prepend((1::BIGINT << n) - 1, w), lambda r, p: ((r + (r & p)) | (r - (r & p))) & ((1::BIGINT << n) - 1)) AS r FROM windows),
scored AS (SELECT line, ord, anchor, max(200.0::DOUBLE * (n - bit_count(r)) / (n + len(w))) * least(1.0::DOUBLE, any_value(length(t)) / any_value(length(a))) AS score FROM rows GROUP BY ALL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, ord) = 1)
SELECT line, CASE WHEN score > 0 THEN anchor END AS anchor, greatest(score, 0.0::DOUBLE) AS score, score >= {fuzzy.BOILERPLATE_THRESHOLD} AS matches FROM best""")
def boilerplate_lines(spark, d):
    p = table(spark, d, "part").select(F.concat(F.col("p_type"), F.lit(" of birth")).alias("line"))
    return fuzzy.is_printed_boilerplate(p, "line")


@query("SELECT DISTINCT n_name, CASE WHEN length(n_name) BETWEEN 2 AND 100 AND regexp_full_match(upper(n_name), '[A-Z '' -]+') THEN upper(n_name) END AS name FROM nation")
def person_names(spark, d):
    return table(spark, d, "nation").select("n_name", domains.person_name(F.concat(F.lit("  "), F.col("n_name")), ocr=True).alias("name")).distinct()


# --- normalisation and decoding ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS value, 0.9::DOUBLE AS confidence FROM orders")
def date_parse(spark, d):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "ddMMyyyy"))
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("issue_date").alias("field_key"), raw.alias("text"), F.lit(0.9).alias("confidence"))
    return normalize.fields(rows).select("o_orderkey", "value", "confidence")


_SWAP = "CASE {0} WHEN '1' THEN '7' WHEN '7' THEN '1' WHEN '3' THEN '8' WHEN '8' THEN '3' WHEN '0' THEN '6' WHEN '6' THEN '0' END"
_VARIANTS = " UNION ALL ".join(f"SELECT k, digits[1:{i - 1}] || {_SWAP.format(f'digits[{i}]')} || digits[{i + 1}:8] AS v FROM bad" for i in range(1, 5)).replace("digits[1:0]", "''")


@query(f"""WITH bad AS (SELECT o_orderkey AS k, lpad((o_orderkey % 100)::VARCHAR, 2, '0') || lpad((o_custkey % 20)::VARCHAR, 2, '0') || '1990' AS digits FROM orders),
real AS (SELECT k, TRY_CAST(v[5:8] || '-' || v[3:4] || '-' || v[1:2] AS DATE) AS day FROM ({_VARIANTS}) WHERE v IS NOT NULL)
SELECT b.k, CASE WHEN count(DISTINCT day) = 1 THEN max(day) END AS repaired FROM bad b LEFT JOIN real USING (k) GROUP BY 1""")
def date_repair(spark, d):
    raw = F.concat(F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("o_custkey") % 20).cast("string"), 2, "0"), F.lit("1990"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), dates.repair_date(raw).alias("repaired"))


ALIASES = [(1, "BO CONG AN", None, domains.BO_CONG_AN, 0.98), (2, "CUC TRUONG CUC CANH SAT", None, domains.CUC_CANH_SAT, 0.95), (3, None, ["QUAN", "LY", "HANH"], domains.CUC_CANH_SAT, 0.6)]


@query()
def issue_place_tiers(spark, d):
    """Rows only: fuzzy tiers have no SQL; tests hold each tier to hand-made values."""
    aliases = spark.createDataFrame(ALIASES, "ord int, alias_normalized string, keywords array<string>, canonical_value string, assigned_confidence double")
    raw = F.element_at(F.array(*map(F.lit, ("bộ công an", "Bo Cong Am", "CỤC TRƯỞNG CỤC CẢNH SÁT", "x quan ly hanh chinh", "zzz"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return normalize.issue_places(table(spark, d, "orders").select("o_orderkey", raw.alias("text"), F.lit(0.97).alias("confidence")), aliases)


@query("""WITH c AS (SELECT o_orderkey, lpad((o_orderkey % 1000000000)::VARCHAR, 9, '0') AS v FROM orders)
SELECT o_orderkey, (list_sum([v[i + 1]::INT * [7, 3, 1][i % 3 + 1] for i in range(0, 9)]) % 10)::INT::VARCHAR AS digit FROM c""")
def check_digits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", decode.check_digit(F.lpad((F.col("o_orderkey") % 1000000000).cast("string"), 9, "0")).alias("digit"))


@query("""SELECT o_orderkey, lpad(o_custkey::VARCHAR, 12, '0') AS id_number, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'NGUYEN VAN AN' END AS full_name, '05021990' AS birth, strftime(o_orderdate, '%d%m%Y') AS issue FROM orders WHERE o_orderkey % 5 <> 0""")
def payload_split(spark, d):
    name = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("NGUYEN VAN AN")
    parts = [F.lpad(F.col("o_custkey").cast("string"), 12, "0"), F.lit(""), name, F.lit("05021990"), F.lit("Nam"), F.lit("HN"), F.date_format("o_orderdate", "ddMMyyyy")]
    payload = F.concat(F.concat_ws("|", *parts), F.when(F.col("o_orderkey") % 5 == 0, "|more").otherwise("|"))
    return table(spark, d, "orders").select("o_orderkey", decode.payload_fields(payload).alias("p")).where("p is not null").select("o_orderkey", "p.*")


@query("SELECT o_orderkey, lpad(o_custkey::VARCHAR, 12, '0') AS citizen_id, '900205' AS birth, '300205' AS expiry, 'M' AS sex, 'NGUYEN' AS surname, 'VAN AN' AS given_names, true AS checksum_valid, 0 AS corrections FROM orders")
def td1_round_trip(spark, d):
    """Blocks built from keys with their check digits, then parsed."""
    doc, cid = F.lpad((F.col("o_orderkey") % 1000000000).cast("string"), 9, "0"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")
    c = decode.check_digit
    one = F.concat(F.lit("IDVNM"), doc, c(doc), cid, F.lit("<<"), c(F.concat(cid, F.lit("<<"))))
    two = F.concat(F.lit("900205"), c(F.lit("900205")), F.lit("M300205"), c(F.lit("300205")), F.lit("VNM<<<<<<<<<<<"))
    whole = F.concat(F.substring(one, 6, 25), F.substring(two, 1, 7), F.substring(two, 9, 7), F.substring(two, 19, 11))
    block = F.concat_ws("\n", one, F.concat(two, c(whole)), F.rpad(F.lit("NGUYEN<<VAN<AN"), 30, "<"))
    rows = table(spark, d, "orders").select("o_orderkey", block.alias("raw"))
    return decode.parse_td1(rows, "raw", ["o_orderkey"]).select("o_orderkey", "citizen_id", "birth", "expiry", "sex", "surname", "given_names", "checksum_valid", "corrections")


_DIGIT = "(list_sum([{0}[i + 1]::INT * [7, 3, 1][i % 3 + 1] for i in range(0, 6)]) % 10)::VARCHAR"


@query(f"""WITH RECURSIVE other(c, o, nr) AS (VALUES {", ".join(f"('{c}', '{o}', {i})" for c, others in decode.ALTERNATIVES.items() for i, o in enumerate(others))}),
read AS (SELECT o_orderkey, {_DIGIT.format("v")} AS digit, substr(v, 1, place) || o || substr(v, place + 2) AS damaged FROM (SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') AS v, (o_orderkey % 6)::INT AS place FROM orders) JOIN other ON c = v[place + 1] AND nr = 0),
tried AS (SELECT DISTINCT damaged, digit, damaged AS made, 0 AS last, []::INT[] AS edits FROM read
 UNION ALL SELECT damaged, digit, substr(made, 1, i - 1) || o || substr(made, i + 1), i, list_append(edits, (i * 10 + nr)::INT) FROM tried, (SELECT unnest(range(1, 7))::INT AS i), other WHERE i > last AND len(edits) < {decode.MAX_EDITS} AND c = damaged[i]),
firsts AS (SELECT damaged, digit, arg_min(made, edits) AS repaired FROM tried WHERE {_DIGIT.format("made")} = digit GROUP BY ALL)
SELECT o_orderkey, damaged, digit, repaired FROM read LEFT JOIN firsts USING (damaged, digit)""")
def check_repairs(spark, d):
    """Dates with one digit misread and their true check digit: the first reading that the digit allows."""
    other = F.create_map(*[F.lit(x) for c, others in decode.ALTERNATIVES.items() for x in (c, others[0])])
    at, v = (F.col("o_orderkey") % 6).cast("int"), F.date_format("o_orderdate", "yyMMdd")
    damaged = F.concat(F.substring(v, F.lit(1), at), F.element_at(other, F.substring(v, at + 1, F.lit(1))), F.substring(v, at + 2, F.lit(6)))
    read = table(spark, d, "orders").select("o_orderkey", damaged.alias("damaged"), decode.check_digit(v).alias("digit"))
    return read.withColumn("repaired", decode.repaired_group(F.col("damaged"), F.col("digit")))


# --- formatting and templates ------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, 'HD-' || strftime(o_orderdate, '%Y%m') || '-' || CASE WHEN length(o_orderkey::VARCHAR) >= 5 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 5, '0') END AS number, 'ngày ' || strftime(o_orderdate, '%d') || ' tháng ' || strftime(o_orderdate, '%m') || ' năm ' || strftime(o_orderdate, '%Y') AS day FROM orders""")
def contract_numbers(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", formatting.contract_number("HD-{yyyy}{MM}-{seq:05d}", F.col("o_orderdate"), F.col("o_orderkey")).alias("number"), formatting.format_date_text(F.col("o_orderdate")).alias("day"))


@query("""SELECT o_orderkey, replace(format('{:,}', (o_totalprice * 1000)::DECIMAL(38, 6)::DOUBLE::BIGINT - 0), ',', '.') AS money FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)""")
def currency(spark, d):
    return table(spark, d, "orders").select("o_orderkey", formatting.format_currency(F.floor("o_totalprice") * 1000).alias("money"))


_U = "['không','một','hai','ba','bốn','năm','sáu','bảy','tám','chín']"


def _group_sql(g: str, full: str) -> str:
    h, t, u = f"({g} // 100)", f"({g} // 10 % 10)", f"({g} % 10)"
    unit = lambda x: f"{_U}[{x} + 1]"
    hundreds = f"CASE WHEN {h} > 0 OR {full} THEN {unit(h)} || ' trăm' END"
    tens = f"CASE WHEN {t} = 1 THEN 'mười' WHEN {t} > 1 THEN {unit(t)} || ' mươi' WHEN {u} > 0 AND ({h} > 0 OR {full}) THEN 'linh' END"
    ones = f"CASE WHEN {u} = 0 THEN NULL WHEN {t} = 0 THEN {unit(u)} WHEN {u} = 5 THEN 'lăm' WHEN {t} > 1 AND {u} = 1 THEN 'mốt' WHEN {t} > 1 AND {u} = 4 THEN 'tư' ELSE {unit(u)} END"
    return f"concat_ws(' ', {hundreds}, {tens}, {ones})"


@query(f"""WITH a AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders), w AS (SELECT o_orderkey, n, concat_ws(' ', CASE WHEN n // 1000000 % 1000 > 0 THEN {_group_sql("(n // 1000000 % 1000)", "false")} || ' triệu' END,
 CASE WHEN n // 1000 % 1000 > 0 THEN {_group_sql("(n // 1000 % 1000)", "n >= 1000000")} || ' nghìn' END, CASE WHEN n % 1000 > 0 THEN {_group_sql("(n % 1000)", "n >= 1000")} END) AS words FROM a)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'Không đồng' ELSE upper(words[1]) || words[2:] || ' đồng' END AS words FROM w""")
def currency_words(spark, d):
    return table(spark, d, "orders").select("o_orderkey", formatting.format_currency_text(F.floor("o_totalprice")).alias("words"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, replace(printf('%.2f', l_extendedprice), '.', ',') AS price FROM lineitem")
def decimals(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", formatting.format_decimal(F.col("l_extendedprice")).alias("price"))


@query("""SELECT p_partkey, base || CASE WHEN nth > 1 THEN ' (' || nth || ')' ELSE '' END AS name FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS nth FROM (SELECT p_partkey, 'HD ' || p_brand AS base FROM part))""")
def export_names(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part").select("p_partkey", formatting.export_name("HD: {brand}? {missing} .", {"brand": F.col("p_brand")}).alias("base"))
    return p.select("p_partkey", formatting.disambiguated(F.col("base"), F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))).alias("name"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', balance ' || (c_acctbal::DECIMAL(12, 2))::VARCHAR || '.' AS filled FROM customer")
def template_fill(spark, d):
    context = F.create_map(F.lit("name"), F.col("c_name"), F.lit("balance"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    return table(spark, d, "customer").select("c_custkey", templates.fill(F.lit("Dear {{ name }}, balance {{balance}}{{ missing }}."), context).alias("filled"))






# --- privacy -----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, repeat('•', length(v) - 4) || right(v, 4) AS masked FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 12, '0') AS v FROM customer)")
def mask_suffix(spark, d):
    return table(spark, d, "customer").select("c_custkey", privacy.mask_keep_suffix(F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("masked"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]{9,20}')) AS long_runs FROM documents")
def pii_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]{9,20}")).cast("long").alias("long_runs"))


def _masks_sql() -> str:
    """The masks one length at a time; runs twice, as a match takes the characters at its edges. Of mail only the edge before is taken: it has
    letters and digits to the end, so the next match finds its own edge, and cannot begin within a name whose edge is gone."""
    out, edge = "text", (r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])")
    runs = [("[0-9]{8}([0-9]{4})", 8), ("0[0-9]{6}([0-9]{3})", 7), ("([0-9]{3}C)[0-9]{3}([0-9]{3})", 0), *((f"[0-9]{{{n - 4}}}([0-9]{{4}})", n - 4) for n in range(9, 21))]
    for run, dots in runs:
        new = f"\\1{'•' * dots}\\2\\3" if dots else "\\1\\2•••\\3\\4"
        for _ in range(2):
            out = f"regexp_replace({out}, '{edge[0]}{run}{edge[1]}', '{new}', 'g')"
    mail = r"([\p{L}\p{N}_])[\p{L}\p{N}_.%+-]*@([\p{L}\p{N}_-])[\p{L}\p{N}_-]*((?:\.[\p{L}\p{N}_-]+)*\.[\p{L}\p{N}_]+)"
    return f"regexp_replace({out}, '{edge[0]}{mail}', '\\1\\2***@\\3***\\4', 'g')"


@query(f"SELECT doc_id, md5({_masks_sql()}) AS masked FROM documents")
def pii_mask_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(privacy.redact_text(F.col("text")).cast("binary")).alias("masked"))


_KEY = PEPPER.ljust(64, b"\0")
_IPAD, _OPAD = (bytes(k ^ b for k in _KEY).hex() for b in (0x36, 0x5C))


@query(f"SELECT c_custkey, substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode('phone') || unhex('00') || encode(c_name)))), 1, 32) AS idx FROM customer")
def blind_index(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.lower(F.hex(privacy.blind_index(F.col("c_name"), "phone", PEPPER))).alias("idx"))


@query("SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_name = b.c_name")
def blind_index_join(spark, d):
    c = table(spark, d, "customer").withColumn("i", privacy.blind_index(F.col("c_name"), "name", PEPPER))
    return c.select(F.col("c_custkey").alias("a"), "i").join(c.select(F.col("c_custkey").alias("b"), "i"), "i").select("a", "b")


@query("SELECT c_custkey, c_name FROM customer")
def aes_round_trip(spark, d):
    key, aad = F.lit(b"0123456789abcdef0123456789abcdef"), F.lit("customer/name")
    nonce = F.substring(F.unhex(F.sha2(F.col("c_custkey").cast("string"), 256)), 1, 12)
    sealed = privacy.encrypt(F.encode("c_name", "UTF-8"), key, nonce, aad)
    return table(spark, d, "customer").select("c_custkey", F.decode(privacy.decrypt(sealed, key, aad), "UTF-8").alias("c_name"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_dedup(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = vault.new_content(files, spark.createDataFrame([], "sha256 string"))
    return out.select(F.col("path").alias("doc_id"), "sha256", "copies")


@query("SELECT o_orderkey, 'contracts/' || strftime(o_orderdate, '%Y/%m/%d/') || concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) || '.enc' AS path, true AS valid FROM (SELECT o_orderkey, o_orderdate, md5(o_orderkey::VARCHAR) AS h FROM orders)")
def vault_paths(spark, d):
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    ident = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    out = table(spark, d, "orders").select("o_orderkey", vault.build_relative_path(F.lit("contracts"), F.col("o_orderdate"), ident).alias("path"))
    return out.withColumn("valid", vault.resolves_within(F.col("path"), F.lit("contracts")))


# --- layout ------------------------------------------------------------------------------------------------------

BOXES = "box AS (SELECT l_orderkey AS image, l_linenumber AS ord, l_partkey, l_suppkey, l_partkey % 80 / 100.0::DOUBLE AS x, l_suppkey % 90 / 100.0::DOUBLE AS y, 0.2::DOUBLE AS w, 0.1::DOUBLE AS h, l_discount + 0.0::DOUBLE AS confidence, l_returnflag AS fit FROM lineitem)"


def regions(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("image"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), (c("l_partkey") % 80 / 100.0).alias("x"), (c("l_suppkey") % 90 / 100.0).alias("y"), F.lit(0.2).alias("w"), F.lit(0.1).alias("h"), (c("l_discount") + 0.0).alias("confidence"), F.array("l_returnflag").alias("fits"), c("l_partkey").cast("string").alias("text"), (c("l_linenumber").cast("long") * 10**12 + c("l_partkey") * 10**6 + c("l_suppkey")).alias("ord")).drop("o")


@query(f"""WITH {BOXES}, z(field_key, zx, zy, zw, zh) AS (VALUES ('A', 0.0, 0.0, 0.5, 0.5), ('N', 0.4, 0.4, 0.6, 0.6)),
p AS (SELECT image, field_key, l_partkey::VARCHAR AS text, ord::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord, greatest(0.0::DOUBLE, least(x + w, zx::DOUBLE + zw::DOUBLE) - greatest(x, zx::DOUBLE)) * greatest(0.0::DOUBLE, least(y + h, zy::DOUBLE + zh::DOUBLE) - greatest(y, zy::DOUBLE)) / (w * h) AS overlap FROM box JOIN z ON fit = field_key)
SELECT image, field_key, text, ord FROM (SELECT *, row_number() OVER (PARTITION BY image, field_key ORDER BY overlap DESC, ord) AS r FROM p WHERE overlap >= 0.5) WHERE r = 1""")
def zone_overlap_pick(spark, d):
    zones = spark.createDataFrame([("A", 0.0, 0.0, 0.5, 0.5), ("N", 0.4, 0.4, 0.6, 0.6)], "field_key string, x double, y double, w double, h double")
    return spatial.by_zone(regions(spark, d), zones).select("image", "field_key", "text", "ord")


@query("SELECT image, type, n FROM (SELECT image, CASE WHEN n > coalesce(lead(n) OVER (PARTITION BY image ORDER BY n DESC, t), 0) THEN t END AS type, n, row_number() OVER (PARTITION BY image ORDER BY n DESC, t) AS r FROM (SELECT l_orderkey AS image, l_returnflag AS t, count(DISTINCT l_linestatus || l_linenumber) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1")
def marker_vote(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("type"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("marker"))
    return spatial.marker_vote(hits)


@query(f"WITH {BOXES} SELECT image, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM box GROUP BY image")
def union_boxes(spark, d):
    return spatial.union_box(regions(spark, d), "image")


PAGES = """RECURSIVE r AS (SELECT *, y + h / 2 AS centre FROM (SELECT l_orderkey AS image, l_linenumber AS ord, l_partkey % 80 / 100.0::DOUBLE AS x, l_suppkey % 90 / 100.0::DOUBLE AS y, 0.05::DOUBLE + l_linenumber % 4 / 100.0::DOUBLE AS h, row_number() OVER () AS nr FROM lineitem)),
slack AS (SELECT image, greatest(0.6::DOUBLE * list_sort(list(h))[count(*) // 2 + 1], 0.000001::DOUBLE) AS slack FROM r GROUP BY image),
walk AS (SELECT image, min(centre) AS anchor, 0 AS line FROM r GROUP BY image UNION ALL SELECT w.image, min(r.centre), w.line + 1 FROM walk w JOIN r ON r.image = w.image JOIN slack s ON s.image = w.image WHERE r.centre - w.anchor > s.slack GROUP BY w.image, w.line)"""


def pages(spark, d):
    y, h = F.col("l_suppkey") % 90 / 100.0, F.lit(0.05) + F.col("l_linenumber") % 4 / 100.0
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 80 / 100.0).alias("x"), y.alias("y"), h.alias("h"))


@query(f"""WITH {PAGES}, placed AS (SELECT r.image, ord, x, centre, max(line) AS line FROM r JOIN walk w ON w.image = r.image AND w.anchor <= r.centre GROUP BY r.image, ord, x, centre, nr) SELECT image, ord, line::INT AS line, (row_number() OVER (PARTITION BY image ORDER BY line, x, centre, ord) - 1)::INT AS place FROM placed""")
def reading_order(spark, d):
    return spatial.sort_reading_order(pages(spark, d))


@query(f"""WITH {PAGES}, pick AS (SELECT l.ord AS l_ord, v.*, CASE WHEN l.ord = v.ord THEN 0 WHEN abs(v.centre - l.centre) <= 0.6::DOUBLE * l.h THEN CASE WHEN v.x >= l.x THEN 1 END WHEN v.centre > l.centre AND v.centre - l.centre <= 2.5::DOUBLE * l.h THEN 2 END AS k
 FROM r l JOIN r v ON v.image = l.image WHERE l.ord < 3 AND v.ord >= 3 AND NOT EXISTS (SELECT 1 FROM r o WHERE o.image = l.image GROUP BY o.ord HAVING count(*) > 1))
SELECT image, 'n' AS field_key, ord FROM (SELECT image, ord, row_number() OVER (PARTITION BY image ORDER BY l_ord, k, CASE WHEN k = 2 THEN y ELSE 0 END, x, ord) AS nth FROM pick WHERE k IS NOT NULL) WHERE nth = 1""")
def beside_label(spark, d):
    """Lines 1 and 2 of an order are labels, later ones values; orders that have a line twice have no order of regions."""
    rows = pages(spark, d)
    twice = rows.groupBy("image", "ord").agg(F.count("*").alias("n")).where("n > 1").select("image")
    rows = rows.join(twice, "image", "left_anti").withColumns({"text": F.lit("v"), "confidence": F.lit(0.9), "w": F.lit(0.1), "fits": F.when(F.col("ord") >= 3, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))})
    labels = rows.where("ord < 3").select("image", "ord", F.lit("n").alias("field_key"))
    return spatial.beside_label(rows, labels).select("image", "field_key", "ord")


_SCORE = "greatest(0.0::DOUBLE, least(0.5::DOUBLE * least(s / 300.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * (1.0::DOUBLE - least(abs(b - 128.0::DOUBLE) / 128.0::DOUBLE, 1.0::DOUBLE)) + 0.2::DOUBLE * (1.0::DOUBLE - least(g / 0.1::DOUBLE, 1.0::DOUBLE)), 1.0::DOUBLE))"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 400 / 1.0::DOUBLE AS s, l_suppkey % 256 / 1.0::DOUBLE AS b, l_discount / 2.0::DOUBLE AS g, l_suppkey % 1000 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {half_even_sql(_SCORE, 3)} AS score,
 [f FOR f IN [CASE WHEN s < 100 THEN 'BLURRY' END, CASE WHEN b < 70 THEN 'DARK' END, CASE WHEN b > 200 THEN 'BRIGHT' END, CASE WHEN g > 0.02::DOUBLE THEN 'GLARE' END, CASE WHEN e < 600 THEN 'LOW_RESOLUTION' END] IF f IS NOT NULL] AS flags FROM m""")
def image_quality(spark, d):
    keys, c = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], F.col
    q = spatial.assess_quality((c("l_partkey") % 400).cast("double"), (c("l_suppkey") % 256).cast("double"), c("l_discount") / 2.0, c("l_suppkey") % 1000)
    return table(spark, d, "lineitem").select(*keys, q.alias("q")).select(*keys, "q.score", "q.flags")


@query("""WITH m AS (SELECT p_partkey, 300 + p_partkey % 1700 AS w, 200 + p_size * 25 AS h FROM part)
SELECT p_partkey, greatest(1, round_even(w * (1600.0::DOUBLE / greatest(w, h)), 0))::INT AS width, greatest(1, round_even(h * (1600.0::DOUBLE / greatest(w, h)), 0))::INT AS height FROM m""")
def scaled_sizes(spark, d):
    size = spatial.scaled_size(300 + F.col("p_partkey") % 1700, 200 + F.col("p_size") * 25, 1600)
    return table(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("""WITH m AS (SELECT p_partkey, 299.0::DOUBLE + p_partkey % 1700 AS r, 199.0::DOUBLE + p_size * 25 AS b FROM part)
SELECT p_partkey, CASE WHEN r >= b THEN 0 ELSE r END AS first_x, CASE WHEN r >= b THEN r ELSE 0 END AS third_x, b AS third_y
FROM (SELECT p_partkey, r, b FROM m WHERE greatest(r, b) / least(r, b) BETWEEN 1.45::DOUBLE AND 1.72::DOUBLE)""")
def full_frames(spark, d):
    """The first and third corners of images that are cards as they are."""
    quad = spatial.full_frame(300 + F.col("p_partkey") % 1700, 200 + F.col("p_size") * 25)
    rows = table(spark, d, "part").select("p_partkey", quad.alias("q")).where("q is not null")
    return rows.select("p_partkey", F.col("q")[0]["x"].alias("first_x"), F.col("q")[2]["x"].alias("third_x"), F.col("q")[2]["y"].alias("third_y"))


@query("SELECT event_id, CASE WHEN sa >= 0.4 AND sb >= 0.4 AND a = b THEN 'DUPLICATE_SIDE' WHEN sa >= 0.4 OR sb >= 0.4 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS verdict FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'FRONT' WHEN event_id % 3 = 0 THEN 'BACK' ELSE NULL END AS a, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 0.4 ELSE 0 END AS sa, CASE WHEN event_id % 5 = 0 THEN 'BACK' ELSE 'FRONT' END AS b, CASE WHEN event_id % 5 = 0 THEN 0.4 ELSE 0.15 END AS sb FROM events)")
def side_verdicts(spark, d):
    i, no, zero = F.col("event_id"), F.lit(False), F.lit(0)
    a = spatial.weigh_side(i % 2 == 0, (i % 2 != 0) & (i % 3 == 0), zero, zero)
    b = spatial.weigh_side(no, i % 5 == 0, F.lit(1), zero)
    return table(spark, d, "events").select("event_id", spatial.reconcile(a, b).alias("verdict"))


BANDS = """b AS (SELECT l_orderkey AS image, l_suppkey % 25 / 25.0::DOUBLE AS centre, min(0.03::DOUBLE + l_suppkey % 4 / 100.0::DOUBLE) AS h FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, lead(centre, 1) OVER w - centre AS one, lead(centre, 2) OVER w - lead(centre, 1) OVER w AS two, centre + lead(centre, 1) OVER w + lead(centre, 2) OVER w AS three, greatest(h, lead(h, 1) OVER w, lead(h, 2) OVER w) - least(h, lead(h, 1) OVER w, lead(h, 2) OVER w) AS apart FROM b WINDOW w AS (PARTITION BY image ORDER BY centre)),
found AS (SELECT image, three / 3 AS centre FROM s WHERE three IS NOT NULL AND one >= 0.04::DOUBLE AND one <= 0.12::DOUBLE AND two >= 0.04::DOUBLE AND two <= 0.12::DOUBLE AND abs(one - two) <= 0.025::DOUBLE AND apart <= 0.02::DOUBLE)"""


def bands(spark, d):
    s = F.col("l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (s % 25 / 25.0).alias("centre"), (F.lit(0.03) + s % 4 / 100.0).alias("h")).groupBy("image", "centre").agg(F.min("h").alias("h"))


@query(f"WITH {BANDS} SELECT image, centre FROM found")
def even_bands(spark, d):
    return spatial.evenly_spaced_bands(bands(spark, d))


@query(f"WITH {BANDS}, edge AS (SELECT image, count(*) FILTER (centre < 0.35::DOUBLE OR centre > 0.65::DOUBLE) AS n, min(centre) FILTER (centre < 0.35::DOUBLE OR centre > 0.65::DOUBLE) AS c FROM found GROUP BY image) SELECT image, CASE WHEN n = 1 THEN c < 0.5 END AS upside_down FROM edge")
def orientation_votes(spark, d):
    return spatial.orientation_vote(spatial.evenly_spaced_bands(bands(spark, d)))
