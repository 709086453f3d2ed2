"""Templates, party schemas, contexts and their snapshots over the supplied tables.

Templates and schemas are put together from fragments by the keys of a table. What each fragment gives is recorded
beside it, and the SQL puts the records together in the same way.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import formatting, fuzzy, privacy
from tessera.operators import grammar, parties
from tessera.plans.registry import query, table


def _sql(x: object) -> str:
    """A Python value as a literal of DuckDB."""
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(_sql, x)) + "]" + ("" if x else "::VARCHAR[]")
    return "NULL" if x is None else str(x)


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, (i, *r))) + ")" for i, r in enumerate(rows)) + ")"


def _pick(texts: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))


# (text, declared, loops, has loops, has conditionals, broken rules)
FRAGMENTS = [
    ("Họ và tên: {{ full_name }}\n", ["full_name"], [], False, False, []),
    ("{{ holder.full_name }} và {{ holder.dob }}", ["holder.dob", "holder.full_name"], [], False, False, []),
    ("{% for p in parties %}{{ p.name }}{{ loop.index }}{% else %}{{ nobody }}{% endfor %}", ["nobody", "parties"], ["parties"], True, False, []),
    ("{% for q in signers if q.ok %}{{ q }}{% endfor %}{{ q.left }}", ["q", "q.left", "q.ok", "signers"], ["signers"], True, False, []),
    ("{% if (amount) %}{{ 'a|b' }}{% elif not other.x %}{% endif %}", ["amount", "other.x"], [], False, True, []),
    ("{{ a1 ~ b1 }}{% if c1 and d1 %}{{ e1 if f1 else g1 }}{% endif %}", ["a1", "b1", "c1", "d1", "e1", "f1", "g1"], [], False, True, []),
    ("{{ lines[0].price }} {{ rows[at.k].v }} {{ box['w'] }}", ["at.k", "box['w']", "lines[0].price", "rows[].v"], [], False, False, []),
    ("{{ name_of|upper|trim }} {{ city|default('(none)') }}", ["city", "name_of"], [], False, False, []),
    ("{% set z1 = w1.e %}{{ z1.r }}{# {{ hidden }} #}{% raw %}{{ raw1 }}{% endraw %}", ["w1.e"], [], False, False, []),
    ("{{ ''.__class__ }}", [], [], False, False, ["truy cập thuộc tính nội bộ '.__class__'"]),
    ("{{ cfg['_secret'] }}", ["cfg['_secret']"], [], False, False, ["truy cập thuộc tính nội bộ ['_secret']"]),
    ("{{ cycler(1, 2) }}{{ fn(arg, key=val) }}", ["arg", "fn", "val"], [], False, False, ["lời gọi hàm", "tên toàn cục 'cycler'"]),
    ("{% include 'other' %}{{ request.args|map('upper') }}", ["request.args"], [], False, False, ["bộ lọc 'map' ngoài danh sách cho phép", "thẻ include", "tên toàn cục 'request'"]),
    ("{{ v1 is not none }}{{ {'k': v2, 'l': [v3, -v4.n]} }}{{ (h1).i }}", ["h1.i", "v1", "v2", "v3", "v4.n"], [], False, False, []),
    ("chỉ có chữ, không có thẻ\n", [], [], False, False, []),
]


@query(f"""WITH {_values("f", "i, t, declared, loops, has_loops, has_conditionals, findings", FRAGMENTS)}
SELECT p_partkey, list_sort(list_distinct(a.declared || b.declared)) AS declared, list_sort(list_distinct(a.loops || b.loops)) AS loops, a.has_loops OR b.has_loops AS has_loops,
 a.has_conditionals OR b.has_conditionals AS has_conditionals, list_sort(list_distinct(a.findings || b.findings)) AS findings
FROM part JOIN f a ON a.i = p_partkey % {len(FRAGMENTS)} JOIN f b ON b.i = p_partkey // {len(FRAGMENTS)} % {len(FRAGMENTS)}""")
def template_reads(spark, d):
    """What templates of two fragments each read, loop over and break."""
    n, texts = len(FRAGMENTS), [f[0] for f in FRAGMENTS]
    p = table(spark, d, "part").select("p_partkey", F.concat(_pick(texts, F.col("p_partkey")), _pick(texts, F.floor(F.col("p_partkey") / n))).alias("source"))
    r = grammar.once_per_text(p, ["source"], "r", lambda texts: texts.withColumn("r", grammar.inspect("source")))
    return r.select("p_partkey", *[f"r.{c}" for c in ("declared", "loops", "has_loops", "has_conditionals", "findings")])


# (text, paragraph of its first error)
BROKEN = [
    ("ổn\nSố: {{ id_number %}", 1), ("{% for %}", 0), ("a\n\n{{ x y }}", 2), ("{% if a %}\nb", 1), ("{{ }}", 0), ("{{ (a }}", 0), ("\n{% endif %}", 1),
    ("{{ a. }}", 0), ("{{ a | }}", 0), ("{{ a + }}", 0), ("{% frobnicate x %}", 0), ("{{ [a) }}", 0), ("{% for x in y %}{% endif %}", 0), ("{{ a }} tốt", None), ("{% if a %}\n{% else %}b{% endif %}", None), ("{{ 'x }} y' ~ \"{{\" }}", None),
]


@query(f"""WITH {_values("f", "i, t, error", BROKEN)} SELECT s_suppkey, error + (s_suppkey % 3)::INT AS error FROM supplier JOIN f ON i = s_suppkey % {len(BROKEN)}""")
def template_errors(spark, d):
    """The paragraph of the first error of templates after up to two blank paragraphs."""
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.repeat(F.lit("\n"), (s % 3).cast("int")), _pick([f[0] for f in BROKEN], s)).alias("source"))
    return grammar.once_per_text(rows, ["source"], "error", lambda texts: texts.withColumn("error", grammar.inspect("source")["error"])).select("s_suppkey", "error")


def _party(key: str | None = "holder", label: str = "Bên tham gia", entity_type: str | None = "INDIVIDUAL", low: int = 1, high: int = 1, collect: list[str] | None = None) -> dict:
    return {"key": key, "label": label, "entity_type": entity_type, "min": low, "max": high, "collect": collect or []}


# (schema, parties, what isn't supported, (party keys, declared, required, styled) of its extra fields)
SCHEMAS = [
    ([{"key": "holder"}], [_party()], [], (["holder"], [], [], [])),
    ([["key", "buyer"]], [_party()], [], ([], [], [], [])),
    ([{"key": "buyer", "label": "Bên mua", "min": 2, "collect": ["contact", "org_profile"]}], [_party("buyer", "Bên mua", low=2, collect=["contact", "org_profile"])], ["bên 'buyer' khai min=2", "bên 'buyer' khai collect=['org_profile']"], (["buyer"], [], [], [])),
    ([{"entity_type": "ORGANIZATION", "max": "3", "key": ""}, {"key": "b"}], [_party("", entity_type="ORGANIZATION", high=3), _party("b")], ["bên '?' khai entity_type=ORGANIZATION", "bên '?' khai max=3"], (["b"], [], [], [])),
    ([{"key": "holder", "extra_fields": [{"key": "nick", "required": True}, {"key": "grade", "required": "true", "render_style": {"bold": True}}, {"required": True}, "loose"]}], [_party()], [], (["holder"], ["grade", "nick"], ["nick"], ["grade"])),
    ([{"key": "holder", "extra_fields": "none", "entity_type": None, "collect": "contact"}], [_party(entity_type=None)], [], (["holder"], [], [], [])),
    ([], [], [], ([], [], [], [])),
    ([{"key": "holder", "extra_fields": [{"key": "a", "render_style": {"bold": False, "size": 0, "font": ""}}, {"key": 5, "required": True}]}, 7], [_party(), _party()], [], (["holder"], ["a"], [], [])),
]
_STRUCT = "STRUCT(key VARCHAR, label VARCHAR, entity_type VARCHAR, min INT, max INT, collect VARCHAR[])[]"


def _schemas() -> str:
    rows = [(json.dumps(p, ensure_ascii=False), u, *v) for _, p, u, v in SCHEMAS]
    return _values("f", "i, parties, unsupported, party_keys, declared, required, styled", rows)


def _schema(key: Column) -> Column:
    return _pick([json.dumps(s, ensure_ascii=False) for s, *_ in SCHEMAS], key)


@query(f"""WITH {_schemas()} SELECT s_suppkey, problem, list_transform(p, lambda x: x.key) AS keys, list_transform(p, lambda x: x.label) AS labels, list_transform(p, lambda x: x.entity_type) AS entity_types,
 list_transform(p, lambda x: x.min || '-' || x.max) AS counts, list_transform(p, lambda x: array_to_string(x.collect, ' ')) AS collected, CASE WHEN problem IS NULL THEN version END AS active_version_no,
 (len(p) + 2)::INT AS wizard_steps
FROM (SELECT *, CASE WHEN problem IS NULL THEN parties::JSON::{_STRUCT} END AS p FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'TEMPLATE_NO_ACTIVE_VERSION' WHEN s_suppkey % 5 = 0 THEN 'TEMPLATE_ACTIVE_VERSION_MISSING' END AS problem, parties, s_nationkey::INT AS version FROM supplier JOIN f ON i = s_suppkey % {len(SCHEMAS)} WHERE s_suppkey % 11 <> 0))""")
def template_requirements(spark, d):
    """What suppliers' templates ask for: every eleventh is deleted, others have no active version, or one that is gone."""
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    rows = s.select(key.alias("template_id"), _schema(key).alias("party_schema"), F.when(key % 7 != 0, key).alias("active_version_id"), (key % 11 == 0).alias("is_deleted"))
    versions = s.where(key % 5 != 0).select(key.alias("version_id"), F.col("s_nationkey").cast("int").alias("version_no"))
    asked = parties.requirements(rows, versions)
    each = {"keys": lambda p: p["key"], "labels": lambda p: p["label"], "entity_types": lambda p: p["entity_type"], "counts": lambda p: F.concat_ws("-", p["min"], p["max"]), "collected": lambda p: F.array_join(p["collect"], " ")}
    return asked.select(F.col("template_id").alias("s_suppkey"), "problem", *[F.transform("parties", f).alias(k) for k, f in each.items()], "active_version_no", "wizard_steps")


@query(f"""WITH {_schemas()} SELECT c_custkey, unsupported, party_keys, list_sort(list_distinct({list(parties.KNOWN)} || declared)) AS known, required, list_sort(list_distinct({list(parties.STYLED)} || styled)) AS styled FROM customer JOIN f ON i = c_custkey % {len(SCHEMAS)}""")
def schema_vocabulary(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", _schema(F.col("c_custkey")).alias("s"), F.lit(None).cast("string").alias("fields"))
    return rows.select("c_custkey", parties.unsupported("s").alias("unsupported"), parties.vocabulary("s", "fields").alias("v")).select("c_custkey", "unsupported", "v.*")


# (template, declared, written to keep their style, loops, images, broken rules or hits)
UPLOADS = [
    ("{{ full_name }} {{r securities_account_no }}", ["full_name", "securities_account_no"], ["securities_account_no"], [], 0, []),
    ("{{ holder.full_name }} {{ securities_account_no }} {{ grade }}", ["grade", "holder.full_name", "securities_account_no"], [], [], 0, []),
    ("{{ nick }} {{ stranger }}\n{{p photo }}", ["nick", "photo", "stranger"], [], [], 1, []),
    ("{% for x in full_name %}{{ x }}{% endfor %}{{ holder.nick }}", ["full_name", "holder.nick"], [], ["full_name"], 0, []),
    ("{{ a.mro }} {{ address|eval }}", ["a.mro", "address"], [], [], 0, ["bộ lọc 'eval' ngoài danh sách cho phép", "từ khoá 'eval'", "từ khoá 'mro'"]),
]
_LEAF = "CASE WHEN list_contains(party_keys, split_part(p, '.', 1)) AND contains(p, '.') THEN split_part(p, '.', -1) ELSE p END"


@query(f"""WITH {_schemas()}, {_values("u", "j, t, said, rich, loops, images, bad", UPLOADS)}, x AS (
 SELECT p_partkey, u.*, unsupported, required, {list(parties.KNOWN)} || declared AS known, {list(parties.STYLED)} || styled AS styled, list_transform(said, lambda p: {_LEAF}) AS leaves, party_keys FROM part JOIN f ON f.i = p_partkey // {len(UPLOADS)} % {len(SCHEMAS)} JOIN u ON j = p_partkey % {len(UPLOADS)}
), y AS (SELECT *, list_filter(said, lambda p: list_contains(known, {_LEAF})) AS fine,
 (CASE WHEN len(bad) > 0 THEN ['6014'] ELSE [] END) || (CASE WHEN len(unsupported) > 0 THEN ['6016'] ELSE [] END) AS errors FROM x
), z AS (SELECT *, list_transform(range(images), lambda k: '6010') || list_transform(list_filter(leaves, lambda p: NOT list_contains(known, p)), lambda p: '6009') || list_transform(list_filter(required, lambda k: NOT list_contains(leaves, k)), lambda k: '6011')
 || list_transform(list_filter(leaves, lambda p: list_contains(styled, p) AND NOT list_contains(rich, p)), lambda p: '6008') || list_transform(list_filter(loops, lambda p: list_contains(known, p)), lambda p: '6012') AS warnings FROM y)
SELECT p_partkey, CASE WHEN len(errors) > 0 THEN 'INVALID' WHEN len(warnings) > 0 THEN 'WARNING' ELSE 'VALID' END AS status, errors || warnings AS codes, said AS declared, list_filter(fine, lambda p: list_contains(required, {_LEAF})) AS required, list_filter(said, lambda p: NOT list_contains(fine, p)) AS unknown, rich AS richtext FROM z""")
def template_uploads(spark, d):
    """What each upload is told: every template with every schema."""
    p = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", _pick([u[0] for u in UPLOADS], p).alias("source"), _schema(F.floor(p / len(UPLOADS))).alias("party_schema"), F.lit("[]").alias("contract_fields"))
    i = F.col("inspection")
    return parties.inspected(rows).select("p_partkey", i["status"].alias("status"), F.transform(i["diagnostics"], lambda x: x["code"]).alias("codes"), i["declared"].alias("declared"), i["required"].alias("required"), i["unknown"].alias("unknown"), i["richtext"].alias("richtext"))


_DAY = "strftime(o_orderdate, '%d/%m/%Y')"
_DAY_TEXT = "'ngày ' || strftime(o_orderdate, '%d') || ' tháng ' || strftime(o_orderdate, '%m') || ' năm ' || strftime(o_orderdate, '%Y')"
_DATED = "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE {} END"
_BANKED = "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE {} END"


@query(f"""SELECT o_orderkey, c_name AS full_name, rtrim(regexp_replace(lpad(c_custkey::VARCHAR, 12, '0'), '(....)', '\\1 ', 'g')) AS id_number_spaced, {_DAY} AS dob, {_DAY_TEXT} AS dob_text,
 CASE WHEN o_orderkey % 5 = 0 THEN 'KHÔNG THỜI HẠN' ELSE {_DAY} END AS expiry_date, CASE o_orderkey % 3 WHEN 0 THEN 'BCA' WHEN 1 THEN 'X' ELSE '' END AS issue_place_short, CASE o_orderkey % 4 WHEN 0 THEN 'Nam' WHEN 1 THEN 'Nữ' ELSE '' END AS gender,
 {_BANKED.format("c_custkey::VARCHAR")} AS bank_account, {_BANKED.format("CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE 'other' END")} AS account_holder_name, {_DATED.format(_DAY)} AS contract_date, {_DATED.format(_DAY_TEXT)} AS contract_date_text,
 {_DATED.format("strftime(o_orderdate, '%d')")} AS day, {_DATED.format("strftime(o_orderdate, '%m')")} AS month, {_DATED.format("strftime(o_orderdate, '%Y')")} AS year, o_clerk AS created_by_name
FROM (SELECT *, 'Clerk' || o_custkey % 10 AS o_clerk FROM orders) JOIN customer ON c_custkey = o_custkey""")
def render_contexts(spark, d):
    """The variables of a contract for every order: its customer's, their bank account's, the contract's."""
    c, key = F.col, F.col("o_orderkey")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customers, "o_custkey")
    nothing, day = F.lit(None).cast("string"), c("o_orderdate").cast("date")
    party = parties.party_values({
        "full_name": c("c_name"), "id_number": F.lpad(c("o_custkey").cast("string"), 12, "0"), "dob": day, "issue_date": day, "expiry_date": F.when(key % 5 != 0, day), "issue_place": F.when(key % 3 == 0, next(iter(parties.SHORT_PLACES))).when(key % 3 == 1, "X"),
        "gender": F.when(key % 4 == 0, "NAM").when(key % 4 == 1, "NỮ").when(key % 4 == 2, "UNKNOWN"), "phone": nothing, "email": nothing, "address": nothing, "securities_account_no": nothing,
    })
    account = F.when(key % 3 != 0, F.struct(c("o_custkey").alias("account_number"), F.lit("b").alias("bank_name"), nothing.alias("bank_code"), F.lit("c").alias("branch"), F.when(key % 2 == 0, "").otherwise("other").alias("account_holder_name")))
    values = party | parties.bank_values(account, c("c_name")) | parties.system_values(key, F.when(key % 4 != 0, day), day, F.concat(F.lit("Clerk"), (c("o_custkey") % 10).cast("string")))
    wanted = "full_name id_number_spaced dob dob_text expiry_date issue_place_short gender bank_account account_holder_name contract_date contract_date_text day month year created_by_name".split()
    return rows.select("o_orderkey", *[values[k].alias(k) for k in wanted])


@query("""SELECT o_orderkey, sha256('{"b": [' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_custkey || ', null' END || '], "m": {"a": ' || o_totalprice::DOUBLE || ', "z\\"": "é\\n' || o_orderkey || '"}, "n": null, "t": ' || (o_orderkey % 2 = 0) || '}') AS digest FROM orders""")
def snapshot_digests(spark, d):
    """The digest of each order's snapshot: nested, with a null, a double, quotes and a line break, keys out of order."""
    key = F.col("o_orderkey")
    inner = F.struct(F.concat(F.lit("é\n"), key.cast("string")).alias('z"'), F.col("o_totalprice").cast("double").alias("a"))
    snapshot = F.struct((key % 2 == 0).alias("t"), F.lit(None).cast("string").alias("n"), inner.alias("m"), F.when(key % 3 == 0, F.array().cast("array<long>")).otherwise(F.array(F.col("o_custkey").cast("long"), F.lit(None))).alias("b"))
    rows = table(spark, d, "orders").select("o_orderkey", snapshot.alias("s"))
    return rows.select("o_orderkey", formatting.digest(F.col("s"), rows.schema["s"].dataType).alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'N**' || ' u**' END AS full_name, ['[địa chỉ] Hà Nội', '[REDACTED:address]'] AS addresses, '[REDACTED]' AS token, '[REDACTED:qr_raw]' AS raw, value, '•••••••• '[:8] || lpad((event_id % 10000)::VARCHAR, 4, '0') AS note, event_type AS kind FROM events""")
def redacted_contexts(spark, d):
    """Contexts of three levels: names, addresses in a list, secrets and raw values in a map, and texts."""
    number = F.concat(F.lit("00119901"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"))
    user = F.when(F.col("event_id") % 4 != 0, F.struct(F.concat(F.lit("Nam user")).alias("full_name")))
    context = F.struct(
        user.alias("user"), F.array(F.lit("1 phố X, Hà Nội"), F.lit("nowhere")).alias("home_address"), F.col("value"), F.array(F.struct(F.create_map(F.lit("access_token"), F.lit("abc"), F.lit("qr_raw"), F.lit("P<X")).alias("m"), number.alias("note"), F.col("event_type").alias("kind"))).alias("steps")
    )
    rows = table(spark, d, "events").select("event_id", context.alias("c"))
    r = rows.select("event_id", privacy.redact(F.col("c"), rows.schema["c"].dataType).alias("c"))
    step = F.col("c.steps")[0]
    return r.select("event_id", F.col("c.user.full_name").alias("full_name"), F.col("c.home_address").alias("addresses"), step["m"]["access_token"].alias("token"), step["m"]["qr_raw"].alias("raw"), F.col("c.value").alias("value"), step["note"].alias("note"), step["kind"].alias("kind"))


# (line, what is found in it)
EXPIRIES = [
    ("Có giá trị đến: {}", "{}"), ("Date of expiry", None), ("KHÔNG THỜI HẠN", "KHÔNG THỜI HẠN"), ("Khong thoi han", "KHÔNG THỜI HẠN"), ("Có giá trị đến: KHONG THOl HAN", "KHÔNG THỜI HẠN"),
    ("KHONG", None), ("", None), (None, None), ("{} KHÔNG THỜI HẠN", "{}"), ("99/99/9999", None),
]


@query(f"""WITH {_values("f", "i, line, found", EXPIRIES)} SELECT o_orderkey, replace(found, '{{}}', strftime(o_orderdate, '%d/%m/%Y')) AS found FROM orders JOIN f ON i = o_orderkey % {len(EXPIRIES)}""")
def find_expiries(spark, d):
    """Lines of a card's back with a date, with the words for no expiry as they are read, or with neither."""
    said = F.replace(_pick([x for x, _ in EXPIRIES], F.col("o_orderkey")), F.lit("{}"), F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", fuzzy.find_expiry(said).alias("found"))
