"""Party schemas of mixed shape as one struct, the vocabulary they give a template, its inspection, and the values of its context.

Schemas are JSON read as VARIANT: an entry may be an object or anything else, a key may be absent, null or of another type, and each of these
has its own meaning. Nothing is inferred from the data, so new keys need no new schema.

Defined cases: a null or malformed schema has no parties; an entry that is no object is one without keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import domains
from tessera.functions.formatting import format_date, format_date_text
from tessera.operators import grammar, templates

# The variables that every template may use, those with a style, and what a party's entry says if it doesn't say it.
CARD = ("full_name", "id_number", "id_number_spaced", "dob", "dob_text", "issue_date", "issue_date_text", "expiry_date", "issue_place", "issue_place_short", "gender")
CONTACT = ("phone", "email", "address")
BANK = ("bank_account", "bank_name", "bank_short_name", "branch", "account_holder_name")
SYSTEM = ("contract_no", "contract_date", "contract_date_text", "today", "day", "month", "year", "created_by_name")
STYLED = ("securities_account_no",)
KNOWN = (*CARD, *CONTACT, *BANK, *STYLED, *SYSTEM)
PARTY = {"key": "holder", "label": "Bên tham gia", "entity_type": "INDIVIDUAL", "min": 1, "max": 1}
COLLECTED = ("contact", "bank_account")
NO_EXPIRY = "KHÔNG THỜI HẠN"
GENDERS = {"NAM": "Nam", "NỮ": "Nữ", "KHÁC": "Khác", "UNKNOWN": ""}
SHORT_PLACES = {domains.BO_CONG_AN: "BCA", domains.CUC_CANH_SAT: "CỤC CS QLHC VỀ TTXH"}
WIZARD_STEPS = 2


def entries(schema: str) -> str:
    """The entries of a column of JSON as an array of VARIANT."""
    return f"coalesce(try_variant_get(try_parse_json({schema}), '$', 'array<variant>'), cast(array() as array<variant>))"


def _kind(x: str, path: str) -> str:
    """The type of what stands at a path, null where nothing does."""
    return f"schema_of_variant(try_variant_get({x}, '$.{path}', 'variant'))"


def _text(x: str, path: str) -> str:
    """A text that is no empty text, else null."""
    return f"if({_kind(x, path)} = 'STRING', nullif(try_variant_get({x}, '$.{path}', 'string'), ''), null)"


def parties(schema: str) -> Column:
    """The parties of a schema as (key, label, entity_type, min, max, collect): an absent value has its default, a null one stays null."""

    def value(name: str) -> str:
        kind = "int" if isinstance(PARTY[name], int) else "string"
        return f"'{name}', if({_kind('e', name)} is null, {PARTY[name]!r}, try_variant_get(e, '$.{name}', '{kind}'))"

    collect = "'collect', coalesce(try_variant_get(e, '$.collect', 'array<string>'), cast(array() as array<string>))"
    return F.expr(f"transform({entries(schema)}, e -> named_struct({', '.join(map(value, PARTY))}, {collect}))")


def unsupported(schema: str) -> Column:
    """What parties ask for that there isn't: other kinds, more than one, other things to collect."""
    key = "coalesce(nullif(try_variant_get(e, '$.key', 'string'), ''), '?')"
    said = lambda what: f"concat('bên \\'', {key}, '\\' khai ', {what})"
    value = lambda name: f"try_variant_get(e, '$.{name}', 'string')"
    kind = f"if({value('entity_type')} <> '{PARTY['entity_type']}', {said(f'''concat('entity_type=', {value('entity_type')})''')}, null)"
    bounds = [f"if(not coalesce(try_variant_get(e, '$.{b}', 'double') = 1, false) and {value(b)} is not null, {said(f'''concat('{b}=', {value(b)})''')}, null)" for b in ("min", "max")]
    other = f"filter(try_variant_get(e, '$.collect', 'array<string>'), c -> c not in {COLLECTED})"
    collect = f"if(size({other}) > 0, {said(f'''concat('collect=[', array_join(transform({other}, c -> concat('\\'', c, '\\'')), ', '), ']')''')}, null)"
    return F.expr(f"filter(flatten(transform({entries(schema)}, e -> array({kind}, {', '.join(bounds)}, {collect}))), r -> r is not null)")


def vocabulary(party_schema: str, contract_fields: str) -> Column:
    """party_keys, known, required and styled: the variables that a template may use."""
    own = f"filter({entries(party_schema)}, e -> startswith(schema_of_variant(e), 'OBJECT'))"
    extra = f"flatten(transform({own}, e -> coalesce(try_variant_get(e, '$.extra_fields', 'array<variant>'), cast(array() as array<variant>))))"
    fields = f"filter(concat({extra}, {entries(contract_fields)}), e -> startswith(schema_of_variant(e), 'OBJECT') and {_text('e', 'key')} is not null)"
    keys = lambda test: f"transform(filter({fields}, e -> {test}), e -> {_text('e', 'key')})"
    needed = f"{_kind('e', 'required')} = 'BOOLEAN' and try_variant_get(e, '$.required', 'boolean')"
    style = "exists(map_values(try_variant_get(e, '$.render_style', 'map<string,variant>')), v -> not is_variant_null(v) and to_json(v) not in ('false', '0', '0.0', '\"\"', '[]', '{}'))"
    words = lambda w: f"array({', '.join(map(repr, w))})"
    out = {
        "party_keys": f"filter(transform({own}, e -> {_text('e', 'key')}), k -> k is not null)",
        "known": f"concat({words(KNOWN)}, {keys('true')})",
        "required": keys(needed),
        "styled": f"concat({words(STYLED)}, {keys(f'coalesce({style}, false)')})",
    }
    return F.expr(f"named_struct({', '.join(f'''{k!r}, array_sort(array_distinct({v}))''' for k, v in out.items())})")


def _leaf(path: Column, words: Column) -> Column:
    """A path without its party's key: `holder.full_name` and `full_name` are one variable."""
    root = F.split(path, r"[.\[]", 2)[0]
    return F.when(F.contains(path, F.lit(".")) & F.array_contains(words["party_keys"], root), F.regexp_extract(path, r"(?s)\.([^.]*)\z", 1)).otherwise(path)


def inspected(rows: DataFrame, source: str = "source", party_schema: str = "party_schema", contract_fields: str = "contract_fields") -> DataFrame:
    """rows with what an upload of their template is told, as inspection: status, declared, required, optional, unknown, richtext,
    has_loops, has_conditionals, error (the paragraph of a syntax error, which leaves the rest empty) and diagnostics (code, severity, name), errors first.
    """
    return grammar.once_per_text(rows, [source, party_schema, contract_fields], "inspection", lambda texts: _inspected(texts, source, party_schema, contract_fields))


def _inspected(rows: DataFrame, source: str, party_schema: str, contract_fields: str) -> DataFrame:
    rows = rows.withColumn("_plain", templates.plain_tags(F.col(source))).withColumn("_read", grammar.inspect("_plain")).withColumn("_words", vocabulary(party_schema, contract_fields))
    read, words = F.col("_read"), F.col("_words")
    nothing = F.array().cast("array<string>")
    leaf = lambda p: _leaf(p, words)
    known = lambda p: F.array_contains(words["known"], leaf(p)) & ~F.contains(leaf(p), F.lit("["))
    rows = rows.withColumn("_rich", templates.richtext_variables(F.col(source))).withColumn("_bad", F.array_sort(F.array_union(read["findings"], templates.blacklist_hits(F.col("_plain")))))
    declared, rich = read["declared"], F.transform("_rich", leaf)
    rows = rows.withColumn("_known", F.filter(declared, known))
    diagnostic = lambda code, severity, name: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), name.cast("string").alias("name"))
    each = lambda names, code: F.transform(names, lambda n: diagnostic(code, "WARNING", n))
    once = lambda names, code: F.when(F.size(names) > 0, F.array(diagnostic(code, "ERROR", F.array_join(names, ", ")))).otherwise(F.array().cast("array<struct<code:string,severity:string,name:string>>"))
    plain = F.filter(F.transform(declared, leaf), lambda p: F.array_contains(words["styled"], p) & ~F.array_contains(rich, p))
    said = F.concat(
        once(F.col("_bad"), "6014"),
        once(unsupported(party_schema), "6016"),
        each(templates.image_paragraphs(F.col(source)), "6010"),
        each(F.filter(declared, lambda p: ~known(p)), "6009"),
        each(F.filter(words["required"], lambda k: ~F.array_contains(F.transform(declared, leaf), k)), "6011"),
        each(plain, "6008"),
        each(F.filter(read["loops"], known), "6012"),
    )
    said = F.when(read["error"].isNotNull(), F.array(diagnostic("6003", "ERROR", read["error"]))).otherwise(said)
    rows = rows.withColumn("_said", said)
    status = F.when(F.exists("_said", lambda d: d["severity"] == "ERROR"), "INVALID").when(F.size("_said") > 0, "WARNING").otherwise("VALID")
    needed = lambda p: F.array_contains(words["required"], leaf(p))
    sound = lambda x, none=nothing: F.when(read["error"].isNull(), x).otherwise(none)
    out = {
        "status": status, "declared": sound(declared), "required": sound(F.filter("_known", needed)), "optional": sound(F.filter("_known", lambda p: ~needed(p))),
        "unknown": sound(F.array_except(declared, "_known")), "richtext": sound(F.col("_rich")), "has_loops": sound(read["has_loops"], F.lit(False)), "has_conditionals": sound(read["has_conditionals"], F.lit(False)),
        "error": read["error"], "diagnostics": F.col("_said"),
    }
    inspection = F.when(F.col(source).isNotNull(), F.struct(*[x.alias(k) for k, x in out.items()]))
    return rows.withColumn("inspection", inspection).drop("_plain", "_read", "_words", "_rich", "_bad", "_known", "_said")


def requirements(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """template_id, problem, parties, active_version_no and wizard_steps of templates (template_id, party_schema, active_version_id, is_deleted), with
    versions (version_id, version_no): a deleted template isn't found, one without an active version that exists has nothing to fill in."""
    active = versions.select(F.col("version_id").alias("active_version_id"), F.col("version_no").alias("active_version_no"))
    rows = rows.where(~F.coalesce("is_deleted", F.lit(False))).join(active, "active_version_id", "left").withColumn("parties", parties("party_schema"))
    problem = F.when(F.col("active_version_id").isNull(), "TEMPLATE_NO_ACTIVE_VERSION").when(F.col("active_version_no").isNull(), "TEMPLATE_ACTIVE_VERSION_MISSING")
    rows = rows.withColumn("problem", problem)
    fine = lambda x: F.when(F.col("problem").isNull(), x)
    return rows.select("template_id", "problem", fine(F.col("parties")).alias("parties"), fine(F.col("active_version_no")).alias("active_version_no"), fine(F.size("parties") + WIZARD_STEPS).alias("wizard_steps"))


def _blank(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def grouped_by_four(x: Column) -> Column:
    return F.rtrim(F.regexp_replace(x, r"(.{4})", "$1 "))


def party_values(c: dict[str, Column]) -> dict[str, Column]:
    """The variables of a party from the columns of a customer; a card without an expiry says so."""
    place = _blank(c["issue_place"])
    short = F.coalesce(*[F.when(place == k, v) for k, v in SHORT_PLACES.items()], place)
    return {
        "full_name": _blank(c["full_name"]), "id_number": _blank(c["id_number"]), "id_number_spaced": grouped_by_four(_blank(c["id_number"])),
        "dob": _blank(format_date(c["dob"])), "dob_text": _blank(format_date_text(c["dob"])), "issue_date": _blank(format_date(c["issue_date"])), "issue_date_text": _blank(format_date_text(c["issue_date"])),
        "expiry_date": F.coalesce(format_date(c["expiry_date"]), F.lit(NO_EXPIRY)), "issue_place": place, "issue_place_short": short,
        "gender": F.coalesce(*[F.when(c["gender"] == k, v) for k, v in GENDERS.items()], F.lit("")),
        "phone": _blank(c["phone"]), "email": _blank(c["email"]), "address": _blank(c["address"]), "securities_account_no": _blank(c["securities_account_no"]),
    }


def bank_values(account: Column, holder: Column) -> dict[str, Column]:
    """The variables of a bank account (account_number, bank_name, bank_code, branch, account_holder_name), all blank without one; its holder is the party unless it names another."""
    named = {"bank_account": account["account_number"], "bank_name": account["bank_name"], "bank_short_name": account["bank_code"], "branch": account["branch"], "account_holder_name": templates.or_else(account["account_holder_name"], holder)}
    return {k: F.when(account.isNotNull(), _blank(x)).otherwise("") for k, x in named.items()}


def system_values(number: Column, day: Column, today: Column, created_by: Column) -> dict[str, Column]:
    part = lambda form: _blank(F.date_format(day, form))
    return {
        "contract_no": _blank(number), "contract_date": _blank(format_date(day)), "contract_date_text": _blank(format_date_text(day)), "today": _blank(format_date(today)),
        "day": part("dd"), "month": part("MM"), "year": part("yyyy"), "created_by_name": _blank(created_by),
    }


def as_map(values: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
