"""Declarative validation: rules with severities over rows, as issue arrays and as an issue table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates, domains
from tessera.functions.text import word_count

E, W, I = "ERROR", "WARNING", "INFO"
REQUIRED = ("id_number", "full_name", "date_of_birth", "issue_date", "issue_place")
FIELDS = (*REQUIRED[:4], "expiry_date", "issue_place")


@dataclass(frozen=True)
class Rule:
    """code, severity, field and the test that finds the issue; the test sees the row and the context."""

    code: str
    severity: str
    field: str
    test: Callable[[Context], Column]


@dataclass(frozen=True)
class Context:
    today: Column
    threshold: float = 0.85
    provinces: tuple[str, ...] = ()


def _has(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _date(name: str) -> Column:
    return F.col(f"_parsed_{name}")


def _bad_date(name: str) -> Callable[[Context], Column]:
    return lambda c: _has(name) & _date(name).isNull()


def _expiry_text() -> Column:
    return F.col("expiry_date") == dates.NO_EXPIRY_TEXT


def _age_at_issue() -> Column:
    return F.col("_parsed_age")


def _ordered() -> Column:
    """The card's dates are known and in order."""
    return _date("issue_date").isNotNull() & _date("expiry_date").isNotNull() & (_date("issue_date") <= _date("expiry_date"))


def _citizen() -> Column:
    return F.col("_parsed_citizen")



def implied_year(citizen: Column) -> Column:
    """The birth year that an id implies; without a century, its last two digits after dots."""
    lo = domains.inferred_birth_years(citizen)["lo"]
    return F.when(lo.isNotNull(), F.concat(F.substring(lo.cast("string"), 1, 2), domains.birth_year_suffix(citizen))).otherwise(F.concat(F.lit(".."), domains.birth_year_suffix(citizen)))


def _wrong_year(c: Context) -> Column:
    years, born = F.col("_parsed_years"), F.year(_date("date_of_birth"))
    return (F.lpad((born % 100).cast("string"), 2, "0") != domains.birth_year_suffix(_citizen())) | ~F.coalesce(born.between(years["lo"], years["hi"]), F.lit(True))


#: Rules over one card: a column for each field, confidence_<field>, flags_<field>, has_front, has_back, same_side, gender.
CARD = [
    Rule("V-OCR-001", E, "front_image", lambda c: ~F.col("has_front")),
    Rule("V-OCR-001", E, "back_image", lambda c: ~F.col("has_back")),
    Rule("V-OCR-002", E, "images", lambda c: F.col("same_side")),
    Rule("V-OCR-003", E, "id_number", lambda c: _has("id_number") & _citizen().isNull()),
    Rule("V-OCR-004", W, "full_name", lambda c: _has("full_name") & (word_count(F.col("full_name")) < 2)),
    Rule("V-OCR-005", E, "date_of_birth", _bad_date("date_of_birth")),
    Rule("V-OCR-006", E, "issue_date", _bad_date("issue_date")),
    Rule("V-OCR-007", E, "expiry_date", lambda c: _bad_date("expiry_date")(c) & ~_expiry_text()),
    Rule("V-OCR-008", E, "expiry_date", lambda c: _date("issue_date") > _date("expiry_date")),
    Rule("V-OCR-009", E, "issue_date", lambda c: _date("date_of_birth") >= _date("issue_date")),
    Rule("V-OCR-010", W, "issue_date", lambda c: _age_at_issue() < dates.MIN_AGE_AT_ISSUE),
    Rule("V-OCR-011", W, "date_of_birth", lambda c: ~dates.age_in_years(_date("date_of_birth"), c.today).between(14, 120)),
    Rule("V-OCR-012", E, "issue_date", lambda c: _date("issue_date") > c.today),
    Rule("V-OCR-013", W, "expiry_date", lambda c: _ordered() & dates.is_expired(_date("expiry_date"), c.today)),
    Rule("V-OCR-014", I, "expiry_date", lambda c: _ordered() & dates.is_expiring_soon(_date("expiry_date"), c.today)),
    Rule("V-OCR-015", I, "expiry_date", lambda c: _ordered() & (_age_at_issue() >= dates.NO_EXPIRY_AGE)),
    Rule("V-OCR-016", E, "issue_place", lambda c: _has("issue_place") & ~F.col("issue_place").isin(domains.BO_CONG_AN, domains.CUC_CANH_SAT)),
    *[Rule("V-OCR-017", E, f, lambda c, f=f: ~_has(f)) for f in REQUIRED],
    *[Rule("V-OCR-018", W, f, lambda c, f=f: _has(f) & (F.col(f"confidence_{f}") < c.threshold)) for f in FIELDS],
    Rule("V-OCR-019", E, "id_number", lambda c: F.array_contains("flags_id_number", "CARD_MISMATCH")),
    *[Rule("V-OCR-020", W, f, lambda c, f=f: F.array_contains(f"flags_{f}", "SOURCE_CONFLICT")) for f in FIELDS],
    Rule("V-OCR-021", W, "id_number", lambda c: ~domains.province_code(_citizen()).isin(list(c.provinces)) if c.provinces else F.lit(False)),
    Rule("V-OCR-022", W, "id_number", lambda c: domains.inferred_gender(_citizen()) != F.col("gender")),
    Rule("V-OCR-023", W, "date_of_birth", _wrong_year),
]

#: Rules over one contract candidate: its version, template file, space, parties' states.
CONTRACT = [
    Rule("V-CTR-001", E, "template", lambda c: ~F.coalesce(F.col("version_usable"), F.lit(False))),
    Rule("V-CTR-002", E, "template", lambda c: ~F.col("file_exists") | ~F.coalesce(F.col("checksum") == F.col("expected_checksum"), F.lit(False))),
    Rule("V-CTR-008", E, "storage", lambda c: F.col("free_bytes") < 100 * 1024 * 1024),
    Rule("V-CTR-009", E, "customer", lambda c: F.col("customer_deleted_at").isNotNull()),
    Rule("V-CTR-010", W, "expiry_date", lambda c: dates.is_expired(F.col("card_expiry"), c.today)),
]
#: Rule sets by name; forms and templates are registered empty.
RULE_SETS: dict[str, list[Rule]] = {"ocr": CARD, "contract": CONTRACT, "form": [], "template": []}


def rules_in(rule_set: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(r.code for r in RULE_SETS[rule_set]))


def issues(rules: list[Rule], context: Context) -> Column:
    """A row's issues in the order of the rules; a test that is null finds none."""
    found = [F.when(F.coalesce(r.test(context), F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"))) for i, r in enumerate(rules)]
    if not found:
        return F.array().cast("array<struct<ord:int,code:string,severity:string,field:string>>")
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def parsed_card(df: DataFrame) -> DataFrame:
    """df with the dates, id, age and years that the rules over a card read many times, each computed once a row."""
    dated = {f"_parsed_{f}": dates.parse_iso(F.col(f)) for f in ("date_of_birth", "issue_date", "expiry_date")}
    df = df.withColumns(dated | {"_parsed_citizen": F.when(F.col("id_number").rlike(r"^[0-9]{12}\z"), F.col("id_number"))})
    return df.withColumns({"_parsed_age": dates.age_in_years(_date("date_of_birth"), _date("issue_date")), "_parsed_years": domains.inferred_birth_years(_citizen())})


def validate(df: DataFrame, rule_set: str, context: Context) -> DataFrame:
    """df with the issues that the rules find."""
    rows = parsed_card(df) if rule_set == "ocr" else df
    return rows.withColumn("issues", issues(RULE_SETS[rule_set], context)).select(*df.columns, "issues")


def issue_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """An issue a row. The outer form keeps Spark from finding all issues once more, as a filter for rows that have any."""
    return df.select(*keys, F.inline_outer("issues")).where(F.col("code").isNotNull())


def by_severity(found: Column, severity: str) -> Column:
    return F.filter(found, lambda i: i["severity"] == severity)


def is_valid(found: Column) -> Column:
    return F.size(by_severity(found, E)) == 0


def codes(found: Column) -> Column:
    return F.transform(found, lambda i: i["code"])


def missing_variables(required: DataFrame, values: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Required (contract, key) that aren't suppressed and have no value or a blank one."""
    asked = required.join(suppressed, ["contract", "key"], "left_anti")
    filled = values.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("contract", "key")
    return asked.join(filled, ["contract", "key"], "left_anti")


def party_counts(parties: DataFrame, schema: DataFrame) -> DataFrame:
    """(contract, party) whose count is out of the schema's range, or that the schema doesn't declare.

    parties: contract, party; schema: contract, party, least, most.
    """
    counts = parties.groupBy("contract", "party").agg(F.count("*").alias("n"))
    both = counts.join(schema, ["contract", "party"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    undeclared = F.col("least").isNull()
    return both.where(undeclared | ~F.col("n").between(F.col("least"), F.col("most"))).select("contract", "party", "n", undeclared.alias("undeclared"))


def wrong_entity_types(parties: DataFrame) -> DataFrame:
    return parties.where((F.col("expected_type") != "ANY") & (F.col("expected_type") != F.col("entity_type")))


def missing_accounts(parties: DataFrame) -> DataFrame:
    return parties.where(F.array_contains("collect", "bank_account") & F.col("account").isNull())


def repeated_customers(parties: DataFrame) -> DataFrame:
    """The second and further places of a customer in one contract."""
    seen = Window.partitionBy("contract", "customer").orderBy("ord")
    return parties.withColumn("nth", F.row_number().over(seen)).where("nth > 1")


def unique_violations(df: DataFrame, key: list[str], where: Column | None = None) -> DataFrame:
    """Keys that a partial unique index would refuse."""
    return (df.where(where) if where is not None else df).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
