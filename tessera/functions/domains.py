"""Self-validating scalars: each has a normal form and a test for it; values out of the domain read as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import VN_UPPERCASE, collapse_whitespace, fix_ocr_digits, nfc_upper

# Letters misread for digits; phone prefixes by carrier; mistyped mail domains; places of issue.
ID_LETTERS = {"O": "0", "I": "1", "L": "1", "S": "5", "B": "8", "Z": "2", "G": "6", "D": "0"}
CARRIERS = {
    "Viettel": ("032", "033", "034", "035", "036", "037", "038", "039", "086", "096", "097", "098"),
    "Vinaphone": ("081", "082", "083", "084", "085", "088", "091", "094"),
    "Mobifone": ("070", "076", "077", "078", "079", "089", "090", "093"),
    "Vietnamobile": ("052", "056", "058", "092"),
    "Gmobile": ("059", "099"),
    "Itelecom": ("087",),
}
TYPO_DOMAINS = {"gmai.com": "gmail.com", "gmial.com": "gmail.com", "gmail.co": "gmail.com", "yaho.com": "yahoo.com", "hotmial.com": "hotmail.com", "outlok.com": "outlook.com"}
BO_CONG_AN = "BỘ CÔNG AN"
CUC_CANH_SAT = "CỤC CẢNH SÁT QUẢN LÝ HÀNH CHÍNH VỀ TRẬT TỰ XÃ HỘI"
MEMBER_CODE = "008"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def _valid(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(rf"^(?:{pattern})\z"), value)


def person_name(raw: Column, ocr: bool = False) -> Column:
    """2 to 100 letters of the alphabet, spaces, hyphens and apostrophes; ocr repairs misread digits first."""
    value = collapse_whitespace(nfc_upper(F.coalesce(raw, F.lit(""))))
    return _valid(fix_ocr_digits(value) if ocr else value, rf"[{VN_UPPERCASE} \-']{{2,100}}")


def citizen_id(raw: Column, ocr: bool = False) -> Column:
    """Exactly twelve digits; ocr reads lookalike letters as digits first."""
    if ocr:
        raw = F.translate(F.upper(raw), "".join(ID_LETTERS), "".join(ID_LETTERS.values()))
    return _valid(digits(raw), "[0-9]{12}")


def province_code(x: Column) -> Column:
    return F.substring(x, 1, 3)


def gender_century_digit(x: Column) -> Column:
    return F.substring(x, 4, 1)


def birth_year_suffix(x: Column) -> Column:
    return F.substring(x, 5, 2)


def sequence(x: Column) -> Column:
    return F.substring(x, 7, 6)


def inferred_gender(x: Column) -> Column:
    d = gender_century_digit(x)
    return F.when(d.isin("0", "2", "4"), "MALE").when(d.isin("1", "3", "5"), "FEMALE")


def inferred_birth_years(x: Column) -> Column:
    """The first and last year of the century that the fourth digit stands for."""
    d = gender_century_digit(x).cast("int")
    first = F.lit(1900) + 100 * F.floor(d / 2).cast("int")
    return F.when(d.between(0, 5), F.struct(first.alias("lo"), (first + 99).alias("hi")))


def phone(raw: Column) -> Column:
    """A mobile number of ten digits, from any spacing and with the country code or without."""
    value = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\s.\-()]", ""), r"^\+?84", "0")
    return _valid(value, "0(?:3[2-9]|5[2689]|7[06-9]|8[1-9]|9[0-9])[0-9]{7}")


def carrier(x: Column) -> Column:
    return F.element_at(_map({p: name for name, prefixes in CARRIERS.items() for p in prefixes}), F.substring(x, 1, 3))


def email(raw: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    label = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    good = _valid(value, rf"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@{label}(?:\.{label})*\.[A-Za-z]{{2,63}}")
    return F.when(~F.contains(value, F.lit("..")) & (F.length(F.substring_index(value, "@", 1)) <= 64) & (F.length(value) <= 254), good)


def email_domain(x: Column) -> Column:
    return F.substring_index(x, "@", -1)


def typo_suggestion(x: Column) -> Column:
    better = F.element_at(_map(TYPO_DOMAINS), email_domain(x))
    return F.when(better.isNotNull(), F.concat(F.substring_index(x, "@", 1), F.lit("@"), better))


def bank_account(raw: Column) -> Column:
    return _valid(digits(raw), "[0-9]{6,20}")


def matches_bank_length(x: Column, least: Column, most: Column) -> Column:
    return F.length(x).between(least, most)


def securities_account(raw: Column, member: str = MEMBER_CODE, strict: bool = True) -> Column:
    value = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\s\-]", ""))
    value = F.when(value.rlike(r"^[0-9]{6}\z"), F.concat(F.lit(member + "C"), value)).otherwise(value)
    return _valid(value, (member if strict else "[0-9]{3}") + "C[0-9]{6}")


def member_code(x: Column) -> Column:
    return F.substring(x, 1, 3)


def customer_code(x: Column) -> Column:
    return F.substring(x, 5, 6)


def securities_display(x: Column) -> Column:
    return F.concat_ws(" ", F.substring(x, 1, 4), F.substring(x, 5, 6))


def issue_place(raw: Column) -> Column:
    value = collapse_whitespace(nfc_upper(F.coalesce(raw, F.lit(""))))
    return F.when(value.isin(BO_CONG_AN, CUC_CANH_SAT), value)


def clamp(x: Column) -> Column:
    """A confidence within 0 and 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def below(x: Column, threshold: float) -> Column:
    return x < threshold


def as_percent(x: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.bround(x * 100).cast("int")
