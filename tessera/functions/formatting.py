"""Values as text: dates, numbers, money in figures and words, number patterns and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType

from tessera.functions.text import collapse_whitespace, strip_diacritics

# Words of numbers and scales; names and characters that a file name can't have.
UNITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")
SCALES = ("", " nghìn", " triệu", " tỷ")
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'
NAME_LENGTH = 180


def format_date(x: Column) -> Column:
    return F.date_format(x, "dd/MM/yyyy")


def format_date_text(x: Column) -> Column:
    return F.concat(F.lit("ngày "), F.date_format(x, "dd"), F.lit(" tháng "), F.date_format(x, "MM"), F.lit(" năm "), F.date_format(x, "yyyy"))


def group_thousands(x: Column) -> Column:
    return F.translate(F.format_number(x, 0), ",", ".")


def format_currency(x: Column) -> Column:
    return group_thousands(x.cast("long"))


def format_number(x: Column) -> Column:
    return x.cast("long").cast("string")


def format_decimal(x: Column) -> Column:
    """Two places and a comma; of a double, its exact binary value is rounded, halves to even."""
    return F.replace(F.bround(x.cast("decimal(38,18)"), 2).cast("decimal(38,2)").cast("string"), F.lit("."), F.lit(","))


def format_percent(x: Column) -> Column:
    return F.concat(F.regexp_replace(format_decimal(x), r",00\z", ""), F.lit("%"))


def format_boolean(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), "Có").otherwise("Không")


def _group_words(n: int, full: bool) -> str:
    hundreds, tens, units = n // 100, n // 10 % 10, n % 10
    said = [f"{UNITS[hundreds]} trăm"] if hundreds or full else []
    if tens:
        said.append("mười" if tens == 1 else f"{UNITS[tens]} mươi")
    elif units and said:
        said.append("linh")
    special = {5: "lăm"} if tens == 1 else {1: "mốt", 4: "tư", 5: "lăm"} if tens else {}
    return " ".join([*said, special.get(units, UNITS[units])] if units else said)


def spell_group(group: Column, full: Column) -> Column:
    """0 to 999 in words; full says the hundreds even where there are none. Read from a table of all groups."""
    table = lambda f: F.split(F.lit("|".join(_group_words(n, f) for n in range(1000))), "[|]")
    at = group.cast("int")
    return F.when(full, F.get(table(True), at)).otherwise(F.get(table(False), at))


def spell_number(x: Column) -> Column:
    """A positive long in words, by groups of a thousand; scales repeat after four."""
    x = x.cast("long")
    group = lambda i: F.call_function("mod", F.call_function("div", x, F.lit(1000**i)), F.lit(1000))
    more = lambda i: x >= F.lit(1000 ** (i + 1)) if i < 6 else F.lit(False)
    parts = [F.when(group(i) > 0, F.concat(spell_group(group(i), more(i)), F.lit(SCALES[i % 4]))) for i in reversed(range(7))]
    return F.concat_ws(" ", *parts)


def format_currency_text(x: Column) -> Column:
    n = x.cast("long")
    words = spell_number(F.abs(n))
    capital = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))
    return F.when(n == 0, "Không đồng").when(n < 0, F.concat(F.lit("Âm "), words, F.lit(" đồng"))).otherwise(F.concat(capital, F.lit(" đồng")))


def format_value(kind: str, x: Column) -> Column:
    """Text of a value by kind; null and blank are empty, but a null boolean is no."""
    known = {"date": format_date, "date_text": format_date_text, "number": format_number, "decimal": format_decimal, "currency": format_currency, "currency_text": format_currency_text, "percent": format_percent}
    if kind == "boolean":
        return format_boolean(x)
    return F.coalesce(F.trim(known.get(kind, lambda c: c.cast("string"))(x)), F.lit(""))


def group_of_four(x: Column) -> Column:
    return F.regexp_replace(x, "(.{4})(?=.)", "$1 ")


def contract_number(pattern: str, on: Column, seq: Column) -> Column:
    """{yyyy}, {MM} and {seq:0Nd} filled; longer numbers aren't cut; null where a token is left or a number is negative."""
    import re

    out: list[Column] = []
    at, known = 0, True
    for m in re.finditer(r"\{yyyy\}|\{MM\}|\{seq:0(\d+)d\}|\{[^}]*\}", pattern):
        out.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m[0] == "{yyyy}":
            out.append(F.date_format(on, "yyyy"))
        elif m[0] == "{MM}":
            out.append(F.date_format(on, "MM"))
        elif m[1]:
            text = seq.cast("string")
            out.append(F.lpad(text, F.greatest(F.length(text), F.lit(int(m[1]))), F.lit("0")))
        else:
            known = False
    out.append(F.lit(pattern[at:]))
    return F.when((seq >= 0) & F.lit(known and bool(pattern)), F.concat(*out))


def export_name(pattern: str, values: dict[str, Column], plain: bool = False, default: str = "hop-dong") -> Column:
    """A file name: tokens filled, forbidden characters and trailing dots gone, reserved names marked, 180 long at most."""
    x = F.lit(pattern)
    for key, value in values.items():
        x = F.replace(x, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    x = collapse_whitespace(F.regexp_replace(F.regexp_replace(x, r"\{[^}]*\}", ""), FORBIDDEN, ""))
    x = F.regexp_replace(strip_diacritics(x) if plain else x, r"[. ]+\z", "")
    x = F.when(x == "", F.lit(default)).otherwise(x)
    x = F.when(F.upper(F.substring_index(x, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), x)).otherwise(x)
    return F.regexp_replace(F.substring(x, 1, NAME_LENGTH), r"[. ]+\z", "")


def disambiguated(name: Column, nth: Column) -> Column:
    """The nth of equal names carries its number from the second on."""
    return F.when(nth > 1, F.concat(name, F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(name)


def _json_text(x: Column) -> Column:
    """A text as JSON: quotes, backslashes and control characters escaped, all else as it is."""
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    escaped = plain
    for c in range(32):
        escaped = F.replace(escaped, F.lit(chr(c)), F.lit(named.get(c, f"\\u{c:04x}")))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def _json_double(x: Column) -> Column:
    """A double as its shortest decimal: an exponent under -4 or from 16 on is written, others aren't. The smallest subnormals have a digit more than they need."""
    said = x.cast("string")
    digits, power = F.regexp_replace(F.regexp_extract(said, r"^-?([0-9.]+)E", 1), r"\.(?:0\z)?", ""), F.regexp_extract(said, r"E(-?\d+)\z", 1).try_cast("int")
    sign = F.when(F.startswith(said, F.lit("-")), "-").otherwise("")
    whole = F.rpad(digits, F.greatest(power + 1, F.length(digits)), F.lit("0"))
    rest = F.substring(whole, power + 2, F.length(whole))
    large = F.concat(F.substring(whole, F.lit(1), power + 1), F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise("")
    exponent = F.concat(F.substring(digits, 1, 1), fraction, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    scaled = F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(exponent)
    return F.when(power.isNull(), said).otherwise(F.concat(sign, scaled))


def canonical_json(x: Column, kind: DataType) -> Column:
    """A value of any depth as JSON in one form only: keys in order, nulls kept, `, ` and `: ` between, texts unescaped where they can be.

    kind is the value's type: texts, whole and floating numbers, booleans, and arrays, structs and maps of them; others are refused when the plan is made.
    """
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        members = [F.concat(_json_text(F.lit(f.name)), F.lit(": "), canonical_json(x[f.name], f.dataType)) for f in fields]
        said = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    elif isinstance(kind, ArrayType):
        said = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: canonical_json(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat(_json_text(k), F.lit(": "), canonical_json(x[k], kind.valueType)))
        said = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    elif isinstance(kind, StringType):
        said = _json_text(x)
    elif isinstance(kind, FloatType | DoubleType):
        said = _json_double(x.cast("double"))
    elif isinstance(kind, BooleanType | IntegralType | NullType):
        said = x.cast("string")
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.when(x.isNotNull(), said).otherwise("null")


def digest(x: Column, kind: DataType) -> Column:
    """The SHA-256 of a value's canonical form, in hexadecimal digits."""
    return F.sha2(canonical_json(x, kind), 256)
