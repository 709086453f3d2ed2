"""Text normalisation and searching, as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Capitals of the Vietnamese alphabet, and what else a name may hold.
VN_UPPERCASE = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    "ĂÂĐÊÔƠƯ"
    "ÀÁẢÃẠẰẮẲẴẶẦẤẨẪẬ"
    "ÈÉẺẼẸỀẾỂỄỆ"
    "ÌÍỈĨỊ"
    "ÒÓỎÕỌỒỐỔỖỘỜỚỞỠỢ"
    "ÙÚỦŨỤỪỨỬỮỰ"
    "ỲÝỶỸỴ"
)
NAME_EXTRA = " -'"
# Marks that text recognition leaves behind.
ARTEFACTS = "'`’ʼ"
# Digits misread for letters between letters.
NAME_DIGITS = {"0": "O", "1": "I", "5": "S", "8": "B"}


def _unaccented() -> tuple[str, str]:
    """Letters with marks and their base letters, by decomposition, for the Latin blocks."""
    marked, plain = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            marked.append(chr(point))
            plain.append(base)
    return "".join(marked) + "Đđ", "".join(plain) + "Dd"


MARKED, PLAIN = _unaccented()


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return x.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc_upper(x: Column, composed: bool = True) -> Column:
    """Upper case of the composed text; composed says that the text is known to be in that form."""
    return F.upper(x if composed else nfc(x))


def collapse_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def is_vn_uppercase_letter(c: Column) -> Column:
    return c.rlike(f"^[{VN_UPPERCASE}]\\z")


def is_vn_name_char(c: Column) -> Column:
    return c.rlike(rf"^[{VN_UPPERCASE} \-']\z")


def strip_diacritics(x: Column) -> Column:
    """Base letters: composed ones by table, separate combining marks dropped."""
    return F.translate(F.regexp_replace(x, r"\p{Mn}+", ""), MARKED, PLAIN)


def fold(x: Column, composed: bool = True) -> Column:
    """The form in which noisy text is compared."""
    return collapse_whitespace(F.translate(strip_diacritics(nfc_upper(x, composed)), ARTEFACTS, ""))


def compact(x: Column, composed: bool = True) -> Column:
    return F.replace(fold(x, composed), F.lit(" "), F.lit(""))


def fix_ocr_digits(x: Column) -> Column:
    """Digits between two letters as the letters they stand for; a repaired one is no neighbour for the next."""
    for digit, letter in NAME_DIGITS.items():
        x = F.regexp_replace(x, rf"(?<=[\p{{L}}]){digit}(?=\p{{L}})", letter)
    return x


def word_count(x: Column) -> Column:
    return F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), r"(?U)\s+")))


# --- finding values in lines of text ---------------------------------------------------------------------------


def close_digit_gaps(x: Column) -> Column:
    """Single spaces between digits go."""
    return F.regexp_replace(x, r"(?<=[0-9]) (?=[0-9])", "")


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def find_id_number(x: Column) -> Column:
    """The first run of exactly twelve digits."""
    return _found(close_digit_gaps(x), r"(?<![0-9])([0-9]{12})(?![0-9])")


def is_a_plausible_date(day: Column, month: Column, year: Column) -> Column:
    number = lambda c: c.cast("int")
    return number(day).between(1, 31) & number(month).between(1, 12) & number(year).between(1900, 2100)


def find_date(x: Column) -> Column:
    """dd/MM/yyyy from the first separated date, or else the first isolated run of eight digits, if plausible."""
    out = []
    for pattern in (r"([0-9]{2})\s*[/.\-]\s*([0-9]{2})\s*[/.\-]\s*([0-9]{4})", r"(?<![0-9])([0-9]{2})([0-9]{2})([0-9]{4})(?![0-9])"):
        d, m, y = (_found(x, pattern, i) for i in (1, 2, 3))
        out.append(F.when(is_a_plausible_date(d, m, y), F.concat_ws("/", d, m, y)))
    return F.coalesce(*out)


def strip_label(x: Column) -> Column:
    """What follows the first colon or semicolon, unless that is nothing."""
    rest = F.regexp_replace(x, r"(?s)^.*?[:;]\s*", "")
    return F.when(rest == "", x).otherwise(rest)


def find_name(x: Column, boilerplate: Column) -> Column:
    """A line of letters in two words or more, in capitals."""
    line = F.trim(strip_label(F.trim(x)))
    return F.when(line.rlike(r"^[A-Za-zÀ-ỹ' ]{4,}\z") & (word_count(line) >= 2) & ~boilerplate, F.upper(line))


def find_place(x: Column, boilerplate: Column) -> Column:
    """A line of eight characters or more without two digits in a row."""
    line = F.trim(strip_label(F.trim(x)))
    return F.when((F.length(line) >= 8) & ~line.rlike("[0-9]{2}") & ~boilerplate, line)
