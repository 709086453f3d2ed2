"""Dates of cards: ages, expiry and the validity verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_AGE_AT_ISSUE, NO_EXPIRY_AGE, EXPIRY_SOON_DAYS = 14, 60, 90
NO_EXPIRY_TEXT = "KHÔNG THỜI HẠN"


def age_in_years(born: Column, on: Column) -> Column:
    """Whole years: the difference of years, one less before the birthday."""
    early = F.struct(F.month(on), F.day(on)) < F.struct(F.month(born), F.day(born))
    return F.year(on) - F.year(born) - early.cast("int")


def parse_iso(x: Column) -> Column:
    return F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(x, "yyyy-MM-dd"))


def is_no_expiry(expiry: Column) -> Column:
    return expiry.isNull()


def is_expired(expiry: Column, today: Column) -> Column:
    return F.coalesce(expiry < today, F.lit(False))


def is_expiring_soon(expiry: Column, today: Column, within: int = EXPIRY_SOON_DAYS) -> Column:
    days = F.datediff(expiry, today)
    return F.coalesce((days >= 0) & (days < within), F.lit(False))


def should_have_no_expiry(issue: Column, born: Column) -> Column:
    return age_in_years(born, issue) >= NO_EXPIRY_AGE


def dmy(x: Column) -> Column:
    return F.date_format(x, "dd/MM/yyyy")


def remaining(today: Column, expiry: Column) -> Column:
    """Whole months left, as years and months in words."""
    months = F.greatest((F.year(expiry) - F.year(today)) * 12 + F.month(expiry) - F.month(today) - (F.day(expiry) < F.day(today)).cast("int"), F.lit(0))
    y, m = F.floor(months / 12), months % 12
    return F.concat_ws(" ", F.lit("còn"), F.when(y > 0, F.concat(y.cast("string"), F.lit(" năm"))), F.when((m > 0) | (y == 0), F.concat(m.cast("string"), F.lit(" tháng"))))


def validity(issue: Column, expiry: Column, born: Column, today: Column) -> Column:
    """status, message and whether the holder's age asks for no expiry; null if the dates don't agree."""
    status = F.when(is_no_expiry(expiry), "CARD_NO_EXPIRY").when(is_expired(expiry, today), "CARD_EXPIRED").when(is_expiring_soon(expiry, today), "CARD_EXPIRING_SOON").otherwise("CARD_VALID")
    message = (
        F.when(is_no_expiry(expiry), F.lit("Thẻ có giá trị không thời hạn."))
        .when(is_expired(expiry, today), F.concat(F.lit("CCCD đã hết hạn ngày "), dmy(expiry), F.lit(".")))
        .when(is_expiring_soon(expiry, today), F.concat(F.lit("CCCD sẽ hết hạn sau "), F.datediff(expiry, today).cast("string"), F.lit(" ngày.")))
        .otherwise(F.concat(F.lit("Thẻ còn hiệu lực đến "), dmy(expiry), F.lit(" ("), remaining(today, expiry), F.lit(").")))
    )
    return F.when(expiry.isNull() | (issue <= expiry), F.struct(status.alias("status"), message.alias("message"), should_have_no_expiry(issue, born).alias("hint")))


# --- noisy dates -------------------------------------------------------------------------------------------------

# Digits taken for one another.
CONFUSABLE = {"1": "7", "7": "1", "3": "8", "8": "3", "0": "6", "6": "0"}


def date_digits(raw: Column) -> Column:
    """ddMMyyyy of a date written with separators or without."""
    solid = F.replace(raw, F.lit(" "), F.lit(""))
    parted = r"^([0-9]{1,2})\s*[/.\-]\s*([0-9]{1,2})\s*[/.\-]\s*([0-9]{4})\z"
    part = lambda i: F.regexp_extract(raw, parted, i)
    return F.when(solid.rlike(r"^[0-9]{8}\z"), solid).when(raw.rlike(parted), F.concat(F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3)))


def _real(digits: Column) -> Column:
    """The date of ddMMyyyy, null where there is no such day or the year is out of 1900 to 2100."""
    return F.when(F.substring(digits, 5, 4).between("1900", "2100"), F.try_to_date(digits, "ddMMyyyy"))


def parse_date(raw: Column) -> Column:
    return _real(date_digits(raw))


def single_substitutions(digits: Column) -> Column:
    """The readings of ddMMyyyy with one confusable digit of day or month changed."""
    swap = F.create_map(*[F.lit(v) for kv in CONFUSABLE.items() for v in kv])
    other = lambda i: F.element_at(swap, F.substring(digits, i, F.lit(1)))
    made = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.substring(digits, F.lit(1), i - 1), other(i), F.substring(digits, i + 1, F.lit(8))))
    return F.filter(made, lambda v: v.isNotNull())


def repair_date(raw: Column) -> Column:
    """The one real date that a single substitution gives, if exactly one does: day and month are changed as numbers."""
    step = F.array(*[F.lit(int(CONFUSABLE[d]) - int(d) if d in CONFUSABLE else None).cast("int") for d in "0123456789"])

    def of(digits: Column) -> Column:
        number = lambda i, n: F.substring(digits, i, n).cast("int")
        day, month, year = number(1, 2), number(3, 2), number(5, 4)
        change = lambda i: F.get(step, number(i, 1))
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        days = F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))

        def code(d: Column, m: Column) -> Column:
            last = F.get(days, m - 1) + F.when(leap & (m == 2), 1).otherwise(0)
            return F.when((d >= 1) & (d <= last), m * 100 + d)

        made = F.array(code(day + 10 * change(1), month), code(day + change(2), month), code(day, month + 10 * change(3)), code(day, month + change(4)))
        found = F.array_distinct(F.filter(made, lambda c: c.isNotNull()))
        one = F.when(year.between(1900, 2100) & (F.size(found) == 1), F.get(found, F.lit(0)))
        return F.when(one.isNotNull(), F.make_date(year, F.floor(one / 100).cast("int"), one % 100))

    return F.get(F.transform(F.array(date_digits(raw)), of), F.lit(0))
