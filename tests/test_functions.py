"""Functions against hand-computed values."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dates, decode, domains, formatting, fuzzy, privacy, text


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_text(spark):
    got = values(
        spark, text.strip_diacritics(lit("Đỗ Bộ Việt")), text.fold(lit("  Đỗ'  bộ ")), text.fix_ocr_digits(lit("H0ANG 80B A00B")), text.collapse_whitespace(lit(" a  b\n")),
        text.find_id_number(lit("No 0011 9901 2345 x")), text.find_date(lit("cấp 01 / 02 / 2020")), text.find_date(lit("x 31122020 y")), text.find_date(lit("99/99/2020")), text.strip_label(lit("Name: A B")), text.strip_label(lit("Name:")),
        text.compact(lit("a b c")), text.word_count(lit("  a b  ")), text.nfc_upper(lit("é"), composed=False),
    )
    assert got == ("Do Bo Viet", "DO BO", "HOANG 80B A00B", "a b", "001199012345", "01/02/2020", "31/12/2020", None, "A B", "Name:", "ABC", 2, "É")


def test_names_and_places(spark):
    no = F.lit(False)
    assert values(spark, text.find_name(lit("Họ tên: Nguyen Van An"), no), text.find_name(lit("An"), no), text.find_place(lit("Nơi: Phường 1, Hà Nội"), no), text.find_place(lit("12 Hà Nội xx"), no)) == ("NGUYEN VAN AN", None, "Phường 1, Hà Nội", None)


def test_domains(spark):
    got = values(
        spark, domains.phone(lit("+84 912.345.678")), domains.phone(lit("0112345678")), domains.carrier(lit("0912345678")), domains.securities_account(lit("123456")), domains.securities_account(lit("008c-123456")), domains.securities_account(lit("009C123456")),
        domains.email(lit(" A@Gmail.co ")), domains.typo_suggestion(lit("a@gmail.co")), domains.email(lit("a..b@x.org")), domains.citizen_id(lit("OO1199012345"), ocr=True), domains.citizen_id(lit("123")), domains.person_name(lit("h0ang an"), ocr=True),
        domains.person_name(lit("H0")), domains.issue_place(lit("bộ  công an")), domains.as_percent(F.lit(0.125)), domains.inferred_gender(lit("001199012345")), domains.bank_account(lit("12-34")), domains.bank_account(lit("12-3456")), domains.clamp(F.lit(-2.0)),
    )
    assert got == ("0912345678", None, "Vinaphone", "008C123456", "008C123456", None, "a@gmail.co", "a@gmail.com", None, "001199012345", None, "HOANG AN", None, "BỘ CÔNG AN", 12, "FEMALE", None, "123456", 0.0)


def test_dates(spark):
    d = datetime.date
    got = values(
        spark, dates.parse_date(lit("29/02/2024")), dates.parse_date(lit("29022024")), dates.parse_date(lit("1-2-1990")), dates.parse_date(lit("29/02/2023")), dates.repair_date(lit("29/02/2023")), dates.repair_date(lit("71/01/1990")), dates.repair_date(lit("01/00/1990")), dates.repair_date(lit("00/00/1990")),
        dates.age_in_years(F.lit(d(2000, 2, 29)), F.lit(d(2023, 2, 28))), dates.remaining(F.lit(d(2024, 1, 15)), F.lit(d(2025, 3, 14))), dates.validity(F.lit(d(2020, 1, 1)), F.lit(d(2024, 1, 30)), F.lit(d(1950, 1, 1)), F.lit(d(2024, 1, 1)))["status"],
    )
    assert got == (d(2024, 2, 29), d(2024, 2, 29), d(1990, 2, 1), None, None, d(1990, 1, 11), d(1990, 6, 1), None, 22, "còn 1 năm 1 tháng", "CARD_EXPIRING_SOON")


BLOCK = "IDVNM1234567897001199012345<<7\n9905142F3106017VNM<<<<<<<<<<<2\nNGUYEN<<VAN<AN<<<<<<<<<<<<<<<<"


def parsed(spark, block):
    return decode.parse_td1(spark.createDataFrame([(1, block)], "k int, raw string"), "raw", ["k"]).first()


def test_td1_clean(spark):
    r = parsed(spark, BLOCK)
    assert (r.document_number, r.citizen_id, r.birth, r.sex, r.expiry, r.surname, r.given_names) == ("123456789", "001199012345", "990514", "F", "310601", "NGUYEN", "VAN AN")
    assert (r.checksum_valid, r.composite_valid, r.corrections, r.confidence) == (True, True, 0, 0.98)


def test_td1_noise_and_repair(spark):
    assert parsed(spark, "noise\n" + BLOCK.replace("0119", "O119")).citizen_id == "001199012345"
    r = parsed(spark, BLOCK.replace("1234567897", "1234567397"))
    assert r.checksum_valid and r.corrections >= 1 and r.confidence == 0.90


def test_payload(spark):
    good = "001199012345||An|05021990|Nam|HN|01012020"
    assert values(spark, decode.payload_fields(lit(good))["issue"], decode.payload_fields(lit(good + "|x"))["issue"], decode.payload_fields(lit("1|2"))["issue"]) == ("01012020", None, None)


def test_formatting(spark):
    got = values(
        spark, formatting.format_currency(F.lit(1500000)), formatting.format_currency_text(F.lit(0)), formatting.format_currency_text(F.lit(105)), formatting.format_currency_text(F.lit(-21)), formatting.format_currency_text(F.lit(1000015)), formatting.format_decimal(F.lit(0.125)), formatting.format_percent(F.lit(5.0)),
        formatting.contract_number("A-{yyyy}{MM}-{seq:05d}", F.lit(datetime.date(2026, 8, 1)), F.lit(42)), formatting.contract_number("{seq:02d}", F.lit(datetime.date(2026, 8, 1)), F.lit(12345)), formatting.contract_number("{x}", F.lit(datetime.date(2026, 8, 1)), F.lit(1)), formatting.group_of_four(lit("123456789")), formatting.export_name("CON", {}),
    )
    assert got == ("1.500.000", "Không đồng", "Một trăm linh năm đồng", "Âm hai mươi mốt đồng", "Một triệu không trăm mười lăm đồng", "0,12", "5%", "A-202608-00042", "12345", None, "1234 5678 9", "_CON")


def test_masks(spark):
    got = values(
        spark, privacy.mask_keep_suffix(lit("001199012345")), privacy.mask_keep_suffix(lit("123")), privacy.redact_text(lit("id 001199012345 tel 0912345678 tk 008C123456 mail ab@cd.org")), privacy.mask_full_name(lit("Nguyen An B")), privacy.mask_address(lit("1 phố, Hà Nội")), privacy.mask_address(lit("x")),
        privacy.redact_for_key(lit("api_key"), lit("v")), privacy.redact_for_key(lit("full_name"), lit("An")), privacy.redact_for_key(lit("qr_raw"), lit("v")),
    )
    assert got == ("••••••••2345", "•••", "id ••••••••2345 tel •••••••678 tk 008C•••456 mail a***@c***.org", "Ng* An B".replace("Ng*", "N**").replace("An", "A*"), "[địa chỉ] Hà Nội", "[REDACTED:address]", "[REDACTED]", "A*", "[REDACTED:qr_raw]")


def test_keyed_hash_and_cipher(spark):
    import hashlib
    import hmac

    want = hmac.new(b"pepper", b"phone\0" + b"0912345678", hashlib.sha256).digest()[:16]
    key, aad = F.lit(b"k" * 32), F.lit("a/b/c")
    sealed = privacy.encrypt(F.lit(b"secret"), key, F.lit(b"n" * 12), aad)
    got = values(spark, privacy.blind_index(lit("0912345678"), "phone", b"pepper"), privacy.decrypt(sealed, key, aad), privacy.decrypt(sealed, key, F.lit("other")))
    assert (bytes(got[0]), bytes(got[1]), got[2]) == (want, b"secret", None)


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 100.0), ("abc", "abd", 200 * 2 / 6), ("", "", 100.0), ("a", "", 0.0)])
def test_ratio(a, b, want):
    assert fuzzy.ratio(a, b) == pytest.approx(want)


def test_partial_and_token_set():
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100.0
    assert fuzzy.token_set_ratio("a b c", "a b") == 100.0
    assert fuzzy.token_set_ratio("a", "b") == 0.0


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy.common_subsequence(a, b) == table[-1][-1]
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)


def test_boilerplate(spark):
    lines = spark.createDataFrame([("Date of birth",), ("date  of b1rth / x",), ("something else",)], "line string")
    got = {r.line: r.matches for r in fuzzy.is_printed_boilerplate(lines, "line").collect()}
    assert got["Date of birth"] and not got["something else"]
