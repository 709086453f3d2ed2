"""Masks, keyed hashes and authenticated encryption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

DOT, STAR = "•", "*"
# Parts of key names that say how a value is masked, in order of precedence.
RAW_KEYS = ("qr_raw", "qr_payload", "mrz_raw", "mrz_text", "raw_engine_output", "raw_payload")
SECRET_KEYS = ("password", "token", "secret", "passphrase", "apikey", "api_key", "kek", "dek", "key")
# Provinces, in the order in which they are looked for.
PROVINCES = (
    "Hà Nội", "Hà Giang", "Cao Bằng", "Bắc Kạn", "Tuyên Quang", "Lào Cai", "Điện Biên",
    "Lai Châu", "Sơn La", "Yên Bái", "Hòa Bình", "Thái Nguyên", "Lạng Sơn", "Quảng Ninh",
    "Bắc Giang", "Phú Thọ", "Vĩnh Phúc", "Bắc Ninh", "Hải Dương", "Hải Phòng", "Hưng Yên",
    "Thái Bình", "Hà Nam", "Nam Định", "Ninh Bình", "Thanh Hóa", "Nghệ An", "Hà Tĩnh",
    "Quảng Bình", "Quảng Trị", "Thừa Thiên Huế", "Đà Nẵng", "Quảng Nam", "Quảng Ngãi",
    "Bình Định", "Phú Yên", "Khánh Hòa", "Ninh Thuận", "Bình Thuận", "Kon Tum", "Gia Lai",
    "Đắk Lắk", "Đắk Nông", "Lâm Đồng", "Bình Phước", "Tây Ninh", "Bình Dương", "Đồng Nai",
    "Bà Rịa - Vũng Tàu", "TP. Hồ Chí Minh", "Long An", "Tiền Giang", "Bến Tre", "Trà Vinh",
    "Vĩnh Long", "Đồng Tháp", "An Giang", "Kiên Giang", "Cần Thơ", "Hậu Giang", "Sóc Trăng",
    "Bạc Liêu", "Cà Mau",
)
_EDGE = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")


def mask_keep_suffix(x: Column, visible: int = 4) -> Column:
    """Dots but for the last characters; a value no longer than those is all dots."""
    n = F.length(x)
    return F.when(n <= visible, F.repeat(F.lit(DOT), n)).otherwise(F.concat(F.repeat(F.lit(DOT), n - visible), F.right(x, F.lit(visible))))


def _masked_runs(x: Column, length: str, keep: int, lead: str = "") -> Column:
    """Runs of digits of the given lengths between word edges: each digit with at least keep others after it is a dot.

    A match is the first digit of a run, or the digit where the last match ended.
    """
    opens = rf"(?={lead}[0-9]{{{length}}}{_EDGE[1]}){_EDGE[0]}"
    return F.regexp_replace(x, rf"(?:{opens}|(?!^)\G)[0-9](?=[0-9]{{{keep}}})", DOT)


def mask_securities(x: Column) -> Column:
    return F.regexp_replace(x, rf"{_EDGE[0]}([0-9]{{3}}C)[0-9]{{3}}([0-9]{{3}}){_EDGE[1]}", f"$1{DOT * 3}$2")


def mask_email(x: Column) -> Column:
    return F.regexp_replace(x, rf"{_EDGE[0]}([\p{{L}}\p{{N}}_])[\p{{L}}\p{{N}}_.%+-]*@([\p{{L}}\p{{N}}_-])[\p{{L}}\p{{N}}_-]*((?:\.[\p{{L}}\p{{N}}_-]+)*\.[\p{{L}}\p{{N}}_]+){_EDGE[1]}", "$1***@$2***$3")


def redact_text(x: Column) -> Column:
    """Ids, phones, securities accounts, other long numbers and mail addresses, in this order."""
    long = _masked_runs(_masked_runs(x, "12", 4), "9", 3, lead="0")
    return mask_email(F.when(x.rlike("[0-9]{6}"), _masked_runs(mask_securities(long), "9,20", 4)).otherwise(x))


def mask_full_name(x: Column) -> Column:
    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.repeat(F.lit(STAR), F.least(F.length(w) - 1, F.lit(2))))), " ")


def mask_address(x: Column) -> Column:
    """The first listed province that the address has, or nothing of it."""
    found = F.filter(F.array(*map(F.lit, PROVINCES)), lambda p: F.contains(x, p))
    return F.when(F.size(found) > 0, F.concat(F.lit("[địa chỉ] "), F.get(found, F.lit(0)))).otherwise("[REDACTED:address]")


def redact_for_key(key: Column, x: Column) -> Column:
    """A value masked as its key's name asks: raw payloads, secrets, addresses, names, else as text; null stays."""
    low = F.lower(key)
    some = lambda parts: low.rlike("|".join(parts))
    said = F.when(some(RAW_KEYS), F.concat(F.lit("[REDACTED:"), key, F.lit("]"))).when(some(SECRET_KEYS), "[REDACTED]").when(some(("address",)), mask_address(x)).when(some(("name",)), mask_full_name(x)).otherwise(redact_text(x))
    return F.when(x.isNotNull(), said)


def redact_map(x: Column) -> Column:
    return F.transform_values(x, redact_for_key)


def redact(x: Column, kind: DataType, key: Column | None = None) -> Column:
    """A context of any depth with its texts masked, each as the nearest name above it asks.

    Names are those of a struct's fields and a map's keys; the elements of an array go by the array's. Values that are no texts, and nulls, stay.
    """
    if isinstance(kind, StructType):
        said = F.struct(*[redact(x[f.name], f.dataType, F.lit(f.name)).alias(f.name) for f in kind.fields])
        return F.when(x.isNotNull(), said)
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda k, v: redact(v, kind.valueType, k))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda v: redact(v, kind.elementType, key))
    return redact_for_key(key, x) if isinstance(kind, StringType) and key is not None else x


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of binary, from two rounds of the hash."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.lit(bytes(k ^ b for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))


def blind_index(value: Column, field: str, pepper: bytes) -> Column:
    """The first 16 bytes of the keyed hash of field, a zero byte and value."""
    message = F.concat(F.lit(field.encode() + b"\0"), F.encode(value, "UTF-8"))
    return F.substring(hmac_sha256(message, pepper), 1, 16)


def encrypt(x: Column, key: Column, nonce: Column, aad: Column) -> Column:
    """A version byte, the nonce, and AES-GCM of x bound to where it is stored. nonce: 12 bytes, never used twice with a key."""
    return F.concat(F.lit(b"\x01"), F.aes_encrypt(x, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad))


def decrypt(x: Column, key: Column, aad: Column) -> Column:
    """The plain text, null where version, key or place don't fit."""
    body = F.substring(x, F.lit(2), F.length(x))
    return F.when(F.substring(x, 1, 1) == F.lit(b"\x01"), F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), aad))
