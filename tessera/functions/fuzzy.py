"""Indel similarity of strings: bit-parallel common subsequences as folds in Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import NO_EXPIRY_TEXT
from tessera.functions.text import compact, find_date


# Fixed value: the likeness to the words for no expiry that is enough.
NO_EXPIRY_LIKE = 85.0

#: Characters whose places one long holds, with room for the carry of an addition.
WORD = 62
FULL = (1 << WORD) - 1


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _places(of: Column, chars: Column) -> Column:
    """The places of a character among chars (no more than WORD), as bits."""
    return F.aggregate(F.transform(chars, lambda c, i: F.when(c == of, _bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def _fold(places: Column, n: Column) -> Column:
    """The longest common subsequence of n characters and a string, given the places of each of its characters among the n."""
    full = _bit(n) - 1

    def step(row: Column, at: Column) -> Column:
        hit = row.bitwiseAND(at)
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(full)

    return n - F.bit_count(F.aggregate(places, full, step))


def _folded_in_words(short: Column, long: Column) -> Column:
    """The same for any length: rows of several longs, with a carry from one to the next."""
    count = F.ceil(F.size(short) / F.lit(WORD)).cast("int")
    words, one = F.sequence(F.lit(0), count - 1), F.lit(FULL).cast("long")
    start = F.struct(F.array().cast("array<bigint>").alias("rows"), F.lit(0).cast("long").alias("carry"))

    def step(rows: Column, c: Column) -> Column:
        def word(done: Column, w: Column) -> Column:
            row, at = F.get(rows, w), _places(c, F.slice(short, w * WORD + 1, F.lit(WORD)))
            hit = row.bitwiseAND(at)
            return _let(F.struct((row + hit + done["carry"]).alias("sum"), (row - hit).alias("left")), lambda s: F.struct(
                F.concat(done["rows"], F.array(s["sum"].bitwiseOR(s["left"]).bitwiseAND(one))).alias("rows"), F.shiftright(s["sum"], WORD).alias("carry")
            ))

        return F.aggregate(words, start, word, lambda done: done["rows"])

    rows = F.aggregate(long, F.array_repeat(one, count), step)
    return F.aggregate(rows, F.lit(0), lambda s, row: s + WORD - F.bit_count(row))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings of any length."""

    def of(x: Column) -> Column:
        short, long = x["short"], x["long"]
        narrow = _fold(F.transform(long, lambda c: _places(c, short)), F.size(short))
        return F.when(F.size(short) == 0, 0).when(F.size(short) <= WORD, narrow).otherwise(_folded_in_words(short, long))

    lists = lambda s, t: F.struct(_chars(s).alias("short"), _chars(t).alias("long"))
    return F.when(a.isNotNull() & b.isNotNull(), _let(F.when(F.length(a) <= F.length(b), lists(a, b)).otherwise(lists(b, a)), of))


def likeness(a: Column, b: Column) -> Column:
    """200 LCS / (|a| + |b|); two empty strings are alike."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(F.lit(200.0) * common_length(a, b) / both)


def partial_likeness(a: Column, b: Column) -> Column:
    """The best likeness of the shorter one to any window of the other, windows over the ends included.

    A window is searched only if its characters that the shorter one has at all could make it the best so far.
    """

    def slid(short: Column, long: Column) -> Column:
        n, size = F.length(short), F.length(long)

        def best(places: Column) -> Column:
            def window(i: Column) -> Column:
                return F.slice(places, F.greatest(i, F.lit(0)) + 1, F.least(i + n, size) - F.greatest(i, F.lit(0)))

            def better(so_far: Column, w: Column) -> Column:
                share = lambda found: F.lit(200.0) * found / (n + F.size(w))
                return F.when(share(F.size(F.filter(w, lambda at: at != 0))) > so_far, F.greatest(so_far, share(_fold(w, n)))).otherwise(so_far)

            return F.aggregate(F.transform(F.sequence(1 - n, size - 1), window), F.lit(0.0), better)

        whole = lambda i: F.substring(long, F.greatest(i, F.lit(0)) + 1, F.least(i + n, size) - F.greatest(i, F.lit(0)))
        wide = F.array_max(F.transform(F.sequence(1 - n, size - 1), lambda i: likeness(short, whole(i))))
        return F.when(n <= WORD, _let(_let(_chars(short), lambda s: F.transform(_chars(long), lambda c: _places(c, s))), best)).otherwise(wide)

    one, two = F.length(a), F.length(b)
    found = F.when(one < two, slid(a, b)).when(one > two, slid(b, a)).otherwise(F.greatest(slid(a, b), slid(b, a)))
    return F.when((one == 0) | (two == 0), F.when(one == two, 100.0).otherwise(0.0)).when(one.isNotNull() & two.isNotNull(), found)


def token_set_likeness(a: Column, b: Column) -> Column:
    """The best likeness between the common words and each side's common words with its rest.

    The common words begin both sides, so that only the rests need a common subsequence.
    """
    words = lambda s: F.array_sort(F.array_distinct(F.filter(F.split(s, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")))
    said = lambda w: F.array_join(w, " ")

    def of(x: Column) -> Column:
        both, left, right = x["both"], x["left"], x["right"]
        head = F.when(both == "", 0).otherwise(F.length(both) + 1)
        one, two = head + F.length(left), head + F.length(right)
        with_rest = lambda n: F.lit(200.0) * F.length(both) / (F.length(both) + n)
        sides = F.lit(200.0) * (head + common_length(left, right)) / (one + two)
        return F.when((both != "") & ((left == "") | (right == "")), 100.0).when(both == "", sides).otherwise(F.greatest(sides, with_rest(one), with_rest(two)))

    split = lambda w: F.struct(said(F.array_intersect(w["x"], w["y"])).alias("both"), said(F.array_except(w["x"], w["y"])).alias("left"), said(F.array_except(w["y"], w["x"])).alias("right"))
    return _let(F.struct(words(a).alias("x"), words(b).alias("y")), lambda w: F.when((F.size(w["x"]) == 0) | (F.size(w["y"]) == 0), 0.0).otherwise(_let(split(w), of)))


def _anchored(text: Column, anchor: Column) -> Column:
    coverage = F.least(F.lit(1.0), F.length(text) / F.length(anchor))
    return F.when((text == "") | (anchor == ""), 0.0).otherwise(partial_likeness(anchor, text) * coverage)


def similarity(text: Column, anchor: Column) -> Column:
    """0 to 100: the partial likeness of compact forms, less where the text is shorter than the anchor."""
    return _let(F.struct(compact(text).alias("t"), compact(anchor).alias("a")), lambda x: _anchored(x["t"], x["a"]))


def find_expiry(text: Column) -> Column:
    """A date, or the words that a card without an expiry has instead, as they should read: from NO_EXPIRY_LIKE on a line is taken for them."""
    phrase = F.lit(NO_EXPIRY_TEXT)
    return F.coalesce(find_date(text), F.when(similarity(text, phrase) >= NO_EXPIRY_LIKE, phrase))


def best_match(lines: DataFrame, column: str, anchors: list[str]) -> DataFrame:
    """Distinct lines with the anchor most like them (the first of equals; null where nothing is) and its score.

    anchors is a closed vocabulary given in the call, so it is bounded; it multiplies only distinct lines.
    """
    some = F.posexplode(F.array(*[F.struct(F.lit(a).alias("anchor"), compact(F.lit(a)).alias("a")) for a in anchors]))
    scored = lines.select(column).distinct().withColumn("t", compact(F.col(column))).select(column, "t", some.alias("ord", "s"))
    scored = scored.select(column, "ord", "s.anchor", _anchored(F.col("t"), F.col("s.a")).alias("score"))
    best = F.max_by(F.struct("anchor", "score"), F.struct("score", -F.col("ord")))
    picked = scored.groupBy(column).agg(best.alias("b"))
    return picked.select(column, F.when(F.col("b.score") > 0, F.col("b.anchor")).alias("anchor"), F.greatest("b.score", F.lit(0.0)).alias("score"))


def matches_any(lines: DataFrame, column: str, anchors: list[str], threshold: float) -> DataFrame:
    return best_match(lines, column, anchors).withColumn("matches", F.col("score") >= threshold)


# Phrases printed on every card.
BOILERPLATE = [
    "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM",
    "SOCIALIST REPUBLIC OF VIET NAM",
    "Độc lập - Tự do - Hạnh phúc",
    "Independence - Freedom - Happiness",
    "Quốc tịch",
    "Nationality",
    "Việt Nam",
    "Full name",
    "Date of birth",
    "Date of expiry",
    "CĂN CƯỚC CÔNG DÂN",
    "Citizen Identity Card",
    "Đặc điểm nhân dạng",
    "Personal identification",
    "Nơi thường trú",
    "Place of residence",
    "Quê quán",
    "Place of origin",
    "CĂN CƯỚC",
    "IDENTITY CARD",
    "Số định danh cá nhân",
    "Họ, chữ đệm và tên khai sinh",
    "Nơi cư trú",
    "Nơi đăng ký khai sinh",
    "Place of birth",
    "Ngày, tháng, năm hết hạn",
    "Date of issue",
]
BOILERPLATE_THRESHOLD = 85.0


def is_printed_boilerplate(lines: DataFrame, column: str) -> DataFrame:
    return matches_any(lines, column, BOILERPLATE, BOILERPLATE_THRESHOLD)


# The same of two strings at hand.


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    """200 LCS / (|a| + |b|); two empty strings are alike."""
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


@lru_cache(maxsize=1 << 16)
def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter one to any window of the other, windows over the ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    best = max(ratio(short, w) for w in windows)
    if len(a) == len(b):  # either may be the shorter
        best = max(best, max(ratio(long, short[max(0, i) : i + n]) for i in range(1 - n, len(short))))
    return best


@lru_cache(maxsize=1 << 16)
def token_set_ratio(a: str, b: str) -> float:
    """The best ratio between the common words and each side's common words with its rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [ratio(one, two)]
    if both:
        found += [ratio(both, one), ratio(both, two)]
    return max(found)
