"""Surrogates for personal data, in DataFrame functions alone.

Entities are found by one expression: e-mail addresses, phone numbers, network addresses, card and account numbers,
social security numbers, keys and passwords, and names after an honorific or with a known given name. Each is
replaced by a surrogate of its type and format: letters by letters, digits by digits, separators, case, script and
length kept; cards keep their check digit's validity, network addresses stay addresses, and given names are drawn
from those of their gender and script.

A surrogate is a keyed permutation g'(s(g(x))) of the entity's canonical form, where g is a Feistel network over the
character classes, g' its inverse and s moves every character by one. Being a permutation it keeps distinct entities
distinct and the same entity the same wherever it occurs, with no table of entities to share; moving every character
between g and g' means that no entity is its own surrogate. Where strings of one format are dealt to two permutations
(listed given names and other names, hexadecimal secrets and others), the second is walked on until it leaves the
first one's strings, so that their images never meet. collisions() checks that over a corpus, and the query over each
document. The words of a name are looked for in the rest of its document, also in capitals, and get the same surrogates.

Defined cases: null texts stay null and have no entity; empty and clean texts are unchanged; repeated rows and
repeated entities get equal surrogates; overlapping entities go to the leftmost, then to the earlier kind in KINDS;
an empty table gives an empty result; other columns are kept, whatever their names; texts are read whole, however long.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, wrapped

#: The session's setting that holds the key, and the key of runs that set none, which is public and hides nothing.
KEY_SETTING, EXAMPLE_KEY = "spark.tessera.pii.key", "example"

# Honorifics and given names by gender and script.
HONORIFICS = {
    "m": ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Госпожа", "Г-жа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Paul", "Steven", "Andrew", "George", "Peter", "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "Luis", "Carlos", "José", "Juan"],
    ("f", "latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Margaret", "Sandra", "Ashley", "Emily", "Anna", "Alice", "Greta", "Ursula", "Monika", "Marie", "Sophie", "Camille", "María", "Carmen", "Lucía", "Elena"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Алексей", "Николай", "Михаил"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
}

_TITLES = "|".join(t.replace("-", r"\-") for ts in HONORIFICS.values() for t in sorted(ts, key=len, reverse=True))
_NAMES = "|".join(n for ns in GIVEN.values() for n in ns)
_SURNAME = r"\p{Lu}\p{Ll}++(?:[-'’]\p{Lu}\p{Ll}++)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key)\s{0,2}[=:]\s{0,2}[\"']?"

#: Kinds of entities, with their expressions, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}+",
    "secret": rf"(?<!\w){_SECRET}[A-Za-z0-9+/_\-]{{8,}}+",
    "key": r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\- ]\d{3}[.\- ]\d{4})(?!\w)",
    "card": r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w)",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? {_SURNAME}(?: {_SURNAME}){{0,2}}|(?:{_NAMES}) {_SURNAME})",
}
ENTITY = "|".join(f"(?:{x})" for x in KINDS.values())
#: Found in every text that ENTITY is found in, and cheaper to look for; each kind has to imply one of its branches.
MAY_HAVE = rf"[@0-9]|{_SECRET}|AKIA|ASIA|(?:^|[^\p{{L}}])(?:{_TITLES}|{_NAMES})\.? "

DIGITS, HEX = ("0123456789",), ("0123456789abcdef",)
PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SPOKEN = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчш", "αεηιουω", "βγδζθκλμνξπρστφχψ")


def _other_letters() -> tuple[str, ...]:
    """The lower-case letters that SPOKEN doesn't list and that have one capital each, a class a script: no name may keep its letters."""
    scripts: dict[str, str] = {}
    for c in map(chr, range(0x80, 0x2E00)):
        if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c and c.upper() != c and not any(c in letters for letters in SPOKEN):
            script = unicodedata.name(c).split()[0]
            scripts[script] = scripts.get(script, "") + c
    return tuple(letters for letters in scripts.values() if len(letters) > 1)


SPOKEN = (*SPOKEN, *_other_letters())
HALF_ROUNDS = 4
#: Steps in which a walk leaves any run of hexadecimal strings of eight characters or more.
WALK = 100


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, EXAMPLE_KEY)


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _join(x: Column) -> Column:
    return F.array_join(x, "")


def _move(c: Column, by: Column, classes: tuple[str, ...]) -> Column:
    """The character so many places on within its class; others as they are."""
    out = c
    for letters in reversed(classes):
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
    return out


def _shift(x: Column, stream: Column, sign: Column, classes: tuple[str, ...]) -> Column:
    amount = lambda i: F.conv(F.substring(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return _join(F.transform(_chars(x), lambda c, i: _move(c, sign * amount(i), classes)))


def permuted(x: Column, classes: tuple[str, ...], key: str, tweak: str) -> Column:
    """A keyed permutation of strings of the same classes of characters that leaves none as it was."""
    n = F.length(x)
    half = (n / 2).cast("int")
    start = F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, n).alias("b"))

    def step(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        stream = lambda r, other: F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), r.cast("string"), F.lit("|"), n.cast("string"), F.lit("|"), other), 256)
        onward = F.struct(b.alias("a"), _shift(a, stream(i, b), F.lit(1), classes).alias("b"))
        # The middle step moves every character by one; the steps after it undo those before it, last first.
        one = lambda y: _join(F.transform(_chars(y), lambda c: _move(c, F.lit(1), classes)))
        middle = F.struct(one(a).alias("a"), one(b).alias("b"))
        back = F.struct(_shift(b, stream(F.lit(2 * HALF_ROUNDS) - i, a), F.lit(-1), classes).alias("a"), a.alias("b"))
        return F.when(i < HALF_ROUNDS, onward).when(i == HALF_ROUNDS, middle).otherwise(back)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(2 * HALF_ROUNDS)), start, step)
    return F.concat(end["a"], end["b"])


def walked(x: Column, step: Callable[[Column], Column], barred: Callable[[Column], Column], most: int) -> Column:
    """x after one step of a permutation, and on while that is barred: a permutation of what isn't barred, as a walk comes back to x at last."""
    go = lambda at, i: F.when((i == 0) | barred(at), step(at)).otherwise(at)
    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), x, go)


def _recased(x: Column, like: Column) -> Column:
    """x with capitals where like has them."""
    return _join(F.zip_with(_chars(x), _chars(like), lambda c, o: F.when((F.upper(o) == o) & (F.lower(o) != o), F.upper(c)).otherwise(c)))


def _refilled(digits: Column, like: Column) -> Column:
    """The digits in the places that like has digits in."""
    return _join(F.zip_with(F.split(like, "[0-9]", -1), _chars(digits), lambda gap, d: F.concat(gap, F.coalesce(d, F.lit("")))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit of a string of digits."""
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    at = F.transform(F.reverse(_chars(body)), lambda c, i: F.when(i % 2 == 0, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(10 - F.aggregate(at, F.lit(0), lambda s, d: s + d) % 10, F.lit(10))


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    last = F.substring_index(domain, ".", -1)
    site = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    return _recased(F.concat(permuted(local, PLAIN, key, "local"), F.lit("@"), permuted(site, PLAIN, key, "site"), F.lit("."), last), m)


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    own = F.greatest(F.length(d) - 10, F.lit(0))
    return _refilled(F.concat(F.substring(d, F.lit(1), own), permuted(F.substring(d, own + 1, F.length(d)), DIGITS, key, "phone")), m)


def _card(m: Column, key: str) -> Column:
    """The first digit stays, the body is permuted, and the last stands to the check digit as it stood."""
    d = _digits(m)
    n = F.length(d)
    body, last = F.substring(d, F.lit(1), n - 1), F.substring(d, n, F.lit(1)).cast("int")
    new = F.concat(F.substring(body, 1, 1), permuted(F.substring(body, F.lit(2), n), DIGITS, key, "card"))
    return _refilled(F.concat(new, F.pmod(_check_digit(new) + last - _check_digit(body), F.lit(10)).cast("string")), m)


def _ip(m: Column, key: str) -> Column:
    as_hex = _join(F.transform(F.split(m, "[.]"), lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0"))))
    new = permuted(as_hex, HEX, key, "ip")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(new, i * 2 + 1, F.lit(2)), 16, 10)), ".")


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, rf"^({_SECRET})", 1)
    value = F.substring(m, F.length(head) + 1, F.length(m))
    is_hex = lambda x: x.rlike("^[0-9a-f]+$")
    other = walked(value, lambda x: permuted(x, PLAIN, key, "secret"), is_hex, WALK)
    return F.concat(head, F.when(is_hex(value), permuted(value, HEX, key, "secret")).otherwise(other))


def _given_names(key: str) -> dict[str, str]:
    """Each given name to the next of its gender and script in a keyed order: a permutation without a fixed point."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _shape(name: str) -> tuple:
    """What a permutation of SPOKEN keeps: the class of each character."""
    return tuple(next((i for i, letters in enumerate(SPOKEN) if c in letters), c) for c in name.lower())


#: Listed given names of one shape: a walk among them is no longer.
_ALIKE = max(Counter(_shape(n) for ns in GIVEN.values() for n in ns).values())


def _name(m: Column, key: str) -> Column:
    """Each word of a name, as one or in capitals; given names stay given names and others others."""
    head = F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1)
    known = F.create_map(*[F.lit(x.lower()) for pair in _given_names(key).items() for x in pair])
    words = F.split(F.substring(m, F.length(head) + 1, F.length(m)), " ")
    other = lambda low: walked(low, lambda x: permuted(x, SPOKEN, key, "name"), lambda x: F.map_contains_key(known, x), _ALIKE)
    cased = lambda new, w: F.when(F.upper(w) == w, F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new))))
    one = lambda w: F.when(F.map_contains_key(known, F.lower(w)), cased(F.element_at(known, F.lower(w)), w)).otherwise(_recased(other(F.lower(w)), w))
    return F.concat(head, F.array_join(F.transform(words, one), " "))


def name_words(entities: Column) -> Column:
    """The different words of the names among entities, without honorifics, as they are and in capitals."""
    names = F.filter(entities, lambda m: kind_of(m) == "name")
    words = F.flatten(F.transform(names, lambda m: F.split(F.regexp_replace(m, rf"^(?:{_TITLES})\.? ", ""), " ")))
    return F.array_distinct(F.concat(words, F.transform(words, F.upper)))


def kind_of(m: Column) -> Column:
    """The kind of an entity that the whole expression has found."""
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def surrogate(m: Column, key: str) -> Column:
    """An entity's surrogate."""
    plain = lambda m, key: permuted(m, PLAIN, key, "plain")
    iban = lambda m, key: F.concat(F.substring(m, 1, 2), permuted(F.substring(m, F.lit(3), F.length(m)), PLAIN, key, "iban"))
    amazon = lambda m, key: F.concat(F.substring(m, 1, 4), permuted(F.substring(m, 5, 16), PLAIN, key, "key"))
    ssn = lambda m, key: _refilled(permuted(_digits(m), DIGITS, key, "ssn"), m)
    how = {"email": _email, "secret": _secret, "key": amazon, "ip": _ip, "ssn": ssn, "iban": iban, "phone": _phone, "card": _card, "name": _name}
    out, kind = plain(m, key), kind_of(m)
    for k, f in how.items():
        out = F.when(kind == k, f(m, key)).otherwise(out)
    return out


def found_entities(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs as struct row, with the entities of text, their surrogates, and text with these in their place."""
    whole = wrapped(docs).withColumn("text", F.col("row.text").cast("string"))
    none = F.array().cast("array<string>")
    first = F.when(F.col("text").rlike(MAY_HAVE), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).otherwise(none)
    whole = whole.withColumn("words", _once(first, name_words))
    # Where a document has names, their words are entities too, wherever else they are.
    pattern = F.when(F.size("words") > 0, F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(ENTITY))
    whole = whole.withColumn("pattern", pattern)
    whole = whole.withColumn("entities", F.when(F.size("words") > 0, F.regexp_extract_all("text", "pattern", F.lit(0))).otherwise(first))
    whole = whole.withColumn("surrogates", F.transform("entities", lambda m: surrogate(m, key)))
    pieces = F.zip_with(F.split("text", F.col("pattern"), -1), F.col("surrogates"), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    return whole.select("row", F.coalesce("entities", none).alias("entities"), F.coalesce("surrogates", none).alias("surrogates"), F.when(F.size("entities") > 0, _join(pieces)).otherwise(F.col("text")).alias("text"))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x computed once, however often f reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def without_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and n_chars set anew where docs has it."""
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    of = lambda c: new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")
    return found_entities(docs, key).select(*[of(c).alias(c) for c in docs.columns])


def entities(docs: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, entity, surrogate) over all of docs."""
    pairs = found_entities(docs.select("text"), key).select(F.explode(F.arrays_zip("entities", "surrogates")).alias("x"))
    pairs = pairs.select(F.col("x.entities").alias("entity"), F.col("x.surrogates").alias("surrogate")).distinct()
    return pairs.select(kind_of(F.col("entity")).alias("kind"), "entity", "surrogate")


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """Surrogates that stand for several entities, or that are their own entity; there should be none."""
    found = entities(docs, key)
    return found.groupBy("surrogate").agg(F.count_distinct("entity").alias("n"), F.max((F.col("entity") == F.col("surrogate")).cast("int")).alias("same")).where("n > 1 or same = 1")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found_entities(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark))
    distinct = lambda c: F.size(F.array_distinct(c))
    kinds = F.array_sort(F.array_distinct(F.transform("entities", kind_of)))
    return out.select("row.doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"), (distinct("entities") - distinct("surrogates")).alias("n_collisions"))
