"""Normalising a field's text by its kind, and places of issue by tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, domains, fuzzy
from tessera.functions.text import NAME_EXTRA, VN_UPPERCASE, collapse_whitespace, fix_ocr_digits, nfc_upper, strip_diacritics

# Fixed values.
REPAIRED_DATE, NO_EXPIRY_RATIO = 0.75, 85.0
FUZZY_HIGH, FUZZY_LOW, KEYWORD = (85.0, 0.90), (70.0, 0.65), 0.60
HEAD, DECISIVE, MARGIN, CORROBORATED, HEAD_ONLY = 3, 80.0, 25.0, 0.92, 0.85
SCHEMA = "struct<value string, confidence double, flags array<string>>"


def _result(value: Column, confidence: Column, *flags: str) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"), (F.array(*map(F.lit, flags)) if flags else F.array().cast("array<string>")).alias("flags"))


EMPTY = ("UNPARSEABLE",)


def _or_empty(value: Column, confidence: Column) -> Column:
    return F.when(value.isNotNull(), _result(value, confidence)).otherwise(_result(F.lit(None).cast("string"), F.lit(0.0), *EMPTY))


def name(raw: Column) -> Column:
    """Capitals, digits repaired, then foreign characters dropped, in this order."""
    fixed = fix_ocr_digits(collapse_whitespace(nfc_upper(raw)))
    return domains.person_name(F.regexp_replace(fixed, rf"[^{VN_UPPERCASE}{NAME_EXTRA[0]}\-']", ""))


def date_field(raw: Column, confidence: Column) -> Column:
    """An ISO date; one found by repair has less confidence and a flag."""
    parsed, repaired = dates.parse_date(raw), dates.repair_date(raw)
    return (
        F.when(parsed.isNotNull(), _result(parsed.cast("string"), confidence))
        .when(repaired.isNotNull(), _result(repaired.cast("string"), F.least(confidence, F.lit(REPAIRED_DATE)), "DATE_REPAIRED"))
        .otherwise(_result(F.lit(None).cast("string"), F.lit(0.0), *EMPTY))
    )


def expiry(raw: Column, confidence: Column) -> Column:
    """The phrase for no expiry, or nearly that, or a date."""
    folded, phrase = strip_diacritics(nfc_upper(raw)), strip_diacritics(F.lit(dates.NO_EXPIRY_TEXT))
    near = (folded == phrase) | (fuzzy.likeness(folded, phrase) >= NO_EXPIRY_RATIO)
    return F.when(near, _result(F.lit(dates.NO_EXPIRY_TEXT), confidence, "NO_EXPIRY")).otherwise(date_field(raw, confidence))


def fields(rows: DataFrame) -> DataFrame:
    """rows (field_key, text, confidence) with value, confidence and flags; places of issue are done by issue_places."""
    raw, sure = collapse_whitespace(F.coalesce("text", F.lit(""))), domains.clamp(F.col("confidence"))
    done = (
        F.when(raw == "", _result(F.lit(None).cast("string"), F.lit(0.0), *EMPTY))
        .when(F.col("field_key") == "id_number", _or_empty(domains.citizen_id(raw, ocr=True), sure))
        .when(F.col("field_key") == "full_name", _or_empty(name(raw), sure))
        .when(F.col("field_key") == "expiry_date", expiry(raw, sure))
        .when(F.col("field_key").isin("date_of_birth", "issue_date"), date_field(raw, sure))
        .otherwise(_result(F.lit(None).cast("string"), F.lit(0.0), *EMPTY))
    )
    return rows.withColumn("r", done).select(*[c for c in rows.columns if c != "confidence"], "r.value", "r.confidence", "r.flags")


def shape_tokens(raw: Column) -> Column:
    """Words of letters, without leading ones of a single letter."""
    words = F.filter(F.split(F.regexp_replace(strip_diacritics(nfc_upper(raw)), r"[^\p{L}]", " "), " +"), lambda w: w != "")
    at = F.array_position(F.transform(words, lambda w: F.length(w) >= 2), True)
    return F.when(at > 0, F.slice(words, at.cast("int"), F.size(words))).otherwise(F.array().cast("array<string>"))


def shape_verdict(raw: Column) -> Column:
    """The place that the first letters tell, if they tell one clearly; the first word's length may bear it out."""
    tokens = shape_tokens(raw)
    head = F.substring(F.array_join(tokens, ""), 1, HEAD)
    heads = [F.substring(F.regexp_replace(strip_diacritics(F.lit(p)), r"[^\p{L}]", ""), 1, HEAD) for p in (domains.BO_CONG_AN, domains.CUC_CANH_SAT)]
    one, two = (fuzzy.likeness(head, F.substring(h, F.lit(1), F.length(head))) for h in heads)
    best, other = F.greatest(one, two), F.least(one, two)
    place = F.when(one >= two, domains.BO_CONG_AN).otherwise(domains.CUC_CANH_SAT)
    vote = F.when(F.length(F.get(tokens, F.lit(0))) <= 2, domains.BO_CONG_AN).otherwise(domains.CUC_CANH_SAT)
    decided = (F.size(tokens) > 0) & (best >= DECISIVE) & (best - other >= MARGIN)
    return F.when(decided, F.struct(place.alias("value"), F.when(vote == place, CORROBORATED).otherwise(HEAD_ONLY).alias("confidence")))


def issue_places(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (text, confidence) with value, confidence and tier: canonical form, alias, shape, likeness, keywords, in this order.

    aliases (ord, alias_normalized, keywords, canonical_value, assigned_confidence) is a small dimension; fuzzy tiers
    run over distinct texts.
    """
    texts = rows.select("text").distinct().withColumn("plain", strip_diacritics(collapse_whitespace(nfc_upper(F.coalesce("text", F.lit(""))))))
    out = lambda v, c, t: F.struct(v.alias("value"), c.alias("confidence"), F.lit(t).alias("tier"))
    canonical = F.create_map(*[x for p in (domains.BO_CONG_AN, domains.CUC_CANH_SAT) for x in (strip_diacritics(F.lit(p)), F.lit(p))])
    texts = texts.withColumn("t1", F.when(F.element_at(canonical, F.col("plain")).isNotNull(), out(F.element_at(canonical, F.col("plain")), F.lit(1.0), 1)))
    shape = shape_verdict(F.coalesce("text", F.lit("")))
    texts = texts.withColumn("s", shape).withColumn("t5", F.when(F.col("s").isNotNull(), out(F.col("s.value"), F.col("s.confidence"), 5))).drop("s")
    pairs = texts.select("text", "plain").join(F.broadcast(aliases))  # sixteen rows of configuration
    score = F.when(F.col("alias_normalized").isNotNull(), fuzzy.token_set_likeness(F.col("plain"), F.col("alias_normalized")))
    pairs = pairs.withColumn("score", score).withColumn("same", F.col("plain") == F.col("alias_normalized"))
    pairs = pairs.withColumn("kw", (F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0) & F.forall("keywords", lambda k: F.array_contains(F.split("plain", " "), k)))
    hit = pairs.groupBy("text").agg(
        F.min_by(F.struct("canonical_value", "assigned_confidence"), F.when(F.col("same"), F.col("ord"))).alias("a2"),
        F.max_by(F.struct("canonical_value", "score"), F.when(F.col("score") > 0, F.struct("score", -F.col("ord")))).alias("a3"),
        F.min_by("canonical_value", F.when(F.col("kw"), F.col("ord"))).alias("a4"),
    )
    texts = texts.join(hit, "text", "left")
    t2 = F.when(F.col("a2").isNotNull(), out(F.col("a2.canonical_value"), F.col("a2.assigned_confidence"), 2))
    t3 = F.when(F.col("a3.score") >= FUZZY_LOW[0], out(F.col("a3.canonical_value"), F.when(F.col("a3.score") >= FUZZY_HIGH[0], FUZZY_HIGH[1]).otherwise(FUZZY_LOW[1]), 3))
    t4 = F.when(F.col("a4").isNotNull(), out(F.col("a4"), F.lit(KEYWORD), 4))
    texts = texts.select("text", F.coalesce("t1", t2, "t5", t3, t4).alias("p"))
    found = rows.join(texts, rows["text"].eqNullSafe(texts["text"]), "left").drop(texts["text"])
    value = F.col("p.value")
    return found.select(*[c for c in rows.columns if c != "confidence"], value.alias("value"), F.when(value.isNotNull(), F.least(domains.clamp(F.col("confidence")), "p.confidence")).otherwise(0.0).alias("confidence"), F.col("p.tier").alias("tier"), F.when(value.isNull(), F.array(F.lit("ISSUE_PLACE_UNRECOGNIZED"))).otherwise(F.array().cast("array<string>")).alias("flags"))


