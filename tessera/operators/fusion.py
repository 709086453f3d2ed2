"""Fusing competing readings of a field into one scored winner.

Candidates are a long table: entity, field_key, source, value, confidence, arrival. Blank values are no values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import domains
from tessera.functions.numbers import half_even

# Fixed values.
FIELDS = ("id_number", "full_name", "date_of_birth", "issue_date", "expiry_date", "issue_place")
PRIORITY = {"QR": 0, "MRZ": 1, "OCR": 2, "MANUAL": 3, "NONE": 4}
OCR_FACTORS = {"id_number": 1.00, "full_name": 0.75, "date_of_birth": 0.95, "issue_date": 0.95, "expiry_date": 0.95, "issue_place": 1.00}
WEIGHTS = {"id_number": 0.30, "full_name": 0.25, "date_of_birth": 0.15, "issue_date": 0.10, "expiry_date": 0.10, "issue_place": 0.10}
CONSENSUS, CONFLICT, CONTRADICTED, REVIEW, RETAKE = 0.10, 0.90, 0.50, 0.85, 0.40


def priority(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv]), source), F.lit(len(PRIORITY)))


def base_score(field_key: Column, source: Column, confidence: Column) -> Column:
    """The clamped confidence, less for recognised text by field."""
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in OCR_FACTORS.items() for v in kv]), field_key), F.lit(1.0))
    return domains.clamp(confidence) * F.when(source == "OCR", factor).otherwise(1.0)


def best_per_source(candidates: DataFrame) -> DataFrame:
    """The best usable candidate of each source, the first of equals, with its base score."""
    usable = candidates.where(F.coalesce(F.col("value"), F.lit("")) != "")
    scored = usable.withColumn("base", base_score(F.col("field_key"), F.col("source"), F.col("confidence")))
    order = Window.partitionBy("entity", "field_key", "source").orderBy(F.desc("base"), "arrival")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def fuse_fields(candidates: DataFrame, review: float = REVIEW) -> DataFrame:
    """One row for each entity and field with a usable candidate: votes add to scores, contradictions of confident sources lower them."""
    best = best_per_source(candidates)
    value = Window.partitionBy("entity", "field_key", "value")
    best = best.withColumn("votes", F.count("*").over(value)).withColumn("p", priority(F.col("source")))
    best = best.withColumn("score", F.least(F.col("base") + CONSENSUS * (F.col("votes") - 1), F.lit(1.0)))
    sure = F.col("base") >= CONFLICT
    groups = best.groupBy("entity", "field_key").agg(
        F.max_by(F.struct("value", "source", "score", "votes"), F.struct("score", -F.col("p"))).alias("w"),
        F.count_distinct(F.when(sure, F.col("value"))).alias("sure_values"),
        F.min_by(F.struct("value", "source"), F.when(sure, F.col("p"))).alias("preferred"),
    )
    conflict = F.col("sure_values") >= 2
    return groups.select(
        "entity", "field_key",
        F.when(conflict, F.col("preferred.value")).otherwise(F.col("w.value")).alias("value"),
        F.when(conflict, F.col("preferred.source")).otherwise(F.col("w.source")).alias("source"),
        F.when(conflict, CONTRADICTED).otherwise(F.col("w.score")).alias("confidence"),
        (conflict | (F.col("w.score") < review)).alias("needs_review"),
        F.when(conflict, F.array(F.lit("SOURCE_CONFLICT"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        (~conflict & (F.col("w.votes") > 1)).alias("agreement"),
    )


def all_fields(entities: DataFrame, fused: DataFrame) -> DataFrame:
    """All six fields of each entity, the missing ones empty and for review."""
    keys = entities.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, FIELDS))).alias("field_key"))
    out = keys.join(fused, ["entity", "field_key"], "left")
    return out.select("entity", "field_key", "value", F.coalesce("source", F.lit("NONE")).alias("source"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("needs_review", F.lit(True)).alias("needs_review"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("agreement", F.lit(False)).alias("agreement"))


def first_value(source: str) -> Column:
    """The first usable value of a source, by arrival."""
    return F.min_by(F.col("value"), F.when((F.col("source") == source) & (F.coalesce(F.col("value"), F.lit("")) != ""), F.col("arrival")))


def card_mismatch(candidates: DataFrame) -> DataFrame:
    """Entities whose first machine-read ids differ."""
    firsts = candidates.where(F.col("field_key") == "id_number").groupBy("entity").agg(first_value("QR").alias("qr_value"), first_value("MRZ").alias("mrz_value"))
    return firsts.where("qr_value <> mrz_value")


def year_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "^([0-9]{4})", 1), F.lit("")).cast("int")


def year_matches(citizen: Column, year: Column) -> Column:
    """The id's year digits, and its century where it tells one, agree with a year."""
    century = domains.inferred_birth_years(citizen)
    return (F.lpad((year % 100).cast("string"), 2, "0") == domains.birth_year_suffix(citizen)) & F.coalesce(year.between(century["lo"], century["hi"]), F.lit(True))


def with_flag(df: DataFrame, when: Column, flag: str, at_most: float = CONTRADICTED) -> DataFrame:
    """Rows that meet when get the flag and a lower confidence, and are for review under the default threshold."""
    low = F.least(F.col("confidence"), F.lit(at_most))
    return df.withColumns({"flags": F.when(when, F.array_append("flags", F.lit(flag))).otherwise(F.col("flags")), "needs_review": F.when(when, F.col("needs_review") | (low < REVIEW)).otherwise(F.col("needs_review")), "confidence": F.when(when, low).otherwise(F.col("confidence"))})


def fuse(candidates: DataFrame, provinces: list[str] | None = None, review: float = REVIEW) -> DataFrame:
    """All rules: winners and conflicts, all six fields, then mismatch of cards, then consistency of the id."""
    fields = all_fields(candidates, fuse_fields(candidates, review))
    mismatch = card_mismatch(candidates).select("entity", F.lit(True).alias("mismatch"))
    fields = fields.join(mismatch, "entity", "left")
    is_id = F.col("field_key") == "id_number"
    fields = with_flag(fields, is_id & F.coalesce("mismatch", F.lit(False)), "CARD_MISMATCH").drop("mismatch")
    births = fields.where(F.col("field_key") == "date_of_birth").select("entity", year_of(F.col("value")).alias("born"))
    fields = fields.join(births, "entity", "left")
    citizen = F.when(F.col("value").rlike(r"^[0-9]{12}\z"), F.col("value"))
    unknown = ~domains.province_code(citizen).isin(provinces) if provinces else F.lit(False)
    wrong = is_id & citizen.isNotNull() & F.when(unknown, True).otherwise(F.coalesce(~year_matches(citizen, F.col("born")), F.lit(False)))
    return with_flag(fields, wrong, "ID_INCONSISTENT").drop("born")


def overall(fields: DataFrame) -> DataFrame:
    """The weighted confidence over the six fields in fixed order, and whether to take the picture again."""
    each = [F.coalesce(F.max(F.when((F.col("field_key") == k) & F.col("value").isNotNull(), domains.clamp(F.col("confidence")))), F.lit(0.0)) * w for k, w in WEIGHTS.items()]
    total = each[0]
    for x in each[1:]:
        total = total + x
    return fields.groupBy("entity").agg(half_even(total, 4).alias("overall")).withColumn("needs_retake", F.col("overall") < RETAKE)


def sides_wanted(candidates: DataFrame, zones: DataFrame) -> DataFrame:
    """Sides (entity, side) with a printed field whose best confidence is under the threshold; zones: side, field_key."""
    best = candidates.groupBy("entity", "field_key").agg(F.max("confidence").alias("best"))
    asked = candidates.select("entity").distinct().crossJoin(F.broadcast(zones.distinct()))  # zones: a dozen rows of configuration
    return asked.join(best, ["entity", "field_key"], "left").groupBy("entity", "side").agg((F.min(F.coalesce("best", F.lit(0.0))) < REVIEW).alias("wanted"))


def traces(candidates: DataFrame, fused: DataFrame) -> DataFrame:
    """Each candidate with whether it agrees with the winner."""
    winner = fused.select("entity", "field_key", F.col("value").alias("winner"))
    return candidates.join(winner, ["entity", "field_key"], "left").withColumn("agrees", F.coalesce(F.col("value") == F.col("winner"), F.lit(False)))


def channel_summary(candidates: DataFrame) -> DataFrame:
    has = lambda s: F.max((F.col("source") == s).cast("int")) == 1
    return candidates.groupBy("entity").agg(has("QR").alias("qr_available"), has("MRZ").alias("mrz_available"), F.count(F.when(F.col("source") == "OCR", 1)).alias("ocr_lines"), half_even(F.avg(F.when(F.col("source") == "OCR", domains.clamp(F.col("confidence")))), 4).alias("ocr_confidence"))


def status_for(issues: Column) -> Column:
    return F.when(issues > 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")


def side_failure(verdict: Column) -> Column:
    return F.when(verdict == "DUPLICATE_SIDE", "NEEDS_REUPLOAD").when(verdict == "AMBIGUOUS", "NEEDS_MANUAL_ASSIGN")
