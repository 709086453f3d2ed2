"""Specification queries: equality filters, soft deletion, ordering and pages, and what stores do around them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Specification:
    filters: dict[str, Any] = field(default_factory=dict)
    order_by: tuple[str, ...] = ()
    page: int = 1
    page_size: int = 50
    include_deleted: bool = False


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't softly deleted; tables without that column are all live."""
    return df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df


def ordering(names: tuple[str, ...]) -> list[Column]:
    """Sort keys with the store's placement of nulls: last when ascending, first when descending."""
    return [F.col(n[1:]).desc_nulls_first() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names]


def select(df: DataFrame, spec: Specification) -> DataFrame:
    """Rows that meet all equalities; a null filter value meets nulls."""
    df = df if spec.include_deleted else live(df)
    tests = [F.col(k).eqNullSafe(F.lit(v)) for k, v in spec.filters.items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def get(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def count(df: DataFrame, spec: Specification) -> DataFrame:
    return select(df, spec).agg(F.count("*").alias("total"))


def exists(df: DataFrame, spec: Specification) -> DataFrame:
    """One row that says whether any row meets the specification; the scan stops at the first."""
    return select(df, spec).limit(1).agg((F.count("*") > 0).alias("found"))


def page(df: DataFrame, spec: Specification) -> DataFrame:
    """The page's rows with the total and whether another page follows. Top-k by partial sorts; the total is a one-row join."""
    rows = select(df, spec)
    total = rows.agg(F.count("*").alias("total"))
    kept = rows.orderBy(*ordering(spec.order_by)).offset((spec.page - 1) * spec.page_size).limit(spec.page_size)
    return kept.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > spec.page * spec.page_size)


def conflicts(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is stored already, or comes twice among the new ones."""
    twice = new.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    known = stored.select(*key).distinct()
    return new.join(known.unionByName(twice).distinct(), key, "left_semi")


def insertable(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """The new rows that conflict with none, stored or new."""
    return new.join(conflicts(new, stored, key).select(*key), key, "left_anti")


def of_kind(rows: DataFrame, kinds: DataFrame, on: tuple[str, str], spec: Specification) -> DataFrame:
    """rows with their kind, for the kinds of a small dimension that meet spec; its rows are as many as the configuration has."""
    child, parent = on
    return rows.join(F.broadcast(select(kinds, spec)), F.col(child) == F.col(parent)).orderBy(*ordering(spec.order_by))


def by_needle(rows: DataFrame, column: str, needles: DataFrame, needle: str) -> DataFrame:
    """Each needle with the rows whose column equals it; an empty or null needle finds nothing."""
    return needles.where(F.nullif(F.col(needle), F.lit("")).isNotNull()).join(rows, F.col(needle) == F.col(column))


def by_digest(rows: DataFrame, content: Column, digests: DataFrame) -> DataFrame:
    """rows with the sha256 of their content, where digests (sha256) has it."""
    return rows.withColumn("sha256", F.sha2(content, 256)).join(digests.select("sha256"), "sha256", "left_semi")


def counted(events: DataFrame, key: str, at: str) -> DataFrame:
    """How often and when last something was recorded for each key: an atomic counter as the sum of its events."""
    return events.groupBy(key).agg(F.count("*").alias("times"), F.max(at).alias("last_at"))


def with_children(parents: DataFrame, key: str, children: DataFrame, of: str, value: str) -> DataFrame:
    """Every parent with its children's values in order, none being an empty list, and how many there are."""
    kids = children.groupBy(F.col(of).alias("_of")).agg(F.array_sort(F.collect_list(value)).alias("children"))
    out = parents.join(kids, F.col(key) == F.col("_of"), "left").drop("_of")
    return out.withColumn("children", F.coalesce("children", F.array().cast(kids.schema["children"].dataType))).withColumn("n_children", F.size("children").cast("long"))


def with_result(sessions: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every session with its result, if it has one."""
    return sessions.join(results, key, "left")


def resolved_parties(requests: DataFrame, customers: DataFrame, on: tuple[str, str], accounts: DataFrame, account_on: tuple[str, str]) -> DataFrame:
    """Each requested party with its customer and, if there is one, its account."""
    return requests.join(customers, F.col(on[0]) == F.col(on[1])).join(accounts, F.col(account_on[0]) == F.col(account_on[1]), "left")


def unresolved_parties(requests: DataFrame, customers: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Requests whose customer is missing, any of which aborts the whole."""
    return requests.join(customers, F.col(on[0]) == F.col(on[1]), "left_anti")


def update_versioned(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """stored with the changes whose expected_version holds; applied says which rows changed and stale which didn't for it."""
    new = changes.select(key, "expected_version", *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("asked"))
    both = stored.join(new, key, "left")
    ok = F.col("asked").isNotNull() & F.col("version").eqNullSafe(F.col("expected_version"))
    out = [F.when(ok, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns if c != "version"]
    return both.select(*out, F.when(ok, F.col("version") + 1).otherwise(F.col("version")).alias("version"), ok.alias("applied"), (F.col("asked").isNotNull() & ~ok).alias("stale"))


def latest(df: DataFrame, key: list[str], by: str, value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max(by).alias(by), F.max_by(value, F.struct(by, value)).alias(value))


def ranked(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Rows of each parent, numbered in order."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*key).orderBy(*ordering(order))))


def next_version(df: DataFrame, key: list[str], version: str) -> DataFrame:
    return df.groupBy(*key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def effective(corrected: Column, user: Column, final: Column) -> Column:
    """The user's value where it was corrected, even to null; else the machine's."""
    return F.when(corrected, user).otherwise(final)


def as_text(x: Column, kind: str) -> Column:
    """A summary's value as text: truth values and nulls are spelt with capitals."""
    if kind == "boolean":
        return F.when(x, "True").when(~x, "False").otherwise("None")
    return F.coalesce(x.cast("string"), F.lit("None"))


def derived_id(*parts: Column) -> Column:
    """A stable identifier in place of a random one: version and variant digits set on a keyed digest."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("7"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
