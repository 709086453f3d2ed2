"""Histories of states: illegal transitions, terminal states, queues and heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed transitions of contracts; terminal and completing states of sessions; progress by status.
CONTRACT = {
    "DRAFT": ("GENERATING", "VOIDED"),
    "GENERATING": ("COMPLETED", "GENERATION_FAILED", "VOIDED"),
    "GENERATION_FAILED": ("GENERATING", "VOIDED"),
    "COMPLETED": ("SUPERSEDED", "VOIDED"),
    "SUPERSEDED": (),
    "VOIDED": (),
}
LOCKED = ("COMPLETED", "SUPERSEDED", "VOIDED")
TERMINAL = ("COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED")
PROGRESS = {"QUEUED": 5, "PREPROCESSING": 20, "EXTRACTING": 50, "NORMALIZING": 75, "VALIDATING": 90, "COMPLETED": 100, "COMPLETED_WITH_WARNINGS": 100}
VOID_REASON, STALE_SECONDS, MAX_ATTEMPTS = 10, 300, 3


def previous(history: DataFrame, key: str, *order: str) -> DataFrame:
    return history.withColumn("was", F.lag("status").over(Window.partitionBy(key).orderBy(*order)))


def illegal_transitions(history: DataFrame, key: str, allowed: dict[str, tuple[str, ...]], *order: str) -> DataFrame:
    """Steps whose (was, status) isn't allowed. The pairs are a literal, so no join is needed."""
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return previous(history, key, *order).where(F.col("was").isNotNull() & ~F.concat_ws(">", "was", "status").isin(pairs))


def after_terminal(history: DataFrame, key: str, terminal: tuple[str, ...], *order: str) -> DataFrame:
    """Steps taken after a terminal state was reached."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("ended", F.coalesce(F.max(F.col("status").isin(*terminal).cast("int")).over(before), F.lit(0)) == 1).where("ended")


def more_than_once(history: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Repeats of what may happen once: purges, soft deletions, archiving."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return history.where(F.col("status") == status).withColumn("nth", nth).where("nth > 1")


def can_void(status: Column, reason: Column) -> Column:
    return ~status.isin("VOIDED", "SUPERSEDED") & (F.length(F.trim(F.coalesce(reason, F.lit("")))) >= VOID_REASON)


def can_supersede(status: Column) -> Column:
    return status == "COMPLETED"


def is_locked(status: Column) -> Column:
    return status.isin(*LOCKED)


def is_usable(archived_at: Column, state: Column) -> Column:
    return archived_at.isNull() & (state != "INVALID")


def completed_at(status: Column, now: Column) -> Column:
    return F.when(status.isin(*TERMINAL), now)


def resolved_side(classified: Column, hint: Column) -> Column:
    return F.coalesce(classified, hint)


def progress(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in PROGRESS.items() for v in kv]), status), F.lit(0))


def sequence_numbers(rows: DataFrame, key: list[str], base: Column, *order: str) -> DataFrame:
    """Numbers given out under a lock become ranks over a stored base."""
    return rows.withColumn("sequence", base + F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def session_inputs(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs of images (front, back) that exist, aren't purged and are of one document type."""
    usable = images.where(F.col("purged_at").isNull()).select("image", "type")
    a, b = usable.withColumnsRenamed({"image": "front", "type": "front_type"}), usable.withColumnsRenamed({"image": "back", "type": "back_type"})
    return pairs.join(a, "front").join(b, "back").where("front_type = back_type").drop("back_type")


def foreign_corrections(corrections: DataFrame, fields: DataFrame) -> DataFrame:
    """Corrections of fields that aren't of their session; any of them voids the whole batch."""
    return corrections.join(fields.select("session", "field"), ["session", "field"], "left_anti")


def confirmable(fields: DataFrame) -> DataFrame:
    return fields.groupBy("session").agg(F.bool_and(~F.col("needs_review")).alias("confirmable"))


# --- the queue -----------------------------------------------------------------------------------------------------


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "QUEUED") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))


def claim_next(jobs: DataFrame, now: Column, k: int = 1) -> DataFrame:
    """The first k in order of priority and age: partial top-k in each task."""
    return claimable(jobs, now).orderBy("priority", "created_at", "id").limit(k)


def clamp_progress(percent: Column, message: Column) -> Column:
    return F.struct(F.least(F.greatest(percent, F.lit(0)), F.lit(100)).alias("percent"), F.left(message, F.lit(150)).alias("message"))


def finish(jobs: DataFrame, status: Column, now: Column, retryable: Column) -> DataFrame:
    """Terminal stamps; a retryable failure with attempts left goes back to the queue."""
    again = (status == "FAILED") & retryable & (F.col("attempt_count") < F.col("max_attempts"))
    after = F.when(again, "QUEUED").otherwise(status)
    return jobs.withColumns({"status": after, "finished_at": F.when(~again, now), "progress": F.when(after == "SUCCEEDED", 100).otherwise(F.col("progress"))})


def requeue_stale(jobs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Running jobs without a fresh heartbeat: failed if no attempt is left, else queued."""
    stale = jobs.where((F.col("status") == "RUNNING") & (F.unix_micros("heartbeat_at") < F.unix_micros(now) - seconds * 1_000_000))
    return stale.withColumn("status", F.when(F.col("attempt_count") >= F.col("max_attempts"), "FAILED").otherwise("QUEUED"))


def error_code(code: Column, types: Column, known: list[str], fallbacks: list[tuple[str, str]], unhandled: str) -> Column:
    """The code that an error is answered with: its own if known, else that of the first fallback (type, code) among its types and their ancestors."""
    usual = [(kind, other) for kind, other in fallbacks if other in known]
    by_type = F.coalesce(*[F.when(F.array_contains(types, kind), other) for kind, other in usual], F.lit(unhandled))
    return F.when(code.isin(*known), code).otherwise(by_type)
