"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal token counts are numbered 0, 1, 2, ... and slot i is given the golden-ratio point frac((i + 1) / phi).
The point falls in one source's part of the cumulative target weights, counted in blocks; the slot's rank among the
source's slots says which block of that source fills it. A source's blocks cut its documents, shuffled by a keyed
digest anew for each pass over the source, into runs of equal token counts, the last one cut where the target is
reached. Points are drawn until all blocks have a slot: those of golden ratio leave no gap of twice their mean distance,
so DRAWS times as many points as blocks are enough; a point whose source has no block left fills no slot.

Defined cases: a null source is a source of its own, ordered last; null and empty texts have size 0 and take 0;
repeated rows count as documents of their own; ties in the shuffle are split by doc_id; an empty table gives an
empty result; extra columns are ignored. Sizes of sources are collected, one row a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents

#: Slots in a schedule, at least; more sources make it longer.
SLOTS = 1 << 16
SLOTS_A_SOURCE = 64
#: No source is passed over more often.
MOST_PASSES = 3
#: Points drawn for each block.
DRAWS = 4
#: Rows of a source that one task ranks, about: leading digits of the shuffle's digest part it so.
PART_ROWS = 1 << 20
GOLDEN = (math.sqrt(5) - 1) / 2


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of each document."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))


def targets(source_sizes: list[tuple[str | None, int]], share: float = 1.0) -> list[tuple[str | None, int, float, int]]:
    """(source, size, target, order): weights 1, 2, 3 repeat over sources by code point; what is over a cap is shared anew by weight."""
    ordered = sorted(source_sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [i % 3 + 1 for i in range(len(ordered))]
    cap = [float(MOST_PASSES * s) for _, s in ordered]
    by_ratio = sorted(range(len(ordered)), key=lambda i: (cap[i] / weight[i], i))
    left, weights, out = share * sum(s for _, s in ordered), float(sum(weight)), [0.0] * len(ordered)
    for k, i in enumerate(by_ratio):
        level = left / weights
        if cap[i] / weight[i] >= level:
            for j in by_ratio[k:]:
                out[j] = min(cap[j], level * weight[j])
            break
        out[i], left, weights = cap[i], left - cap[i], weights - weight[i]
    return [(name, size, out[i], i) for i, (name, size) in enumerate(ordered)]


def schedule(spark: SparkSession, plan: list[tuple[str | None, int, float, int]]) -> tuple[DataFrame, int]:
    """(slot, source_no, rank, start, words) of each slot, and the words of a full block."""
    quota = [math.floor(t + 0.5) for _, _, t, _ in plan]
    block = max(1, sum(quota) // max(SLOTS, SLOTS_A_SOURCE * len(plan)))
    need = [-(-q // block) for q in quota]
    edges = np.cumsum(np.array(need, np.float64)) / max(1, sum(need))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = np.searchsorted(edges, np.modf((b.column(0).to_numpy() + 1) * GOLDEN)[0], "right")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(source.astype(np.int32))], ["slot", "source_no"])

    drawn = spark.range(DRAWS * sum(need)).mapInArrow(draw, "slot long, source_no int")
    numbers = spark.createDataFrame(list(zip(range(len(plan)), quota, need, strict=True)), "source_no int, quota long, need long")
    rank = F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1
    slots = drawn.withColumn("rank", rank.cast("long")).join(F.broadcast(numbers), "source_no").where("rank < need")
    start = F.col("rank") * F.lit(block)
    return slots.select("slot", "source_no", "rank", start.alias("start"), F.least(F.lit(block), F.col("quota") - start).alias("words")), block


def mix_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix as (slot, doc_id, copy, source_no, size, first_word, words) pieces, and each document with its source's target.

    copy tells apart rows that agree in doc_id, source and size.
    """
    spark = docs.sparkSession
    rows = Scratch(spark, "mixing").keep(sizes(docs), "sizes", few=True)  # texts are read once
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    plan, digits = targets([(r["source"], r["n"]) for r in found]), 2
    while max((r["rows"] for r in found), default=0) > PART_ROWS << 4 * digits:
        digits += 1
    slots, block = schedule(spark, plan)
    numbered = spark.createDataFrame([(name, i, size, target, math.floor(target + 0.5)) for name, size, target, i in plan], "named string, source_no int, source_size long, target double, quota long")
    rows = rows.join(F.broadcast(numbered), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source_no", "size").orderBy(F.lit(0))))
    passes = F.explode(F.expr("sequence(0L, (quota - 1) div source_size)"))
    laid = rows.where("size > 0 and quota > 0").select("doc_id", "copy", "source_no", "size", "source_size", "quota", passes.alias("pass"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("pass").cast("string")).cast("binary"))
    laid = laid.withColumn("key", key).withColumn("part", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))
    sums = laid.groupBy("source_no", "pass", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source_no", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0))).drop("part_size")
    within = Window.partitionBy("source_no", "pass", "part").orderBy("key", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = laid.withColumn("upto", F.sum("size").over(within)).join(sums, ["source_no", "pass", "part"])
    laid = laid.withColumn("first", F.expr("pass * source_size + before + upto - size")).where("first < quota")
    cut = F.explode(F.expr(f"sequence(first div {block}L, (first + size - 1) div {block}L)"))
    cut = laid.select("doc_id", "copy", "source_no", "size", "first", cut.alias("rank"))
    begin, end = F.greatest("first", "start"), F.least(F.expr("first + size"), F.expr("start + words"))
    mixed = cut.join(slots, ["source_no", "rank"]).where(end > begin)
    return mixed.select("slot", "doc_id", "copy", "source_no", "size", (begin - F.col("first")).alias("first_word"), (end - begin).alias("words")), rows


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, the words that the mix takes, the first slot they fill and how many, for each row of docs."""
    mixed, rows = mix_sources(docs)
    own = ["doc_id", "copy", "source_no", "size"]
    both = rows.select(*own, "source_size", "target", F.lit(0).cast("long").alias("words"))
    both = both.unionByName(mixed.select(*own, "words", "slot"), allowMissingColumns=True)
    taken = [F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots")]
    out = both.groupBy(*own).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), *taken)
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


#: The same mix in DuckDB: blocks of shuffled documents, met by the slots of golden-ratio points.
OP6_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM docs GROUP BY source
), weighed AS (
  SELECT *, (no % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / (no % 3 + 1), no) AS k FROM per
), level AS (
  SELECT 1::BIGINT AS k, (SELECT sum(source_size) FROM per)::DOUBLE AS rest, (SELECT sum(w) FROM weighed)::DOUBLE AS ws
  UNION ALL
  SELECT l.k + 1, l.rest - x.cap, l.ws - x.w FROM level l JOIN weighed x USING (k) WHERE x.cap / x.w < l.rest / l.ws
), last AS (SELECT k, rest / ws AS lvl FROM level ORDER BY k DESC LIMIT 1
), target AS (
  SELECT source, no, source_size, CASE WHEN x.k < last.k THEN cap ELSE least(cap, lvl * w) END AS target FROM weighed x, last
), quota AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM target
), block AS (SELECT greatest(1, sum(quota)::BIGINT // greatest({SLOTS}, {SLOTS_A_SOURCE} * count(*))) AS block FROM quota
), need AS (SELECT no, (quota + block - 1) // block AS need FROM quota, block
), edge AS (SELECT no, need, sum(need) OVER (ORDER BY no) AS upto, sum(need) OVER () AS total FROM need
), point AS (
  SELECT i AS slot, (i + 1)::DOUBLE * {GOLDEN!r}::DOUBLE - floor((i + 1)::DOUBLE * {GOLDEN!r}::DOUBLE) AS x FROM range({DRAWS} * (SELECT sum(need) FROM need)::BIGINT) t(i)
), slot AS (
  SELECT slot, no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM point JOIN edge ON x >= (upto - need)::DOUBLE / total::DOUBLE AND x < upto::DOUBLE / total::DOUBLE
), laid AS (
  SELECT d.doc_id, d.size, no, source_size, quota, unnest(range((quota - 1) // source_size + 1)) AS pass FROM docs d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source WHERE size > 0 AND quota > 0
), placed AS (
  SELECT *, pass * source_size + coalesce(sum(size) OVER (PARTITION BY no, pass ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || pass), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM laid
), cut AS (
  SELECT doc_id, no, first, least(first + size, quota) AS stop, unnest(range(first // block, (least(first + size, quota) - 1) // block + 1)) AS rank FROM placed, block WHERE first < quota
), mixed AS (
  SELECT doc_id, sum(least(stop, (rank + 1) * block) - greatest(first, rank * block))::BIGINT AS taken, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM cut JOIN slot USING (no, rank), block GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM docs d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN mixed USING (doc_id)
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(documents(spark, sf_dir))
