"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k least hashes of a text's distinct five-word shingles (of its whole word sequence if it has
fewer words). Sketches of parts merge into the sketch of the whole, and two sketches estimate the resemblance and
containment of their texts and how many distinct shingles each has.

Defined cases: null reads as the empty text; texts without a word have an empty sketch, and two empty sketches are
alike (1.0); an empty and a filled one are not (0.0). Rows are ordered by doc_id (nulls first), then by the digest of
the text, so repeated and tied rows have a defined next row. The next row of the last is the first, of a lone row
itself. An empty table gives an empty result; extra columns are ignored; texts are read whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, shingles, short_batches, word_hashes

K = 128
WORDS = 5
#: Fine ranges measured for each range of documents that a task gets.
FINE = 8


def sketch(text: str | None, k: int = K, n: int = WORDS) -> np.ndarray:
    """The k least distinct shingle hashes, ascending."""
    hashes = shingles(word_hashes(text), n)
    if len(hashes) > 4 * k:  # only the least matter: cut before sorting, and take all if too many were equal
        least = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection over that of the union; exact while both sketches hold all shingles."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).sum() / len(both))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K, n: int = WORDS) -> DataFrame:
    """doc_id, fingerprint and estimated distinct shingles of each row of docs."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(t, k, n) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(encode, found), pa.string()), pa.array([distinct_shingles(x, k) for x in found], pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges_of(rows: DataFrame, parts: int) -> tuple[Column, int]:
    """Which of about so many ranges of (doc_id, digest), in order and of like bytes, a row is in, and how many there are.

    Quantiles of doc_id make fine ranges, whose sizes in bytes are collected (FINE a range of the result); neighbours are
    joined up to a range's share, and a range that one doc_id fills alone is cut by its digests.
    """
    steps = FINE * parts
    cuts = rows.select(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], 4 * steps)).first()[0] or []
    fine = _place(sorted(set(cuts)))
    rows = rows.groupBy(fine.alias("fine")).agg(F.sum(F.octet_length("text") + 64).alias("size"), (F.count("*") > 1).alias("many"), (F.min("doc_id").eqNullSafe(F.max("doc_id"))).alias("alone"))
    found = sorted(map(tuple, rows.collect()))
    share = max(1, -(-sum(size for _, size, _, _ in found) // parts))
    # For each fine range: its first part, and the parts that its digests are dealt to.
    first, cut, n, held = {}, {}, 0, 0
    for place, size, many, alone in found:
        if held and held + size > share:
            n, held = n + 1, 0
        first[place] = n
        if many and alone and size > share:
            cut[place] = -(-size // share)
            n += cut[place]
        else:
            held += size
    total = n + bool(held)
    at = lambda values, default: F.get(_longs([values.get(i, default) for i in range(len(cuts) + 2)]), fine)
    digits = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    return (at(first, 0) + F.shiftright(digits * at(cut, 1), 32)).cast("int"), total


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _place(cuts: list[int]) -> Column:
    """0 for a null doc_id, else 1 and the number of cuts under it, found by halving."""
    if not cuts:
        return F.when(F.col("doc_id").isNull(), 0).otherwise(1)

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["lo"] + span["hi"], 1)
        over = F.get(_longs(cuts), middle) < F.col("doc_id")
        open_ = span["lo"] < span["hi"]
        return F.struct(F.when(open_ & over, middle + 1).otherwise(span["lo"]).alias("lo"), F.when(open_ & ~over, middle).otherwise(span["hi"]).alias("hi"))

    span = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(1 + F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), span, halve)["lo"])


def compare_with_next(docs: DataFrame, k: int = K, n: int = WORDS) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike it is to that and to the next document.

    Documents are dealt by ranges of doc_id and sorted within; each range also gets the first document of the next
    one, so that every task reads its part once, in order, holding two documents.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"))
    place, total = ranges_of(rows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    rows = rows.withColumn("part", place)
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "digest")).alias("f")
    order = sorted((r["part"], r["f"]["doc_id"], r["f"]["digest"]) for r in rows.groupBy("part").agg(least).collect())  # a row a range
    ends = spark.createDataFrame([(*r, order[i - 1][0]) for i, r in enumerate(order)], "part int, first_id long, first_digest string, before int")
    edge = rows.join(F.broadcast(ends), "part").where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")))
    edge = edge.select("doc_id", "text", F.col("before").alias("part"), "digest", F.lit(1).alias("guest"))
    dealt = rows.select("doc_id", "text", "part", "digest", F.lit(0).alias("guest")).unionByName(edge)
    dealt = dealt.repartitionById(max(total, 1), F.col("part")).sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), "digest").select("doc_id", "text", "part", "guest")
    short_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def row(mine, following):
            doc_id, text, own = mine
            changed = edited(text, following[1])
            theirs = sketch(changed, k, n)
            return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encode(own), encode(theirs), resemblance(own, theirs, k), resemblance(own, following[2], k)

        for b in batches:
            out = []
            for doc_id, text, part, guest in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                now = (doc_id, text, sketch(text, k, n))
                if held and held[0] == part and not held[2]:
                    out.append(row(held[1], now))
                held = (part, now, guest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
