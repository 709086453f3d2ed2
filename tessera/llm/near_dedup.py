"""Near-duplicates by b-bit MinHash.

A document's set is its distinct word shingles. Minima of seeded hashes of the set make bands; documents that agree
in a band are candidates. Of the minima only the low bits are kept, packed; a candidate pair's similarity is
estimated from equal low bits, corrected for chance collisions, and pairs far under the threshold are dropped. The
others are confirmed on their full sets, so a link is exact: similarity by intersection over union.

Documents with equal sets are one class from the start and only its first document goes on. Within a band's bucket,
documents are first compared to the bucket's least one, then, where its documents are still in different components,
to one drawn at random; what each pass links is contracted. A last pass compares all documents of one bucket that are
in different components even then, so that no group of copies is paired with itself and no link that joins
components is lost.

Defined cases: null, empty and all-space texts have an empty set and link with nothing; texts with fewer words than a
shingle have their whole word sequence as the one shingle; repeated rows are equal sets; rows with a null doc_id get
null component and kept true; rows that share a doc_id but not a text are compared by their own texts; ties go to the
smaller doc_id, then to the smaller digest; of a row that is met again the filter keeps one; empty tables give empty
results; extra columns, whatever their names, are ignored by the queries and kept by the filter; texts are read whole,
however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents, mix, shingles, short_batches, text_digest, word_hashes, wrapped
from tessera.llm.components import components

#: Bands of so many minima: a pair at 0.8 is missed by all bands once in 10 million pairs.
BANDS, ROWS = 40, 5
#: Low bits kept of each minimum, and minima in a signature (a multiple of 32 for packing).
BITS, MINIMA = 2, 224
#: The same for the last pass, over the few documents that it compares.
FINE = 2048
#: Pairs estimated so far under the threshold are dropped: seven, and for fine signatures five, standard errors.
MARGIN, FINE_MARGIN = 0.22, 0.05
#: Passes that compare documents to others of their buckets before the last one compares all that are left, pairs of
#: each component that such a pass estimates (those that share most buckets), and those that it confirms.
PASSES, LOOKS, TRIES = 2, 8, 3
#: Parts of a component's pairs that are ranked apart, one after the other.
PARTS = (256, 16, 1)
WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

_seeds = mix(np.arange(1, 2 * FINE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = (_seeds[:FINE] | np.uint64(1))[:, None], _seeds[FINE:][:, None]
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def minima(found: np.ndarray, count: int = MINIMA) -> np.ndarray:
    """The least of each seeded hash over a set of shingle hashes."""
    low = np.full(count, 0xFFFFFFFF, np.uint64)
    step = (1 << 20) // count
    for at in range(0, len(found), step):
        low = np.minimum(low, ((found[at : at + step][None, :] * _A[:count] + _B[:count]) >> np.uint64(32)).min(1))
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 32 to a 64-bit word."""
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(-1, 32)
    return np.bitwise_or.reduce(bits << (np.arange(32, dtype=np.uint64) * np.uint64(BITS)), 1)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = _BAND.copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
    return key


def shingle_set(text: str | None, n: int) -> set[str]:
    """The full set, as the confirmation uses it."""
    words = WORD.findall((text or "").translate(_LOWER) if text and text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    m = min(n, len(words))
    return set(map(" ".join, zip(*(words[i:] for i in range(m)), strict=False))) if m > 1 else set(words) if n == 1 else {words[0]}


def identified(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart: doc_id and the digest of the text."""
    return [doc_id.cast("long").alias("doc_id"), text_digest(text).alias("tid")]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest of the text, set size, digest of the words, packed low bits and band keys of each row.

    Rows of the same words have the same set. Other rows of equal sets have equal signatures, meet in all bands and are confirmed on their full sets.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tid", "n_shingles", "digest", "bits", "bands"]
        for b in batches:
            sizes, digests, bits, bands = [], [], [], []
            for text in b.column(2).to_pylist():
                found = np.unique(shingles(word_hashes(text), n))
                sizes.append(len(found))
                said = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
                digests.append(hashlib.blake2b(said, digest_size=16).digest() if len(found) else None)
                low = minima(found)
                bits.append(packed(low).astype(np.int64) if len(found) else None)
                bands.append(band_keys(low).astype(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names)

    rows = docs.select(*identified(F.col("doc_id"), F.col("text")), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, tid binary, n_shingles long, digest binary, bits array<long>, bands array<long>")


def fine_signatures(texts: DataFrame, n: int) -> DataFrame:
    """id and a longer packed signature."""
    short_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [packed(minima(np.unique(shingles(word_hashes(t), n)), FINE)).astype(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "fine"])

    return texts.select("id", "text").mapInArrow(run, "id long, fine array<long>")


def estimate(a: Column, b: Column, count: int = MINIMA) -> Column:
    """Similarity from packed low bits: equal fields are counted, and chance equality is taken out."""
    apart = lambda x: F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: apart(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    return (1 - unequal / F.lit(float(count)) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    short_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, last, kept = [], None, None
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last != y:
                    last, kept = y, shingle_set(y, n)
                mine = shingle_set(x, n)
                common = len(mine & kept)
                keep.append(bool(common) and 100 * common >= percent * (len(mine) + len(kept) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _first_of(df: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """Each key's pairs (a, b) of highest by, at most so many: first in each of its parts, then in ever fewer, so that no task gets a hot key's rows."""
    for parts in PARTS:
        best = Window.partitionBy(key, F.pmod(F.xxhash64("a", "b"), F.lit(parts))).orderBy(F.desc(by), "a", "b")
        df = df.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    return df.drop("r")


def classified(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tid (digest of the text), n_shingles and rep, the least (doc_id, tid) of its component, for each row of docs; rep is null without a set or doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    signed = scratch.keep(signatures(docs, n), "signatures")
    filled = signed.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    # One row for each different sequence of words, numbered in the order of their first rows, so that a bucket's least one is its earliest.
    classes = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "tid")).alias("row"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes.sort("row").withColumn("id", F.monotonically_increasing_id()), "classes")
    bands = classes.select("id", F.explode("bands").alias("key"))
    leads = bands.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("members")).where("members > 1")
    bands = scratch.keep(bands.join(leads, "key").select("id", "key", "lead"), "bands")
    facts = classes.select("id", "n", "bits")

    like = estimate(F.col("bits_a"), F.col("bits_b"))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    fits = sizes & (like >= percent / 100 - MARGIN)

    def likely(pairs: DataFrame, *more: str) -> DataFrame:
        """Of pairs (a, b), those that set sizes and low bits allow to meet the threshold."""
        x = facts.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
        y = facts.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
        return pairs.join(x, "a").join(y, "b").where(fits).select("a", "b", *more, like.alias("like"))

    # First pass: each document with the least of its buckets' least ones, and the one with which it shares most buckets.
    first = bands.where("id <> lead").groupBy(F.col("id").alias("a"), "lead").agg(F.count("*").alias("shared"))
    first = first.groupBy("a").agg(F.min("lead").alias("least"), F.max_by("lead", F.struct("shared", -F.col("lead"))).alias("likeliest"))
    first = likely(first.select("a", F.explode(F.array_distinct(F.array("least", "likeliest"))).alias("b"))).select("a", "b")
    first = scratch.keep(first, "first", few=True)
    wanted = classes.select("id", "row.doc_id", "row.tid").join(bands.select("id").distinct(), "id", "left_semi")
    texts = docs.select(*identified(F.col("doc_id"), F.col("text")), F.col("text").cast("string"))
    texts = scratch.keep(texts.join(wanted, ["doc_id", "tid"]).groupBy("id").agg(F.first("text").alias("text")), "texts")
    linked = scratch.keep(_confirmed(first, texts, n, percent), "linked", few=True)
    joined = scratch.keep(components(linked, scratch), "components", few=True)
    for salt in range(PASSES):
        # Documents and one drawn from each of their buckets that has another component; each component's likeliest.
        placed = bands.join(joined, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
        drawn = placed.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", "key", F.lit(salt))).alias("d"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        pairs = placed.join(drawn, "key").where("component <> d.component").select(F.greatest("id", "d.id").alias("a"), F.least("id", "d.id").alias("b"), "component")
        pairs = pairs.groupBy("a", "b", "component").agg(F.count("*").alias("shared"))
        pairs = _first_of(pairs, "component", "shared", LOOKS).select("a", "b", "component")
        tried = _first_of(likely(pairs, "component"), "component", "like", TRIES).select("a", "b").distinct()
        linked = scratch.keep(linked.unionByName(_confirmed(tried, texts, n, percent)), "linked", few=True)
        joined = scratch.keep(components(linked, scratch), "components", few=True)
    # Last pass: all that share a bucket but not a component, each pair in the first bucket that they share.
    placed = bands.join(joined, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    placed_kept = placed = scratch.keep(placed.join(mixed, "key"), "mixed")
    fine = scratch.keep(fine_signatures(texts.join(placed.select("id").distinct(), "id", "left_semi"), n), "fine")
    placed = placed.join(classes.select("id", "n", "bands").join(fine, "id"), "id").withColumn("place", F.array_position("bands", F.col("key")).cast("int"))
    one, other = (placed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "fine", "bands", "place")]) for x in "ab")
    first_shared = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True)
    pairs = one.join(other, (one["key"] == other["key"]) & (F.col("component_a") < F.col("component_b")) & sizes & (first_shared == F.col("place_a")) & (estimate(F.col("fine_a"), F.col("fine_b"), FINE) >= percent / 100 - FINE_MARGIN))
    pairs = pairs.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))
    linked = scratch.keep(linked.unionByName(_confirmed(pairs, texts, n, percent)), "linked", few=True)
    final = components(linked, scratch)
    for used in (bands, first, texts, placed_kept, fine):
        scratch.drop(used)
    # A component is named by its least id, whose row stands for it; a hot component's members meet it in several tasks.
    names = final.select("component").distinct().join(classes.select(F.col("id").alias("component"), F.col("row").alias("rep")), "component")
    names = names.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS[1] - 1))))
    named = final.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS[1])).cast("int")).join(names, ["component", "part"]).select("id", "rep")
    ids = classes.select("digest", "id", "row").join(named, "id", "left").select("digest", F.coalesce("rep", "row").alias("rep"))
    rows = signed.select("doc_id", "tid", "n_shingles", "digest").join(ids, "digest", "left")
    return rows.select("doc_id", "tid", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    component = F.coalesce("rep.doc_id", "doc_id")
    return classified(docs, n, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, unchanged, without those that another row of their component stands for."""
    key = ["doc_id", "tid"]
    rows = classified(docs, n, percent).where("rep is not null").groupBy(*key).agg(F.count("*").alias("copies"), F.first("rep").alias("rep"))
    rows = Scratch(docs.sparkSession, "near-dedup").keep(rows.select(*key, "copies", (F.struct(*key) == F.col("rep")).alias("stands")), "standing", few=True)
    whole = wrapped(docs).select("row", *identified(F.col("row.doc_id"), F.col("row.text"))).join(rows.where("not stands").select(*key), key, "left_anti")
    again = rows.where("stands and copies > 1").select(*key)
    if not again.isEmpty():
        whole = whole.join(again, key, "left_anti").select("row").unionByName(whole.join(again, key, "left_semi").dropDuplicates(key).select("row"))
    return whole.select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=2)

