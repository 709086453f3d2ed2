"""Language identification by rank-order profiles of character n-grams.

A text's 1- to 3-grams (letters lower-cased, every other run read as one space, words padded with a space) are
ranked by count; its most frequent ones are compared to each language's profile by the out-of-place distance: the
sum over them of how far their ranks lie apart, or the profile's length where the profile lacks the n-gram. The
language of least distance wins.

Defined cases: null texts and texts without a letter give `und` with score 0; ties go to the first language by code
point; repeated rows are scored alike; an empty table gives an empty result, and without a training row every text
is `und`; extra columns are ignored; texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc_bucket, documents, sampled, short_batches

#: N-grams in a profile, and of a text that are compared.
PROFILE = 400
#: A profile is fitted on about so many training rows of its language at most (the documented bound of the fitting sample).
FIT_ROWS = 5_000
UNKNOWN = "und"
_STEP = 1 << 18  # characters counted at a time


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of anything but letters as one space, with a space at each end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.unique(points)
    letters = known[np.fromiter((chr(c).isalpha() for c in known), bool, len(known))]
    letter = np.isin(points, letters, kind="table") if len(letters) and letters[-1] < 1 << 16 else np.isin(points, letters)
    if not letter.any():
        return np.zeros(0, np.uint64)
    out = np.full(len(points) + 2, 32, np.uint64)
    out[1:-1] = np.where(letter, points, 32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of a text, packed 21 bits a character, and their counts."""
    codes = _codes(text)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = (codes[:-1] << np.uint64(21)) | codes[1:]
    three = (two[:-1] << np.uint64(21)) | codes[2:]
    keys, counts = np.unique(np.concatenate([codes[codes != 32], two, three]), return_counts=True)
    return keys, counts


def top_ranked(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, most frequent first; ties in the order of the packed n-grams."""
    if len(keys) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:n]


def fit_profiles(train: DataFrame, profile: int = PROFILE, at_most: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams over rows (doc_id, text, lang), counted over all rows of the sample."""
    spark = train.sparkSession
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return {}
    many = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, at_most / n))])
    train = train.where(sampled(F.col("doc_id"), F.element_at(many, F.col("lang")))).select("lang", "text")
    short_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngram_counts(text))
            for lang, found in by.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(sums)], ["lang", "gram", "n"])

    grams = train.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = grams.withColumn("rank", rank).where(F.col("rank") <= profile).collect()  # profile rows a language
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.uint64) for lang, grams in out.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngram_counts(text or "")
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        top = top_ranked(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, top), max(0, len(self.grams) - 1))
        at = np.where(self.grams[at] == top, at, len(self.grams))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1.0 - apart[best] / (self.size * len(top)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs."""
    model = Profiles(profiles)
    short_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), crc_bucket(F.col("doc_id"), 4) == 2
    profiles = fit_profiles(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")
