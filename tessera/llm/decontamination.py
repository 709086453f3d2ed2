"""Benchmark decontamination by greedy string tiling.

Each benchmark item's runs of five tokens are seeds; a document's runs are joined to them by hash. Where a document
shares seeds with an item, tiles are laid over both: running Karp-Rabin hashes find the longest match of unmarked
tokens, it is marked in document and item, and so on down to the seed's length. Tiles never overlap and their order
is free, so reordered passages are caught. A document that covers enough of an item's tokens is contaminated.

The benchmark is the stated query set: it is read in blocks of bounded size, each matched to all documents by a job of
its own, to which it is broadcast and after which it is dropped. What a block's items cover is written as rows of text
digest, item and coverage, which all blocks' rows are joined by.

Tokens are runs of letters and digits of any script, compatibility forms composed, lower-cased; quotes, dashes, spaces and punctuation of every kind part
them. Defined cases: null and empty texts cover nothing; items without
a token are never covered; items with fewer tokens than a seed are matched whole; among items of equal coverage the
smaller item_id is named; repeated rows are judged alike; an empty benchmark leaves all documents clean; extra
columns, whatever their names, are kept by the filter; texts are read whole, however long.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NOT_WORD, Scratch, documents, mix, power_tables, shingles, short_batches, text_digest, word_hashes, wrapped

SEED = 5
THRESHOLD = 0.8
#: Tokens of benchmark items in a block, which is what every task holds at a time.
BLOCK_TOKENS = 1_000_000


def tokens(text: str | None) -> np.ndarray:
    """A hash of each token. Only texts with other than ASCII characters need Unicode's classes."""
    text = text or ""
    if text.isascii():
        return word_hashes(text, NOT_WORD)
    return word_hashes(_NO_TOKEN.sub(" ", unicodedata.normalize("NFKC", text).lower()))


_NO_TOKEN = re.compile(r"[\W_]+")


class Block:
    """A bounded part of the benchmark, with its seeds."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(i, t) for i, t in items if len(t)]
        seeds = [np.unique(shingles(t, SEED)) for _, t in self.items]
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owner = self.seeds[order], owner[order]
        #: Items shorter than a seed are matched by their whole sequence, of each length there is.
        self.lengths = sorted({min(SEED, len(t)) for _, t in self.items})

    def coverages(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item_id, share of its tokens tiled) of each item that shares a seed with the text."""
        if not len(self.seeds) or not text:
            return []
        words = tokens(text)
        shared = np.zeros(len(words), bool)
        owners: set[int] = set()
        for size in self.lengths:
            if size > len(words):
                continue
            found = shingles(words, size)
            at = np.searchsorted(self.seeds, found)
            hits = np.flatnonzero(self.seeds[np.minimum(at, len(self.seeds) - 1)] == found)
            if not len(hits):
                continue
            for j in range(size):
                shared[hits + j] = True
            for seed in np.unique(found[hits]):
                lo, hi = np.searchsorted(self.seeds, seed, "left"), np.searchsorted(self.seeds, seed, "right")
                owners.update(self.owner[lo:hi].tolist())
        if not owners:
            return []
        # Only tokens in shared runs can be tiled; a gap keeps runs apart.
        text_runs = _runs(words, shared)
        out = []
        for k in sorted(owners):
            i, item = self.items[k]
            # Tiles take the first of equal runs, and an item has no room for more tiles than this.
            most = len(item) // min(SEED, len(item))
            out.append((i, tiled_share([run for run, nth in text_runs if nth < most], item)))
        return out


def _runs(words: np.ndarray, shared: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Runs of shared words, each with the number of equal ones before it."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], shared.astype(np.int8), [0]])))
    seen, out = Counter(), []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        run = words[a:b]
        key = run.tobytes()
        out.append((run, seen[key]))
        seen[key] += 1
    return out


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """Running Karp-Rabin hashes of all windows, through prefix sums; equal windows of any two sequences agree."""
    up, down = power_tables(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * down[: len(x)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * up[: len(x) - size + 1])


def tiled_share(text_runs: list[np.ndarray], item: np.ndarray, least: int = SEED) -> float:
    """The share of the item's tokens that greedy tiling marks."""
    least = min(least, len(item))
    free_item = np.ones(len(item), bool)
    free_runs = [np.ones(len(r), bool) for r in text_runs]
    size = min(len(item), max(map(len, text_runs)))
    while size >= least:
        starts: dict[int, list[int]] = {}
        ok = np.flatnonzero(_all_free(free_item, size))
        hashes = _windows(item, size)
        for i in ok:
            starts.setdefault(int(hashes[i]), []).append(int(i))
        if starts:
            wanted = np.array(sorted(starts), np.uint64)
            for run, free in zip(text_runs, free_runs, strict=True):
                if len(run) < size:
                    continue
                theirs = _windows(run, size)
                for j in np.flatnonzero(_all_free(free, size) & np.isin(theirs, wanted)):
                    for i in starts[int(theirs[j])]:
                        # Marked meanwhile, or only the hashes agree: not a tile.
                        if free_item[i : i + size].all() and free[j : j + size].all() and (item[i : i + size] == run[j : j + size]).all():
                            free_item[i : i + size] = False
                            free[j : j + size] = False
                            break
        size -= 1
    return float(1 - free_item.mean())


def _all_free(free: np.ndarray, size: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(free)])
    return sums[size:] - sums[:-size] == size


def blocks(benchmark: DataFrame, most: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The benchmark, a bounded block at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        found = tokens(r["text"])
        if held and size + len(found) > most:
            yield Block(held)
            held, size = [], 0
        held.append((r["item_id"], found))
        size += len(found)
    yield Block(held)


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.0) -> DataFrame:
    """(tid, item_id, coverage) of each text (by its digest) and benchmark item that it covers by at least so much and shares a seed with."""
    spark = docs.sparkSession
    scratch, found = Scratch(spark, "decontamination"), []
    texts = docs.select(text_digest(F.col("text")).alias("tid"), F.col("text").cast("string").alias("text")).where("text is not null")
    short_batches(spark)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for b in batches:
                hits = [(k, i, c) for k, text in enumerate(b.column(1).to_pylist()) for i, c in block.coverages(text) if c >= least]
                at, item, share = zip(*hits, strict=True) if hits else ([], [], [])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["tid", "item_id", "coverage"])

        found.append(scratch.keep(texts.mapInArrow(run, "tid binary, item_id long, coverage double"), "matches", few=True))
        shared.destroy()
    return reduce(DataFrame.unionByName, found).groupBy("tid", "item_id").agg(F.first("coverage").alias("coverage"))  # copies of a text say the same


def measure(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, items covered to the threshold, the item covered most, its coverage, and contaminated, for each row of docs."""
    n = F.count(F.when(F.col("coverage") >= threshold, 1)).alias("n_items")
    best = F.max_by(F.struct("item_id", "coverage"), F.struct("coverage", -F.col("item_id"))).alias("best")
    found = matches(docs, benchmark).where("coverage > 0").groupBy("tid").agg(n, best)
    rows = docs.select(F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("tid")).join(found, "tid", "left")
    n = F.coalesce("n_items", F.lit(0))
    return rows.select("doc_id", n.alias("n_items"), "best.item_id", F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), (n > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, that cover no item to the threshold."""
    gone = matches(docs, benchmark, threshold).select("tid").distinct()
    return wrapped(docs).withColumn("tid", text_digest(F.col("row.text"))).join(gone, "tid", "left_anti").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
