"""Shared plumbing: scratch tables, deterministic samples, batch sizes and vectorised word hashing."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python; texts may be long, so batches stay short.
BATCH_ROWS = 256

#: Bytes of a word up to which a polynomial of its bytes is its hash.
POLYNOMIAL_BYTES = 64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of whole texts can take of a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_roots: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where a local session has set none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/tessera"
    return at.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_roots() -> None:
    """Results are read lazily, so their scratch tables go when the session's program ends."""
    for spark, root in _roots:
        if spark.sparkContext._jsc is not None:
            remove(spark, root)


def text_digest(text: Column) -> Column:
    """A digest of the text, null being the empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def wrapped(docs: DataFrame) -> DataFrame:
    """The rows of docs as one struct row, clear of the names of columns beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _roots.append((spark, self.root))

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        """df written and read again; few writes a few files a core, where rows are short."""
        if few:
            df = df.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        df.write.parquet(at := self.path(name))
        # Shuffle files go when the driver's plans of what is written do: without this, a long job fills executors' disks.
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df: DataFrame) -> None:
        """Remove a kept table whose readers have all finished."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.root.rsplit("/", 1)[1] in folder:
                remove(self.spark, folder)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def sampled(key: Column, share: Column) -> Column:
    """Whether a row is in a sample of about that share of all rows, the same ones each time: those whose keyed hash is small."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 32)) < (share * (1 << 32)).cast("long")


def bounded(df: DataFrame, key: Column, at_most: int, total: int) -> DataFrame:
    """About at_most of total rows."""
    return df if total <= at_most else df.where(sampled(key, F.lit(at_most / total)))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, grown as texts need them."""
    if not _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    value = np.arange(256)
    value[65:91] += 32
    values = mix(value.astype(np.uint64) + np.uint64(77))
    plain = np.ones(256, bool)
    plain[128:] = False
    plain[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return space, values, plain


SPACE, VALUE, NOT_WORD = _byte_tables()


def word_spans(raw: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not gaps."""
    flags = np.ones(len(raw) + 2, np.int8)
    flags[1:-1] = gap[raw]
    edges = np.flatnonzero(np.diff(flags))
    return edges[::2], edges[1::2]


def word_hashes(text: str | None, gap: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; words end at bytes in gap."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return span_hashes(raw, *word_spans(raw, gap))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUE[raw] * down[: len(raw)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))
    # There are long words that any such polynomial takes for one another; these get a cryptographic hash.
    for k in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES):
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes().lower(), digest_size=8).digest(), "little")
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total = (total + words[j : j + len(total)]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(total + np.uint64(n))
