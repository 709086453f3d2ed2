"""Token counts through a digest cache.

Each text is identified by the SHA-256 digest of its normalised content (null reads as the empty text; nothing
else may be normalised away, as the tokenizer sees every byte) and the digest of the tokenizer's file. Counts that
the cache holds are joined; each distinct missing content is encoded once and its count appended to the cache.

Defined cases: null and empty texts have 0 tokens; repeated rows are encoded once and all returned; a digest that was
appended twice (by two jobs at once, or one that was run again) counts once; an empty table gives an empty result;
extra columns are ignored; very long texts are encoded whole. Rows of a repeated content that holds more than one in
SHARE of all rows, of which there are under SHARE, get its count from a broadcast and are dealt by their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents, short_batches

LIMIT = 4096
#: A content of more than one in so many rows is hot.
SHARE = 10_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a list of texts to their token counts, for a .model or .json file."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(path)
    words.no_truncation()
    words.no_padding()
    return lambda texts: [len(x.ids) for x in words.encode_batch(texts, add_special_tokens=False)]


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def encode_misses(docs: DataFrame, cache: str, tokenizer: str) -> None:
    """Append the counts of distinct contents that the cache lacks for this tokenizer version."""
    spark, version = docs.sparkSession, version_of(tokenizer)
    distinct = with_digest(docs).select("digest", "text").dropDuplicates(["digest"])
    known = read_cache(spark, cache)
    if known is not None:
        distinct = distinct.join(known.where(F.col("version") == version).select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer)
        for b in batches:
            counts = count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    short_batches(spark)
    distinct.mapInArrow(encode, "digest binary, version string, n_tokens long").write.mode("append").parquet(cache)


def read_cache(spark: SparkSession, cache: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("digest binary, version string, n_tokens long").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over the limit, for each row of docs."""
    encode_misses(docs, cache, tokenizer)
    stored = read_cache(docs.sparkSession, cache).where(F.col("version") == version_of(tokenizer)).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    rows = with_digest(docs).select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies")).where((F.col("copies") > 1) & (F.col("copies") * SHARE > docs.count()))
    hot = copies.join(stored, "digest").select("digest", F.col("n_tokens").alias("hot_tokens"))
    dealt = rows.join(F.broadcast(hot), "digest", "left")
    # A hot row's key goes on with its id, so it equals no stored digest and its content's rows spread over all tasks.
    spread = F.concat("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    dealt = dealt.withColumn("key", F.when(F.col("hot_tokens").isNull(), F.col("digest")).otherwise(spread))
    found = dealt.join(stored.withColumnRenamed("digest", "key"), "key", "left").withColumn("n_tokens", F.coalesce("hot_tokens", "n_tokens"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = Scratch(spark, "token-cache").path("counts")
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), cache)
